"""Operators that clean, check, split and mix text for language-model training."""
