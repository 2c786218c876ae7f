"""Named queries over the tables of a scale directory, and their SQL twins."""
