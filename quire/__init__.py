"""quire: document, layout and hypergraph analytics expressed as Spark DataFrames.

Python kernels used inside Spark are shipped by value, so executors need
pandas, numpy and pyarrow but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
