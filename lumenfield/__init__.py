"""Graph smoothing and regression on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions for Python workers travel by value: executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
