"""Training-data operators: ten components and the queries that apply them.

Nothing else in the library imports this subpackage. Its functions travel to Python
workers by value, so executors need no installed copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
