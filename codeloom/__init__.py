"""A Spark-native repository intelligence engine: source trees as tables, questions as DataFrames.

Functions shipped to Python workers are pickled by value, so executors need no
copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
