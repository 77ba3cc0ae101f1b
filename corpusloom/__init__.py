"""A Spark engine for preparing, searching and evaluating text corpora."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value: a cluster needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
