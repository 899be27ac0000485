"""Link frontier, document catalogue and raw-record files for a web corpus, on Spark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python workers get the library's functions by value, so executors need not have it installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
