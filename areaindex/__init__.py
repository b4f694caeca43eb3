"""Small-area composite indicators as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel by value, so a cluster needs no copy of the package on its machines
cloudpickle.register_pickle_by_value(sys.modules[__name__])
