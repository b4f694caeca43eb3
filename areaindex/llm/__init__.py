"""Operators for preparing training data at corpus scale, and their registered queries.

Functions of this subpackage travel to executors by value, so a cluster needs
no copy of it on its machines.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
