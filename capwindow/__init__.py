"""Spark-native analytics over ordered logs of frequency-capping counters."""

import sys

from pyspark import cloudpickle

# Workers get the code of Python operators with the plan, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
