"""PySpark-native engine for published notices: sources, extraction, merging, monitoring and digests."""

import sys

from pyspark import cloudpickle

# Python workers get the functions they run by value: nothing has to be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
