"""gleaner: topical web-text analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions sent to Python workers travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
