"""cohortspark: longitudinal population analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# executors need no copy of the package: what their Python functions use travels with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])
