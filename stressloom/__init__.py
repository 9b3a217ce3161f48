"""stressloom: composite stress indices over panels of time series, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Small helpers that run inside tasks travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
