"""Time-series preparation, analysis and forecasting for many series at once, on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so the package need only be
# installed where the driver runs.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
