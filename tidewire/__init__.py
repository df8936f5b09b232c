"""tidewire: information dynamics of multivariate time series, and corpus preparation, on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so that no copy of the package has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
