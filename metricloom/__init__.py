"""Named, traceable measurements over Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get the functions themselves, so they need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
