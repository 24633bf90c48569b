"""farpoint: spherical pair-search analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions that tasks run travel with their tasks, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
