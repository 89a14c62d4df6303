"""A PySpark-native gradient-boosting engine: every step is a DataFrame operator.

Functions of this package that run on executors travel with the job, so that executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
