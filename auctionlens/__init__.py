"""Advertising-log analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with the plan, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
