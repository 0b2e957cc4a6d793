"""Corpus and code-health analytics expressed as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# functions sent to executors travel whole, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
