"""Daily market bars on Spark: land, clean, validate, derive features, split, model, score."""

import sys

from pyspark import cloudpickle

# Functions run in Python workers travel with their code: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
