"""Spark-native analytics over descriptions, dictionaries, events and training data."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers carry their code with them: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
