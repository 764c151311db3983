"""A Spark-native engine that analyses codebases as tables."""

import sys

from pyspark import cloudpickle

# Python workers get functions of this package with their code, so it needs no installation on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
