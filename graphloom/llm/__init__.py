"""Operators for preparing language-model training data; nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Python workers get these functions with their code, so the package needs no installation on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
