"""Operators for preparing language-model training data, and their registered queries."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with them, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
