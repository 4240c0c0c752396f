"""Operators for preparing language-model training data, their queries and SQL.

Functions that run on executors travel with their code, so the package need not be
installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
