"""Operators for large training-data pipelines (one module per operator).

Nothing else in the library imports this subpackage; ``queries.py`` holds the
registered queries and their SQL.
"""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
