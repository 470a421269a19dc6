"""Operators for preparing language-model training data. Nothing else in the library imports this subpackage."""
from __future__ import annotations

import sys

from pyspark import cloudpickle

# Executors get this code inside the functions that use it and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
