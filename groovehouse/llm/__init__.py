"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage.  The Python parts of the
operators are pickled by value, so executors run them without the package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
