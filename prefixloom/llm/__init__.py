"""Operators for preparing training corpora at scale.

Nothing else in the library imports this subpackage.  Its functions are
shipped to the executors by value, so that a worker needs no copy of the
repository on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
