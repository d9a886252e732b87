"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Worker functions are
pickled by value, so executors need only the third-party packages, not this
repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
