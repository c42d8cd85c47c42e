"""evalspark: evaluation-data operators on Spark DataFrames."""

from __future__ import annotations

import sys as _sys

# Python code that runs inside Spark tasks (mapInPandas functions, generator
# factories) is shipped with the task by value, so executors need no copy of
# this package on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # older cloudpickle: must be installed
    pass
