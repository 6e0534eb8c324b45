"""finch: a Spark engine for text corpora, retrieval, prompts and card transactions."""

import sys as _sys

__version__ = "0.1.0"

# Functions that run inside Python workers (mapInArrow / pandas UDFs) are
# shipped by value, so executors need numpy/pandas/pyarrow but not this
# package on their path.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to shipping the package by path
    pass
