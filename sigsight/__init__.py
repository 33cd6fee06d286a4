"""sigsight — operational-signal retrieval and evaluation as Spark DataFrame jobs."""

import sys as _sys

try:  # ship this package's code inside UDF closures, so executors need no install
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__version__ = "0.1.0"
