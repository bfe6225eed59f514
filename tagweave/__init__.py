"""tagweave: entity-labelled corpus building and scoring on Spark DataFrames.

Every operator is a function from DataFrame(s) to a DataFrame.  Operators
never collect data to the driver; the only driver-side work is reading
column names and session settings.
"""

__version__ = "0.1.0"

# Functions of this package that run inside Python workers (Arrow UDFs,
# mapInPandas bodies) are pickled by value, so executors do not need the
# package on their path.  Shipping it with --py-files works as well.
try:  # pragma: no cover - depends on the installed PySpark
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
