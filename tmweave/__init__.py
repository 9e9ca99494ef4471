"""tmweave: retrieval-augmented document translation as Spark DataFrame jobs.

Every operator takes and returns DataFrames; the heavy lifting (joins, grouping,
windows, streaming state) runs inside Spark.  Python code on executors is limited
to Arrow-batched functions for the blocked similarity search, the hashing embedder
and caller-supplied model plug-ins.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so closures sent to executors
    (pandas functions, plug-ins) do not need the package installed there."""
    import sys

    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - fall back to by-reference pickling
        pass


_ship_by_value()
