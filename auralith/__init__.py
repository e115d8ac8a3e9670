"""auralith: speech/text corpus curation and scoring as Spark DataFrame operators.

Every public operator is either ``Column -> Column`` (``auralith.functions``) or
``DataFrame -> DataFrame`` (``auralith.operators``); sources and sinks live in
``auralith.sources``, incremental variants in ``auralith.streaming`` and the
registered queries over the driver tables in ``auralith.plans``.
"""

__all__ = ["functions", "operators", "sources", "plans", "streaming", "session"]


def _pickle_by_value() -> None:
    """Ship this package's functions to Python workers by value, so executors do not need it installed."""
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: workers then import the package normally
        pass


_pickle_by_value()
