"""tessera: time-series and text DataFrame operators for market and news data on Spark.

Every operator is a plain function ``DataFrame -> DataFrame`` or ``Column -> Column``;
chain them with ``DataFrame.transform``.  Rows are keyed by ticker (``tic``) and ordered
by ``date`` (or ``ts``) unless a function says otherwise.
"""

from tessera.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
