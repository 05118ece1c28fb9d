"""ledgerlens: entity-risk analytics expressed as Spark DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` function (or returns a
small DataFrame of statistics).  Nothing row-scale is collected to the driver:
only fitted statistics (quantiles, vocabularies, model coefficients) are.
"""

from ledgerlens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
