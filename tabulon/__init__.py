"""tabulon — Spark-native tabular profiling, cleaning, feature engineering and modelling.

Every operator is a lazy ``DataFrame -> DataFrame`` function or a ``pyspark.ml``
Estimator/Transformer.  Statistics over many columns are folded into one
aggregation pass; fitted state (limits, levels, means) is a small table that is
attached back by join (AQE decides broadcast from the measured size).
"""

from tabulon.session import get_spark, ensure_checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "ensure_checkpoint_dir"]
