"""Session construction and the settings every plan of the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC makes timestamps comparable across engines; AQE re-plans joins and splits skewed partitions at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # A task has one core; matrix products in its Python worker keep to it.
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
}


def get_session(app: str = "skein", master: str | None = None, **conf: str) -> SparkSession:
    """The active session, or a new one with DEFAULTS and conf. master: left to spark-submit where None."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
