"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

#: Bytes of an Arrow batch between executor and worker; rows alone do not bound it, as texts differ in length.
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Workers give freed arrays back to the system rather than keep them for the next stage.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}


def workers_find_package(spark: SparkSession) -> SparkSession:
    """Put this package's folder on the Python path of the workers, for runs where it isn't installed on them,
    and bound what workers hold: Arrow batches by bytes (a setting of the session's own stays), freed memory."""
    env = spark.sparkContext.environment
    for k, v in WORKER_MEMORY.items():
        env.setdefault(k, v)
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, (ROOT, env.get("PYTHONPATH", ""))))
    return spark
