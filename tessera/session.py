"""Session construction with the settings the engine's semantics rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings that results depend on: two's-complement wrap and NULL instead of errors, and UTC timestamps.
SEMANTIC_CONF = {"spark.sql.ansi.enabled": "false", "spark.sql.session.timeZone": "UTC"}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for scripts, benches and tests; on a cluster pass ``master`` and sizes of your own."""
    builder = SparkSession.builder.master(master).appName("tessera")
    settings = {
        **SEMANTIC_CONF,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_semantics(spark: SparkSession) -> SparkSession:
    """Set the settings that results depend on in a session made elsewhere."""
    for key, value in SEMANTIC_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_path(spark: SparkSession) -> str:
    """A new folder name that all tasks can reach, under spark.checkpoint.dir; on one machine alone a temporary one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
