"""Session settings every public entry relies on.

The driver hands us its own session, so each public entry calls
``prepare(spark)`` first: timestamps are read and bucketed in UTC, JSON with
duplicate keys keeps the last value (as a JavaScript ``JSON.parse`` does) and
constraint propagation is off (see below).
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # An offset is a caller's number: beyond this many rows a page comes from a
    # distributed sort, not from a heap of offset + limit rows in every task.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
    # Decoded keys are long expressions over hex strings. Constraint
    # propagation would copy them into inferred IS NOT NULL filters, push
    # those below exchanges (evaluating the decoders twice) and spend seconds
    # planning; no scan column benefits from the inferred filters here.
    "spark.sql.constraintPropagation.enabled": "false",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in _REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is used as
    is. Where it is unset a local session gets a scratch folder of its own;
    on a cluster that is an error, as executors do not share local folders.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
        sc.setCheckpointDir(current)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def local_session(app: str = "ledgerlens", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests, the bench and the CLI (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="ledgerlens-wh-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
