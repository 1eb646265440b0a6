"""SparkSession defaults shared by the library, tests and the bench.

The library never creates a session on its own inside an operator; callers
pass one in.  ``get_session`` is a convenience for scripts and tests.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every operator relies on for its semantics (not for speed):
#  * UTC session time zone: year()/to_date() of timestamps must not depend on
#    the host zone.
#  * ANSI mode stays on: hard casts raise, safe casts go through try_* helpers.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Execution settings.  AQE re-plans joins from runtime sizes, coalesces small
# shuffle partitions and splits skewed ones.
EXECUTION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "overmark") -> SparkSession:
    master = master or os.environ.get("OVERMARK_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app_name)
    for k, v in {**SEMANTIC_CONF, **EXECUTION_CONF}.items():
        builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("OVERMARK_DRIVER_MEM", "16g"))
    if master.startswith("local"):
        # local runs: catalog tables go to a fresh folder, not the working dir
        builder = builder.config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="overmark-wh-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_semantics(spark)
    return spark


def apply_semantics(spark: SparkSession) -> None:
    """Pin the settings the operators' results depend on (idempotent)."""
    for k, v in SEMANTIC_CONF.items():
        spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and materialised tables.

    On a cluster this is the folder the deployment names in
    ``spark.checkpoint.dir``; without one, jobs there cannot share files, so
    this raises.  Only a local master (tests, scripts) gets a fresh folder
    under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="overmark-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex}"
