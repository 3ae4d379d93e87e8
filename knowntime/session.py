"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "knowntime", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library relies on (UTC, AQE, skew joins)."""
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.ui.enabled", "false"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared scratch folder (``spark.checkpoint.dir``).

    A session on one machine (master ``local``) that names none gets a temporary folder, which is then
    remembered in the session so that every later caller shares it. On a cluster that would be a different
    folder on every machine, so a session without the setting is refused there.
    """
    root = (spark.conf.get("spark.checkpoint.dir", None)
            or spark.sparkContext.getConf().get("spark.checkpoint.dir")
            or spark.conf.get("spark.knowntime.localScratch", None))
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.knowntime.localScratch", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared scratch folder, never reused by another run."""
    return f"{scratch_root(spark).rstrip('/')}/knowntime/{name}-{uuid.uuid4().hex}"
