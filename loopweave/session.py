"""Session set-up and the settings that every plan of this package relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: Settings that fix results (time zone) or keep plans adaptive. Sizes of memory are left to whoever submits the job.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "loopweave", **conf: str) -> SparkSession:
    """A session with :data:`SETTINGS`; ``conf`` wins over them (``_`` in a key stands for a dot)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | {k.replace("_", "."): str(v) for k, v in conf.items()}).items():
        b = b.config(k, v)
    return visible(b.getOrCreate())


def visible(spark: SparkSession) -> SparkSession:
    """``spark`` with this package's folder on the path of its Python workers, for a checkout that isn't installed.

    Machines that don't share the folder need the package installed, as any other.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir``, else (tests only) one made here.

    A lineage cut must survive the loss of an executor, so it goes to the folder that all executors share.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        where = set_dir
    else:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "loopweave-checkpoints")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where
