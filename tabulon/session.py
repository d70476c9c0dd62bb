"""Session construction for tests and the bench, and checkpoint-dir handling."""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

ARROW_BATCH_BYTES = 8 << 20


def get_spark(master: str | None = None, app: str = "tabulon",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session used by tests and bench.py (a cluster brings its own)."""
    cpus = os.environ.get("BENCH_CPUS", "*")
    parts = shuffle_partitions or int(os.environ.get("TABULON_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TABULON_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory named by the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Only a local-mode
    session (tests, bench) without one gets a scratch folder of its own; on a
    cluster a missing setting is an error, because a machine-local folder does
    not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return conf
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...)")
    path = tempfile.mkdtemp(prefix="tabulon-ckpt-")
    sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate files under the shared checkpoint directory."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tabulon-scratch/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, as tasks with functions of its modules must, and pass rows to them in
    Arrow batches of ``ARROW_BATCH_BYTES`` at most (a smaller setting of the session stays).

    Nothing is done if the workers' ``PYTHONPATH`` names the folder already.  In
    local mode the folder is added to it; on a cluster the package is sent once
    with ``addPyFile``.
    """
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m").lower().rstrip("b")
    if size.isdigit() and int(size) > ARROW_BATCH_BYTES or size.endswith(("m", "g")):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [p for p in (os.environ.get("PYTHONPATH", ""), sc.environment.get("PYTHONPATH", "")) if p]
    if any(os.path.realpath(p) == os.path.realpath(root) for p in ":".join(known).split(":") if p):
        return
    if re.match(r"local(\[|$)", sc.master):
        sc.environment["PYTHONPATH"] = ":".join([root, *known[1:]])
    elif not getattr(sc, "_tabulon_sent", False):
        folder = os.path.realpath(tempfile.mkdtemp(prefix="tabulon-"))  # the driver serves it from here
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "tabulon"), "zip", root, "tabulon"))
        sc._tabulon_sent = True
