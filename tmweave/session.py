"""Session helpers: building a local session and locating shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "tmweave",
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library assumes (AQE on, UTC, no UI)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Text work after a shuffle (embedding, parsing, block products) is CPU-heavy
        # per byte: let AQE keep small post-shuffle partitions instead of merging
        # them into one task.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext of a classic session (None for a Connect session)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        return None


def _is_local(spark: SparkSession) -> bool:
    sc = _context(spark)
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    return master.startswith("local")


def parallelism(spark: SparkSession) -> int:
    """Cores available to the session's jobs."""
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.default.parallelism", "8"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be configured (it has to be reachable from every
    executor).  Only a local-mode session without one gets a private folder, as in
    tests.
    """
    sc = _context(spark)
    path = spark.conf.get(CHECKPOINT_CONF, None) or (sc.getCheckpointDir() if sc else None)
    if not path:
        if not _is_local(spark):
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is not set; point it at shared storage (HDFS, object store)")
        path = tempfile.mkdtemp(prefix="tmweave-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if base.startswith("file:"):
        base = base[len("file:"):]
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    if "://" not in path:
        os.makedirs(path, exist_ok=True)
    return path


def materialize(df, name: str):
    """Write ``df`` as a parquet table under the shared checkpoint folder and
    read it back: the lineage is cut, generated ids are fixed, and the data
    survives the loss of any executor.

    Nothing reads the write's shuffle files once the table is there; they are removed at its end,
    not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)
    out = spark.read.parquet(path)
    out._scratch = path
    return out


def discard(df) -> None:
    """Delete the table that ``materialize`` returned as ``df``, which nothing may read any more.
    A Connect session leaves it to the folder's retention policy."""
    spark, path = df.sparkSession, getattr(df, "_scratch", None)
    if path is None or _context(spark) is None:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ship_package(spark: SparkSession) -> str:
    """Zip this package on the driver and add it to the executors' Python path
    (``addPyFile`` serves it from there), the usual way to deploy library code to a
    cluster.  Functions are also pickled by value, so this is needed only
    for code that imports the package on executors by name."""
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tmweave-pyfiles-"), "tmweave.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc = _context(spark)
    if sc is None:
        spark.addArtifacts(archive, pyfile=True)
    else:
        sc.addPyFile(archive)
    return archive
