"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job here relies on. AQE re-plans joins and coalesces small
# shuffles at runtime; skew-join splitting covers hot keys (one sample id,
# dataset or pair key holding a large share of rows).
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(
    master: str | None = None,
    app_name: str = "auditframe",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the engine's settings.

    ``master`` defaults to ``$AUDITFRAME_MASTER`` or ``local[8]``; on a
    cluster pass nothing and let spark-submit decide.
    """
    builder = SparkSession.builder.appName(app_name)
    master = master or os.environ.get("AUDITFRAME_MASTER")
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    # Local mode runs every task inside the driver JVM; on a cluster the
    # submit-time setting wins because the JVM already exists.
    conf.setdefault("spark.driver.memory", os.environ.get("AUDITFRAME_DRIVER_MEMORY", "16g"))
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` names a shared file system and is never replaced.
    Only a local session (``local[...]``: one machine) gets a scratch folder
    where it is unset; on a cluster an unset folder is an error, because a
    machine-local one would lose the other executors' parts.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        current = given.get() if given.isDefined() else None
    if not current:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="auditframe-ckpt-", dir=spark.conf.get("spark.local.dir", None))
        spark.conf.set("spark.checkpoint.dir", current)
    return current


_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that Python
    functions import there whatever folder the workers start in."""
    sc = spark.sparkContext
    if getattr(sc, "_auditframe_shipped", False):
        return
    out = os.path.join(tempfile.mkdtemp(prefix="auditframe-ship-"), "auditframe_src.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
    sc.addPyFile(out)
    sc._auditframe_shipped = True


_SCOPES: list[list[str]] = []


def track(path: str) -> None:
    """Leave a written folder to the innermost open ``lineage_scope``."""
    if _SCOPES:
        _SCOPES[-1].append(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file beside ``path`` and move it there: a reader sees the
    old text, none for a moment, or the new one, never a part."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    final, temporary = p(path), p(f"{path}.{uuid.uuid4().hex}")
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(final, False)
    if not fs.rename(temporary, final):
        raise OSError(f"{path} could not be put in place")


@contextmanager
def lineage_scope(spark: SparkSession):
    """Intermediate tables written inside the block go when it ends (those of
    this block only): write the results inside, use nothing lazy after it."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete_path(spark, path)


def cut_lineage(df):
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder
    and read it back.

    Same guarantee as a reliable checkpoint (never a local one): downstream
    reads see one fixed copy, and a lost executor never forces the upstream
    stages (row checks, model calls) to run again. Unlike
    ``Dataset.checkpoint`` on an unpersisted plan, the rows are computed once
    (one write job), and the copy is columnar and compressed. The table lives
    until the ``lineage_scope`` it was written in ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/auditframe-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    track(path)
    return spark.read.schema(df.schema).parquet(path)
