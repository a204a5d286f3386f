"""Session helpers and durable intermediate tables.

Intermediate results that cut lineage are written as Parquet below the folder named by
``spark.checkpoint.dir`` (shared by all executors, so the loss of one costs nothing). Where that
setting is absent a local session gets a folder of its own, removed at its end; a cluster gets an error, as a
folder of one machine can't be read by the others.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "storyflow", master: str | None = None, shared: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC, AQE and Arrow. ``shared`` is the folder all executors can reach."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | ({"spark.checkpoint.dir": shared} if shared else {})
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for durable intermediate tables, shared by the whole cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get().rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="storyflow-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/storyflow/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a shared Parquet table and return a scan of it.

    Unlike ``checkpoint()`` the plan runs a single time and later readers still prune columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def superseded(df: DataFrame) -> None:
    """Delete the table behind a result of ``materialize`` that nothing reads any more (a round that the next replaced)."""
    path = getattr(df, "_scratch", None)
    if isinstance(path, str):
        remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no open DataFrame reads any more."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small text file of the shared folder (pointers and manifests)."""
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file of the shared folder, None where there is none."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()
