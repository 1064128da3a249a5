"""Session helpers: a tuned local session, the shared scratch folder, lineage cuts."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_COPIES: dict[int, list[str]] = {}      # by thread: the folders of the job that runs in it


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, name: str = "factloom") -> SparkSession:
    """A session for tests and benches. On a cluster the session comes from the submitter."""
    return (SparkSession.builder.master(f"local[{cores}]").appName(name)
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`.

    Only where the setting is absent and the session is local is a temporary
    folder used; a cluster without the setting is an error, because a folder of
    one machine would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if configured:
        if current.isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    if not current.isEmpty():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; inside `working_copies` it is deleted at the end."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    held = _COPIES.get(threading.get_ident())
    if held is not None:
        held.append(path)
    return path


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back.

    Loops neither re-run nor grow their plan, a lost executor costs no recomputation of what
    came before, and unlike a checkpoint the copy is compressed, pruned by column and has
    a known size for the joins that follow. A job that stores its results inside `working_copies`
    leaves none behind.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def working_copies(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the folders that were made inside. The results must be stored by then.

    Every thread has its own list, so jobs that run at once leave each other's copies alone.
    """
    here = threading.get_ident()
    outer, _COPIES[here] = _COPIES.get(here), []
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name in _COPIES.pop(here):
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        if outer is not None:
            _COPIES[here] = outer
