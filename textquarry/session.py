"""Session defaults and tables kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

from textquarry.errors import InvalidInput

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []
_paths: dict[int, str] = {}  # of tables written, by their identity


def build_session(name: str = "textquarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow transfer and UTC; conf overrides."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def spread(table: DataFrame) -> DataFrame:
    """A table as it was read, in as many parts as there are cores if it has fewer: a file of one row group would
    otherwise be tokenized by one task. Tables with more parts are not moved."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a master on this machine alone (as in tests)
    gets a temporary folder, once; on any other it is an error, as no executor would see such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
        if not folder:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise InvalidInput(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
            # The setting cannot change while a session runs, so the folder goes to its context.
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="textquarry-"))
            folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/textquarry/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and lost executors cost nothing. The
    shuffle files that the write needed are removed as soon as it is done."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[id(table)] = path
    weakref.finalize(table, _paths.pop, id(table), None)
    return table


def drop_table(table: DataFrame) -> None:
    """Remove the files of a table that `materialize` gave, once nothing reads it any more."""
    path = _paths.pop(id(table), None)
    if path:
        _written[:] = [w for w in _written if w[1] != path]
        _remove(table.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_written() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone; the folder belongs to the cluster
            return
