"""Session settings and fault-tolerant staging of intermediate tables.

Nothing here changes a session that was handed in, but for :func:`small_methods`, which a program calls on its own;
:func:`build_session` makes one with the settings that fit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# One generated method over a hundred feature formulas is beyond what the JVM compiles to machine code (8000 bytes),
# and would run interpreted; below this limit Spark generates many small methods instead.
METHOD_LIMIT, COMPILED_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"

_made: ContextVar[list[str] | None] = ContextVar("staged_paths", default=None)


def build_session(app: str = "starloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package is tuned for; cluster settings are left alone."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Call sites in error messages cost several JVM calls per Column; wide feature plans have thousands.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config(METHOD_LIMIT, COMPILED_BYTES)
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def small_methods(spark: SparkSession) -> None:
    """Hold a running session to generated methods that the JVM compiles, unless its limit is lower already."""
    if int(spark.conf.get(METHOD_LIMIT)) > int(COMPILED_BYTES):
        spark.conf.set(METHOD_LIMIT, COMPILED_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the warehouse where that is unset.

    Raises where neither is set on a cluster: the default warehouse is a folder of the driver's own disk.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and (warehouse.startswith("file:") or ":" not in warehouse):
        raise ValueError(f"set spark.checkpoint.dir to a shared folder; the warehouse {warehouse} is on a machine's own disk")
    return f"{warehouse}/staging"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of its own below :func:`shared_folder`."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, so results must be written or collected before."""
    paths: list[str] = []
    token = _made.set(paths)
    try:
        yield
    finally:
        _made.reset(token)
        for path in paths:
            remove(spark, path)


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as parquet below the shared folder, with the writer's ``options``, and read it back.

    This cuts the lineage at a table that outlives executors, and gives the planner real sizes.  Wrap a job in
    :func:`temporary_tables` to have its tables removed.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    made = _made.get()
    if made is not None:
        made.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """Like :func:`stage`, for a wide table that is joined by ``key`` several times: it is dealt into ``buckets`` by the key
    once, and joins of the table read them without a shuffle.  The session's catalog gets an entry, which needs no files.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    made = _made.get()
    if made is not None:
        made.append(path)
    name = f"starloom_{label}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)
