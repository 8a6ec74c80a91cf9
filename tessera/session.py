"""Session defaults, and the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[1])
MOST_BROADCAST_ROWS = 200_000
ARROW_BYTES = 4 << 20
#: Tables of blobs: by default, a writer looks at the size of a page or row group after 100 rows only, and holds 128 MB of each file.
SMALL_PAGES = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}
_scopes: list[list[str]] = []


def session(master: str = "local[8]", shuffle_partitions: int = 8, name: str = "tessera") -> SparkSession:
    return (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.timestampType", "TIMESTAMP_NTZ")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (on a cluster: --py-files), and get rows in
    batches of some ARROW_BYTES: the default lets a task hold 64 MB of texts or blobs several times over. A task has one
    thread for products of matrices."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, None) or ARROW_BYTES + 1) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))
    env = spark.sparkContext.environment
    env.setdefault("OPENBLAS_NUM_THREADS", "1")
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder is made only where none is set on a local master (tests)."""
    conf, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if context.getCheckpointDir() is None:
        if conf is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(conf or tempfile.mkdtemp(prefix="shared-"))
    return conf or context.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends here and no executor's loss matters."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.options(**SMALL_PAGES).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_in = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is stored inside is deleted at the end, but for the stored tables given to the function that this yields.

    Those belong to the enclosing scratch, if there is one. Whatever is returned must read from kept tables only.
    """
    own: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        own.remove(df.stored_in)
        if len(_scopes) > 1:
            _scopes[-2].append(df.stored_in)
        return df

    _scopes.append(own)
    try:
        yield keep
    finally:
        _scopes.remove(own)
        for path in own:
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number in the new column name for each row that stays the same however often it is read: made of the file's
    rank and the row's place in it if df is a plain scan of Parquet files, else stored with the rows."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or not df.inputFiles():
        return stored(df.select(*columns, F.monotonically_increasing_id().alias(name)), "numbered")
    path, (file, place, rank, ranked) = F.col("_metadata.file_path"), (free_name(df, x) for x in ("file_name", "row_place", "file_rank", "ranked_file"))
    files = df.select(path.alias("file")).distinct().toArrow()["file"].to_pylist()  # a row for each file
    ranks = df.sparkSession.createDataFrame(pa.table({rank: pa.array(range(len(files)), pa.int64()), ranked: pa.array(sorted(files), pa.string())}))
    placed = df.select(*columns, path.alias(file), F.col("_metadata.row_index").alias(place))
    joined = placed.join(F.broadcast(ranks) if len(files) <= MOST_BROADCAST_ROWS else ranks, F.col(file) == F.col(ranked))
    return joined.select(*columns, (F.shiftleft(F.col(rank), 40) + F.col(place)).alias(name))
