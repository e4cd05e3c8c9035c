"""Shared plumbing: shared-folder scratch tables, Arrow batch bounds, row keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_CHECKPOINTS = "/tmp/checkpoints"

#: Arrow batches handed to Python stay under these, whatever a row holds.
BATCH_ROWS = 1000
BATCH_BYTES = "4m"

#: Spark's switch that deletes a query's shuffle files when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Keys with more than one in so many rows are joined without a shuffle.
HEAVY = 4096
#: Narrow facts of so many rows (16 MB at 250 bytes) may be broadcast whole.
BROADCAST_ROWS = 1 << 16

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a local folder; any other one raises,
    as its executors would each write to a disk of their own."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = LOCAL_CHECKPOINTS
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run here go as each ends, the caller's setting
    comes back. Else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, name: str, rows_in_group: int | None = None) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: lineage ends there, and
    nothing of its shuffles stays on the disks.

    A task holds up to 4096 rows of a file's row group at once, in writing and in
    reading; ``rows_in_group`` bounds that where a row takes megabytes."""
    spark = df.sparkSession
    path = scratch(spark, name)
    groups = {"parquet.block.row.count.limit": str(rows_in_group)} if rows_in_group else {}
    with _shuffles_deleted(spark):
        df.write.options(**groups).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def meet(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) joined with ``facts``, narrow and one row of
    each key, whose column ``count`` tells how many ``rows`` have it.

    ``total`` may be an upper bound. Facts are no more than the rows, so up to
    BROADCAST_ROWS of these they are broadcast. Beyond, the keys with more than
    1/HEAVY of all rows are fewer than HEAVY: their facts are broadcast, so their
    rows need not meet in one task; the others are shuffled."""
    if total <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts), key)
    heavy = F.col(count) * HEAVY > total
    hot = facts.where(heavy)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(facts.where(~heavy), key))


def look_up(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """``meet`` for facts that don't tell how many ``rows`` have their key."""
    count = fresh([*rows.columns, *facts.columns], "_count")
    counted = rows.groupBy(key).agg(F.count("*").alias(count)).join(facts, key)
    return meet(rows, counted, key, count, total).drop(count)


def fresh(taken: list[str], name: str) -> str:
    """A column name like ``name`` that none of these has, in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch bounds to ours.

    Spark reads them when a plan runs, which is after this library returns its
    frame, so they can't be put back here; a smaller bound of the caller stays."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def arrow_column(
    spark: SparkSession,
    fn: Callable[[Iterator], Iterator[pa.Array]],
    schema: str,
    *columns: Column,
) -> Column:
    """One column that ``fn`` makes of batches of ``columns``, evaluated once.

    Only these columns go to Python, and only its result comes back."""
    bound_batches(spark)
    given = Iterator[pa.Array] if len(columns) == 1 else Iterator[tuple[pa.Array, ...]]

    def run(batches: given) -> Iterator[pa.Array]:
        return fn(batches)

    run.__annotations__ = {"batches": given, "return": Iterator[pa.Array]}
    return F.arrow_udf(run, schema).asNondeterministic()(*columns)


def struct_array(fields: dict[str, pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(fields.values()), list(fields))


def map_arrow(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    bound_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; fold 2 is held out of training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A local relation of constants: its size is known and no Python runs."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
