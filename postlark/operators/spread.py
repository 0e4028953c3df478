"""Joins, numbering and lineage cuts that hold when a single key owns a large share of the rows."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER_BLOCK = 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A local folder is used only by a local master that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="postlark-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


_CUTS: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor loses nothing.

    The table goes when the ``scratch`` it was cut in ends, else with the application.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder, files = _folder(spark, path)
    files.deleteOnExit(folder)
    _CUTS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    folder, files = _folder(spark, path)
    return files.exists(folder)


def folders(spark: SparkSession, pattern: str, levels: int = 1) -> list[str]:
    """The folders that match a path pattern, each by its last ``levels`` names."""
    folder, files = _folder(spark, pattern)
    return ["/".join(f.getPath().toString().rsplit("/", levels)[1:]) for f in files.globStatus(folder) or []]


@contextmanager
def scratch(spark: SparkSession):
    """Remove the tables cut inside once the block is done: for jobs whose results are written by then."""
    first = len(_CUTS)
    try:
        yield
    finally:
        for path in _CUTS[first:]:
            folder, files = _folder(spark, path)
            files.delete(folder, True)
        del _CUTS[first:]


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A filter on a plain computed column is pushed below its projection and computes it a second time; for scores over
    long texts that doubles the work. As the output of a one-row generator the values are read instead.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def attach(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` to a table with one row per key.

    A key may own a third of the rows: the rows are the outer side of a plain join, which Spark cuts into parts at run
    time (``spark.sql.adaptive.skewJoin``). Where a grouping by the same key would follow, ``cut`` has to come between,
    because a grouping keeps the join's partitions together.
    """
    return rows.join(table, key, "left").select(*rows.columns, *[c for c in table.columns if c != key])


def sequenced(rows: DataFrame, order_by: list[str | Column], name: str = "seq") -> DataFrame:
    """Add a unique whole number that grows in the given global order, and cut the lineage.

    Rows are range-partitioned and sorted inside partitions, so partition number plus position is the order. The
    numbers are written with the rows, hence stable; they have gaps between partitions.
    """
    ordered = rows.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    return cut(ordered.withColumn(name, F.monotonically_increasing_id()))


def numbered(rows: DataFrame, order_by: list[str | Column], name: str = "rank") -> DataFrame:
    """Add a dense 1-based number in global order, without moving everything to one task."""
    return dense_rank_of(sequenced(rows, order_by, "_seq"), "_seq", name).drop("_seq")


def dense_rank_of(rows: DataFrame, seq: str, name: str) -> DataFrame:
    """Add a dense 1-based rank over a unique whole-number column, as ``sequenced`` makes it.

    Blocks of the number line hold at most NUMBER_BLOCK rows each, so no task gets more than that.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(seq) / NUMBER_BLOCK))
    sizes = blocked.groupBy("_block").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_block", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(seq))
    out = blocked.withColumn("_inside", inside).join(starts, "_block")
    return out.withColumn(name, (F.col("_start") + F.col("_inside")).cast("bigint")).select(*rows.columns, name)
