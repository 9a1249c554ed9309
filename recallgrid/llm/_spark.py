"""Shared Spark plumbing of the training-data operators: scratch tables in the
cluster's shared folder, and connected components by joins."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recallgrid.llm import _arrays


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir,
    or where that is unset in local mode (tests) a temporary one. A cluster
    without that setting is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not at:
        at = tempfile.mkdtemp(prefix="recallgrid-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def bounded_batches(spark: SparkSession, at_most: str = "8m") -> None:
    """Arrow batches of whole texts stay small enough for several Python
    workers on an executor (a setting of the session)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", at_most)


class Scratch:
    """Tables written to the shared folder to cut lineage. They survive lost
    executors; drop() removes those that later steps no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        bounded_batches(spark)

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/t{self.made}"
        df.write.parquet(path)
        self.release()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Has the driver collect its garbage: only then does Spark remove the
        shuffle files of steps that have ended."""
        gc.collect()
        self.spark._jvm.System.gc()


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"_{name}_{uuid.uuid4().hex}"


def map_rows(df: DataFrame, run: Callable, more: str) -> DataFrame:
    """df.mapInArrow for a function that gives df's columns and more (a schema
    string); df's columns may have any names."""
    names = [f"c{k}" for k in range(len(df.columns))]
    plain = df.toDF(*names)
    added = StructType.fromDDL(more)
    return plain.mapInArrow(run, StructType([*plain.schema.fields, *added.fields])).toDF(*df.columns, *added.names)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out a single time for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: A key is hot if it holds over 1 / HOT_KEYS of the rows, so that there are fewer hot keys than this.
HOT_KEYS = 1000


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of big (of total rows) with small, which has one row for
    each key and in n the number of big's rows that have it. The rows of hot
    keys stay where they are and meet the few rows of these keys in a
    broadcast; all others are shuffled, and no key holds much of that."""
    hot = F.col("n") * HOT_KEYS > total
    few, rest = small.where(hot).drop("n"), small.where(~hot).drop("n")
    spread = big.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(rest, keys)
    return big.join(F.broadcast(few), keys).unionByName(spread)


def binary_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slabs(column: pa.Array, at_most: int = 2_000_000) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, last row + 1, texts) of pieces of a batch, each of about
    at_most bytes or a single row, so that work arrays stay small."""
    sizes = column.cast(pa.large_binary())
    lengths = np.diff(np.frombuffer(sizes.buffers()[1], dtype=np.int64, count=len(sizes) + 1, offset=8 * sizes.offset)) if len(sizes) else np.zeros(0, np.int64)
    start = 0
    while start < len(lengths):
        end, total = start, 0
        while end < len(lengths) and (end == start or total + lengths[end] <= at_most):
            total += int(lengths[end])
            end += 1
        yield start, end, binary_texts(column.slice(start, end - start))
        start = end


EDGES = "a long, b long"


def _local_forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of a task by a spanning forest of them."""
    for batch in batches:
        node, root = _arrays.forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])


def components(scratch: Scratch, edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of links (a, b): rows (id, root), root being the
    smallest id of the component, for every id that is not that root itself.

    Large-star and small-star rounds: each points a node's neighbours at the
    smallest of them by an aggregation with map-side combine and a join, so
    no node's neighbours are gathered in one place. Every round is written to
    the shared folder. Links of an id to itself count for nothing.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    now = scratch.keep(pairs.mapInArrow(_local_forest, EDGES).distinct())
    for _ in range(max_rounds):
        low = now.groupBy("a").agg(F.count("*").alias("n"))
        many = low.where("n > 1").limit(1).count()
        chained = 0 if many else now.select(F.col("b").alias("a")).distinct().join(now.select("a"), "a", "left_semi").limit(1).count()
        if not many and not chained:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.keep(large.where("a <> b").mapInArrow(_local_forest, EDGES).distinct())
        scratch.drop(now, least)
        least = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = scratch.keep(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        scratch.drop(large, least)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
