"""A store on disk: versioned Parquet tables and a pointer to the current one."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.operators import keyword, search
from recallgrid.operators.lifecycle import Tables, add, compact
from recallgrid.plans.schema import EDGES, RECORDS, VECTORS, as_records, empty, live

TABLES = {"records": RECORDS, "vectors": VECTORS, "edges": EDGES}
PARTITIONS = {"records": "namespace_id", "vectors": "modality"}


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


class ConcurrentSave(OSError):
    """Another save came between this store's reading and its saving."""


class Store:
    """A directory with one directory per version. save() writes a new version
    in full, then creates the next numbered pointer file, which fails if that
    is there: readers see the old version or the new one, and of two savers
    that started from the same version the second is refused. Any file system
    that Spark knows and that creates files exclusively will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.base: int | None = None  # number of the version that open() read

    def _current(self) -> tuple[int, str | None]:
        """Number and name of the current version; (0, None) for a new store."""
        fs, where = _fs(self.spark, f"{self.path}/current")
        names = sorted((s.getPath().getName() for s in fs.listStatus(where)), reverse=True) if fs.exists(where) else []
        for name in names:
            stream = fs.open(_fs(self.spark, f"{self.path}/current/{name}")[1])
            try:
                version = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if version.endswith("\n"):  # a pointer that is only half written doesn't count
                return int(name), version.strip()
        return 0, None

    def version(self) -> str | None:
        return self._current()[1]

    def open(self) -> Tables:
        """The current tables, empty ones for a new store. Fields that an older
        version lacks get their defaults."""
        self.base, version = self._current()
        if version is None:
            return Tables(*(empty(self.spark, schema) for schema in TABLES.values()))
        records, vectors, edges = (self.spark.read.schema(schema).parquet(f"{self.path}/{version}/{name}") for name, schema in TABLES.items())
        return Tables(as_records(records), vectors, edges)

    def save(self, tables: Tables) -> str:
        """Writes live rows; returns the version. ConcurrentSave if another
        save came since open() (or, without that, since this began)."""
        version, number = uuid.uuid4().hex, (self.base if self.base is not None else self._current()[0]) + 1
        for name, df in zip(TABLES, compact(tables), strict=True):
            writer = df.write
            if name in PARTITIONS:
                writer = writer.partitionBy(PARTITIONS[name])
            writer.parquet(f"{self.path}/{version}/{name}")
        fs, pointer = _fs(self.spark, f"{self.path}/current/{number:012d}")
        try:
            stream = fs.create(pointer, False)
        except Py4JJavaError as e:
            fs.delete(_fs(self.spark, f"{self.path}/{version}")[1], True)
            raise ConcurrentSave(f"{self.path}: version {number} is there already") from e
        try:
            stream.writeBytes(f"{version}\n")
        finally:
            stream.close()
        self.base = number
        return version

    def save_indexes(self, cells: int = 32, buckets: int = 64) -> None:
        """Writes the current version's keyword index (postings by a hash of
        their term, statistics) and vector index (vectors by cell, centres)."""
        version, tables = self.version(), self.open()
        posted, stats = keyword.build_index(live(tables.records), buckets)
        posted.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{version}/postings")
        stats.write.mode("overwrite").parquet(f"{self.path}/{version}/statistics")
        placed, centres = search.build_ivf(tables.vectors.select("id", "vec"), cells)
        placed.write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/{version}/cells")
        self.spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>").write.mode("overwrite").parquet(f"{self.path}/{version}/centres")

    def keyword_search(self, query: str, k: int = 10, hits: DataFrame | None = None) -> DataFrame:
        """BM25 from the saved index; only the buckets of the query's terms are read."""
        at = f"{self.path}/{self.version()}"
        return keyword.search_index(self.spark.read.parquet(f"{at}/postings"), self.spark.read.parquet(f"{at}/statistics"), query, k, hits)

    def vector_search(self, query: list[float], k: int = 10, nprobe: int = 4) -> DataFrame:
        """Approximate search in the saved cells; only those probed are read."""
        at = f"{self.path}/{self.version()}"
        centres = [list(r["centre"]) for r in self.spark.read.parquet(f"{at}/centres").orderBy("cell").collect()]
        return search.search_ivf(self.spark.read.parquet(f"{at}/cells"), centres, query, k, nprobe)

    def adopt(self, other: str) -> str:
        """Takes over another store's tables after reading them by schema."""
        return self.save(Store(self.spark, other).open())

    def drop(self) -> None:
        fs, where = _fs(self.spark, self.path)
        fs.delete(where, True)


def list_stores(spark: SparkSession, root: str) -> list[str]:
    """The stores below a directory."""
    fs, where = _fs(spark, root)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if fs.exists(_fs(spark, f"{s.getPath()}/current")[1]))


def get(records: DataFrame, record_id: int) -> DataFrame:
    return records.where(F.col("id") == record_id)


def get_vector(vectors: DataFrame, record_id: int, modality: str = "text") -> DataFrame:
    return vectors.where((F.col("id") == record_id) & (F.col("modality") == modality)).select("vec")


def modality_names(vectors: DataFrame) -> DataFrame:
    return vectors.select("modality").distinct()


def sizes(vectors: DataFrame) -> DataFrame:
    """(modality, n, dim)."""
    return vectors.groupBy("modality").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"))


def scan(records: DataFrame, after: int, most: int) -> DataFrame:
    """The next page of live records by id."""
    return live(records).where(F.col("id") > after).orderBy("id").limit(most)


def seed(spark: SparkSession, n: int, dim: int, namespace: str, seed: int = 1) -> Tables:
    """n records with random vectors."""
    ids = spark.range(n).withColumn("id", F.col("id").cast("bigint"))
    records = as_records(ids.select("id", F.concat(F.lit("seed record "), F.col("id")).alias("content"), F.lit(namespace).alias("namespace_id")))
    vec = F.array(*[(F.rand(seed + k) * 2 - 1).cast("float") for k in range(dim)])
    return Tables(records, ids.select(F.lit("text").alias("modality"), "id", vec.alias("vec")), empty(spark, EDGES))


def import_json(spark: SparkSession, path: str, dim: int, embed=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, vectors, errors) from lines of JSON with the fields of records
    and vec. embed: a function of a text column for lines without a vector.
    errors: (id, problem) of lines without an id, without a vector, of another
    dimension, or that aren't JSON."""
    raw = spark.read.schema(f"{RECORDS}, vec array<float>, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    vec = F.coalesce("vec", embed(F.col("content")).cast("array<float>")) if embed is not None else F.col("vec")
    rows = raw.withColumn("vec", F.when(F.col("vec").isNull() & (F.coalesce("content", F.lit("")) == ""), F.lit(None)).otherwise(vec))
    problem = F.when(F.col("_corrupt").isNotNull(), "not JSON").when(F.col("id").isNull(), "no id").when(F.col("vec").isNull(), "no vector").when(F.size("vec") != dim, "wrong dimension")
    checked = rows.withColumn("problem", problem)
    good = checked.where("problem is null")
    return as_records(good), good.select(F.lit("text").alias("modality"), "id", "vec"), checked.where("problem is not null").select("id", "problem")


def ingest_texts(tables: Tables, texts: DataFrame, embed, now: int, namespace: str = "") -> Tables:
    """Adds texts (id, content) with their embeddings."""
    records = as_records(texts.select("id", "content", F.lit(now).cast("bigint").alias("ts"), F.lit(namespace).alias("namespace_id")))
    return add(tables, records, texts.select(F.lit("text").alias("modality"), "id", embed(F.col("content")).cast("array<float>").alias("vec")))
