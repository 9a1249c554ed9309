"""Line dedup by overlapping windows of three lines.

Every three consecutive lines of a text are hashed; a window that occurs more
than once stays where it comes first, by (doc_id, place), and elsewhere the
lines it covers go. Windows of blank lines alone don't count.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.llm._spark import Scratch, fresh, map_rows, once, spread_join

WINDOW = 3


def _windows(text: Column, window: int) -> Column:
    """Of each window, in the order of places: (h, g), 96 hash bits; null if it is blank."""

    def hashed(joined: Column) -> Column:
        return F.when(F.btrim(joined, F.lit(" \t\n\x0b\x0c\r")) != "", F.struct(F.xxhash64(joined).alias("h"), F.hash(joined).alias("g")))

    def of_lines(lines: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(lines) - window)
        each = F.transform(places, lambda place: once(F.concat_ws("\n", *[F.get(lines, place + k) for k in range(window)]), hashed))
        return F.when(F.size(lines) >= window, each)

    # the lambda's variable is bound once, so that a text is split a single time
    return once(F.split(text, "\n", -1), of_lines)


def _cut(at: int, window: int, width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, removed = [], [], []
            for text, cuts in zip(batch.column(at), batch.column(width), strict=True):
                value = text.as_py()
                rows = value.split("\n") if value is not None else []
                gone = 0
                if cuts.is_valid:
                    p = cuts.values.to_numpy()
                    edge = np.bincount(p, minlength=len(rows) + 1) - np.bincount(p + window, minlength=len(rows) + 1)
                    stays = np.cumsum(edge)[: len(rows)] == 0
                    gone = len(rows) - int(stays.sum())
                    value = "\n".join([r for r, s in zip(rows, stays.tolist(), strict=True) if s])
                texts.append(value)
                lines.append(len(rows))
                removed.append(gone)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            columns[width] = pa.nulls(batch.num_rows, columns[width].type)  # dropped
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], names=[*batch.schema.names, "n_lines", "n_removed"])

    return run


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, text without the lines of later occurrences of a
    window, and n_lines, n_removed (columns of these names are replaced).

    Lines are what "\\n" separates. Texts of fewer lines than a window stay as
    they are, nulls null with 0 lines; an empty text is one line. The first
    occurrence is that in the smallest doc_id (null: the largest of all),
    then the earliest place in it; places in the same document count as later
    ones, too. Rows alike in doc_id and text are one document; of rows alike
    in doc_id alone the one whose text has the smaller hash comes first.
    Windows are told apart by 96 bits of hash. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.drop("n_lines", "n_removed")
    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", tag.alias("tag"), "text")
    found = rows.select("doc_id", "tag", F.posexplode_outer(_windows(F.col("text"), window)).alias("p", "w")).where("w is not null")
    windows = scratch.keep(found.select("w.h", "w.g", F.col("doc_id").alias("doc"), "tag", "p"))
    place = F.struct(F.isnull("doc"), "doc", "tag", "p")
    repeated = windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = scratch.keep(repeated.select("h", "g", "first", "n"))
    later = spread_join(windows, repeated, ["h", "g"], windows.count()).where(place > F.col("first"))
    own, own_tag, places = fresh("doc"), fresh("tag"), fresh("cuts")
    cuts = scratch.keep(later.groupBy("doc", "tag").agg(F.collect_list("p").alias(places)).withColumnsRenamed({"doc": own, "tag": own_tag}))
    scratch.drop(windows, repeated)
    # texts are dealt out by a merge join at every size of the small side
    joined = docs.join(cuts.hint("merge"), F.col("doc_id").eqNullSafe(F.col(own)) & (tag == F.col(own_tag)), "left").drop(own, own_tag)
    return map_rows(joined, _cut(docs.columns.index("text"), window, len(docs.columns)), "n_lines long, n_removed long").drop(places)
