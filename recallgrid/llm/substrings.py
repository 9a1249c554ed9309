"""Removal of repeated passages, found by recompression.

Each level names the runs and pairs of the symbols that the level before left
(words at first). A short run of equal symbols becomes one symbol; of the
others, a symbol whose name falls on the left side on this level and one on
the right side become one if they are adjacent. A name is a hash of what it
names, so it stands for the same words in all documents. With each symbol goes
the range of words that its making looked at. Equal windows have the same
symbols wherever that range lies inside them: their interior symbols.

The work goes in Spark rounds, each up to a higher level. A round represents
every window that is left by its longest interior symbol (of equally long ones
that of the least name) and counts over all documents which documents hold
these symbols. Windows whose symbol is in one document alone are unique and
leave; the others go on to the next round. The windows that share a symbol
after the last are verified by a 96-bit hash of all their words; of those in
two documents or more, every window outside its smallest document goes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm import _arrays
from recallgrid.llm._spark import Scratch, slabs, spread_join

WINDOW = 50
#: The highest level of each Spark round.
LEVELS = (4, 7)
#: Symbols that have come up to this level, or are made on a higher one, represent windows; else words do.
LEAST_LEVEL = 3
U64 = np.uint64
FAR = np.int64(1) << 40


class Symbols(NamedTuple):
    """name; the words start..start+span-1 that it stands for; lo..hi-1, those
    that its making looked at."""

    name: np.ndarray
    start: np.ndarray
    span: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def _around(values: np.ndarray, by: int, edge: int) -> np.ndarray:
    """values[k + by], edge beyond the ends."""
    out = np.full(len(values), edge, dtype=values.dtype)
    if by > 0:
        out[:-by] = values[by:]
    else:
        out[-by:] = values[:by]
    return out


def compress(words: np.ndarray, head: np.ndarray, levels: int) -> Iterator[tuple[int, Symbols, np.ndarray]]:
    """Of each level from 1 on the symbols, and which of them are new. words:
    hashes of words; head: True at the first word of each text. What looks
    beyond a text's ends, or at a run too long to be named, has a lo or hi far
    off."""
    n = len(words)
    place = np.arange(n, dtype=np.int64)
    name, span, first = words, np.ones(n, np.int64), head
    start, lo, hi = place, place, place + 1
    for level in range(1, levels + 1):
        if not len(name):
            return
        last = _around(first, 1, True)
        same = np.zeros(len(name), bool)  # as the one before
        same[1:] = (name[1:] == name[:-1]) & ~first[1:]
        repeated = same | _around(same, 1, False)
        run = np.flatnonzero(~same)
        run_len = np.diff(run, append=len(name))
        short = (run_len > 1) & (run_len * span[run] <= 2**level)
        right = (_arrays.mix(name ^ U64(level)) & U64(1)).astype(bool)
        pair = np.zeros(len(name), bool)  # joined with the one after
        pair[:-1] = ~repeated[:-1] & ~repeated[1:] & ~right[:-1] & right[1:] & ~first[1:]
        # the ranges that a look at the neighbours needs
        lo_before = np.where(first, -FAR, _around(lo, -1, -FAR))
        hi_after = np.where(last, FAR, _around(hi, 1, FAR))
        near_lo, near_hi = np.minimum(lo, lo_before), np.maximum(hi, hi_after)
        new_lo, new_hi = np.minimum(near_lo, _around(near_lo, 1, FAR)), np.maximum(near_hi, _around(near_hi, 1, -FAR))
        # left alone though the sides fit: the neighbour is in a run, which its own neighbour tells
        fits = np.zeros(len(name), bool)
        fits[:-1] = ~right[:-1] & right[1:] & ~first[1:]
        fitted = np.zeros(len(name), bool)
        fitted[1:] = fits[:-1]
        own_lo = np.where(fitted, np.minimum(near_lo, _around(near_lo, -1, -FAR)), near_lo)
        own_hi = np.where(fits, np.maximum(near_hi, _around(near_hi, 1, FAR)), near_hi)
        long_run = repeated & ~np.repeat(short, run_len)
        own_lo, own_hi = np.where(long_run, -FAR, own_lo), np.where(long_run, FAR, own_hi)
        left = np.flatnonzero(pair)
        own_lo[left], own_hi[left] = new_lo[left], new_hi[left]
        merged, length, made = name.copy(), span.copy(), pair.copy()
        with np.errstate(over="ignore"):
            merged[left] = _arrays.mix(name[left] * U64(3) + _arrays.mix(name[left + 1]))
            length[left] += span[left + 1]
            heads, sizes = run[short], run_len[short]
            merged[heads] = _arrays.mix(name[heads] * U64(5) + sizes.astype(U64))
        length[heads] = sizes * span[heads]
        made[heads] = True
        own_lo[heads] = np.minimum.reduceat(near_lo, run)[short]
        own_hi[heads] = np.maximum.reduceat(near_hi, run)[short]
        gone = np.zeros(len(name), bool)
        gone[1:] = pair[:-1]
        gone |= same & np.repeat(short, run_len)
        stays = ~gone
        name, span, first, start, lo, hi, made = (x[stays] for x in (merged, length, first, start, own_lo, own_hi, made))
        yield level, Symbols(name, start, span, lo, hi), made


def representatives(words: np.ndarray, head: np.ndarray, window: int, levels: int) -> np.ndarray:
    """For the window that starts at each word (if its text goes on so long)
    the name of its longest interior symbol, of equally long ones the least."""
    n = len(words)
    none = np.iinfo(np.uint64).max
    # tables of the least rank over 1, 2, 4, ... window starts from a place on
    tables = [np.full(n, none, dtype=U64) for _ in range(window.bit_length())]
    for level, s, made in compress(words, head, levels):
        take = np.flatnonzero(((s.hi - s.lo) <= window) & (made if level > LEAST_LEVEL else level == LEAST_LEVEL))
        # it is inside the windows that start at hi - window .. lo
        begin = np.maximum(s.hi[take] - window, 0)
        count = s.lo[take] - begin + 1
        rank = ((U64(255) - np.minimum(s.span[take], 255).astype(U64)) << U64(56)) | (s.name[take] >> U64(8))
        size = np.frexp(count.astype(np.float64))[1] - 1
        for k in range(len(tables)):
            of = np.flatnonzero(size == k)
            np.minimum.at(tables[k], begin[of], rank[of])
            np.minimum.at(tables[k], begin[of] + count[of] - 2**k, rank[of])
    for k in range(len(tables) - 1, 0, -1):
        half = 2 ** (k - 1)
        np.minimum(tables[k - 1], tables[k], out=tables[k - 1])
        np.minimum(tables[k - 1][half:], tables[k][:-half], out=tables[k - 1][half:])
    found = tables[0]
    least = np.full(n, none, dtype=U64)
    if n >= window:
        least[: n - window + 1] = _arrays.sliding_min(words, window) >> U64(8)
    # the highest byte of a word's rank tells it from a symbol's
    return np.where(found == none, (U64(255) << U64(56)) | least, found)


def _hashed(texts: list[bytes]) -> tuple[_arrays.Words, np.ndarray]:
    words = _arrays.Words(texts)
    return words, _arrays.span_hashes(words.data, words.start, words.size)


def _symbols_of_windows(window: int, levels: int):
    """(key, doc_id, tag, p, n): windows p..p+n-1 of a document have the symbol
    key. Read are doc_id, tag (a hash of the text), text and spans, the
    windows that are left (null: all)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for begin, end, texts in slabs(batch.column(2)):
                words, value = _hashed(texts)
                count = np.maximum(words.count - window + 1, 0)
                if not count.sum():
                    continue
                head = np.zeros(len(value), bool)
                head[words.first[words.count > 0]] = True
                key = representatives(value, head, window, levels)
                spans = batch.column(3).slice(begin, end - begin)
                if spans.null_count:
                    row, first, size = np.arange(end - begin), np.zeros(end - begin, np.int64), count
                else:
                    row = np.repeat(np.arange(end - begin), spans.value_lengths().to_numpy())
                    first, size = (spans.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
                part = np.repeat(np.arange(len(row)), size)
                p = _arrays.ranges(first, size)
                of = key[_arrays.ranges(words.first[row] + first, size)].view(np.int64)
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (part[1:] != part[:-1])
                at = np.flatnonzero(new)
                row = row[part[at]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of[at]), pa.array(ids[begin:end][row]), pa.array(tags[begin:end][row]), pa.array(p[at].astype(np.int32)), pa.array(np.diff(at, append=len(of)).astype(np.int32))],
                    names=["key", "doc_id", "tag", "p", "n"],
                )

    return run


def _window_hashes(window: int):
    """(h, g, doc_id, tag, p): 64 and 32 hash bits of the windows to verify."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for begin, end, texts in slabs(batch.column(2)):
                spans = batch.column(3).slice(begin, end - begin)
                parts = spans.flatten()
                row = np.repeat(np.arange(end - begin), spans.value_lengths().to_numpy())
                p, n = (parts.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                words, value = _hashed(texts)
                at = _arrays.ranges(words.first[row] + p, n)
                row = np.repeat(row, n)
                h = _arrays.rolled(value, window)[at]
                g = _arrays.rolled(_arrays.mix(value + U64(1)), window)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array((g >> U64(32)).astype(np.uint32).view(np.int32)), pa.array(ids[begin:end][row]), pa.array(tags[begin:end][row]), pa.array((at - words.first[row]).astype(np.int32))],
                    names=["h", "g", "doc_id", "tag", "p"],
                )

    return run


def _cut(window: int):
    """(doc_id, n_words, n_removed, kept)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy = batch.column(3).to_pylist()
            for begin, end, texts in slabs(batch.column(1)):
                windows = batch.column(2).slice(begin, end - begin)
                words = _arrays.Words(texts)
                removed, kept = [], []
                for k in range(end - begin):
                    first, count = words.first[k], words.count[k]
                    stop = first + count
                    body = words.data[words.start[first] : words.start[stop - 1] + words.size[stop - 1] + 1] if count else words.data[:0]
                    gone = 0
                    if copy[begin + k] and count >= window:
                        gone, body = count, body[:0]
                    elif windows[k].is_valid and len(windows[k]):
                        p = windows[k].values.to_numpy()
                        edge = np.bincount(p, minlength=count + 1)[: count + 1] - np.bincount(p + window, minlength=count + 1)[: count + 1]
                        stays = np.cumsum(edge)[:count] == 0
                        gone = count - int(stays.sum())
                        body = body[np.repeat(stays, words.size[first:stop] + 1)]
                    removed.append(gone)
                    kept.append(body[:-1].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(words.count.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Removes each word of a window (so many consecutive words of one
    document) whose word sequence also starts in a document with a smaller
    doc_id, judged on the input. One row for each row of docs: doc_id,
    n_words, n_removed, kept (the kept words joined by one space).

    Words are what white space (tab to carriage return, blank) leaves. A null
    or empty text has no words, and one shorter than a window loses none. Rows
    with the same doc_id remove nothing from each other; a row with a null
    doc_id loses no words and removes none. Columns besides doc_id and text
    are not read; an empty table gives no rows. Windows are told apart by 96
    bits of hash, whole texts by SHA-256.
    """
    if window < 1:
        raise ValueError("a window has one word at least")
    scratch = Scratch(docs.sparkSession, "substrings")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    known = rows.where("doc_id is not null")
    # later copies of a whole text lose all their windows, so these needn't be compared
    tags = scratch.keep(known.select("doc_id", "tag", F.unhex(F.sha2("text", 256)).alias("sha")).distinct())
    copied = scratch.keep(tags.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"))
    copies = scratch.keep(spread_join(tags, copied, ["sha"], tags.count()).where("doc_id > least").select("doc_id", "tag"))
    scratch.drop(tags, copied)
    spans = "array<struct<p: int, n: int>>"
    left = known.select("doc_id", "tag", "text", F.lit(None).cast(spans).alias("spans"))
    for levels in LEVELS:
        symbols = scratch.keep(left.mapInArrow(_symbols_of_windows(window, levels), "key long, doc_id long, tag long, p int, n int"))
        held = symbols.groupBy("key").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi"), F.count("*").alias("n"))
        shared = scratch.keep(held.where("lo < hi").select("key", "n"))
        named = spread_join(symbols.withColumnRenamed("n", "size"), shared, ["key"], symbols.count())
        suspect = named.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("p", F.col("size").alias("n"))).alias("spans"))
        suspect = scratch.keep(suspect.join(copies, ["doc_id", "tag"], "left_anti"))
        scratch.drop(symbols, shared)
        left = known.join(suspect, ["doc_id", "tag"]).select("doc_id", "tag", "text", "spans")
    windows = scratch.keep(left.mapInArrow(_window_hashes(window), "h long, g int, doc_id long, tag long, p int"))
    repeated = windows.groupBy("h", "g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    repeated = scratch.keep(repeated.where("lo < hi").select("h", "g", "lo", "n"))
    later = spread_join(windows, repeated, ["h", "g"], windows.count()).where("doc_id > lo")
    cuts = scratch.keep(later.groupBy("doc_id", "tag").agg(F.collect_list("p").alias("cuts")))
    scratch.drop(windows, repeated)
    cuts = cuts.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", "tag", F.lit(None).cast("array<int>").alias("cuts"), F.lit(True).alias("copy")))
    whole = rows.join(cuts, ["doc_id", "tag"], "left").select("doc_id", "text", "cuts", F.coalesce("copy", F.lit(False)).alias("copy"))
    return whole.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string")
