"""SimHash near-dedup by a byte-position index with count filtering.

A fingerprint of 64 bits has eight bytes. Two fingerprints that differ in at
most four bits agree in four bytes at least: four is the guaranteed number of
matches. The index posts each distinct fingerprint under 20 triples of
positions with their bytes, chosen so that every four positions hold one of
the triples; a pair with four matches thus meets in a list. There the
positional bytes that it shares are tallied, pairs below the guaranteed number
are left out, and of the others the differing bits are counted. A list gives a
spanning forest of its links, never all its pairs.

A list of more than LIST_MOST fingerprints is posted again, under one byte
more (of the five that are free a pair shares one at least), and if that is
still too long under four of the eight nibbles that are then free; such a list
holds 65,536 fingerprints at most, as no more fit in the 16 bits left.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm import _arrays
from recallgrid.llm._spark import Scratch, components, slabs, spread_join

MOST_BITS = 4
LIST_MOST = 8192
FOURS = list(combinations(range(8), 4))


def covering_triples() -> list[tuple[int, ...]]:
    """20 triples of eight positions, one of them in every four positions
    (Turan's construction): of the classes 0-2, 3-5 and 6-7 all three in one
    class, or two in one and one in the next."""
    place = [0, 0, 0, 1, 1, 1, 2, 2]

    def fits(triple: tuple[int, ...]) -> bool:
        n = [sum(place[p] == c for p in triple) for c in range(3)]
        return 3 in n or any(n[c] == 2 and n[(c + 1) % 3] == 1 for c in range(3))

    return [t for t in combinations(range(8), 3) if fits(t)]


TRIPLES = covering_triples()
FREE = np.array([[p for p in range(8) if p not in t] for t in TRIPLES])


def fingerprints_of(texts: list[bytes], width: int) -> np.ndarray:
    """SimHash of each text: ASCII lower case, white-space words, shingles of
    width words (the whole text if it has fewer), XXH64 with seed 42. No
    words: 0."""
    words = _arrays.Words(texts, lower=True)
    shingles = np.where(words.count >= width, words.count - width + 1, words.count > 0).astype(np.int64)
    total = int(shingles.sum())
    out = np.zeros(len(texts), dtype=np.uint64)
    if not total:
        return out
    offset = np.cumsum(shingles) - shingles
    begin = np.repeat(words.first - offset, shingles) + np.arange(total)
    last = begin + np.repeat(np.minimum(words.count, width), shingles) - 1
    hashes = _arrays.xxh64(words.data, words.start[begin], words.start[last] + words.size[last] - words.start[begin])
    full = np.flatnonzero(shingles)
    # bits are summed as bytes over runs of at most 255 shingles, then over runs
    runs = -(-shingles[full] // 255)
    run0 = np.cumsum(runs) - runs
    run_start = np.repeat(offset[full] - 255 * run0, runs) + 255 * np.arange(int(runs.sum()))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    part = np.add.reduceat(bits, run_start, axis=0, dtype=np.uint8)
    ones = np.add.reduceat(part, run0, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * ones > shingles[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text; null texts are empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in slabs(batch.column(1)):
                fp = fingerprints_of(texts, width).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _octets(fp: np.ndarray) -> np.ndarray:
    return fp.view(np.uint8).reshape(-1, 8).astype(np.int64)


def _postings(keys: list[np.ndarray], fp: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(fp, len(keys)))], names=["key", "fp"])


def _post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 20 postings of each fingerprint; key: triple, its three bytes."""
    for batch in batches:
        for i in range(0, batch.num_rows, 8192):
            fp = batch.column(0).slice(i, 8192).to_numpy()
            octets = _octets(fp)
            yield _postings([(n << 24) | (octets[:, a] << 16) | (octets[:, b] << 8) | octets[:, c] for n, (a, b, c) in enumerate(TRIPLES)], fp)


def _post_bytes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The five finer postings of each (list, fingerprint) of the long lists;
    key: that of the list, which of the free positions, its byte."""
    for batch in batches:
        for i in range(0, batch.num_rows, 8192):
            key, fp = (batch.column(k).slice(i, 8192).to_numpy() for k in (0, 1))
            rest = np.take_along_axis(_octets(fp), FREE[key >> 24], axis=1)
            yield _postings([(key << 11) | (n << 8) | rest[:, n] for n in range(5)], fp)


def _post_nibbles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 70 postings of each (list of _post_bytes, fingerprint) that is
    still too long; key: that of the list, which nibbles of the four bytes
    left, their values."""
    left = np.array([[[p for p in free if p != free[n]] for n in range(5)] for free in FREE.tolist()])
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            key, fp = (batch.column(k).slice(i, 4096).to_numpy() for k in (0, 1))
            rest = np.take_along_axis(_octets(fp), left[key >> 35, (key >> 8) & 7], axis=1)
            nibbles = np.stack([rest & 15, rest >> 4], axis=2).reshape(-1, 8)
            yield _postings([(key << 23) | (n << 16) | (nibbles[:, a] << 12) | (nibbles[:, b] << 8) | (nibbles[:, c] << 4) | nibbles[:, d] for n, (a, b, c, d) in enumerate(FOURS)], fp)


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of fingerprints the number of equal positional bytes."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    differing = (a ^ b).view(np.uint64)
    # a byte's high bit is set if the byte isn't zero
    return 8 - np.bitwise_count((((differing & low) + low) | differing) & ~low).astype(np.int64)


LINKS = "long_list boolean, a long, b long"


def _row(long_list: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), long_list)), pa.array(a), pa.array(b)], names=["long_list", "a", "b"])


def _verify(most_bits: int, list_most: int | None):
    """Reads postings sorted by key, as lists; gives links (False, fp, fp) and,
    of lists longer than list_most, the postings (True, key, fp)."""
    guaranteed = 8 - most_bits

    def linked(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, waiting, at = [], 0, np.arange(len(key))
        step = 0
        while at.size:
            step += 1
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            met = at[shared_bytes(fp[at], fp[at + step]) >= guaranteed]
            near = met[np.bitwise_count((fp[met] ^ fp[met + step]).view(np.uint64)) <= most_bits]
            if near.size:
                found.append((fp[near], fp[near + step]))
                waiting += near.size
            if waiting > 500_000:
                found = [_arrays.forest(*map(np.concatenate, zip(*found, strict=True)))]
                waiting = len(found[0][0])
        if found:
            yield _row(False, *_arrays.forest(*map(np.concatenate, zip(*found, strict=True))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        long_key = None
        for batch in batches:
            key, fp = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([fp, batch.column(1).to_numpy()])
            if not len(key):
                continue
            if long_key is not None:
                n = int(np.searchsorted(key, long_key, side="right"))
                if n:
                    yield _row(True, key[:n], fp[:n])
                    key, fp = key[n:], fp[n:]
                if not len(key):
                    continue
                long_key = None
            done = int(np.searchsorted(key, key[-1]))  # the last list may go on in the next batch
            yield from split(key[:done], fp[:done])
            key, fp = key[done:], fp[done:]
            if list_most and len(key) > list_most:
                yield _row(True, key, fp)
                long_key, key, fp = key[0], key[:0], fp[:0]
        yield from split(key, fp)

    def split(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(new, append=len(key))
        each = np.repeat(sizes, sizes)
        if list_most and (over := each > list_most).any():
            yield _row(True, key[over], fp[over])
            key, fp, each = key[~over], fp[~over], each[~over]
        some = each > 1
        yield from linked(key[some], fp[some])

    return run


def fingerprint_links(scratch: Scratch, distinct: DataFrame, most_bits: int = MOST_BITS, list_most: int = LIST_MOST) -> DataFrame:
    """Links (a, b) between distinct fingerprints, at most_bits <= 4 differing
    bits, that join the same fingerprints as all such links do."""
    if not 0 <= most_bits <= MOST_BITS:
        raise ValueError("the index guarantees its four matches at 4 differing bits or fewer")
    todo, links = distinct.select("fp").mapInArrow(_post, "key long, fp long"), []
    for finer in (_post_bytes, _post_nibbles, None):
        lists = todo.repartition("key").sortWithinPartitions("key", "fp")
        found = scratch.keep(lists.mapInArrow(_verify(most_bits, list_most if finer else None), LINKS))
        links.append(found.where("not long_list").select("a", "b"))
        if finer is None or found.where("long_list").isEmpty():
            break
        todo = found.where("long_list").select(F.col("a").alias("key"), F.col("b").alias("fp")).mapInArrow(finer, "key long, fp long")
    return reduce(DataFrame.unionAll, links)


def near_duplicates(docs: DataFrame, width: int = 4, most_bits: int = MOST_BITS) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits),
    component_id, the smallest doc_id that a chain of links reaches.

    Null texts count as empty; texts without words have fingerprint zero and
    link like others. Repeated rows stay and share their component. A null
    doc_id keeps its row and never is the smallest; a component without any
    other has a null component_id. Columns besides doc_id and text are not
    read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, width))
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least_doc"), F.count("*").alias("n")))
    star = components(scratch, fingerprint_links(scratch, distinct, most_bits))
    rooted = distinct.join(star, F.col("fp") == F.col("id"), "left").select("fp", "least_doc", "n", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.keep(rooted)
    classes = rooted.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    of_print = scratch.keep(rooted.join(classes, "root").select("fp", "component_id", "n"))
    joined = spread_join(prints, of_print, ["fp"], prints.count())
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
