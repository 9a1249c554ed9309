"""Quality classifier by co-training.

Two classifiers see different things: one the text's content, the other the
page's metadata (language, source, length and layout). Each is a logistic
regression on features cut at their quantiles. Starting from the labelled
documents, in each round either scores all documents, and those that it is
surest of become further examples for the other: a share of the documents that
grows with each round. In the end either's log-odds are calibrated on labelled
documents held out from training, and a logistic regression on these documents
combines the two.

Fitting takes at most about LABELLED_MOST labelled documents and in a round
about TAUGHT_MOST of the documents that a view is surest of, both chosen by a
hash; which documents these are is judged over all of them, and every document
is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm import _arrays
from recallgrid.llm._spark import Scratch, bounded_batches, fresh, map_rows, slabs

LABELLED_MOST = 20_000
TAUGHT_MOST = 5_000
ROUNDS = 3
SURE = 0.97
SHARE_PER_ROUND = 0.1
STEPS = 16  # sureness is told apart by this part of a unit of log-odds
FALSE_REJECTS = 0.003
BINS = 10
SOURCES = 32
LANGUAGES = 16

#: Byte classes that are counted.
CLASSES = tuple(
    np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
    for chars in (
        bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"!", b"?", b".", b",", b"|", b"#*-_=~", b"<>", b"{}[]()", b";:", b"/\\@&", b"%$+^", b"\"'`", bytes(range(128, 256)), b" ", b"\n",
    )
)
COUNTED = np.stack(CLASSES, axis=1).astype(np.float64)


def text_features(texts: list[bytes]) -> np.ndarray:
    """The content view: shares of byte classes, word lengths, repetition."""
    counts = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts]) @ COUNTED
    size = np.maximum(np.array([len(t) for t in texts], dtype=np.float64), 1)
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    words = _arrays.Words(texts)
    row = np.repeat(np.arange(len(texts)), words.count)
    n = np.maximum(words.count, 1).astype(np.float64)
    total = np.bincount(row, weights=words.size, minlength=len(texts))
    square = np.bincount(row, weights=words.size.astype(np.float64) ** 2, minlength=len(texts))
    value = _arrays.span_hashes(words.data, words.start, words.size)
    keyed = _arrays.mix(value ^ _arrays.mix(row.astype(np.uint64) + np.uint64(1)))
    different = np.bincount(row[np.unique(keyed, return_index=True)[1]], minlength=len(texts))
    inside = np.flatnonzero(row[:-1] == row[1:])
    pairs, pair_row = _arrays.mix(keyed[inside] * np.uint64(7) + keyed[inside + 1]), row[inside]
    different_pairs = np.bincount(pair_row[np.unique(pairs, return_index=True)[1]], minlength=len(texts))
    long_words = np.bincount(row, weights=words.size >= 14, minlength=len(texts)) / n
    short_words = np.bincount(row, weights=words.size <= 2, minlength=len(texts)) / n
    lines = [t.split(b"\n") for t in texts]
    repeated = np.array([1 - len(set(ls)) / len(ls) for ls in lines])
    mean = total / n
    columns = [*(counts / size[:, None]).T, counts[:, 0] / letters, mean, np.sqrt(np.maximum(square / n - mean**2, 0)), different / n, different_pairs / n, long_words, short_words, repeated, np.log1p(words.count), counts[:, 5] / n, counts[:, 3] / n]
    return np.stack(columns, axis=1)


def metadata_features(texts: list[bytes], langs: list[str | None], sources: list[str | None]) -> np.ndarray:
    """The metadata view: language and source (hashed), length, layout."""
    rows = np.arange(len(texts))
    known = np.zeros((len(texts), LANGUAGES + SOURCES))
    known[rows, [zlib.crc32((x or "").encode()) % LANGUAGES for x in langs]] = 1
    known[rows, [LANGUAGES + zlib.crc32((x or "").encode()) % SOURCES for x in sources]] = 1
    lengths = [np.array([len(x) for x in t.split(b"\n")], dtype=np.float64) for t in texts]
    layout = np.stack([[np.log1p(len(t)), len(ls), ls.mean(), ls.max(), ls.min(), (ls < 30).mean(), (ls == 0).mean()] for t, ls in zip(texts, lengths, strict=True)])
    return np.concatenate([layout, known], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the constant."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


class View:
    """A logistic regression on features cut at quantiles, with Platt calibration."""

    def __init__(self, features: np.ndarray):
        steps = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(f, steps)) for f in features.T]
        self.scale = (1.0, 0.0)
        self.beta = np.zeros(self.cut(features[:1]).shape[1])

    def codes(self, features: np.ndarray) -> np.ndarray:
        """For each feature how many of its edges it exceeds, a byte."""
        return np.stack([np.searchsorted(e, f, side="left") for f, e in zip(features.T, self.edges, strict=True)], axis=1).astype(np.uint8)

    def spread(self, codes: np.ndarray) -> np.ndarray:
        """For each feature whether it exceeds each of its edges, and a constant."""
        parts = [c[:, None] > np.arange(len(e))[None] for c, e in zip(codes.T, self.edges, strict=True)]
        return np.concatenate([*parts, np.ones((len(codes), 1))], axis=1).astype(np.float64)

    def cut(self, features: np.ndarray) -> np.ndarray:
        return self.spread(self.codes(features))

    def fit(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.beta = _logistic(self.spread(codes), y, weight, ridge=1.0)

    def calibrate(self, features: np.ndarray, y: np.ndarray) -> None:
        raw = self.cut(features) @ self.beta
        self.scale = tuple(_logistic(np.stack([raw, np.ones(len(raw))], axis=1), y, np.ones(len(y)), ridge=0.01))

    def odds(self, features: np.ndarray) -> np.ndarray:
        return self.scale[0] * (self.cut(features) @ self.beta) + self.scale[1]


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class CoTrained:
    """The two views and their combination."""

    def __init__(self, views: list[View], blend: np.ndarray, threshold: float):
        self.views, self.blend, self.threshold = views, blend, threshold

    def score(self, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: by content, by metadata, by both."""
        odds = [v.odds(f) for v, f in zip(self.views, features, strict=True)]
        return _probability(odds[0]), _probability(odds[1]), _probability(np.stack([*odds, np.ones(len(odds[0]))], axis=1) @ self.blend)


#: Further examples for a view: their codes, labels and weights.
Taught = tuple[np.ndarray, np.ndarray, np.ndarray]


def _as_binary(rows: np.ndarray) -> pa.Array:
    offsets = (np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _as_codes(values: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(len(values), width)


def lots(codes: np.ndarray) -> np.ndarray:
    """A fixed number from 0 to below 1 for each row of bytes, as if drawn."""
    wide = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : codes.shape[1]] = codes
    h = np.full(len(codes), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for part in wide.view(np.uint64).T:
        h = _arrays.mix(h + part)
    return (h >> np.uint64(11)).astype(np.float64) / 2**53


def sure_steps(raw: np.ndarray, scale: tuple[float, float], label: int) -> np.ndarray:
    """How sure a view is of a label, in steps of its log-odds before
    calibration; -1 where it isn't by those after it."""
    toward = 1.0 if label else -1.0
    sure = toward * (scale[0] * raw + scale[1]) >= np.log(SURE / (1 - SURE))
    steps = np.floor((30 + np.clip(toward * np.sign(scale[0]) * raw, -30, 30)) * STEPS)
    return np.where(sure, steps, -1).astype(np.int64)


def last_step(counts: dict[int, int], most: int) -> tuple[int, float, int]:
    """From the surest step down, at most this many documents: the last step
    that takes part, the share of it that does, and their number."""
    taken = 0
    for step in sorted(counts, reverse=True):
        if taken + counts[step] > most:
            return step, (most - taken) / counts[step], most
        taken += counts[step]
    return 0, 1.0, taken


def _read(batch: pa.RecordBatch, views: list[View]) -> tuple[list[np.ndarray], np.ndarray, list[list[np.ndarray]]]:
    """Codes, numbers of documents, and for each view and label the steps."""
    codes = [_as_codes(batch.column(k).to_pylist(), len(v.edges)) for k, v in enumerate(views)]
    raw = [v.spread(c) @ v.beta for v, c in zip(views, codes, strict=True)]
    return codes, batch.column(2).to_numpy(), [[sure_steps(r, v.scale, label) for label in (0, 1)] for r, v in zip(raw, views, strict=True)]


class Pool:
    """All documents as the views' codes; equal ones are one row with their
    number n, so that copies take no room. A table in the shared folder."""

    def __init__(self, docs: DataFrame, views: list[View], taught_most: int):
        self.taught_most = taught_most

        def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin, end, texts in slabs(batch.column(0)):
                    features = _features(texts, batch, begin, end, 1, 2)
                    yield pa.RecordBatch.from_arrays([_as_binary(v.codes(f)) for v, f in zip(views, features, strict=True)], names=["content", "metadata"])

        rows = docs.select("text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")).mapInArrow(coded, "content binary, metadata binary")
        self.rows = Scratch(docs.sparkSession, "quality").keep(rows.groupBy("content", "metadata").agg(F.count("*").alias("n")))
        self.size = self.rows.agg(F.sum("n")).first()[0] or 0

    def teach(self, views: list[View], part: float, shares: tuple[float, float]) -> list[Taught]:
        """What either view learns of the other: documents that the other is
        surest of, at most this part of all and of either label its share, so
        that a view that is sure of one label alone teaches nothing. Of n
        documents alike, sampled at a rate r, n r are expected: one with that
        chance if it is below 1, else one row of that weight."""

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, n, steps = _read(batch, views)
                for view, label in ((0, 0), (0, 1), (1, 0), (1, 1)):
                    step, at = np.unique(steps[view][label], return_inverse=True)
                    total = np.bincount(at, weights=n, minlength=len(step)).astype(np.int64)
                    some = step >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), 2 * view + label)), pa.array(step[some]), pa.array(total[some])], names=["kind", "step", "n"])

        # at most 4 * 60 * STEPS rows
        counts: list[dict[int, int]] = [{}, {}, {}, {}]
        for r in self.rows.mapInArrow(count, "kind long, step long, n long").groupBy("kind", "step").agg(F.sum("n").alias("n")).collect():
            counts[r["kind"]][r["step"]] = r["n"]
        ends = []
        for view in (0, 1):
            sure = [sum(c.values()) for c in counts[2 * view : 2 * view + 2]]
            # so many that either label keeps its share
            most = min(part * self.size, *(n / share for n, share in zip(sure, shares, strict=True)))
            ends += [last_step(counts[2 * view + label], int(most * shares[label])) for label in (0, 1)]
        rates = [min(1.0, self.taught_most / max(1, ends[2 * view][2] + ends[2 * view + 1][2])) for view in (0, 1)]

        def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, n, steps = _read(batch, views)
                lot = lots(np.concatenate(codes, axis=1))
                for view, label in ((0, 0), (0, 1), (1, 0), (1, 1)):
                    step, (last, share, _) = steps[view][label], ends[2 * view + label]
                    expected = n * rates[view] * np.where(step > last, 1.0, np.where(step == last, share, 0.0)) * (step >= 0)
                    some = np.flatnonzero(lot < expected)
                    kinds = (np.full(len(some), 1 - view), np.full(len(some), float(label)), np.maximum(expected[some], 1.0))
                    yield pa.RecordBatch.from_arrays([pa.array(kinds[0]), _as_binary(codes[1 - view][some]), *map(pa.array, kinds[1:])], names=["view", "codes", "label", "weight"])

        # about taught_most rows for either view
        found = sorted(self.rows.mapInArrow(take, "view long, codes binary, label double, weight double").collect(), key=tuple)
        out = []
        for view, width in enumerate(len(v.edges) for v in views):
            own = [r for r in found if r["view"] == view]
            out.append((_as_codes([r["codes"] for r in own], width), np.array([r["label"] for r in own], dtype=np.float64), np.array([r["weight"] for r in own], dtype=np.float64)))
        return out


def co_train(labelled: list[np.ndarray], y: np.ndarray, pool: Callable[[list[View]], Pool], rounds: int = ROUNDS, seed: int = 3) -> CoTrained:
    """labelled: the features of either view; pool: all documents, given the
    views. Without documents of both labels everything gets the share of good
    labels (1 without any)."""
    if len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 1.0
        basis = [f if len(f) else np.zeros((1, f.shape[1])) for f in labelled]
        odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return CoTrained([View(b) for b in basis], np.array([0.0, 0.0, odds]), 0.0)
    order = np.random.default_rng(seed).permutation(len(y))
    kept = max(1, len(y) // 4)
    if len(np.unique(y[order[kept:]])) < 2 or len(np.unique(y[order[:kept]])) < 2:
        kept = 0
    held, train = (order[:kept], order[kept:]) if kept else (order, order)
    views = [View(f[train]) for f in labelled]
    known = [v.codes(f[train]) for v, f in zip(views, labelled, strict=True)]
    everything = pool(views) if rounds else None
    taught: list[Taught] = [(c[:0], y[:0], y[:0]) for c in known]
    for turn in range(rounds + 1):
        for k, (view, (codes, label, weight)) in enumerate(zip(views, taught, strict=True)):
            view.fit(np.concatenate([known[k], codes]), np.concatenate([y[train], label]), np.concatenate([np.ones(len(train)), weight]))
            view.calibrate(labelled[k][held], y[held])
        if turn < rounds:
            taught = everything.teach(views, SHARE_PER_ROUND * (turn + 1), (1 - y.mean(), y.mean()))
    both = np.stack([*(v.odds(f[held]) for v, f in zip(views, labelled, strict=True)), np.ones(len(held))], axis=1)
    blend = _logistic(both, y[held], np.ones(len(held)), ridge=0.1)
    good = np.sort(_probability(both @ blend)[y[held] == 1])
    threshold = min(0.5, float(good[int(FALSE_REJECTS * len(good))]))
    return CoTrained(views, blend, threshold)


def _features(part: list[bytes], batch: pa.RecordBatch, begin: int, end: int, lang: int, source: int) -> list[np.ndarray]:
    langs, sources = (batch.column(c).slice(begin, end - begin).to_pylist() for c in (lang, source))
    return [text_features(part), metadata_features(part, langs, sources)]


def _collect_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, texts in slabs(batch.column(1)):
            views = _features(texts, batch, begin, end, 2, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), *(pa.array(list(v), pa.list_(pa.float64())) for v in views)], names=["y", "content", "metadata"])


def fit(docs: DataFrame, labels: DataFrame, labelled_most: int = LABELLED_MOST, taught_most: int = TAUGHT_MOST, rounds: int = ROUNDS) -> CoTrained:
    """The classifier from a bounded sample of the labelled docs and from all
    docs. A document labelled more than once gets the majority (none if that
    is a tie); null labels and labels other than 0 and 1 don't count."""
    bounded_batches(docs.sparkSession)
    usable = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.avg("quality").alias("q")).where("q <> 0.5")

    def share(n: int, most: int, *salt: F.Column) -> F.Column:
        return F.pmod(F.xxhash64("doc_id", *salt), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most / max(n, 1)))

    own, label = fresh("id"), fresh("label")
    few = usable.where(share(usable.count(), labelled_most)).select(F.col("doc_id").alias(own), F.when(F.col("q") > 0.5, 1.0).otherwise(0.0).alias(label)).limit(2 * labelled_most)
    columns = [F.col("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")]
    # few is bounded by 2 * labelled_most rows; rows that share a doc_id are drawn from one by one
    labelled = docs.join(F.broadcast(few), F.col("doc_id") == F.col(own))
    train = labelled.where(share(labelled.count(), 2 * labelled_most, F.monotonically_increasing_id())).select(F.col(label).alias("y"), *columns)
    rows = train.mapInArrow(_collect_features, "y double, content array<double>, metadata array<double>").collect()
    rows.sort(key=lambda r: (r["content"], r["metadata"], r["y"]))
    widths = text_features([b""]).shape[1], metadata_features([b""], [None], [None]).shape[1]
    views = [np.array([r[v] for r in rows], dtype=np.float64).reshape(len(rows), w) for v, w in zip(("content", "metadata"), widths, strict=True)]
    return co_train(views, np.array([r["y"] for r in rows], dtype=np.float64), lambda cut: Pool(docs, cut, taught_most), rounds)


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """docs with text_score, metadata_score, score (probabilities of good
    quality) and keep (columns of these names are replaced).

    Whole texts are scored. Null texts are empty, null languages and sources
    values of their own; repeated rows get the same scores, other columns
    pass through; an empty table gives no rows. Needs doc_id, text, lang and
    source.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("text_score", "metadata_score", "score", "keep")
    text, lang, source = (docs.columns.index(c) for c in ("text", "lang", "source"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, texts in slabs(batch.column(text)):
                scores = model.score(_features(texts, batch, begin, end, lang, source))
                rows = [c.slice(begin, end - begin) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*rows, *map(pa.array, scores), pa.array(scores[2] >= model.threshold)], names=[*batch.schema.names, "text_score", "metadata_score", "score", "keep"])

    return map_rows(docs, run, "text_score double, metadata_score double, score double, keep boolean")
