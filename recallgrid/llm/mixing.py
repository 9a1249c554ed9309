"""Mixing of sources to target weights by Pfair scheduling.

A source's documents come in blocks, and one block is taken per slot. The
fluid schedule gives every source with blocks left its weight's share of each
slot: by virtual time v a source of weight w has had min(blocks, w v), and
t(v) is the sum of that over the sources. Block k (from 0) may be taken from
slot floor(t(k / w)) on (release) and must be before slot ceil(t((k + 1) / w))
(deadline). The fluid schedule itself meets these windows by fractions, so
earliest deadline first meets them by whole blocks: over the whole run no
source is ever a whole block ahead of or behind its fluid share, also when
others run out. No document is left out or repeated.

Between two sources' ends the windows repeat every D slots, D being the sum of
the weights of those that are left. The schedule is worked out slot by slot
only until it repeats, too; the slots of all further blocks follow from their
numbers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallgrid.llm._spark import Scratch, fresh

BLOCK_DOCS = 16
PARTS = 1000
BUCKET_DOCS = 50_000
PIECE_BLOCKS = 65_536
PLAN_ROWS = 500_000


class Fluid:
    """The fluid schedule of sources, given as (blocks, weight)."""

    def __init__(self, sources: list[tuple[int, int]]):
        self.sources = sources
        #: sources by the virtual time of their end, a whole number of blocks over a weight
        self.ends = sorted(range(len(sources)), key=lambda s: (_Ratio(*sources[s]), s))
        # of each phase: blocks of the sources that have ended, weight of the others
        self.done, self.weight = [0], [sum(w for _, w in sources)]
        for s in self.ends:
            self.done.append(self.done[-1] + sources[s][0])
            self.weight.append(self.weight[-1] - sources[s][1])

    def phase(self, k: int, w: int, phase: int) -> int:
        """The phase, at or after the given one, of virtual time k / w."""
        while phase < len(self.ends):
            blocks, weight = self.sources[self.ends[phase]]
            if k * weight < blocks * w:
                break
            phase += 1
        return phase

    def release(self, k: int, w: int, phase: int) -> int:
        return self.done[phase] + self.weight[phase] * k // w

    def deadline(self, k: int, w: int, phase: int) -> int:
        return self.done[phase] - (-self.weight[phase] * k // w)


class _Ratio(NamedTuple):
    over: int
    under: int

    def __lt__(self, other: _Ratio) -> bool:  # type: ignore[override]
        return self.over * other.under < other.over * self.under


class Run(NamedTuple):
    """Blocks first..last-1 of a source. Block first + q len(slots) + r has
    slot, release and deadline slots[r], ... + q period."""

    source: int
    phase: int
    first: int
    last: int
    period: int
    slots: list[int]
    releases: list[int]
    deadlines: list[int]


def schedule(sources: list[tuple[int, int]]) -> Iterator[Run]:
    """The runs of all blocks, by earliest deadline first (of equal deadlines
    the earlier source)."""
    fluid = Fluid(sources)
    left = sum(n for n, _ in sources)
    taken = [0] * len(sources)
    at = [0] * len(sources)  # the phase of each source's next release
    coming = [(0, s) for s, (n, _) in enumerate(sources) if n]
    waiting: list[tuple[int, int, int]] = []  # deadline, source, release
    rows: dict[int, Run] = {}  # what has been worked out slot by slot since the last repetition

    def note(s: int, phase: int, slot: int, release: int, deadline: int) -> Run | None:
        """Adds a slot to a source's run; gives the run before, if that ends here."""
        old = rows.get(s)
        if old is None or old.phase != phase or len(old.slots) >= PIECE_BLOCKS:
            rows[s] = Run(s, phase, taken[s], taken[s] + 1, 0, [slot], [release], [deadline])
            return old
        for values, value in ((old.slots, slot), (old.releases, release), (old.deadlines, deadline)):
            values.append(value)
        rows[s] = old._replace(last=taken[s] + 1)
        return None

    t, phase = 0, 0
    marks: dict[int, tuple[int, dict[int, int]]] = {}  # of the phase: slot of the last mark, blocks taken then
    history: list[tuple[int, int, int, int]] = []  # since that mark: source, slot, release, deadline
    while left:
        while coming and coming[0][0] <= t:
            release, s = heapq.heappop(coming)
            w = sources[s][1]
            end = fluid.phase(taken[s] + 1, w, at[s])
            heapq.heappush(waiting, (fluid.deadline(taken[s] + 1, w, end), s, release))
        deadline, s, release = heapq.heappop(waiting)
        if old := note(s, at[s], t, release, deadline):
            yield old
        history.append((s, t, release, deadline))
        taken[s] += 1
        left -= 1
        t += 1
        if taken[s] < sources[s][0]:
            at[s] = fluid.phase(taken[s], sources[s][1], at[s])
            heapq.heappush(coming, (fluid.release(taken[s], sources[s][1], at[s]), s))
        while phase < len(fluid.ends) and fluid.done[phase] * sources[fluid.ends[phase]][1] + fluid.weight[phase] * sources[fluid.ends[phase]][0] <= t * sources[fluid.ends[phase]][1]:
            phase += 1
            marks.clear()
        period = fluid.weight[phase] if phase < len(fluid.ends) else 0
        if not period:
            continue
        mark = marks.get(phase)
        if mark is None or t - mark[0] == period:
            alive = [s for s in fluid.ends[phase:] if taken[s] < sources[s][0]]
            steady = len(alive) == len(fluid.ends) - phase and all(at[s] == phase for s in alive)
            if steady and mark is not None and all(taken[s] - mark[1].get(s, -1) == sources[s][1] for s in alive):
                ending = sources[fluid.ends[phase]]
                # blocks whose windows end by this phase's end, over what a period takes
                times = min((ending[0] * sources[s][1] // ending[1] - taken[s]) // sources[s][1] for s in alive) - 1
                if times > 0:
                    yield from rows.values()
                    rows.clear()
                    own: dict[int, list[tuple[int, int, int, int]]] = {s: [] for s in alive}
                    for x in history:
                        own[x[0]].append(x)
                    for s in alive:
                        w = sources[s][1]
                        yield Run(s, phase, taken[s], taken[s] + times * w, period, *([x[k] + period for x in own[s]] for k in (1, 2, 3)))
                        taken[s] += times * w
                    left -= times * sum(sources[s][1] for s in alive)
                    t += times * period
                    coming, waiting = [], []
                    for s in alive:
                        w = sources[s][1]
                        at[s] = fluid.phase(taken[s], w, at[s])
                        coming.append((fluid.release(taken[s], w, at[s]), s))
                    heapq.heapify(coming)
            marks = {phase: (t, {s: taken[s] for s in alive} if steady else {})}
            history = []
    yield from rows.values()


def tempered(counts: dict[str, int], power: float = 0.5, parts: int = PARTS) -> dict[str, int]:
    """Whole weights of about parts in all, in proportion to count**power."""
    total = sum(n**power for n in counts.values())
    return {k: max(1, round(parts * n**power / total)) for k, n in counts.items()}


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def _plan(scratch: Scratch, counts: dict[str, int], weights: dict[str, int], block_docs: int) -> DataFrame:
    """(key, piece, phase, first, last, period, times): the runs, times being
    structs of slot, release and deadline; a row for each piece of
    PIECE_BLOCKS blocks that a run touches. Written by PLAN_ROWS slots."""
    keys = sorted(counts)
    times = pa.list_(pa.struct([("slot", pa.int64()), ("release", pa.int64()), ("deadline", pa.int64())]))
    kinds = pa.schema([("key", pa.string()), ("phase", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("period", pa.int64()), ("times", times)])
    parts: list[DataFrame] = []
    held: list[tuple] = []
    size = 0

    def write() -> None:
        table = pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
        parts.append(scratch.keep(scratch.spark.createDataFrame(table)))
        held.clear()

    for run in schedule([(-(-counts[k] // block_docs), weights[k]) for k in keys]):
        held.append((keys[run.source], run.phase, run.first, run.last, run.period, [{"slot": a, "release": b, "deadline": c} for a, b, c in zip(run.slots, run.releases, run.deadlines, strict=True)]))
        size += len(run.slots)
        if size >= PLAN_ROWS:
            write()
            size = 0
    if held or not parts:
        held or held.append(("", 0, 0, 0, 0, []))
        write()
    runs = parts[0]
    for part in parts[1:]:
        runs = runs.unionByName(part)
    pieces = F.sequence(F.floor(F.col("first") / PIECE_BLOCKS), F.floor((F.col("last") - 1) / PIECE_BLOCKS))
    return runs.where("first < last").withColumn("piece", F.explode(pieces))


def _numbered(rows: DataFrame, counts: dict[str, int]) -> DataFrame:
    """rows (key, h, ...) with number, from 0 within their key in the order of
    h: they are numbered within buckets, and buckets by a running sum."""
    buckets = max(512, 2 ** math.ceil(math.log2(max(1, sum(counts.values()) / BUCKET_DOCS))))
    placed = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sizes = placed.groupBy("key", "bucket").count()
    before = sizes.select("key", "bucket", (F.sum("count").over(Window.partitionBy("key").orderBy("bucket")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "row"))
    ranked = placed.withColumn("rank", rank).join(before, ["key", "bucket"])
    return ranked.withColumn("number", F.col("before") + F.col("rank") - 1).drop("bucket", "rank", "before")


def _places(scratch: Scratch, rows: DataFrame, weights: dict[str | None, int] | None, block_docs: int) -> DataFrame:
    """rows (row, doc_id, source) with the columns that mix() adds."""
    order = F.when(F.col("doc_id").isNull(), F.xxhash64("row", "source")).otherwise(F.xxhash64("doc_id", "source"))
    rows = rows.select("row", "doc_id", "source", _key(F.col("source").cast("string")).alias("key"), order.alias("h"))
    # a few numbers for each source
    counts = {r["key"]: r["count"] for r in rows.groupBy("key").count().collect()}
    chosen = tempered(counts) if weights is None else {"null" if k is None else f"={k}": w for k, w in weights.items()}
    if missing := sorted(k for k in counts if chosen.get(k, 0) < 1):
        raise ValueError(f"no weight of at least 1 for {missing[:5]}")
    number = F.col("number")
    numbered = _numbered(rows, counts).select("row", "doc_id", "source", "key", F.floor(number / block_docs).cast("long").alias("block"), (number % block_docs).alias("inside"))
    numbered = numbered.withColumn("piece", F.floor(F.col("block") / PIECE_BLOCKS))
    plan = _plan(scratch, counts, chosen, block_docs).withColumnsRenamed({"key": "k", "piece": "p"})
    # a piece holds PIECE_BLOCKS blocks of a source at most
    joined = numbered.join(plan.hint("merge"), (F.col("key") == F.col("k")) & (F.col("piece") == F.col("p")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("last")))
    k, size = F.col("block") - F.col("first"), F.size("times")
    whole = F.floor(k / size).cast("long") * F.col("period")
    time = F.get("times", (k % size).cast("int"))
    found = joined.select("row", "doc_id", "source", F.col("phase").alias("mix_phase"), F.col("block").alias("mix_block"), (whole + time["release"]).alias("mix_release"), (whole + time["deadline"]).alias("mix_deadline"), (whole + time["slot"]).alias("mix_slot"), "inside")
    return found.withColumn("mix_place", F.col("mix_slot") * block_docs + F.col("inside")).drop("inside")


def mix(docs: DataFrame, weights: dict[str | None, int] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row for each row of docs: doc_id, source, mix_phase (how many
    sources had run out when its block might begin), mix_block (of its
    source), mix_release and mix_deadline (slots between which the block may
    come), mix_slot, and mix_place, by which the mixed corpus is in order.

    weights: whole numbers of at least 1 for all sources, else ValueError; by
    default in proportion to the square root of a source's documents. Within
    a source documents come in the order of a hash of doc_id (of null doc_ids
    of the row's place in the table). A null source is one of its own.
    Repeated rows count each. There may be any number of sources; the driver
    holds a few numbers for each. Other columns are not read; an empty table
    gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source"))
    return _places(scratch, rows, weights, block_docs).drop("row")


def mixed(docs: DataFrame, weights: dict[str | None, int] | None = None, block_docs: int = BLOCK_DOCS, whole: bool = True) -> DataFrame:
    """All rows and columns of docs, in the order of the mix: by partitions,
    and within them. A partition holds a run of slots.

    whole=False: the mix ends where the first source runs out, so that what
    it holds has the target weights.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    row, place = fresh("row"), fresh("place")
    # texts are written once with a number, so that each row finds its own place
    numbered = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()))
    places = _places(scratch, numbered.select(F.col(row).alias("row"), "doc_id", "source"), weights, block_docs)
    places = scratch.keep(places.where(F.lit(whole) | (F.col("mix_phase") == 0)).select(F.col("row").alias(row), F.col("mix_place").alias(place)))
    last = places.agg(F.max(place)).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = numbered.join(places.hint("merge"), row)
    part = F.floor(F.col(place) * parts / (last + 1)).cast("int")
    return joined.repartitionById(parts, part).sortWithinPartitions(place).drop(row, place).select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])
