"""License scan by ordered signature rules.

A rule is a regular expression over a text's words (ASCII lower case, joined
by one blank), with keywords without which it is not tried, a label, a
priority and a weight. Most are written by hand (license_notices.py); mentions
of a license's name are put together from the name and the turn of phrase. Of overlapping detections the one of the higher
priority wins, then the longer, then the earlier: a detection inside the
interval of one that won is suppressed. Detections of the base phrases always
stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm import _arrays
from recallgrid.llm._spark import bounded_batches, slabs
from recallgrid.llm.license_notices import NOTICES

#: Phrase and label of the base detections.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, keyword, regular expressions of its names.
NAMES = (
    ("mit", " mit ", (r"mit", r"mit x11")),
    ("mit", " expat ", (r"expat",)),
    ("apache", "apache", (r"apache(?: software)?", r"apache 2(?: 0)?")),
    ("apache", "asl 2", (r"asl 2(?: 0)?",)),
    ("agpl", "affero", (r"(?:gnu )?affero general public", r"gnu affero gpl")),
    ("lgpl", "general public", (r"(?:gnu )?lesser general public", r"(?:gnu )?library general public", r"gnu library or lesser general public")),
    ("gpl", "general public", (r"(?:gnu )?general public",)),
    ("gpl", "gpl", (r"gnu gpl", r"gpl ?v?[123]?")),
    ("lgpl", "lgpl", (r"gnu lgpl", r"lgpl ?v?[23]?(?: 1)?")),
    ("agpl", "agpl", (r"gnu agpl", r"agpl ?v?3?")),
    ("mpl", "mozilla", (r"mozilla public",)),
    ("epl", "eclipse", (r"eclipse public", r"eclipse distribution")),
    ("cddl", "common development", (r"common development and distribution",)),
    ("bsd", " bsd ", (r"bsd", r"(?:simplified|modified|revised|new|original) bsd", r"(?:two|three|four|[0234]) clause bsd", r"bsd [0234] clause")),
    ("isc", " isc ", (r"isc",)),
    ("isc", "internet systems", (r"internet systems consortium",)),
    ("zlib", " zlib ", (r"zlib", r"zlib libpng")),
    ("boost", "boost", (r"boost software",)),
    ("artistic", "artistic", (r"artistic", r"perl artistic")),
    ("wtfpl", "wtfpl", (r"wtfpl",)),
    ("eupl", "european union", (r"european union public",)),
    ("upl", "universal permissive", (r"universal permissive",)),
    ("ofl", "open font", (r"(?:sil )?open font",)),
    ("odbl", "open data", (r"open database", r"open data commons open database")),
    ("psf", "python", (r"python software foundation", r"python")),
    ("php", " php ", (r"php",)),
    ("ms-pl", "microsoft public", (r"microsoft public",)),
    ("unlicense", "unlicense", (r"unlicense",)),
    ("cc-by-nc-sa", "sharealike", (r"(?:creative commons )?attribution non ?commercial sharealike",)),
    ("cc-by-sa", "sharealike", (r"(?:creative commons )?attribution sharealike",)),
    ("cc-by-nc", "commercial", (r"(?:creative commons )?attribution non ?commercial",)),
    ("cc-by", "creative commons", (r"creative commons attribution",)),
)

#: Keyword besides the name's, priority, weight and the expression of a mention of a license's name.
MENTIONS = (
    (" under ", 50, 0.95, r"(?:is |are |be )?(?:licensed|released|distributed|published|available|made available|redistributed) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name})(?: licen[sc]e)?(?: version)?(?: v?\d+(?: \d+)?)?"),
    ("licen", 45, 0.9, r"(?:subject to|under|covered by|governed by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name}) licen[sc]e(?: version)?(?: v?\d+(?: \d+)?)?"),
    ("licen", 40, 0.8, r"(?:{name}) licen[sc]e(?: version)?(?: v?\d+(?: \d+)?)?(?: or (?:any )?later(?: version)?)?"),
    ("licen", 35, 0.7, r"licen[sc]e (?:is )?(?:the )?(?:{name})(?: licen[sc]e)?"),
)

#: SPDX families: label, identifiers.
SPDX = (
    ("mit", r"mit(?: 0)?"), ("apache", r"apache [12] [01]"), ("gpl", r"gpl [123] 0(?: only| or later)?"), ("lgpl", r"lgpl [23] [01](?: only| or later)?"),
    ("agpl", r"agpl [13] 0(?: only| or later)?"), ("bsd", r"(?:0bsd|bsd [1234] clause)"), ("mpl", r"mpl [12] [01]"), ("epl", r"epl [12] 0"), ("isc", r"isc"),
    ("cc0", r"cc0 1 0"), ("zlib", r"zlib"), ("boost", r"bsl 1 0"), ("unlicense", r"unlicense"), ("artistic", r"artistic [12] 0"), ("ofl", r"ofl 1 [01]"), ("eupl", r"eupl 1 [012]"),
)


class Rule(NamedTuple):
    label: str
    #: all of these are in what the expression matches, with a blank on both sides of it
    keywords: tuple[str, ...]
    priority: int
    weight: float
    pattern: re.Pattern


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first."""
    found = [(label, (keyword,), priority, weight, pattern) for label, keyword, priority, weight, pattern in NOTICES]
    found += [(label, (keyword, also), priority, weight, mention.format(name=name)) for label, keyword, names in NAMES for name in names for also, priority, weight, mention in MENTIONS]
    found += [(label, ("spdx",), 100, 1.0, rf"spdx license identifier {identifier}") for label, identifier in SPDX]
    # the Creative Commons short forms are built from their parts
    for parts in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        label = f"cc {parts}".replace(" ", "-")
        found += [(label, ("cc by",), 70 + len(parts), 0.9, rf"(?:licensed under )?(?:a )?(?:creative commons )?cc {parts}(?: \d 0)?")]
    found.sort(key=lambda r: -r[2])
    return tuple(Rule(label, keywords, priority, weight, re.compile(rf"(?<![0-9a-z\u0080-\U0010ffff])(?:{pattern})(?![0-9a-z\u0080-\U0010ffff])")) for label, keywords, priority, weight, pattern in found)


@cache
def keywords() -> tuple[str, ...]:
    return tuple(sorted({keyword for rule in rules() for keyword in rule.keywords}))


def _uncontained(found: list[tuple]) -> list[tuple[int, int, Rule]]:
    """The detections, in the order given, that no interval taken before holds.

    A tree of running maxima over the starts knows how far the intervals that
    start at or before a place reach."""
    rank = {s: k + 1 for k, s in enumerate(sorted({x[2] for x in found}))}
    reach = [0] * (len(rank) + 1)
    won = []
    for _, _, start, end, rule in found:
        k, farthest = rank[start], 0
        while k:
            farthest = max(farthest, reach[k])
            k &= k - 1
        if farthest >= end:
            continue
        won.append((start, end, rule))
        k = rank[start]
        while k < len(reach):
            reach[k] = max(reach[k], end)
            k += k & -k
    return won


WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Scan(NamedTuple):
    """What is found in one text; spans: label, first word, word after the last."""

    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: list[str]
    labels: list[str]
    score: float
    spans: list[tuple[str, int, int]]


NOTHING = Scan(0, None, None, [], [], 0.0, [])


def scan(lowered: bytes) -> Scan:
    """The detections in a text in ASCII lower case."""
    words = [w.decode("utf-8", "replace") for w in WORD.findall(lowered)]
    joined = f" {' '.join(words)} "
    # the keyword prefilter: most texts hold few keywords, and so need few expressions or none
    present = {keyword for keyword in keywords() if keyword in joined}
    tried = [rule for rule in rules() if present.issuperset(rule.keywords)] if present else []
    if not tried and not any(phrase in joined for phrase, _ in BASE):
        return NOTHING
    begins = np.cumsum([1] + [len(w) + 1 for w in words])

    def word_at(place: int) -> int:
        return int(np.searchsorted(begins, place))

    base, spans = [], []
    for phrase, label in BASE:
        at = joined.find(f" {phrase} ")
        while at >= 0:
            base.append((word_at(at + 1), label))
            spans.append((label, base[-1][0], base[-1][0] + phrase.count(" ") + 1))
            at = joined.find(f" {phrase} ", at + 1)
    found = [(-rule.priority, m.start() - m.end(), m.start(), m.end(), rule) for rule in tried for m in rule.pattern.finditer(joined)]
    won = _uncontained(sorted(found, key=lambda x: x[:3]))
    spans += [(rule.label, word_at(s), word_at(e + 1)) for s, e, rule in won]
    labels = {label for _, label in base}
    score = max([rule.weight for *_, rule in won] + [0.8] * bool(base), default=0.0)
    places = [p for p, _ in base]
    return Scan(len(base), min(places, default=None), max(places, default=None), sorted(labels), sorted(labels | {r.label for *_, r in won}), score, sorted(set(spans), key=lambda x: (x[1], x[2], x[0])))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base (all places of
    the base phrases), first_word, last_word (their least and greatest start,
    words from 0; null without any), base_labels and labels (distinct, sorted,
    comma-joined; empty if there are none), score (the greatest weight of a
    detection that stays, 0 to 1) and spans (label, start, end: words).

    Whole texts are scanned. Words are runs of ASCII letters and digits and of
    all characters beyond ASCII; null texts are empty. Repeated rows and null
    doc_ids are kept, other columns not read; an empty table gives no rows.
    """

    bounded_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, texts in slabs(batch.column(1)):
                raw = _arrays.LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
                inside = WORD_BYTES[raw]
                starts = inside.copy()
                starts[1:] &= ~inside[:-1]
                stops = np.cumsum([len(t) + 1 for t in texts])
                upto = np.concatenate([[0], np.cumsum(starts)[stops - 1]])
                lowered = raw.tobytes()
                found = [scan(lowered[a : b - 1]) for a, b in zip(np.concatenate([[0], stops[:-1]]), stops, strict=True)]
                spans = [[{"label": a, "start": b, "end": c} for a, b, c in f.spans] for f in found]
                columns = [
                    batch.column(0).slice(begin, end - begin), pa.array(np.diff(upto).astype(np.int64)), pa.array([f.n_base for f in found], pa.int64()),
                    pa.array([f.first_word for f in found], pa.int64()), pa.array([f.last_word for f in found], pa.int64()),
                    pa.array([",".join(f.base_labels) for f in found], pa.string()), pa.array([",".join(f.labels) for f in found], pa.string()), pa.array([f.score for f in found], pa.float64()),
                    pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id"), "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: int, end: int>>")
