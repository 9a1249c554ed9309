"""The training-data operators against brute force, the library or planted cases."""

import hashlib
import itertools
import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from recallgrid.llm import _arrays, embedding_dedup, licenses, line_dedup, mixing, permutation_index, quality, queries, sentencepiece_codec, simhash, simhash_wide, substrings, warc
from recallgrid.llm._spark import Scratch, components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCS)


EDGE_ROWS = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "a b c d e f"), (4, "  \n\t "), (5, "é漢 ü\n" * 40)]


@pytest.fixture(params=["edge", "empty", "extra"])
def odd(request, spark):
    """Tables that operators must take: nulls and short texts, no rows, clashing columns."""
    df = docs(spark, EDGE_ROWS if request.param != "empty" else [])
    if request.param == "extra":
        for name in ("h", "p", "key", "fp", "root", "tag", "n_lines", "keep", "score", "ids", "bucket", "id", "a", "b", "row", "spans", "__place", "__doc", "__own", "__id", "place", "a`b", "number", "piece"):
            df = df.withColumn(name, F.lit("x"))
    return df


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def component_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


# -- shared ----------------------------------------------------------------


def test_xxh64_equals_library():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abc dE\n") for _ in range(rng.randrange(200))) for _ in range(200)] + [b"", b" "]
    w = _arrays.Words(texts)
    span = np.array([rng.randrange(1, 15) for _ in w.start])
    last = np.minimum(np.arange(len(span)) + span, len(span)) - 1
    size = w.start[last] + w.size[last] - w.start
    got = _arrays.xxh64(w.data, w.start, size)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(w.data[s : s + n].tobytes(), 42) for s, n in zip(w.start, size, strict=True)]
    assert [w.data[a : a + n].tobytes() for a, n in zip(w.start, w.size, strict=True)] == [x for t in texts for x in t.split()]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 5000 + k) for k in range(1, 60)]
    want = component_of({x for link in links for x in link}, links)
    got = {r.id: r.root for r in components(Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 ---------------------------------------------------------------------


def brute_fingerprint(text):
    w = words_of(lower(text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(40)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(60, 200))] for _ in range(12)]
    rows = list(EDGE_ROWS)
    for k in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((100 + k, " ".join(w)))
    rows += [(400, " ".join(rng.choice(vocabulary) for _ in range(6000))), (401, "long " * 2000)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = component_of(range(len(rows)), near)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root[i]].append(d)
    want = sorted(((d is None, d or 0), f"{fps[i]:016x}", min((x for x in least[root[i]] if x is not None), default=None)) for i, (d, _) in enumerate(rows))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint, r.component_id) for r in got) == want


def test_every_four_positions_hold_a_triple():
    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in simhash.FOURS)


def test_tally_of_shared_bytes():
    rng = np.random.default_rng(30)
    a, b = rng.integers(0, 3, (500, 8)).astype(np.uint8), rng.integers(0, 3, (500, 8)).astype(np.uint8)
    b[:50] |= 128
    got = simhash.shared_bytes(a.view(np.int64).ravel(), b.view(np.int64).ravel())
    assert got.tolist() == (a == b).sum(1).tolist()


@pytest.mark.parametrize("most", [5, 20, 100_000])
def test_long_lists_are_posted_again(spark, most):
    rng = random.Random(4)
    fps = {0x0123456789ABCDEF ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for _ in range(150)}
    fps |= {rng.getrandbits(64) & 0xFFFF00000000FFFF for _ in range(200)}
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = component_of(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4])
    links = simhash.fingerprint_links(Scratch(spark, "t"), frame, list_most=most).collect()
    assert component_of(signed, [(r.a, r.b) for r in links]) == want


def test_simhash_takes_odd_tables(odd):
    assert simhash.near_duplicates(odd).count() == odd.count()


def jaccard(a, b):
    def shingles(t):
        w = words_of(lower(t))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_representatives_catch_near_copies(spark):
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(3000)]
    rows, near = [], []
    for k in range(60):
        w = [rng.choice(vocabulary) for _ in range(200)]
        rows.append((k, " ".join(w)))
        w[rng.randrange(200)] = "changed"
        w[rng.randrange(200)] = "changed"
        near.append((100 + k, " ".join(w)))
    kept = sorted(r.doc_id for r in simhash_wide.representatives(docs(spark, rows + near)).collect())
    assert min(jaccard(a[1], b[1]) for a, b in zip(rows, near, strict=True)) > 0.85
    assert kept == [r[0] for r in rows]


def test_representatives_do_not_depend_on_list_length(spark, monkeypatch):
    rng = random.Random(15)
    common = [f"c{k}" for k in range(220)]
    rows = []
    for k in range(120):
        w = common + [f"w{k}-{n}" for n in range(60)]
        rows.append((k, " ".join(w)))
        for n in range(3):
            at = rng.randrange(300)
            rows.append((1000 * (n + 1) + k, " ".join(x if i not in (at, at // 2, at // 3, at // 4, at // 5) else "changed" for i, x in enumerate(w))))
    kept = []
    for most in (10**6, 40, 4):
        monkeypatch.setattr(simhash_wide, "LIST_MOST", most)
        kept.append(sorted(r.doc_id for r in simhash_wide.representatives(docs(spark, rows)).collect()))
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) < len(rows)


def test_representatives_take_odd_tables(odd):
    got = simhash_wide.representatives(odd)
    assert got.columns == odd.columns and got.count() == (0 if not odd.count() else 4)


# -- 2 ---------------------------------------------------------------------


def fluid(sources):
    """What each source has had before every slot, by whole weights' shares of those with blocks left."""
    had, out = [Fraction(0)] * len(sources), []
    for _ in range(sum(n for n, _ in sources)):
        out.append(list(had))
        room = Fraction(1)
        while room:
            alive = [s for s, (n, _) in enumerate(sources) if had[s] < n]
            total = sum(sources[s][1] for s in alive)
            step = min([room] + [(sources[s][0] - had[s]) * total / sources[s][1] for s in alive])
            for s in alive:
                had[s] += step * sources[s][1] / total
            room -= step
    return [*out, [Fraction(n) for n, _ in sources]]


def brute_schedule(sources, had):
    """(slot, release, deadline) of each (source, block), every slot simulated."""
    total = len(had) - 1
    windows = {(s, k): (max(t for t in range(total + 1) if had[t][s] <= k), min(t for t in range(total + 1) if had[t][s] >= k + 1)) for s, (n, _) in enumerate(sources) for k in range(n)}
    number, out = [0] * len(sources), {}
    for t in range(total):
        s = min((windows[s, k][1], s) for s, k in enumerate(number) if k < sources[s][0] and windows[s, k][0] <= t)[1]
        out[s, number[s]] = (t, *windows[s, number[s]])
        number[s] += 1
    return out


def spelled_out(sources):
    out = {}
    for run in mixing.schedule(sources):
        for k in range(run.first, run.last):
            q, r = divmod(k - run.first, len(run.slots))
            assert (run.source, k) not in out
            out[run.source, k] = tuple(x[r] + q * run.period for x in (run.slots, run.releases, run.deadlines))
    return out


def test_schedule_equals_simulation():
    rng = random.Random(6)
    for _ in range(40):
        sources = [(rng.randrange(0, 60), rng.randrange(1, 9)) for _ in range(rng.randrange(1, 7))]
        assert spelled_out(sources) == brute_schedule(sources, fluid(sources))


def test_no_source_is_ever_a_block_ahead_or_behind():
    rng = random.Random(5)
    repeated = 0
    for _ in range(20):
        sources = [(rng.randrange(0, 500), rng.randrange(1, 6)) for _ in range(rng.randrange(2, 6))]
        repeated += sum(run.period > 0 for run in mixing.schedule(sources))
        got, had, done = spelled_out(sources), fluid(sources), [0] * len(sources)
        by_slot = {slot: (block, release, deadline) for block, (slot, release, deadline) in got.items()}
        assert sorted(by_slot) == list(range(sum(n for n, _ in sources)))
        for t, ((s, k), release, deadline) in sorted(by_slot.items()):
            assert k == done[s] and release <= t < deadline
            done[s] += 1
            assert all(abs(x - y) < 1 for x, y in zip(done, had[t + 1], strict=True))
    assert repeated > 20


def test_schedule_of_many_blocks_is_short():
    runs = list(mixing.schedule([(10**10, 300), (5 * 10**9, 250), (10**8, 200), (77_777, 100), (3, 60)]))
    assert sum(run.last - run.first for run in runs) == 15 * 10**9 + 10**8 + 77_780
    assert sum(len(run.slots) for run in runs) < 20_000


def test_mix_equals_simulation(spark):
    rng = random.Random(7)
    rows = [(k, "x", rng.choice(["a", "a", "a", "b", "b", "c", None])) for k in range(700)]
    rows += [(None, "x", "b")] * 30 + [(5, "x", "c")] * 2
    weights = {"a": 2, "b": 5, "c": 1, None: 3}
    got = mixing.mix(docs(spark, rows), weights, block_docs=7).collect()
    counts = defaultdict(int)
    for _, _, s in rows:
        counts["null" if s is None else f"={s}"] += 1
    sources = [(-(-counts[k] // 7), {"null" if s is None else f"={s}": w for s, w in weights.items()}[k]) for k in sorted(counts)]
    want = brute_schedule(sources, fluid(sources))
    assert len(got) == len({r.mix_place for r in got}) == len(rows)
    keys = sorted(counts)
    assert {(keys.index("null" if r.source is None else f"={r.source}"), r.mix_block): (r.mix_slot, r.mix_release, r.mix_deadline) for r in got} == want


def test_mix_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PLAN_ROWS", 300)
    df = spark.range(3000).selectExpr("id AS doc_id", "'x' AS text", "concat('site', id % 700) AS source")
    got = mixing.mix(df, block_docs=2).collect()
    assert len({r.mix_place for r in got}) == 3000
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)


def test_mix_up_to_the_first_end_has_the_target_weights(spark):
    df = docs(spark, [(k, "x", "ab"[k % 10 == 0]) for k in range(2000)])
    got = mixing.mixed(df, {"a": 3, "b": 1}, block_docs=5, whole=False).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in got}
    assert n["b"] == 200 and abs(n["a"] - 600) <= 10


def test_mixed_keeps_rows_and_order(spark):
    df = docs(spark, [(k, "x", "ab"[k % 3 == 0]) for k in range(200)])
    place = {r.doc_id: r.mix_place for r in mixing.mix(df, block_docs=4).collect()}
    got = [place[r.doc_id] for r in mixing.mixed(df, block_docs=4).collect()]
    assert got == sorted(got) and len(got) == 200


def test_mix_takes_odd_tables(odd):
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() == odd.count()
    if odd.count():
        with pytest.raises(ValueError):
            mixing.mix(odd, {"other": 1})


# -- 3 ---------------------------------------------------------------------


def brute_base(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses_equal_brute_force(spark):
    rng = random.Random(8)
    pieces = ["MIT License.", "the Apache-License", "GNU General Public License v3", "mit", "license", "x_y é", "General  Public\nLicense", "Lesser General Public License", "naïve", "CC BY-NC 4.0"]
    rows = [(k, rng.choice([" ", ", ", "\n"]).join(rng.choice(pieces) for _ in range(rng.randrange(0, 12)))) for k in range(200)] + [(900, None), (901, "")]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    for d, t in rows:
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("under the GNU Lesser General Public License v2.1", ["gpl", "lgpl"]),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", ["mit"]),
        ("SPDX-License-Identifier: BSD-3-Clause", ["bsd"]),
        ("Licensed under CC BY-NC-SA 4.0", ["cc-by-nc-sa"]),
        ("you may not use this file except in compliance with the License", ["apache"]),
        ("no terms here", []),
    ],
)
def test_license_rules(text, labels):
    assert licenses.scan(text.lower().encode()).labels == labels


def spelled(parsed, rng):
    """A text that a rule's expression matches, its branches and repeats drawn."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "SUBPATTERN":
            out += spelled(arg[3], rng)
        elif name == "BRANCH":
            out += spelled(rng.choice(arg[1]), rng)
        elif name == "MAX_REPEAT":
            out += "".join(spelled(arg[2], rng) for _ in range(rng.randint(arg[0], min(int(arg[1]), arg[0] + 1))))
        elif name == "IN":
            kind, value = rng.choice(arg)
            out += {"LITERAL": lambda v: chr(v), "RANGE": lambda v: chr(rng.randint(*v)), "CATEGORY": lambda v: "7"}[str(kind)](value)
        else:
            assert name in ("ASSERT_NOT", "AT"), name
    return out


def rule_examples(n=30):
    rng = random.Random(12)
    return [(rule, spelled(re._parser.parse(rule.pattern.pattern), rng)) for rule in licenses.rules() for _ in range(n)]


def test_license_keywords_miss_no_rule(monkeypatch):
    """With the keyword prefilter and without it the same is found."""
    spoken = ("released under apache 2 0", "distributed under mit", "available under bsd 3 clause", "published under creative commons attribution 4 0", "permit python misc")
    examples = [(rule, text.replace(" ", "-\n").encode()) for rule, text in rule_examples(3) + [(None, x) for x in spoken]]
    gated = [licenses.scan(text) for _, text in examples]
    free = tuple(rule._replace(keywords=()) for rule in licenses.rules())
    monkeypatch.setattr(licenses, "rules", lambda: free)
    monkeypatch.setattr(licenses, "keywords", lambda: ("",))
    for (_, text), got in zip(examples, gated, strict=True):
        want = licenses.scan(text)
        assert got == want._replace(spans=got.spans) and len(got.spans) == len(want.spans), text
    assert all(got.labels for got in gated[-5:-1]) and not gated[-1].labels


def test_license_rules_are_tried_on_what_they_match():
    from recallgrid.llm import license_notices

    assert len(license_notices.NOTICES) > 200 and len(licenses.rules()) > 400
    assert len({x[4] for x in license_notices.NOTICES}) == len(license_notices.NOTICES)
    for rule, text in rule_examples():
        assert rule.pattern.fullmatch(text) and all(keyword in f" {text} " for keyword in rule.keywords), (rule, text)
    for text, label in (("under the Expat license", "mit"), ("ASL 2.0 license", "apache"), ("Internet Systems Consortium license", "isc")):
        assert licenses.scan(text.lower().encode()).labels == [label]


def test_license_labels_equal_a_plain_scan():
    """Priorities and containment by a plain loop over all rules' matches."""
    rng = random.Random(21)
    pool = [text for _, text in rule_examples(2)] + ["some other words", "mit", "license", "under the"]
    for _ in range(60):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))
        joined = f" {text} "
        found = sorted(((-r.priority, m.start() - m.end(), m.start(), k, m.end(), r) for k, r in enumerate(licenses.rules()) for m in r.pattern.finditer(joined)), key=lambda x: x[:4])
        won = []
        for x in found:
            if not any(s <= x[2] and x[4] <= e for s, e, _ in won):
                won.append((x[2], x[4], x[5]))
        base = [label for phrase, label in licenses.BASE if f" {phrase} " in joined]
        got = licenses.scan(text.encode())
        assert got.labels == sorted({r.label for *_, r in won} | set(base)), text
        assert got.score == max([r.weight for *_, r in won] + [0.8] * bool(base), default=0.0)


def test_licenses_take_odd_tables(odd):
    assert licenses.scan_licenses(odd).count() == odd.count()


# -- 4 ---------------------------------------------------------------------


def brute_lines(rows):
    seen, out = set(), []
    for d, t in sorted(rows):
        lines = t.split("\n")
        gone = [False] * len(lines)
        for p in range(len(lines) - 2):
            k = tuple(lines[p : p + 3])
            if not "".join(k).strip():
                continue
            if k in seen:
                gone[p : p + 3] = [True] * 3
            seen.add(k)
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(k, "\n".join(rng.choice(["a", "b", "", "c d", "é"]) for _ in range(rng.randrange(1, 14)))) for k in range(150)]
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(docs(spark, rows)).collect())
    assert got == brute_lines(rows)


def test_lines_take_odd_tables(odd):
    got = line_dedup.dedup_lines(odd)
    assert got.count() == odd.count()
    assert {r.n_lines for r in got.where("text is null").collect()} <= {0}


def test_lines_of_a_very_long_text(spark):
    """A text's windows take time in proportion to its lines."""
    text = "\n".join(f"line {k % 700} of many" for k in range(60_000))
    df = docs(spark, [(1, text), (2, "x")]).withColumn("__cuts", F.lit(1)).withColumn("__doc", F.lit(2)).withColumn("a`b", F.lit("c"))
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    by_id = {r.doc_id: (r.n_lines, r.n_removed, r["a`b"]) for r in got.collect()}
    # line 700 on begins the later occurrences
    assert by_id == {1: (60_000, 60_000 - 700, "c"), 2: (1, 0, "c")}


# -- 5 and 6 ---------------------------------------------------------------


def vectors(spark, seed=10, n=600, dim=16):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    for k in range(0, n // 2):
        m[k] = m[k % 40] + 0.06 * rng.normal(size=dim)
    m[100] = m[200]
    rows = [(k, x.tolist(), 0) for k, x in enumerate(m)]
    odd = [(n, None, 0), (n + 1, [0.0] * dim, 0), (n + 2, [float("nan")] * dim, 0), (n + 3, [1.0, None], 0), (n + 4, [float("inf")] + [1.0] * (dim - 1), 0), (n + 5, [1.0, 2.0], 0), (None, m[7].tolist(), 0), (3, m[3].tolist(), 0), (n + 6, [], 0)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"), rows + odd


def test_embedding_dedup_equals_brute_force(spark):
    df, rows = vectors(spark)
    got = embedding_dedup.near_duplicates(df.withColumn("links", F.lit(1)).withColumn("uid", F.lit(2)), block=64).collect()
    good = [(i, np.array(e, dtype=np.float32).astype(float)) for i, (_, e, _) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = [(i, j) for i, a in good for j, b in good if i < j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95]
    root = component_of(range(len(rows)), links)
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[root[i]].append(r[0])
    count = np.bincount([x for link in links for x in link], minlength=len(rows))
    want = sorted((str(r[0]), int(count[i]), min((x for x in members[root[i]] if x is not None), default=None)) for i, r in enumerate(rows))
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_nearest_neighbours_recall(spark):
    df, rows = vectors(spark, seed=11, n=1500)
    got = permutation_index.nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect()
    good = [(i, np.array(e, dtype=np.float32).astype(float)) for i, e, _ in rows if i is not None and e and len(e) == 16 and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    by_query = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by_query[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for i, q in good:
        if i % 100:
            continue
        far = {j: float(np.sqrt(((q - v) ** 2).sum())) for j, v in good if j != i}
        truth = sorted(far, key=lambda j: (far[j], j))[:10]
        assert [x for x in by_query[i]] == sorted(by_query[i], key=lambda x: (x[1], x[0])) and all(far[v] == pytest.approx(s, abs=1e-12) for v, s in by_query[i])
        hits, total = hits + len(set(truth) & {v for v, _ in by_query[i]}), total + len(truth)
    assert hits / total >= 0.95


def test_links_of_extreme_magnitudes(spark):
    rows = [(1, [1e-200, 1e-200, 0.0]), (2, [1e-200, 1.01e-200, 0.0]), (3, [1e200, 1e200, 0.0]), (4, [1.0, 1.0, 0.0]), (5, [5e-324, 0.0, 0.0]), (6, [1.7e308, 0.0, 0.0]), (7, [0.0, 0.0, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_links_in_a_grid_of_many_cells(spark, monkeypatch):
    """10,000 vectors in a grid of 10 x 10 cells, each planted link found."""
    monkeypatch.setattr(embedding_dedup, "CELL_VECTORS", 100)
    rng = np.random.default_rng(17)
    base = rng.normal(size=(5000, 32))
    near = base + 0.2 * rng.normal(size=base.shape) * np.linalg.norm(base, axis=1, keepdims=True) / np.sqrt(32)
    both = np.concatenate([base, near])
    unit = both / np.linalg.norm(both, axis=1, keepdims=True)
    cosine = (unit[:5000] * unit[5000:]).sum(1)
    links = {(a, b) for i in range(0, 10_000, 500) for a, b in zip(*(x.tolist() for x in np.nonzero(unit[i : i + 500] @ unit.T >= 0.95)), strict=True) for a in (a + i,) if a < b}
    count = np.bincount([x for link in links for x in link], minlength=10_000)
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(both.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(frame, block=60).collect()}
    found = sum(got[k] for k in got)
    assert (cosine >= 0.95).sum() > 4000 and all(got[k] <= count[k] for k in got)
    assert found >= 0.998 * count.sum()


def test_neighbours_with_repeated_ids(spark):
    rng = np.random.default_rng(18)
    m = rng.normal(size=(40, 8))
    rows = [(k, x) for k, x in enumerate(m.tolist())] + [(1, (m[0] + 0.001 * k).tolist()) for k in range(15)] + [(2, m[2].tolist())] * 15
    got = permutation_index.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    far = {}
    for k, x in rows:
        if k:
            far[k] = min(far.get(k, np.inf), float(np.sqrt(((np.array(x) - m[0]) ** 2).sum())))
    want = sorted(far, key=lambda k: (far[k], k))[:10]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == want
    assert all(r.score == far[r.vec_id] for r in got)


def test_neighbours_of_extreme_magnitudes(spark):
    rows = [(0, [1e200, 0.0]), (1, [1.5e200, 0.0]), (2, [1e200, 2e200]), (3, [1e-200, 0.0]), (4, [-1.7e308, 0.0])]
    got = permutation_index.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [(r.vec_id, pytest.approx(r.score, rel=1e-12)) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 0.5e200), (3, 1e200), (2, 2e200), (4, 1.7e308)]


def test_vector_operators_take_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(none).count() == 0 and permutation_index.nearest_neighbours(none, F.col("vec_id") % 100 == 0).count() == 0


# -- 7 ---------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.pmod(F.hash("doc_id"), F.lit(4)) == 0
    model = quality.fit(d, labels.where(~held))
    got = quality.score(d, model).join(labels.where(held), "doc_id").collect()
    assert sum((r.score >= 0.5) == r.quality for r in got) / len(got) >= 0.95
    assert all(r.keep for r in got if r.quality == 1)


def plain_logistic(x, y, ridge):
    """Ridge logistic regression by plain Newton steps, one row at a time."""
    beta = [0.0] * len(x[0])
    for _ in range(12):
        gradient, curve = np.zeros(len(beta)), np.zeros((len(beta), len(beta)))
        for row, label in zip(x, y, strict=True):
            p = 1 / (1 + math.exp(-min(30.0, max(-30.0, float(np.dot(row, beta))))))
            gradient += (label - p) * row
            curve += max(p * (1 - p), 1e-6) * np.outer(row, row)
        for k in range(len(beta)):
            pull = 1e-6 if k == len(beta) - 1 else ridge
            gradient[k] -= pull * beta[k]
            curve[k, k] += pull
        step = np.linalg.solve(curve, gradient)
        beta = [b + s for b, s in zip(beta, step, strict=True)]
        if max(abs(step)) < 1e-6:
            break
    return np.array(beta)


def plain_co_training(labelled, y, pool, asked, rounds):
    """The scheme spelled out, document by document: the scores of asked."""

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    order = np.random.default_rng(3).permutation(len(y))
    held, train = order[: len(y) // 4], order[len(y) // 4 :]
    edges = [[sorted(set(np.quantile(f[train][:, c], [i / quality.BINS for i in range(1, quality.BINS)]).tolist())) for c in range(f.shape[1])] for f in labelled]

    def cut(k, features):
        return np.array([*([float(v > e) for v in features[:, c]] for c, es in enumerate(edges[k]) for e in es), [1.0] * len(features)]).T

    cuts = [{name: cut(k, part[k]) for name, part in (("labelled", labelled), ("pool", pool), ("asked", asked))} for k in (0, 1)]
    kinds = [bytes(sum(v > e for e in es) for k in (0, 1) for v, es in zip(pool[k][i], edges[k], strict=True)) for i in range(len(pool[0]))]
    taught = [[], []]
    for turn in range(rounds + 1):
        betas = []
        for k in (0, 1):
            rows = [cuts[k]["labelled"][i] for i in train] + [cuts[k]["pool"][i] for i, _ in taught[k]]
            betas.append(plain_logistic(np.array(rows), [y[i] for i in train] + [label for _, label in taught[k]], 1.0))
        raw = [cuts[k]["labelled"][held] @ betas[k] for k in (0, 1)]
        scales = [plain_logistic(np.stack([r, np.ones(len(r))], axis=1), y[held], 0.01) for r in raw]
        if turn == rounds:
            break
        taught = [[], []]
        for k in (0, 1):
            plain = cuts[k]["pool"] @ betas[k]
            odds = scales[k][0] * plain + scales[k][1]
            # sure by calibrated odds, ranked by those before calibration
            sures = {label: [(i, sign * plain[i] * np.sign(scales[k][0])) for i, s in enumerate(sign * odds) if sigmoid(s) >= quality.SURE] for label, sign in ((1.0, 1), (0.0, -1))}
            shares = {1.0: y.mean(), 0.0: 1 - y.mean()}
            total = min(quality.SHARE_PER_ROUND * (turn + 1) * len(odds), *(len(sures[label]) / shares[label] for label in shares))
            for label, sure in sures.items():
                most = int(total * shares[label])
                steps = defaultdict(list)
                for i, s in sure:
                    steps[math.floor(max(-30, min(s, 30)) * quality.STEPS)].append(i)
                for step in sorted(steps, reverse=True):
                    rows, room = steps[step], most - sum(pseudo == label for _, pseudo in taught[1 - k])
                    if len(rows) <= room:
                        taught[1 - k] += [(i, label) for i in rows]
                        continue
                    # the last step: by lot, and none of this table's kinds there is frequent
                    lot = quality.lots(np.frombuffer(b"".join(kinds[i] for i in rows), np.uint8).reshape(len(rows), -1))
                    assert all(kinds.count(kinds[i]) * room <= len(rows) for i in rows) or room == 0
                    by_kind = {kinds[i]: (i, u) for i, u in zip(rows, lot, strict=True)}
                    taught[1 - k] += [(i, label) for kind, (i, u) in by_kind.items() if u < kinds.count(kind) * room / len(rows)]
                    break
    odds = [scales[k][0] * raw[k] + scales[k][1] for k in (0, 1)]
    blend = plain_logistic(np.stack([*odds, np.ones(len(held))], axis=1), y[held], 0.1)
    last = [scales[k][0] * (cuts[k]["asked"] @ betas[k]) + scales[k][1] for k in (0, 1)]
    return sigmoid(last[0]), sigmoid(last[1]), sigmoid(blend[0] * last[0] + blend[1] * last[1] + blend[2]), [len(t) for t in taught]


@pytest.mark.parametrize("stray, other", [(0.2, "book"), (0.02, "wiki")])
def test_quality_equals_plain_co_training(spark, stray, other):
    """On a table small enough for the samples to be all of it; the metadata
    view is sure of both labels only where few sources are stray."""
    rng = random.Random(22)
    rows, labels = [], []
    for k in range(260):
        good = rng.random() < 0.6
        text = " ".join(rng.choice(["the", "river", "stone", "walks", "slowly"] if good else ["!!!", "BUY", "now", "$$$", "the"]) for _ in range(rng.randrange(5, 60)))
        rows.append((k, text + ("." if good else "!"), "web" if rng.random() < (stray if good else 1 - stray) else other))
        if k < 160:
            labels.append((k, int(good), 0))
    df = docs(spark, rows)
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in quality.score(df, model).collect()}

    def views(part):
        texts = [t.encode() for _, t, _ in part]
        return [quality.text_features(texts), quality.metadata_features(texts, ["en"] * len(part), [s for *_, s in part])]

    def in_order(part, y):
        v = views(part)
        by = sorted(range(len(part)), key=lambda i: (v[0][i].tolist(), v[1][i].tolist(), y[i]))
        return [x[by] for x in v], np.array([y[i] for i in by], dtype=float)

    labelled, y = in_order(rows[:160], [q for _, q, _ in labels])
    pool, _ = in_order(rows, [0] * len(rows))
    content, metadata, both, taught = plain_co_training(labelled, y, pool, views(rows), quality.ROUNDS)
    assert taught[1] > 0 and (taught[0] > 0) == (stray < 0.1)
    for (d, _, _), *want in zip(rows, content, metadata, both, strict=True):
        # sums of many rows differ in their last digits, which Newton's steps carry on
        assert [got[d].text_score, got[d].metadata_score, got[d].score] == pytest.approx(want, abs=1e-4)


def test_text_features_stand_alone():
    texts = [b"one two three two three", b"", b"a", b"b c b c\n\nb c", b"one"]
    assert (quality.text_features(texts) == np.concatenate([quality.text_features([x]) for x in texts])).all()


def test_last_step_takes_whole_steps_and_a_share():
    assert quality.last_step({9: 5, 7: 10, 3: 100}, 15) == (3, 0.0, 15)
    assert quality.last_step({9: 5, 7: 10, 3: 100}, 10) == (7, 0.5, 10)
    assert quality.last_step({9: 5}, 10) == (0, 1.0, 5)
    assert quality.last_step({}, 10) == (0, 1.0, 0)


def test_quality_learns_from_bounded_samples_of_everything(spark):
    """Copies in hundreds and a bound below what the views are sure of: the
    rows taught stay near the bound and stand for all documents."""
    rng = random.Random(5)
    rows = []
    for k in range(3000):
        good = k % 10 > 3
        words = ["the", "river", "stone", "walks", "slowly"] if good else ["!!!", "BUY", "now", "$$$"]
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))) if k > 400 else "the river walks. " * 5
        rows.append((k, text + ("." if good or k <= 400 else "!"), "book" if good or k <= 400 else "web"))
    labels = spark.createDataFrame([(k, int(k % 10 > 3), 0) for k in range(500, 900)], "doc_id long, quality int, toxic int")
    seen, teach = [], quality.Pool.teach

    def watched(self, views, part, shares):
        seen.append((self.size, self.rows.count(), part, shares, teach(self, views, part, shares)))
        return seen[-1][-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality.Pool, "teach", watched)
        model = quality.fit(docs(spark, rows), labels, taught_most=60)
    assert len(seen) == quality.ROUNDS
    for size, kinds, _, _, taught in seen:
        assert size == 3000 and kinds < 3000 - 300
        for codes, label, weight in taught:
            assert len(codes) == len(label) == len(weight) <= 90
            assert not len(codes) or (30 <= weight.sum() <= 90 and (weight >= 1).all())
    assert max(len(codes) for *_, taught in seen for codes, *_ in taught) > 30
    kept = {r.doc_id for r in quality.score(docs(spark, rows), model).collect() if r.keep}
    assert sum((k in kept) == (k % 10 > 3 or k <= 400) for k in range(3000)) >= 2970


def test_quality_takes_odd_tables(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 1, 0), (None, 1, 0), (5, None, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd, labels)
    assert quality.score(odd, model).count() == odd.count()
    none = quality.fit(odd, labels.limit(0))
    assert all(r.keep for r in quality.score(odd, none).collect())


# -- 8 ---------------------------------------------------------------------


def test_canonical_urls(spark):
    cases = {
        "HTTPS://WWW.Example.com:443/A?b=2&a=1&utm_source=x#top": "http://example.com/A?a=1&b=2",
        "http://user@example.com": "http://example.com/",
        "http://example.com:8080/x?ref=y": "http://example.com:8080/x",
        " ftp://x ": "ftp://x",
    }
    got = {r.u: r.c for r in spark.createDataFrame([(u,) for u in cases], "u string").select("u", warc.canonical_url(F.col("u")).alias("c")).collect()}
    assert got == cases


def test_revisits(spark):
    schema = "record_id long, url string, captured long, kind string, headers map<string,string>, digest string"
    rows = [
        (1, "http://a/x", 10, "response", {"etag": '"1"', "content-length": "5", "age": "1"}, "d1"),
        (2, "https://a/x#f", 200_000, "response", {"etag": '"2"', "last-modified": "m"}, "d2"),
        (3, "http://a/x", 300_000, "revisit", {"etag": 'W/"2"', "content-length": "0", "age": "9"}, None),
        (4, "http://a/x", 50, "revisit", {"etag": '"9"'}, None),
        (5, "http://a/x", 5, "revisit", {"etag": '"1"'}, None),
        (6, "http://b/", 50, "revisit", None, None),
        (7, None, 50, "revisit", {}, None),
        (8, "http://a/x", 200_000, "revisit", {}, None),
        (9, "http://a/x", 200_001, "revisit", {"last-modified": "m"}, None),
        (9, "http://a/x", 200_001, "revisit", {"last-modified": "m"}, None),
        (10, "http://a/x", 60, "request", {}, None),
    ]
    got = sorted((r.record_id, r.response_id, r.status, r.headers, r.digest) for r in warc.resolve_revisits(spark.createDataFrame(rows, schema).withColumn("slice", F.lit("x"))).collect())
    assert got == [
        (3, 2, "resolved", {"etag": '"2"', "last-modified": "m", "age": "9"}, "d2"),
        (4, 1, "changed", None, None),
        (5, None, "missing", None, None),
        (6, None, "missing", None, None),
        (7, None, "missing", None, None),
        (8, 2, "unverified", None, None),
        (9, 2, "resolved", {"etag": '"2"', "last-modified": "m"}, "d2"),
        (9, 2, "resolved", {"etag": '"2"', "last-modified": "m"}, "d2"),
    ]
    assert warc.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_a_hot_url_is_cut_finer(spark):
    """One URL, many captures in a day, some in the same second; by brute force."""
    rng = random.Random(23)
    rows = [(k, "http://a/x", rng.randrange(200_000), rng.choice(["response", "revisit"]), {"etag": "e"}, f"d{k}") for k in range(900)]
    frame = spark.createDataFrame(rows, "record_id long, url string, captured long, kind string, headers map<string,string>, digest string")
    found = warc.resolve_revisits(frame, slice_rows=10).collect()
    responses = [(t, i) for i, _, t, kind, _, _ in rows if kind == "response"]
    want = {i: max(((u, j) for u, j in responses if u <= t), default=(None, None))[1] for i, _, t, kind, _, _ in rows if kind == "revisit"}
    assert {r.record_id: r.response_id for r in found} == want


# -- 9 ---------------------------------------------------------------------


def brute_repeats(rows, window=50):
    first, out = {}, []
    texts = [(d, words_of(t)) for d, t in rows]
    for d, w in texts:
        for p in range(len(w) - window + 1):
            k = " ".join(w[p : p + window])
            first[k] = min(first.get(k, d), d)
    for d, w in texts:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[" ".join(w[p : p + window])] < d:
                gone[p : p + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def test_repeats_equal_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(30)] + ["a"] * 20
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(40, 200))] for _ in range(15)]
    rows = []
    for k in range(140):
        w = []
        for _ in range(rng.randrange(0, 5)):
            b = rng.choice(base)
            s = rng.randrange(len(b))
            w += b[s : s + rng.randrange(30, 120)] + [rng.choice(vocabulary) for _ in range(rng.randrange(0, 10))]
            w += ["a"] * rng.choice([0, 0, 0, 130]) + ["x", "y"] * rng.choice([0, 0, 0, 60])
        rows.append((k, rng.choice([" ", "  ", "\n"]).join(w)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, ""), (503, "short")]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs(spark, rows)).collect())
    assert got == brute_repeats(rows)


@pytest.mark.parametrize("levels", [1, 3, 4, 7, 9])
def test_equal_windows_have_equal_representatives(levels):
    """The same windows in other surroundings, also next to runs and a text's ends."""
    rng = np.random.default_rng(19)
    words = _arrays.mix(np.arange(1, 40, dtype=np.uint64))
    names: dict[bytes, set[int]] = defaultdict(set)
    for turn in range(120):
        text = words[rng.integers(0, 39 if turn % 3 else 3, 60 + turn)]
        text[20:30] = text[19] if turn % 2 else text[20:30]
        for _ in range(4):
            before, after = (np.repeat(text[k], rng.integers(0, 9)) if rng.random() < 0.4 else words[rng.integers(0, 39, rng.integers(0, 30))] for k in (0, -1))
            whole = np.concatenate([before, text, after])
            head = np.zeros(len(whole), bool)
            head[0] = True
            got = substrings.representatives(whole, head, 50, levels)
            for p in range(len(whole) - 49):
                names[whole[p : p + 50].tobytes()].add(int(got[p]))
    assert all(len(x) == 1 for x in names.values()) and len(names) > 5000
    # below LEAST_LEVEL words stand for windows
    assert len({k for x in names.values() for k in x}) > (300 if levels >= substrings.LEAST_LEVEL else 3)


def test_symbols_stand_for_their_words():
    rng = np.random.default_rng(20)
    value = _arrays.mix(rng.integers(1, 6, 3000).astype(np.uint64))
    head = np.zeros(3000, bool)
    head[[0, 7, 900, 2999]] = True
    spelled: dict[int, set[bytes]] = defaultdict(set)
    for _, s, _ in substrings.compress(value, head, 7):
        assert s.start[0] == 0 and (s.start[1:] == (s.start + s.span)[:-1]).all() and s.start[-1] + s.span[-1] == 3000
        assert set(np.flatnonzero(head)) <= set(s.start.tolist())
        for name, a, n in zip(s.name.tolist(), s.start, s.span, strict=True):
            spelled[name].add(value[a : a + n].tobytes())
    assert all(len(x) == 1 for x in spelled.values())


def test_repeats_take_odd_tables(odd):
    assert substrings.remove_repeats(odd).count() == odd.count()
    with pytest.raises(ValueError):
        substrings.remove_repeats(odd, 0)


# -- 10 --------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)


def odd_texts():
    rng = random.Random(13)
    out = ["", " ", "a", "\n\n", "▁x", "=" * 70, "ha" * 40, " " * 35 + "x", "漢字 é\x00"]
    for _ in range(80):
        out.append("".join(rng.choice("etaoinshr ab=-\n漢é ") for _ in range(rng.randrange(1, 120))))
    return out


def test_scan_equals_library(library):
    with open(queries.PIECE_MODEL, "rb") as file:
        model = sentencepiece_codec.Model(file.read())
    for t in odd_texts():
        for size in (1, 5, 33):
            assert sentencepiece_codec.encode_by_chunks(model, t, size) == library.encode(t), (t, size)


def test_unigram_scan_is_as_good_as_the_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    with open(queries.PIECE_MODEL, "rb") as file:
        proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40_000)
    raw = proto.SerializeToString()
    unigram, model = sentencepiece.SentencePieceProcessor(model_proto=raw), sentencepiece_codec.Model(raw)

    def weight(ids):
        return sum(unigram.get_score(i) for i in ids if not unigram.is_byte(i))

    for t in odd_texts()[:40]:
        assert weight(sentencepiece_codec.encode_by_chunks(model, t, 7)) >= weight(unigram.encode(t)) - 1e-3


def test_product_is_associative():
    rng = random.Random(14)

    def matrix():
        return {(i, 0): {(j, 0): rng.randrange(9) * 1.0 for j in range(3) if rng.random() < 0.7} for i in range(3)}

    for _ in range(12):
        a, b, c = matrix(), matrix(), matrix()
        p = sentencepiece_codec.product
        assert p(p(a, b), c) == p(a, p(b, c))


def test_states_at_edges_are_those_of_the_best_path():
    rng = random.Random(16)
    for _ in range(60):
        n = rng.randrange(1, 9)
        matrices = [{(i, 0): {(j, 0): float(rng.randrange(50)) for j in range(3)} for i in range(3)} for _ in range(n)]
        best = max(itertools.product(range(3), repeat=n - 1), key=lambda path: sum(m[a, 0][b, 0] for m, a, b in zip(matrices, (0, *path), (*path, 0), strict=True)))
        states = sentencepiece_codec.edge_states(matrices)
        assert len(states) == n + 1 and states[0] == states[-1] == (0, 0)

        def weight(path):
            return sum(m[a, 0][b, 0] for m, a, b in zip(matrices, path, path[1:], strict=False))

        assert weight([s for s, _ in states]) == weight([0, *best, 0]) == sentencepiece_codec.products(matrices)[0, 0][0, 0]


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_encode_combines_in_rounds(spark, library, fan):
    rows = [(1, "ha" * 400), (2, " ".join(odd_texts())[:900]), (3, "=" * 300 + " x"), (4, "漢字" * 200)]
    got = sentencepiece_codec.encode(docs(spark, rows), queries.PIECE_MODEL, giant_chars=60, chunk_chars=25, fan=fan).collect()
    assert {r.doc_id: r.ids for r in got} == {d: library.encode(t) for d, t in rows}


def test_encode_and_decode(spark, library):
    rows = [(k, t) for k, t in enumerate(odd_texts())] + [(900, "long words " * 200), (900, "long words " * 200), (None, None)]
    got = sentencepiece_codec.encode(docs(spark, rows), queries.PIECE_MODEL, giant_chars=60, chunk_chars=25)
    back = sentencepiece_codec.decode(got, queries.PIECE_MODEL).collect()
    assert len(back) == len(rows)
    for r in back:
        assert r.ids == library.encode(r.text or "") and r.n_tokens == len(r.ids)
        assert r.decoded == (r.text or "").replace("▁", " ")


def test_encode_takes_odd_tables(odd):
    assert sentencepiece_codec.encode(odd, queries.PIECE_MODEL).count() == odd.count()
    ids = odd.drop("ids").withColumn("ids", F.array(F.lit(300)))
    assert sentencepiece_codec.decode(ids, queries.PIECE_MODEL).columns == [*ids.columns, "decoded"]
    assert sentencepiece_codec.decode(ids, queries.PIECE_MODEL).count() == odd.count()


# -- pipeline --------------------------------------------------------------


def test_pipeline_stages(spark, library):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{d}/documents.parquet")
    columns = df.columns
    seen = [df.count()]
    for name, stage in corpus_pipeline.STAGES:
        df = spark.createDataFrame(stage(spark, df, d).toPandas(), schema=None if name.startswith("Sentence") else DOCS)
        seen.append(df.count())
        if not name.startswith("Sentence"):
            assert df.columns == columns
    assert seen == sorted(seen, reverse=True) and seen[3] == seen[4] == seen[5] > seen[0] / 2


def test_op_queries_against_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, d)
        columns = sorted(got.columns)
        got = sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect())))
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert got == sorted(map(repr, want)), name


def test_kept_digest(spark):
    df = docs(spark, [(1, "a  b"), (2, None)])
    got = {r.doc_id: r.k for r in substrings.remove_repeats(df).select("doc_id", F.sha2("kept", 256).alias("k")).collect()}
    assert got == {1: hashlib.sha256(b"a b").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
