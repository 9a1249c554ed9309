"""Formulas, rules and round trips with cases of our own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.functions import text
from recallgrid.functions import vectors as V
from recallgrid.functions.scoring import Decay, decayed, stickiness
from recallgrid.operators import analytics, consolidate, episodes, extraction, graph, hierarchy, keyword, lifecycle, search
from recallgrid.operators.lifecycle import Tables
from recallgrid.plans.filters import FilterSpec
from recallgrid.plans.planner import Plan, Step, execute, plan
from recallgrid.plans.schema import EDGES, VECTORS, as_records, dead, live
from recallgrid.sources import logs, store
from recallgrid.streaming import triggers


NOW = 1_706_745_600


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def records(spark, rows):
    return as_records(spark.createDataFrame(rows, "id long, content string, namespace_id string, source string, ts long, ttl long, importance float, recall_count long, attributes map<string,string>"))


@pytest.fixture
def tables(spark):
    r = records(spark, [(1, "red fox", "a", "s1", 100, 0, 1.0, 0, {"k": "v"}), (2, "blue fox", "a", "s2", 100, 50, 0.5, 3, {}), (3, "green owl", "b", "s1", 200, 0, 0.8, 9, {"_deleted": "true"}), (0, "", "b", "s1", 0, 0, 1.0, 0, None)])
    v = spark.createDataFrame([("text", 1, [1.0, 0.0]), ("text", 2, [0.9, 0.1]), ("text", 3, [0.0, 1.0]), ("text", 0, [0.0, 0.0])], VECTORS)
    e = spark.createDataFrame([(1, 2, "supports", 1.0), (2, 3, "related_to", 0.5), (2, 99, "related_to", 0.5)], EDGES)
    return Tables(r, v, e)


def test_stickiness(spark):
    assert one(spark, stickiness(F.lit(0))) == 1.0
    assert one(spark, stickiness(F.lit(10))) == pytest.approx(1 + math.log(11))
    assert one(spark, stickiness(F.lit(100))) == pytest.approx(1 + math.log(101))


def test_decay_of_the_future_is_fresh(spark):
    got = one(spark, decayed(F.lit(0.5), F.lit(2000), F.lit(0), F.lit(1.0), 1000, Decay(30, 0.3)))
    assert got == pytest.approx(0.7 * 0.5 + 0.3)


def test_half_life(spark):
    got = one(spark, decayed(F.lit(0.0), F.lit(0), F.lit(0), F.lit(1.0), 30 * 86400, Decay(30, 1.0)))
    assert got == pytest.approx(0.5)


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.squared_l2(a, b)) == 25.0 and one(spark, V.l2(a, b)) == 5.0
    assert one(spark, V.cosine(a, b)) == 0.0 and one(spark, V.normalized(b)) == [0.0, 0.0]
    assert one(spark, V.fitted(a, 3)) == [3.0, 4.0, 0.0]
    assert one(spark, V.quantized(F.array(F.lit(0.5), F.lit(-0.5), F.lit(9.0)), F.lit(1.0))) == [1, -1, 9]


def test_tokens(spark):
    assert one(spark, text.tokens(F.lit("The café's 2 FOXES, x and ab"))) == ["caf", "foxes", "ab"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []


def test_leading_numbers(spark):
    cases = {"4.5%": 4.5, "$1,200": 1200.0, "3.2x": 3.2, "March 15, 2024": None, "-.5": -0.5, "": None}
    assert {s: one(spark, text.leading_number(F.lit(s))) for s in cases} == cases


def test_hashed_id(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256("__ep__ab".encode()).digest()[:8], "little") % 2**50
    assert one(spark, episodes.header_id(F.lit("ab"))) == want


def test_keyword_class_order(spark):
    assert one(spark, text.keyword_class(F.lit("Unlikely error")))["entity_type"] == "preference"


def test_dead_rows_are_not_found(spark, tables):
    assert sorted(r.id for r in live(tables.records).collect()) == [0, 1, 2]
    got = search.search_records(tables.records, tables.vectors, [0.0, 1.0], 1000, 10)
    assert 3 not in [r.id for r in got.collect()]


def test_ties_go_to_the_smaller_id(spark):
    v = spark.createDataFrame([(k, [1.0, 1.0]) for k in (5, 2, 9)], "id long, vec array<float>")
    assert [r.id for r in search.search(v, [1.0, 1.0], 2).collect()] == [2, 5]


def test_filter_finds_all_rare_matches(spark):
    rng = np.random.default_rng(0)
    rows = [(k, "x", "rare" if k % 100 == 0 else "big", "s", 0, 0, 1.0, 0, {}) for k in range(300)]
    r = records(spark, rows)
    v = spark.createDataFrame([("text", k, rng.normal(size=4).tolist()) for k in range(300)], VECTORS)
    got = search.search_records(r, v, [0.0] * 4, 0, 20, FilterSpec().namespace("rare"))
    assert got.count() == 3


def test_batch_equals_single(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(200)], "id long, vec array<double>").cache()
    q = v.where("id < 5").select(F.col("id").alias("query_id"), "vec")
    got = {(r.query_id, r["rank"]): r.id for r in search.search_batch(v, q, 7, block=2).collect()}
    for r in q.collect():
        want = [x.id for x in search.search(v, list(r.vec), 7).collect()]
        assert [got[r.query_id, k + 1] for k in range(7)] == want


def test_ivf_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(42)
    centres = rng.normal(size=(16, 16))
    m = centres[rng.integers(0, 16, 1000)] + 0.15 * rng.normal(size=(1000, 16))
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "id long, vec array<float>")
    placed, cells = search.build_ivf(v, 16)
    placed = placed.cache()
    hits = 0
    for q in m[:10]:
        truth = np.argsort(((m - q) ** 2).sum(1), kind="stable")[:10]
        hits += len({r.id for r in search.search_ivf(placed, cells, q.tolist(), 10, 4).collect()} & set(truth.tolist()))
    assert hits / 100 >= 0.95


def test_mmr_prefers_the_different(spark):
    c = spark.createDataFrame([(1, 0.9, [1.0, 0.0]), (2, 0.89, [1.0, 0.01]), (3, 0.5, [0.0, 1.0])], "id long, score double, vec array<double>")
    assert [r.id for r in search.search_diverse(c, 2).orderBy("rank").collect()] == [1, 3]


def test_bm25_edges(spark):
    r = records(spark, [(1, "the and of", "a", "s", 0, 0, 1.0, 0, {}), (2, "fox fox", "a", "s", 0, 0, 1.0, 0, {}), (3, "fox owl", "a", "_forgotten", 0, 0, 1.0, 0, {})])
    assert [x.id for x in keyword.keyword_search(r, "fox FOX").collect()] == [2]
    assert keyword.keyword_search(r, "the of").count() == 0
    assert keyword.keyword_search(r, "unknown").count() == 0


def test_link_unlink_prune(spark, tables):
    new = spark.createDataFrame([(1, 2, "supports", 0.1), (1, 3, "supports", 1.0), (77, 1, "supports", 1.0)], EDGES)
    linked = graph.link(tables.edges, new, tables.records)
    assert sorted((r.src, r.dst) for r in linked.collect()) == [(1, 2), (1, 3), (2, 3), (2, 99)]
    assert graph.unlink(linked, 1, 2).count() == 3
    assert [(r.src, r.dst) for r in graph.prune_dead(tables.edges, tables.records).collect()] == [(1, 2)]


def test_add_keeps_edges_unless_new_ones_come(spark, tables):
    again = tables.records.where("id = 1").withColumn("content", F.lit("new"))
    none = tables.vectors.where("id = 1")
    assert lifecycle.add(tables, again, none).edges.count() == 3
    edges = spark.createDataFrame([(1, 3, "part_of", 1.0)], EDGES)
    out = lifecycle.add(tables, again, none, edges)
    assert sorted((r.src, r.dst) for r in out.edges.collect()) == [(1, 3), (2, 3), (2, 99)]
    assert out.records.where("id = 1").first()["content"] == "new" and out.records.count() == 4


def test_dimensions(spark, tables):
    bad = spark.createDataFrame([("text", 8, [1.0]), ("other", 9, [1.0, 2.0, 3.0])], VECTORS)
    assert [(r.id, r.expected) for r in lifecycle.dimension_errors(tables.vectors, bad).collect()] == [(8, 2)]


def test_ttl_bound_is_not_expired(spark, tables):
    assert lifecycle.forget_expired(tables.records, 150).where("source = '_forgotten'").count() == 0
    assert [r.id for r in lifecycle.forget_expired(tables.records, 151).where("source = '_forgotten'").collect()] == [2]


def test_forget_compact_purge(spark, tables):
    gone = lifecycle.forget(tables.records, spark.createDataFrame([(1,), (1,), (42,)], "id long"))
    row = gone.where("id = 1").first()
    assert (row.content, row.source, row.importance) == ("", "_forgotten", 0.0) and gone.count() == 4
    small = lifecycle.compact(Tables(gone, tables.vectors, tables.edges))
    assert sorted(r.id for r in small.records.collect()) == [0, 2] and small.vectors.count() == 2
    assert lifecycle.compact_if(tables, 0.0) is tables
    assert lifecycle.compact_if(tables, 0.2).records.count() == 3
    left = lifecycle.purge(tables, "a")
    assert (left.records.count(), left.vectors.count(), left.edges.count()) == (2, 2, 0)


def test_merge_stores(spark, tables):
    other = Tables(records(spark, [(1, "other", "a", "o", 1, 0, 2.0, 0, {"k": "w", "n": "1"}), (7, "seven", "a", "o", 1, 0, 1.0, 0, {})]), spark.createDataFrame([("text", 1, [5.0, 5.0]), ("text", 7, [1.0, 1.0])], VECTORS), spark.createDataFrame([(7, 1, "supports", 1.0), (7, 55, "supports", 1.0)], EDGES))
    both = lifecycle.merge(tables, other, "merge")
    row = both.records.where("id = 1").first()
    assert (row.content, row.importance, row.attributes) == ("red fox", 2.0, {"k": "w", "n": "1"})
    # a store's own edges stay, and a new record brings all of its own
    assert sorted((r.src, r.dst) for r in both.edges.collect()) == [(1, 2), (2, 3), (2, 99), (7, 1), (7, 55)]
    assert lifecycle.merge(tables, other, "keep_target").vectors.where("id = 1").first()["vec"] == [1.0, 0.0]
    with pytest.raises(ValueError):
        lifecycle.merge_records(tables.records, other.records, "other")


def test_store_round_trip(spark, tables, tmp_path):
    s = store.Store(spark, str(tmp_path / "x"))
    assert s.open().records.count() == 0
    first = s.save(tables)
    second = s.save(s.open())
    assert first != second == s.version()
    back = s.open()
    assert sorted(r.id for r in back.records.collect()) == [0, 1, 2] and back.records.where("id = 1").first()["attributes"] == {"k": "v"}
    assert store.list_stores(spark, str(tmp_path)) == ["x"]
    assert store.Store(spark, str(tmp_path / "y")).adopt(str(tmp_path / "x"))
    s.drop()
    assert store.list_stores(spark, str(tmp_path)) == ["y"]


def test_import_json(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"id": 1, "content": "a", "vec": [1, 2]}\n{"id": 2, "content": "b"}\n{"content": "c", "vec": [1, 2]}\nnot json\n{"id": 3, "vec": [1]}\n')
    good, vecs, errors = store.import_json(spark, str(tmp_path / "in.json"), 2)
    assert [r.id for r in good.collect()] == [1] and vecs.count() == 1
    assert sorted(r.problem for r in errors.collect()) == ["no id", "no vector", "not JSON", "wrong dimension"]
    filled, _, _ = store.import_json(spark, str(tmp_path / "in.json"), 2, lambda c: text.hash_embedding(c, 2))
    assert sorted(r.id for r in filled.collect()) == [1, 2]


def test_vector_files(spark, tmp_path):
    m = np.arange(12, dtype="<f4").reshape(3, 4)
    raw = np.concatenate([np.full((3, 1), 4, "<i4").view("<f4"), m], axis=1)
    (tmp_path / "a.fvecs").write_bytes(raw.tobytes())
    got = logs.read_fvecs(spark, str(tmp_path / "a.fvecs")).orderBy("id").collect()
    assert [list(r.vec) for r in got] == m.tolist()


def test_ad_export(spark, tmp_path):
    (tmp_path / "ads.csv").write_text(f"name\nctr\n1\ta\t0.5\n2\tb\t{logs.NULL}\n3\tonly two\n", encoding="utf-8")
    assert [tuple(r) for r in logs.read_ad_export(spark, str(tmp_path / "ads.csv")).orderBy("row_num").collect()] == [(1, "a", 0.5), (2, "b", None)]


def test_feedback_log(spark, tmp_path):
    path = str(tmp_path / "fb")
    events = spark.createDataFrame([("fact_endorsed", 1, "a", 10, "u", "{}", "", ""), ("fact_retracted", 2, "a", 20, "u", "{}", "", "")], "kind string, target_id long, namespace_id string, timestamp long, user_id string, payload string, notes string, event_id string")
    logs.append_feedback(logs.with_event_ids(events), path)
    assert logs.read_feedback(spark, path, since=20).count() == 1 and logs.read_feedback(spark, path, kind="fact_endorsed").count() == 1
    with pytest.raises(ValueError):
        logs.append_feedback(events.withColumn("kind", F.lit("odd")), path)


def test_contradictions(spark):
    schema = "id long, subject string, predicate string, object string, valid_at long"
    new = spark.createDataFrame([(1, "Acme ", "had_CTR", "4.5%", None), (2, "acme", "color", "red", 20), (3, "acme", "ctr", "4.50%", 0), (4, "acme", "color", "RED", None)], schema)
    old = spark.createDataFrame([(11, "acme", "HAD_ctr", "4.2%", None), (12, "acme", "color", "blue", 10), (13, "acme", "ctr", "4.51%", None), (14, "acme", "color", "red", None), (15, "acme", "color", "", None)], schema)
    got = {(r.new_id, r.stored_id): (r.severity, r.resolution) for r in extraction.contradictions(new, old).collect()}
    assert got == {(1, 11): ("probable", "review"), (2, 12): ("possible", "supersedes"), (3, 13): ("possible", "merge"), (4, 12): ("definite", "review")}


def test_facts_and_json(spark):
    assert extraction.repaired_json('Here: ```json\n{"a": [1, 2,],}\n```') == {"a": [1, 2]}
    assert extraction.repaired_json("no value") is None
    texts = spark.createDataFrame([(1, "x")], "id long, text string")
    answer = '[{"subject": "a", "predicate": "is", "object": "b", "confidence": 7}, {"subject": "", "predicate": "is", "object": "b"}, {"subject": "c", "predicate": "is", "object": "d", "confidence": 0.2}]'
    got = extraction.facts_of(extraction.complete(texts, lambda _: f"sure: {answer}")).collect()
    assert [(r.subject, r.confidence) for r in got] == [("a", 1.0)]


def test_ontology_edges(spark):
    rows = [(1, 2, "supports", 3.0, None), (1, 1, "supports", 1.0, None), (1, 9, "supports", 1.0, None), (1, 2, "contradicts", 1.0, " "), (1, 2, "likes", 1.0, None)]
    p = spark.createDataFrame(rows, "src long, dst long, rel_type string, weight double, rationale string")
    got = extraction.ontology_edges(p, spark.createDataFrame([(1,), (2,)], "id long")).collect()
    assert [(r.rel_type, r.weight) for r in got] == [("supports", 1.0)]


def test_hierarchy(spark):
    n = spark.createDataFrame([(1, None, "brand"), (2, 1, "channel"), (3, 2, "campaign"), (4, 2, "campaign"), (5, 9, "ad"), (6, 3, "brand")], "id long, parent_id long, level string")
    assert {(r.id, r.problem) for r in hierarchy.problems(n).collect()} == {(5, "missing parent"), (6, "parent not above")}
    pairs = spark.createDataFrame([(3, 4), (1, 3), (3, 5)], "a long, b long")
    assert {(r.a, r.b): r.lca for r in hierarchy.lowest_common(n, pairs).collect()} == {(3, 4): 2, (1, 3): 1, (3, 5): None}


def test_consolidate(spark):
    r = records(spark, [(k, f"note {k}", "a", "s", 0, 0, 0.5 + k / 10, 0, {}) for k in range(4)])
    v = spark.createDataFrame([("text", 0, [1.0, 0.0]), ("text", 1, [0.99, 0.05]), ("text", 2, [0.0, 1.0]), ("text", 3, [0.98, 0.1])], VECTORS)
    out = consolidate.consolidate(r, v, spark.createDataFrame([], EDGES), 1000)
    made = out.records.where("source = 'consolidation'").collect()
    assert len(made) == 1 and made[0].content == "note 0 | note 1 | note 3"
    assert sorted(x.id for x in out.records.where("importance < 0.31 and source <> 'consolidation'").collect()) == [0, 1, 3]
    assert out.edges.count() == 3 and out.vectors.count() == 5


def test_similar_pairs_are_all_pairs(spark):
    rng = np.random.default_rng(4)
    # copies of one vector, two groups closer within than across, zeros, single ones
    groups = [np.tile(rng.normal(size=6), (90, 1)), [1, 0.5, 0, 0, 0, 0] + 0.001 * rng.normal(size=(80, 6)), [1, -0.1, 0, 0, 0, 0] + 0.001 * rng.normal(size=(80, 6)), np.zeros((2, 6)), rng.normal(size=(30, 6))]
    m = np.concatenate(groups)
    n = np.linalg.norm(m, axis=1)
    alike = m @ m.T / (n[:, None] * n[None] + 1e-9) >= 0.8
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)] + [(900, None), (901, []), (902, [1.0])], "id long, vec array<double>")
    root = np.arange(len(m))
    while (new := np.where(alike, root[None], len(m)).min(1).clip(max=root)).tolist() != root.tolist():
        root = new
    expected = {k: int(r) for k, r in enumerate(root) if alike[k].sum() - alike[k, k]}
    for block in (None, 50):
        got = [(r.a, r.b) for r in consolidate.similar_pairs(v, 0.8, block=block).collect()]
        assert sorted(got) == [(a, b) for a, b in np.argwhere(alike).tolist() if a < b]
        labels = consolidate.connected(consolidate.similar_links(v, 0.8, block=block))
        assert {r.id: r.root for r in labels.collect()} == expected


def test_planner(spark, tables):
    got = execute(plan("fox"), tables.records, tables.vectors, tables.edges, [1.0, 0.0], 1000)
    assert {r.id for r in got.collect()} >= {1, 2}
    words = execute(plan("fox"), tables.records, tables.vectors, tables.edges, None, 1000)
    assert {r.id for r in words.collect()} == {1, 2}
    with pytest.warns(UserWarning):
        execute(Plan("x", (Step("odd"),)), tables.records, tables.vectors, tables.edges, None, 0)


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    nodes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "node_id long, vec array<double>")
    nodes.write.parquet(source)
    watches = spark.createDataFrame([(7, [1.0, 0.1], 0.9)], "watch_id long, vec array<double>, threshold double")
    seen = []
    q = triggers.on_matches(spark.readStream.schema(nodes.schema).parquet(source), watches, lambda df, _: seen.extend((r.node_id, r.watch_id) for r in df.collect()), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert seen == [(r.node_id, r.watch_id) for r in triggers.watch_matches(nodes, watches).collect()] == [(1, 7)]


def test_dead_flag(spark, tables):
    assert [r.id for r in tables.records.where(dead()).collect()] == [3]
    marked = lifecycle.mark_deleted(tables.records, spark.createDataFrame([(1,)], "id long"))
    assert sorted(r.id for r in marked.where(dead()).collect()) == [1, 3]


def test_savers_from_one_version_do_not_overwrite_each_other(spark, tmp_path):
    a, b = (store.Store(spark, str(tmp_path / "s")) for _ in range(2))
    first = store.seed(spark, 3, 2, "n")
    a.open(), b.open()
    a.save(first)
    with pytest.raises(store.ConcurrentSave):
        b.save(first)
    assert b.open().records.count() == 3
    b.save(first)
    assert a.open().records.count() == 3 and a.version() == b.version()


def test_saved_indexes_find_what_scans_find(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    t = store.seed(spark, 400, 8, "n")
    s.save(t)
    s.save_indexes(cells=4, buckets=8)
    alive = s.open()
    want = keyword.bm25(alive.records, "record 17 seed", 5).collect()
    assert [(r.id, round(r.score, 9)) for r in s.keyword_search("record 17 seed", 5).collect()] == [(r.id, round(r.score, 9)) for r in want] and want[0].id == 17
    query = [0.1] * 8
    assert s.vector_search(query, 5, nprobe=4).collect() == search.search(alive.vectors, query, 5).collect()


def test_merge_keeps_targets_vectors_and_edges(spark):
    def tables(rows, vectors, edges):
        return Tables(as_records(spark.createDataFrame(rows, "id long, content string")), spark.createDataFrame(vectors, VECTORS), spark.createDataFrame(edges, EDGES))

    target = tables([(1, "a"), (2, "b")], [("text", 1, [1.0]), ("text", 2, [2.0])], [(1, 99, "r", 0.5), (1, 2, "r", 0.5)])
    source = tables([(1, "x"), (3, "y"), (4, "no vector")], [("text", 1, [9.0]), ("text", 3, [3.0])], [(1, 2, "r", 0.9), (1, 3, "r", 0.9), (1, 98, "r", 0.9), (3, 97, "r", 0.9), (4, 1, "r", 0.9)])

    def seen(policy):
        out = lifecycle.merge(target, source, policy)
        return {(r.id, r.vec[0]) for r in out.vectors.collect()}, {(r.src, r.dst, r.weight) for r in out.edges.collect()}, {r.id for r in out.records.collect()}

    near = pytest.approx
    for policy in ("merge", "keep_target"):
        vectors, edges, ids = seen(policy)
        assert vectors == {(1, 1.0), (2, 2.0), (3, 3.0)} and ids == {1, 2, 3}
        assert {(a, b) for a, b, _ in edges} == {(1, 99), (1, 2), (1, 3), (3, 97)} and all(w == near(0.5) for a, b, w in edges if (a, b) == (1, 2))
    vectors, edges, _ = seen("keep_source")
    assert vectors == {(1, 9.0), (2, 2.0), (3, 3.0)} and {(a, b) for a, b, _ in edges} == {(1, 2), (1, 3), (1, 98), (3, 97)}


def test_consolidate_with_a_summariser(spark):
    records = as_records(spark.createDataFrame([(1, "one"), (2, "two"), (3, "far"), (4, "far too")], "id long, content string"))
    vectors = spark.createDataFrame([("text", 1, [1.0, 0.0]), ("text", 2, [1.0, 0.01]), ("text", 3, [0.0, 1.0]), ("text", 4, [0.0, 1.0])], VECTORS)

    def summarise(texts):
        if "far" in texts:
            raise ValueError("no answer")
        return f"{len(texts)} texts"

    out = consolidate.consolidate(records, vectors, spark.createDataFrame([], EDGES), NOW, summarise=summarise)
    made = {r.content for r in out.records.where("source = 'consolidation'").collect()}
    assert made == {"2 texts", "far | far too"}


def test_large_alike_groups_keep_all_pairs(spark):
    """Two tight groups of 100 at a cosine of 0.9: all pairs, one component."""
    rng = np.random.default_rng(3)
    axes = np.eye(32)
    centre = [axes[0], 0.9 * axes[0] + np.sqrt(1 - 0.81) * axes[1]]
    m = np.concatenate([c + 0.001 * rng.normal(size=(100, 32)) for c in centre])
    frame = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "id long, vec array<float>")
    assert consolidate.similar_pairs(frame, 0.85, block=37).count() == 19_900
    roots = {r.root for r in consolidate.connected(consolidate.similar_links(frame, 0.85, block=37)).collect()}
    assert roots == {0}


@pytest.mark.parametrize("n", [24, 300])
def test_components_of_a_chain_in_any_order(spark, n):
    """However many rounds it takes, what the driver holds of them doesn't grow."""
    ids = np.random.default_rng(1).permutation(n).tolist()
    pairs = spark.createDataFrame([*zip(ids[:-1], ids[1:], strict=True), (n, n), (n + 2, n + 1)], "a long, b long")
    labels = consolidate.connected(pairs)
    assert labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**9
    assert {r.id: r.root for r in labels.collect()} == {**dict.fromkeys(range(n), 0), n: n, n + 1: n + 1, n + 2: n + 1}


def test_ingest_classifies_links_and_finds_contradictions(spark):
    from recallgrid.operators import ingest

    def embed(text):
        return F.array(F.length(text).cast("float"), F.lit(1.0).cast("float"))

    start = Tables(as_records(spark.createDataFrame([(1, "we always buy red", "mail"), (2, "x" * 90, "mail")], "id long, content string, source string")), spark.createDataFrame([("text", 1, [17.0, 1.0]), ("text", 2, [90.0, 1.0])], VECTORS), spark.createDataFrame([], EDGES))
    texts = spark.createDataFrame([("we never buy red!",), ("  ",), ("y" * 500,)], "content string")
    out, ids = ingest.ingest_texts(start, texts, embed, NOW, {"namespace": "n"})
    new = {r.content[:8]: r for r in out.records.where("namespace_id = 'n'").collect()}
    assert ids.count() == 2 and new["we never"].attributes["entity_type"] == "preference" and new["yyyyyyyy"].attributes["entity_type"] == "fact"
    assert {(r.src, r.dst, r.rel_type) for r in out.edges.collect()} == {(new["we never"].id, 1, "related_to"), (new["we never"].id, 1, "contradicts")}


def test_ingest_stream_saves_each_batch(spark, tmp_path):
    from recallgrid.operators import ingest

    s = store.Store(spark, str(tmp_path / "s"))
    s.save(store.seed(spark, 2, 2, "old"))
    spark.createDataFrame([("a plan for red", NOW), ("a bug", NOW + 1)], "content string, ts long").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("content string, ts long").json(str(tmp_path / "in"))
    ingest.ingest_stream(stream, s, lambda t: F.array(F.length(t).cast("float"), F.lit(0.0).cast("float")), str(tmp_path / "c")).awaitTermination(120)
    kinds = {r.attributes.get("entity_type") for r in s.open().records.where("source = 'ingest'").collect()}
    assert kinds == {"strategy_brief", "issue"} and s.open().records.count() == 4


def test_plane_keeps_distances_of_flat_vectors(spark):
    rng = np.random.default_rng(4)
    flat, turn = rng.normal(size=(40, 2)), np.linalg.qr(rng.normal(size=(6, 6)))[0][:2]
    frame = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(flat @ turn + 3)], "id long, vec array<double>")
    got = np.array([r.x for r in analytics.plane(frame).orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(got[:, None] - got[None], axis=2), np.linalg.norm(flat[:, None] - flat[None], axis=2), atol=1e-4)
    assert np.allclose(got.mean(axis=0), 0, atol=1e-6)
