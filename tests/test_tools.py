"""Tools, vector store, chat memory and embedders."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.functions import embedders
from recallgrid.operators import analytics
from recallgrid.plans.tools import ChatMemory, Toolbox, VectorStore, empty_tables


@pytest.fixture
def box(spark):
    box = Toolbox(empty_tables(spark), embedders.hashing(32), 1_000_000)
    VectorStore(box).add_texts(spark.createDataFrame([(1, "the red fox"), (2, "a blue whale"), (3, "red fox cub")], "id long, content string"), "zoo")
    t = box.tables
    box.tables = t._replace(records=t.records.checkpoint(), vectors=t.vectors.checkpoint())
    return box


def call(box, name, **arguments):
    return json.loads(box.call(name, json.dumps(arguments)))


def test_tools(box):
    assert [r["id"] for r in call(box, "search", query="red fox cub", k=2)["rows"]] == [3, 1]
    assert [r["id"] for r in call(box, "keyword_recall", query="whale")["rows"]] == [2]
    assert call(box, "stats")["rows"] == [{"namespace_id": "zoo", "n": 3}]
    assert call(box, "link_nodes", src=1, dst=3, rel_type="supports")["rows"][0]["dst"] == 3
    assert [r["other"] for r in call(box, "get_related", id=3)["rows"]] == [1]
    assert call(box, "health")["rows"][0]["orphans"] == 1
    call(box, "forget", id=2)
    assert call(box, "keyword_recall", query="whale")["rows"] == []
    assert "error" in call(box, "unknown") and "error" in call(box, "search")


def test_chat_memory(box, spark):
    memory = ChatMemory(box)
    memory.save(spark.createDataFrame([(9, "user", "green parrot")], "id long, role string, content string"), "zoo")
    assert memory.load("user: green parrot", 1).first()["id"] == 9
    assert memory.read("zoo").count() == 4


def test_hashing_is_md5_modulo_dim(spark):
    import hashlib

    want = [0.0] * 24
    for w in ("red", "red", "fox"):
        want[int(hashlib.md5(w.encode()).hexdigest(), 16) % 24] += 1
    n = sum(x * x for x in want) ** 0.5
    got = spark.range(1).select(embedders.hashing(24)(F.lit("Red fox  red")).alias("v")).first()["v"]
    assert got == pytest.approx([x / n for x in want])


def test_embedders(spark):
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    model = embedders.embedder(lambda texts: [[float(len(t)), 0.0] for t in texts])
    assert [list(r.v) for r in df.select(model(F.col("t")).alias("v")).collect()] == [[3.0, 0.0], [0.0, 0.0]]
    signed = df.select(embedders.six_fold(8)(F.col("t")).alias("v")).first()["v"]
    assert sum(x * x for x in signed) == pytest.approx(1.0, abs=1e-6)
    assert spark.range(1).select(embedders.averaged(F.array(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(3.0))), 2).alias("v")).first()["v"] == [2.0, 1.5]


def test_pca_equals_eigenvectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6)) * [5, 1, 3, 0.2, 0.1, 0.5] @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    odd = [(1000, None), (1001, [1.0]), (1002, [float("nan")] * 6), (1003, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([*((k, v.tolist()) for k, v in enumerate(x)), *odd], "id long, vec array<double>")
    got = {r["id"]: (r["x"], r["y"]) for r in analytics.pca_2d(df, 6).collect()}
    axes = np.linalg.eigh(np.cov(x.T))[1][:, :-3:-1]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    assert np.allclose([got[k] for k in range(300)], (x - x.mean(axis=0)) @ axes)
    assert all(got[k] == (None, None) for k, _ in odd)
    assert analytics.pca_2d(df.where("id = 3"), 6).first()["x"] is None
    assert analytics.pca_2d(df.limit(0), 6).count() == 0
