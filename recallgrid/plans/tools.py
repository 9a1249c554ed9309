"""A store behind named tools with JSON arguments and JSON answers, and as a
vector store and chat memory. Answers are bounded by their k or limit."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.functions.scoring import Decay
from recallgrid.operators import analytics, consolidate, episodes, graph, hybrid, ingest, keyword, lifecycle, search
from recallgrid.operators.lifecycle import Tables
from recallgrid.plans.filters import FilterSpec
from recallgrid.plans.schema import as_records
from recallgrid.sources import store


@dataclass
class Toolbox:
    """tables change with what tools write; embed makes a vector of a text
    column; now is set by the caller, as no query reads the clock."""

    tables: Tables
    embed: Callable[[Column], Column]
    now: int

    def _vector(self, text: str) -> list[float]:
        return [float(x) for x in self.tables.records.sparkSession.range(1).select(self.embed(F.lit(text)).alias("v")).first()["v"]]

    def _where(self, args: dict) -> FilterSpec | None:
        spec = FilterSpec()
        if args.get("namespace") is not None:
            spec = spec.namespace(args["namespace"])
        if args.get("entity") is not None:
            spec = spec.entity(args["entity"])
        for key in ("entity_type", "product"):
            if args.get(key) is not None:
                spec = spec.attribute(key, args[key])
        return spec if spec != FilterSpec() else None

    def _text(self, found: DataFrame, characters: int | None = None) -> DataFrame:
        """found with the contents, whole or their first characters."""
        content = F.col("content") if characters is None else F.substring("content", 1, characters)
        return found.join(self.tables.records.select("id", content.alias("content")), "id", "left")

    def _search(self, a: dict) -> DataFrame:
        found = search.search_records(self.tables.records, self.tables.vectors, self._vector(a["query"]), self.now, a.get("k", 5), self._where(a), Decay() if a.get("decay") else None)
        return self._text(found, 200).orderBy(F.desc("score"), "id")

    def _diverse(self, a: dict) -> DataFrame:
        k = a.get("k", 10)
        near = search.search_records(self.tables.records, self.tables.vectors, self._vector(a["query"]), self.now, min(5 * k, 200), self._where(a))
        return search.search_diverse(near.join(self.tables.vectors.select("id", "vec"), "id"), k, a.get("diversity", 0.5)).orderBy("rank")

    def _chain(self, a: dict) -> DataFrame:
        seeds = search.search_records(self.tables.records, self.tables.vectors, self._vector(a["query"]), self.now, a.get("k", 5)).select("id", "similarity")
        nodes, _ = graph.context_chain(self.tables.records, self.tables.edges, seeds, a.get("hops", 2))
        return self._text(nodes, 200).orderBy("hop", F.desc("score"), "id").limit(a.get("limit", 100))

    def _add(self, a: dict) -> DataFrame:
        spark = self.tables.records.sparkSession
        row = spark.createDataFrame([(a["id"], a["content"], a.get("namespace", ""))], "id long, content string, namespace_id string")
        self.tables = store.ingest_texts(self.tables, row, self.embed, self.now, a.get("namespace", ""))
        return row.select("id")

    def _ingest(self, a: dict) -> DataFrame:
        """Classifies a text by keywords, adds it, and links what it contradicts."""
        row = self.tables.records.sparkSession.createDataFrame([(a["text"],)], "content string")
        self.tables, ids = ingest.ingest_texts(self.tables, row, self.embed, self.now, {k: a[k] for k in ingest.HINTS if k in a})
        return ids

    def _link(self, a: dict) -> DataFrame:
        new = self.tables.records.sparkSession.createDataFrame([(a["src"], a["dst"], a.get("rel_type", "related_to"), float(a.get("weight", 1.0)))], self.tables.edges.schema)
        self.tables = self.tables._replace(edges=graph.link(self.tables.edges, new, self.tables.records))
        return graph.out_edges(self.tables.edges, a["src"]).limit(a.get("limit", 100))

    def _forget(self, a: dict) -> DataFrame:
        ids = self.tables.records.sparkSession.createDataFrame([(a["id"],)], "id long")
        self.tables = self.tables._replace(records=lifecycle.forget(self.tables.records, ids))
        return ids

    def _expire(self, _: dict) -> DataFrame:
        gone = self.tables.records.where(lifecycle.expired(self.now)).agg(F.count("*").alias("expired"))
        self.tables = self.tables._replace(records=lifecycle.forget_expired(self.tables.records, self.now))
        return gone

    def _consolidate(self, a: dict) -> DataFrame:
        out = consolidate.consolidate(self.tables.records, self.tables.vectors, self.tables.edges, self.now, a.get("namespace"), a.get("threshold", 0.85))
        self.tables = Tables(out.records, out.vectors, out.edges)
        return out.clusters.orderBy("id").limit(a.get("limit", 100))

    def tools(self) -> dict[str, Callable[[dict], DataFrame]]:
        t = self.tables
        return {
            "search": self._search,
            "context_chain": self._chain,
            "get_node": lambda a: store.get(t.records, a["id"]),
            "get_related": lambda a: graph.related(t.edges, t.records, a["id"], a.get("direction", "both"), a.get("rel_type")).orderBy("other", "rel_type", "way").limit(a.get("limit", 100)),
            "add_intel": self._add,
            "ingest": self._ingest,
            "link_nodes": self._link,
            "timeline": lambda a: analytics.timeline(t.records, (self._where(a) or FilterSpec()).column(), a.get("limit", 20)),
            "forget": self._forget,
            "health": lambda _: analytics.health_report(t.records, t.edges, self.now),
            "why": lambda a: search.explain(t.records, t.vectors, a["id"], self._vector(a["query"]), self.now),
            "mmr_search": self._diverse,
            "consolidate": self._consolidate,
            "episode_get": lambda a: episodes.timeline(t.edges, t.records).where(F.col("episode") == a["episode"]).orderBy("place").limit(a.get("limit", 100)),
            "expire": self._expire,
            "recall": lambda a: hybrid.recall(t.records, t.vectors, self._vector(a["query"]), a["query"], self.now, a.get("k", 5), a.get("namespace")).orderBy(F.desc("score"), F.desc("id")),
            "keyword_recall": lambda a: self._text(keyword.keyword_search(t.records, a["query"], a.get("k", 5), self._where(a)), 300).orderBy(F.desc("score"), F.desc("id")),
            "stats": lambda _: analytics.namespace_sizes(t.records),
            "list_namespaces": lambda _: analytics.list_namespaces(t.records).orderBy("namespace_id").limit(1000),
        }

    def call(self, name: str, arguments: str = "{}") -> str:
        """A JSON object with rows, or with error."""
        tool = self.tools().get(name)
        if tool is None:
            return json.dumps({"error": f"no tool {name!r}"})
        try:
            rows = tool(json.loads(arguments))
        except (KeyError, ValueError) as e:
            return json.dumps({"error": f"{type(e).__name__}: {e}"})
        return json.dumps({"rows": [json.loads(r[0]) for r in graph.as_json_rows(rows).collect()]})


class VectorStore:
    """Texts in a store, found by what they are like."""

    def __init__(self, box: Toolbox):
        self.box = box

    def add_texts(self, texts: DataFrame, namespace: str = "") -> None:
        """texts: (id, content)."""
        self.box.tables = store.ingest_texts(self.box.tables, texts, self.box.embed, self.box.now, namespace)

    def similarity_search(self, query: str, k: int = 4, where: FilterSpec | None = None) -> DataFrame:
        t = self.box.tables
        return self.box._text(search.search_records(t.records, t.vectors, self.box._vector(query), self.box.now, k, where))

    def delete(self, key: str, value: str) -> None:
        """Forgets the records whose attribute has this value."""
        t = self.box.tables
        hit = t.records.where(FilterSpec().attribute(key, value).column()).select("id")
        self.box.tables = t._replace(records=lifecycle.forget(t.records, hit))

    def read(self, namespace: str | None = None, min_importance: float = 0.0) -> DataFrame:
        """Live records as documents."""
        spec = FilterSpec().min_importance(min_importance)
        hit = self.box.tables.records.where(~lifecycle.dead()).where((spec.namespace(namespace) if namespace is not None else spec).column())
        return hit.select("id", "content", "namespace_id", "attributes")


class ChatMemory(VectorStore):
    """What a conversation remembers: recent things first, a week's half-life."""

    def load(self, query: str, k: int = 5) -> DataFrame:
        t = self.box.tables
        found = search.search_records(t.records, t.vectors, self.box._vector(query), self.box.now, k, decay=Decay(7.0, 0.4))
        return self.box._text(found).orderBy(F.desc("score"), "id")

    def save(self, turns: DataFrame, namespace: str) -> None:
        """turns: (id, role, content)."""
        self.add_texts(turns.select("id", F.concat_ws(": ", "role", "content").alias("content")), namespace)


def empty_tables(spark) -> Tables:
    from recallgrid.plans.schema import EDGES, RECORDS, VECTORS, empty

    return Tables(as_records(empty(spark, RECORDS)), empty(spark, VECTORS), empty(spark, EDGES))
