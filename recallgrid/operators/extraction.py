"""Facts, entities and ontology edges: validation, contradictions, ingestion."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallgrid.functions import vectors as V
from recallgrid.functions.text import hashed_id, leading_number
from recallgrid.operators.graph import both_ways
from recallgrid.operators.search import search_batch

TOLERANCE = 0.02
FACTS_MOST = 20
CONFIDENCE_LEAST = 0.5
SEVERITY_WEIGHT = {"definite": 1.0, "probable": 0.7, "possible": 0.4}
# Relations that a linker may propose.
LINK_RELATIONS = (
    "caused_by", "supports", "contradicts", "supersedes", "part_of", "refers_to", "extracted_from", "uses_creative", "targets_segment", "same_segment_as", "similar_creative_to",
)
FACT_JSON = "array<struct<subject:string,predicate:string,object:string,confidence:double,valid_at:bigint>>"


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def contradictions(new: DataFrame, stored: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Findings (new_id, stored_id, severity, resolution) of new facts (id,
    subject, predicate, object, valid_at) against stored ones: the same
    subject and predicate with another object. Numbers within tolerance are
    "possible" / "merge"; else numbers are "probable" and texts "definite",
    but "possible" if one fact's time is later ("supersedes" where that is
    the new one's). One hash join on subject and predicate."""
    def side(facts: DataFrame, p: str) -> DataFrame:
        bare = F.trim(F.coalesce("object", F.lit("")))
        return facts.select(F.col("id").alias(f"{p}_id"), normal(F.col("subject")).alias("s"), normal(F.col("predicate")).alias("p"), bare.alias(f"{p}_o"), leading_number(bare).alias(f"{p}_n"), F.nullif("valid_at", F.lit(0).cast("bigint")).alias(f"{p}_v"))

    joined = side(new, "new").join(side(stored, "stored"), ["s", "p"])
    joined = joined.where((F.col("new_id") != F.col("stored_id")) & (F.col("stored_o") != "") & (F.lower("stored_o") != F.lower("new_o")))
    numeric = F.col("new_n").isNotNull() & F.col("stored_n").isNotNull()
    base = F.greatest(F.abs("new_n"), F.abs("stored_n"), F.lit(1e-9))
    close = numeric & (F.abs(F.col("new_n") - F.col("stored_n")) / base <= tolerance)
    later, earlier = F.col("new_v") > F.col("stored_v"), F.col("new_v") < F.col("stored_v")
    severity = F.when(close | later | earlier, "possible").when(numeric, "probable").otherwise("definite")
    resolution = F.when(close, "merge").when(later, "supersedes").otherwise("review")
    return joined.select("new_id", "stored_id", severity.alias("severity"), resolution.alias("resolution"))


def contradiction_edges(findings: DataFrame) -> DataFrame:
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITY_WEIGHT.items() for x in pair]), F.col("severity"))
    return findings.select(F.col("new_id").alias("src"), F.col("stored_id").alias("dst"), F.lit("contradicts").alias("rel_type"), weight.cast("float").alias("weight"))


def suspicious_pairs(records: DataFrame, vectors: DataFrame, edges: DataFrame, least: float = 0.9, k: int = 10) -> DataFrame:
    """(a, b, similarity), a < b: alike by 1 / (1 + squared distance) but from
    different sources, and not linked yet."""
    near = search_batch(vectors, vectors.select(F.col("id").alias("query_id"), "vec"), k + 1).where("query_id <> id")
    alike = near.withColumn("similarity", V.similarity(F.col("distance"))).where(F.col("similarity") >= least)
    source = records.select("id", "source")
    joined = alike.join(source.select(F.col("id").alias("query_id"), F.col("source").alias("source_a")), "query_id").join(source, "id").where("source <> source_a")
    pairs = joined.groupBy(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).agg(F.max("similarity").alias("similarity"))
    return pairs.join(both_ways(edges).select(F.col("id").alias("a"), F.col("other").alias("b")), ["a", "b"], "left_anti")


def facts_of(answers: DataFrame, key: str = "id", answer: str = "answer") -> DataFrame:
    """Facts from a model's JSON answers (a list, or an object with "facts"):
    key, nth, subject, predicate, object, confidence, valid_at. Incomplete
    triples and confidences under CONFIDENCE_LEAST go, confidences are held to
    0..1 (null: 1), and at most FACTS_MOST stay, in order."""
    is_list = F.ltrim(answer).startswith("[")
    listed = F.when(is_list, F.from_json(answer, FACT_JSON)).otherwise(F.from_json(answer, f"struct<facts:{FACT_JSON}>")["facts"])
    rows = answers.select(F.col(key), F.posexplode(listed).alias("at", "f"))
    text = {c: F.trim(F.col(f"f.{c}")) for c in ("subject", "predicate", "object")}
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("f.confidence", F.lit(1.0))))
    good = rows.select(key, "at", *[v.alias(c) for c, v in text.items()], sure.alias("confidence"), F.col("f.valid_at").alias("valid_at")).where("subject <> '' and predicate <> '' and object <> ''").where(F.col("confidence") >= CONFIDENCE_LEAST)
    nth = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    return good.withColumn("nth", nth).where(F.col("nth") <= FACTS_MOST).select(key, "nth", "subject", "predicate", "object", "confidence", "valid_at")


def resolved_entities(surfaces: DataFrame, resolved: DataFrame) -> DataFrame:
    """One entity for each surface (surface): that of resolved (surface,
    canonical, entity_type), or itself with type "other"; types in lower case
    with "_", of 64 characters at most."""
    kind = F.substring(F.regexp_replace(F.lower(F.trim(F.coalesce("entity_type", F.lit("other")))), "[^a-z0-9]+", "_"), 1, 64)
    first = resolved.groupBy("surface").agg(F.min(F.struct("canonical", "entity_type")).alias("r"))
    joined = surfaces.select("surface").distinct().join(first, "surface", "left").select("surface", F.coalesce("r.canonical", "surface").alias("canonical"), F.col("r.entity_type").alias("entity_type"))
    return joined.select("surface", "canonical", kind.alias("entity_type"), hashed_id(F.concat(F.lit("entity:"), F.lower("canonical"))).alias("entity_id"))


def ontology_edges(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """Of proposed edges (src, dst, rel_type, weight, rationale) those with a
    known relation between known ids (id), not to themselves, and with a
    rationale where they contradict or supersede; weights held to 0..1."""
    good = proposed.where(F.col("rel_type").isin(*LINK_RELATIONS) & (F.col("src") != F.col("dst")))
    good = good.where(~F.col("rel_type").isin("contradicts", "supersedes") | (F.trim(F.coalesce("rationale", F.lit(""))) != ""))
    for end in ("src", "dst"):
        good = good.join(known.select(F.col("id").alias(end)), end, "left_semi")
    return good.select("src", "dst", "rel_type", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)))).cast("float").alias("weight"), "rationale")


def repaired_json(text: str):
    """The first JSON value in a text that may hold fences, words around it
    or commas before closing brackets; None without one."""
    bare = re.sub(r"```(?:json)?", "", text or "")
    for start in (m.start() for m in re.finditer(r"[\[{]", bare)):
        depth, quoted, skip = 0, False, False
        for end in range(start, len(bare)):
            c = bare[end]
            if quoted:
                quoted, skip = (c != '"' or skip), c == "\\" and not skip
            elif c == '"':
                quoted = True
            else:
                depth += (c in "[{") - (c in "]}")
                if not depth:
                    piece = bare[start : end + 1]
                    for attempt in (piece, re.sub(r",\s*([\]}])", r"\1", piece)):
                        try:
                            return json.loads(attempt)
                        except ValueError:
                            continue
                    break
    return None


def complete(texts: DataFrame, model: Callable[[str], str], key: str = "id", text: str = "text") -> DataFrame:
    """(key, answer): a model's answers as clean JSON, null where there is
    none. model runs on the executors, a text at a time."""
    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            values = [repaired_json(model(t)) for t in frame[text]]
            frame = frame[[key]].copy()
            frame["answer"] = [None if v is None else json.dumps(v) for v in values]
            yield frame

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, answer string")


def ingest(sources: DataFrame, stored: DataFrame, model: Callable[[str], str]) -> dict[str, DataFrame]:
    """Sources (id, content) through a model of facts: facts with stable ids,
    findings against stored facts, the edges of provenance and contradiction,
    and one row of stats."""
    answers = complete(sources.select("id", F.col("content").alias("text")), model)
    facts = facts_of(answers).withColumnRenamed("id", "source_id")
    facts = facts.withColumn("id", hashed_id(F.concat_ws("\x1f", F.lit("fact"), F.col("source_id").cast("string"), "subject", "predicate", "object")))
    findings = contradictions(facts, stored)
    provenance = facts.select(F.col("id").alias("src"), F.col("source_id").alias("dst"), F.lit("extracted_from").alias("rel_type"), F.lit(1.0).cast("float").alias("weight"))
    stats = sources.agg(F.count("*").alias("sources")).join(facts.agg(F.count("*").alias("facts"))).join(findings.agg(F.count("*").alias("contradictions"), F.count_if(F.col("severity") == "definite").alias("definite"), F.count_if(F.col("severity") == "probable").alias("probable"), F.count_if(F.col("severity") == "possible").alias("possible")))
    return {"facts": facts, "findings": findings, "edges": provenance.unionByName(contradiction_edges(findings)), "stats": stats}


def profile(rows: DataFrame, brand: str, user: str) -> DataFrame:
    """Rows of a domain as records' fields: namespace the brand, entity the
    user, all other columns as attributes in text."""
    others = [c for c in rows.columns if c not in ("id", "content", brand, user)]
    pairs = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in others]), F.array(*[F.col(c).cast("string") for c in others])), lambda _, v: v.isNotNull()) if others else F.create_map().cast("map<string,string>")
    return rows.select("id", "content", F.col(brand).cast("string").alias("namespace_id"), F.col(user).cast("string").alias("entity_id"), pairs.alias("attributes"))


def number_of(attribute: str) -> Column:
    """An attribute read back as a number, 0 where it isn't one."""
    return F.coalesce(F.element_at("attributes", attribute).try_cast("double"), F.lit(0.0))
