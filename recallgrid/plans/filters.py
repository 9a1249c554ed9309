"""Record filters: every condition that is set must hold."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FilterSpec:
    """Conditions on records. Bounds are inclusive, and 0 is a bound like any
    other. All parts push down to the scan as plain predicates; namespaces
    prune partitions of a store."""

    types_in: tuple[int, ...] | None = None
    source_is: str | None = None
    source_starts: str | None = None
    ts_from: int | None = None
    ts_to: int | None = None
    importance_from: float | None = None
    tags: tuple[str, ...] = ()
    namespace_is: str | None = None
    entity_is: str | None = None
    attributes: tuple[tuple[str, str], ...] = field(default=())

    def types(self, *values: int) -> FilterSpec:
        return replace(self, types_in=tuple(values))

    def source(self, value: str) -> FilterSpec:
        return replace(self, source_is=value)

    def source_prefix(self, value: str) -> FilterSpec:
        return replace(self, source_starts=value)

    def after(self, ts: int) -> FilterSpec:
        return replace(self, ts_from=ts)

    def before(self, ts: int) -> FilterSpec:
        return replace(self, ts_to=ts)

    def min_importance(self, value: float) -> FilterSpec:
        return replace(self, importance_from=value)

    def contains_tags(self, *values: str) -> FilterSpec:
        return replace(self, tags=self.tags + values)

    def namespace(self, value: str) -> FilterSpec:
        return replace(self, namespace_is=value)

    def entity(self, value: str) -> FilterSpec:
        return replace(self, entity_is=value)

    def attribute(self, key: str, value: str) -> FilterSpec:
        return replace(self, attributes=(*self.attributes, (key, value)))

    def column(self) -> Column:
        """The condition; true where nothing is set. Tags are looked for as
        plain substrings of tags_json."""
        parts: list[Column] = []
        if self.types_in is not None:
            parts.append(F.col("type").isin(*self.types_in))
        if self.source_is is not None:
            parts.append(F.col("source") == self.source_is)
        if self.source_starts is not None:
            parts.append(F.col("source").startswith(self.source_starts))
        if self.ts_from is not None:
            parts.append(F.col("ts") >= self.ts_from)
        if self.ts_to is not None:
            parts.append(F.col("ts") <= self.ts_to)
        if self.importance_from is not None:
            parts.append(F.col("importance") >= F.lit(self.importance_from).cast("float"))
        parts += [F.col("tags_json").contains(tag) for tag in self.tags]
        if self.namespace_is is not None:
            parts.append(F.col("namespace_id") == self.namespace_is)
        if self.entity_is is not None:
            parts.append(F.col("entity_id") == self.entity_is)
        parts += [F.coalesce(F.element_at("attributes", k) == v, F.lit(False)) for k, v in self.attributes]
        out = F.lit(True)
        for part in parts:
            out = out & part
        return out
