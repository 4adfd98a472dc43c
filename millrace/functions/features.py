"""Vectors, ranking features and label tables as Column builders."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

FEATURES = ["cosine", "importance", "priority", "days_old", "access", "topic_match", "source", "length_norm"]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Null for an empty or zero vector: such a row has no vector."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), None).otherwise(F.try_divide(dot(a, b), length))


def fit(a: Column, width: int) -> Column:
    """Cut or padded with zeros to a width."""
    return F.slice(F.concat(a.cast("array<double>"), F.array_repeat(F.lit(0.0), width)), 1, width)


def weight(c: Column, table: Mapping[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def features(score: Column, importance: Column, priority: Column, created: Column, access: Column, topic: Column, source: Column, length: Column, query_topic: Column, now: Column) -> list[Column]:
    """The eight ranking features, in order. Missing values count as their defaults."""
    days = (F.unix_micros(now) - F.unix_micros(created)) / 8.64e10
    mine, asked = F.lower(F.trim(topic)), F.lower(F.trim(query_topic))
    same = (mine != "") & (asked != "") & (mine.contains(asked) | asked.contains(mine))
    cols = [
        F.coalesce(score, F.lit(0.0)),
        F.when(F.coalesce(importance, F.lit(0)) == 0, 5).otherwise(importance).cast("double"),
        weight(F.coalesce(priority, F.lit("None")), C.PRIORITY, 2.0),
        F.when(days.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(365.0), days))),
        F.least(F.lit(50), F.coalesce(access, F.lit(0))).cast("double"),
        F.coalesce(same, F.lit(False)).cast("double"),
        weight(F.coalesce(source, F.lit("None")), C.SOURCE, 1.0),
        F.least(F.lit(1.0), F.coalesce(length.cast("double"), F.lit(0.0)) / 2000.0),
    ]
    return [c.alias(n) for c, n in zip(cols, FEATURES)]


def blend(row: Mapping[str, Column] | None = None) -> Column:
    """Linear score of the features; most of it is the cosine."""
    r = row or {n: F.col(n) for n in FEATURES}
    recency = F.greatest(F.lit(0.0), 1.0 - r["days_old"] / 365.0)
    return 1.60 * r["cosine"] + 0.55 * (r["importance"] / 10.0) + 0.50 * (r["priority"] / 3.0) + 0.45 * recency + 0.40 * r["topic_match"] + 0.20 * F.least(F.lit(1.0), r["access"] / 20.0)


def grade(score: Column, days_old: Column, cos: Column, noise: Column | None = None) -> Column:
    """Training grade 0 to 3: the score less an age penalty for memories off the point, plus noise."""
    s = score - F.when(days_old > 180, 0.35 * (1.0 - cos)).otherwise(0.0) + (F.lit(0.0) if noise is None else noise)
    return F.greatest(F.lit(0), F.least(F.lit(3), F.bround(s * 3.0 / 3.2).cast("int")))


def relabel(c: Column, table: Mapping[str, list[str]], labels: list[str], default: str | None, extra: Mapping[str, str] | None = None) -> Column:
    """A model's label as one of ours: ours as it is, `label_n` by position, others by table."""
    low = F.trim(F.lower(c))
    index = F.regexp_extract(low, r"^label_.*?([^_]*)$", 1).try_cast("int")
    by_index = F.coalesce(F.get(F.array(*map(F.lit, labels)), index), F.lit(default).cast("string"))
    pairs = [x for k, vs in table.items() for v in vs for x in (F.lit(v), F.lit(k))] + [F.lit(x) for kv in (extra or {}).items() for x in kv]
    return F.when(low.isin(labels), low).when(low.startswith("label_"), by_index).otherwise(F.coalesce(F.try_element_at(F.create_map(*pairs), low), F.lit(default).cast("string")))


def first_mapped(found: Column, table: Mapping[str, list[str]]) -> Column:
    """The label of the first entry that the table knows; null if it knows none."""
    m = F.create_map(*[F.lit(x) for k, vs in table.items() for v in vs for x in (v, k)])
    return F.get(F.filter(F.transform(found, lambda x: F.try_element_at(m, x)), lambda x: x.isNotNull()), 0)


def toxicity(scores: Column) -> Column:
    """Of a map of label to score: the greatest of labels about toxicity, hate or threats; 0 if none."""
    found = F.filter(F.map_entries(scores), lambda e: F.lower(e["key"]).rlike("toxic|hate|threat"))
    return F.coalesce(F.array_max(F.transform(found, lambda e: e["value"])), F.lit(0.0))
