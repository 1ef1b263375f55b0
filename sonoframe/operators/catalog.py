"""A searchable catalog: token search, categories, integrity, related entries, typed parameters of agents."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(haystack: Column, search: str | Column) -> Column:
    """Every word of the search, cut at white space, stands somewhere in the haystack, whatever its case."""
    words = F.filter(F.split(F.lower(F.trim(search if isinstance(search, Column) else F.lit(search))), r"\s+"), lambda w: w != "")
    return F.forall(words, lambda w: F.contains(F.lower(haystack), w))


def search(entries: DataFrame, haystack: Column, text: str, category: str | None = None, category_column: str = "category") -> DataFrame:
    found = entries.where(matches(haystack, text))
    return found if category is None else found.where(F.col(category_column) == category)


def categories(entries: DataFrame, column: str = "category") -> DataFrame:
    """Categories with entries, and how many; empty ones aren't listed."""
    return entries.groupBy(column).agg(F.count("*").alias("n"))


def duplicates(entries: DataFrame, key: str) -> DataFrame:
    return entries.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def missing(entries: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Entries that have nothing in others."""
    return entries.join(others.select(key).distinct(), key, "left_anti")


def related(entries: DataFrame, key: str, column: str) -> DataFrame:
    """(key, position, related) of a column of lists, in order, without those that name no entry."""
    edges = entries.select(key, F.posexplode(column).alias("position", "related"))
    return edges.join(entries.select(F.col(key).alias("related")).distinct(), "related", "left_semi").select(key, "position", "related")


def machine_readable(entries: DataFrame, columns: Sequence[str], most_keywords: int = 12) -> DataFrame:
    """One JSON string for each entry that isn't secondary, with its first keywords."""
    some = entries.where(~F.coalesce(F.col("secondary"), F.lit(False))).withColumn("keywords", F.slice("keywords", 1, most_keywords))
    return some.select(F.to_json(F.struct(*columns)).alias("json"))


def with_actions(entries: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """Entries that are not secondary, each with what can be done with it, where anything can."""
    return entries.where(~F.coalesce(F.col("secondary"), F.lit(False))).join(actions, key, "left")


# --- parameters ------------------------------------------------------------------------------------------------------


def parameter_schema(parameters: Sequence[Mapping]) -> dict:
    """A closed JSON schema of parameters {key, type, min, max, enum, description}; all are optional."""
    def one(p: Mapping) -> dict:
        out = {"type": p["type"]}
        out |= {to: p[k] for k, to in (("min", "minimum"), ("max", "maximum"), ("enum", "enum"), ("description", "description")) if p.get(k) is not None}
        return out

    return {"type": "object", "properties": {p["key"]: one(p) for p in parameters}, "additionalProperties": False}


def coerce(parameters: Sequence[Mapping], given: Mapping) -> tuple[dict, list[str]]:
    """(values to use, keys ignored): numbers are clamped; wrong types, unknown keys and values off the list are ignored."""
    import math

    by_key = {p["key"]: p for p in parameters}
    used, ignored = {}, []
    for key, value in given.items():
        p = by_key.get(key)
        kind = p and p["type"]
        if kind == "number" and isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value):
            used[key] = min(p.get("max", math.inf), max(p.get("min", -math.inf), value))
        elif kind == "boolean" and isinstance(value, bool) or kind == "string" and isinstance(value, str) and (not p.get("enum") or value in p["enum"]):
            used[key] = value
        else:
            ignored.append(key)
    return used, ignored


def nearest_option(x: Column, options: Sequence[float]) -> Column:
    """The option nearest to x; of two as near, the one listed first."""
    best = F.array_min(F.array(*[F.struct(F.abs(x - o).alias("d"), F.lit(k).alias("k"), F.lit(float(o)).alias("o")) for k, o in enumerate(options)]))
    return best["o"]


def to_line(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False)
