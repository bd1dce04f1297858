"""Nested documents: a canonical text and its digest, and the values along a path."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A step of a path: a name, [*] for all members of a list, [n] for one, from 0.
STEP = re.compile(r"\.?([A-Za-z_][A-Za-z0-9_]*)|\[(\*|\d+)\]")


def canonical(json: Column) -> Column:
    """A JSON text with the keys of each object in order, without white space; lists stay in theirs.  Null if it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def canonical_digest(json: Column) -> Column:
    """SHA-256 of the canonical text: the same for documents that differ in the order of keys and white space alone."""
    return F.sha2(canonical(json), 256)


def steps(path: str) -> list[str | int | None]:
    """Names, places and None for [*]; a path that has anything else is an error."""
    found, at = [], 0
    for m in STEP.finditer(path):
        if m.start() != at or (at == 0 and m[0].startswith(".")):
            break
        found.append(m[1] if m[1] else None if m[2] == "*" else int(m[2]))
        at = m.end()
    if at != len(path) or not found:
        raise ValueError(f"not a path: {path}")
    return found


def pattern_of(path: str) -> str:
    """A path with [*] for each place."""
    return re.sub(r"\[\d+\]", "[*]", path)


def walk(df: DataFrame, json: str, path: str, kind: str = "double") -> DataFrame:
    """df without json, a row for each value at path: at, its own path, and value as kind; strict: a field or a place that is absent is an error, a null value is not."""
    every = [c for c in df.columns if c != json]
    row = F.struct(*[F.col(c) for c in every]).alias("_row")
    now = df.select(row, F.parse_json(F.col(json)).alias("_v"), F.lit("").alias("_at"))
    for step in steps(path):
        if step is None:
            members = F.variant_get("_v", "$", "array<variant>")
            lists = F.when(F.schema_of_variant("_v").startswith("ARRAY"), members).otherwise(F.raise_error(F.concat(F.lit("not a list at "), "_at")).cast("array<variant>"))
            now = now.select("_row", "_at", F.posexplode(lists).alias("_i", "_v")).select("_row", "_v", F.concat("_at", F.lit("["), F.col("_i").cast("string"), F.lit("]")).alias("_at"))
            continue
        name = f"[{step}]" if isinstance(step, int) else f".{step}"
        shown = name if isinstance(step, int) else F.concat(F.when(F.col("_at") == "", "").otherwise("."), F.lit(step))
        there = F.try_variant_get("_v", f"${name}", "variant")
        found = F.when(there.isNotNull(), there).otherwise(F.raise_error(F.concat(F.lit(f"no {name} at "), "_at")).cast("variant"))
        now = now.select("_row", found.alias("_v"), F.concat("_at", shown if isinstance(shown, Column) else F.lit(shown)).alias("_at"))
    return now.select("_row.*", F.col("_at").alias("at"), F.try_variant_get("_v", "$", kind).alias("value"))
