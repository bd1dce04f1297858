"""Queries of damaged formulas in pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import formulas_in_pages as P
from .base import read, shaped, sql

QUERIES: dict = {}
ORACLES: dict = {}

#: What is put behind a page, by its number: formulas whole and damaged, with the page's number in them.
BEHIND = (r"\(\frac{%}{2} \left( x \right)\)", r"\(2 imes % ight)\) $$a", r"\[x_{%\] \(a}{%\)", "\\(%\tb\\) \\left(", r"\(\left( % \rightarrow y\) \[ b", r"$$\{ -4; % \}$$ ext{ \(lpha_% + ho_1\)")
_N = {"n_formulas": "int", "control_bytes": "bigint", "tabs": "bigint", "torn_commands": "bigint", "unpaired_sides": "bigint", "unbalanced_braces": "bigint", "open_delimiters": "bigint"}


def q(ctes, body: str, **kinds: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: shaped(f(spark, d), **kinds)
        ORACLES[f.__name__] = sql(ctes, body, **kinds)
        return f

    return add


_TEXT = "html || CASE page_id % " + str(len(BEHIND)) + " " + " ".join(f"WHEN {i} THEN replace('{t}', '%', CAST(page_id AS VARCHAR))" for i, t in enumerate(BEHIND)) + " END"
_EACH = lambda x: f"coalesce(list_sum(list_transform(bs, lambda b: {x})), 0)"
_FOUND = lambda p: f"len(regexp_extract_all(b, '{p}'))"
_DEPTH = r"list_transform(string_split(regexp_replace(regexp_replace(b, '(?s)\\.', '', 'g'), '[^{}]', '', 'g'), ''), lambda c: CASE c WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END)"
_OPEN = lambda a, b: f"CAST((length(t) - length(replace(t, '{a}', ''))) <> (length(t) - length(replace(t, '{b}', ''))) AS INT)"


@q(
    [
        f"tx AS (SELECT page_id, {_TEXT} t FROM pages)",
        r"fo AS (SELECT *, list_transform(regexp_extract_all(t, '(?s)\\\(.*?\\\)|\\\[.*?\\\]|\$\$.*?\$\$'), lambda x: x[3:-3]) bs FROM tx)",
        f"de AS (SELECT page_id, list_transform(bs, lambda b: {_DEPTH}) ds FROM fo)",
        "br AS (SELECT page_id, coalesce(list_sum(list_transform(ds, lambda l: CAST(coalesce(list_sum(l), 0) <> 0 OR coalesce(list_min(list_transform(generate_series(1, len(l)), lambda i: list_sum(l[1:i]))), 0) < 0 AS INT))), 0) bad FROM de)",
    ],
    f"SELECT page_id p, len(bs) n_formulas, len(regexp_extract_all(t, '[\\x07\\x08\\x0B\\x0C]')) control_bytes, {_EACH(_FOUND(chr(92) + 't'))} tabs, "
    + _EACH(_FOUND(r"(?:^|[^A-Za-z\\])(?:" + "|".join(map(P.quoted, P.TAILS)) + ")")) + " torn_commands, "
    + _EACH("CAST(" + _FOUND(r"\\left(?:[^A-Za-z]|$)") + " <> " + _FOUND(r"\\right(?:[^A-Za-z]|$)") + " AS INT)") + " unpaired_sides, bad unbalanced_braces, "
    + " + ".join([_OPEN(r"\(", r"\)"), _OPEN(r"\[", r"\]"), r"len(regexp_extract_all(t, '\$\$')) % 2"]) + " open_delimiters FROM fo JOIN br USING (page_id)",
    p="bigint", **_N,
)
def formula_damage(spark, d):
    pages = read(spark, d, "pages")
    behind = F.coalesce(*[F.when(F.col("page_id") % len(BEHIND) == i, F.replace(F.lit(t), F.lit("%"), F.col("page_id").cast("string"))) for i, t in enumerate(BEHIND)])
    return P.damage(pages.select(F.col("page_id").alias("p"), F.concat("html", behind).alias("html")), "html")
