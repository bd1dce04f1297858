"""Queries of canonical digests and paths through nested documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as D
from .base import MK, mk, read, shaped, sql

QUERIES: dict = {}
ORACLES: dict = {}


def q(ctes, body: str, **kinds: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: shaped(f(spark, d), **kinds)
        ORACLES[f.__name__] = sql(ctes, body, **kinds)
        return f

    return add


@q("", """SELECT o_orderkey k, sha256('{"a":{"x":[' || o_custkey || ',' || o_orderkey || '],"y":"' || o_orderstatus || '"},"b":' || o_custkey || ',"c":null}') digest FROM orders""", k="bigint", digest="string")
def canonical_digests(spark, d):
    """Orders as documents whose keys stand in one of three orders."""
    texts = ['{{"a": {{"x": [{c}, {o}], "y": "{s}"}}, "b": {c}, "c": null}}', '{{"c":null,"b":{c},"a":{{"y":"{s}","x":[{c},{o}]}}}}', '{{ "b" : {c} , "a" : {{ "x" : [ {c} , {o} ] , "y" : "{s}" }} , "c" : null }}']
    part = {"c": F.col("o_custkey").cast("string"), "o": F.col("o_orderkey").cast("string"), "s": F.col("o_orderstatus")}

    def filled(text: str):
        out, bits = [], text.replace("{{", "\x01").replace("}}", "\x02").split("{")
        for i, bit in enumerate(bits):
            name, _, rest = bit.partition("}") if i else ("", "", bit)
            out += ([part[name]] if name else []) + [F.lit(rest.replace("\x01", "{").replace("\x02", "}"))]
        return F.concat(*out)

    text = F.coalesce(*[F.when(F.col("o_orderkey") % 3 == i, filled(t)) for i, t in enumerate(texts)])
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), D.canonical_digest(text).alias("digest"))


@q([MK, "r AS (SELECT k, t // 12 y, t, v, row_number() OVER (PARTITION BY k, t // 12 ORDER BY t) - 1 i, dense_rank() OVER (PARTITION BY k ORDER BY t // 12) - 1 j FROM mk)"], "SELECT k, 'years[' || j || '].months[' || i || '].v' AS place, v AS value FROM r", k="string", place="string", value="double")
def path_values(spark, d):
    """Revenue as a document a segment, with a list of years and lists of months, and every value in it by its path."""
    years = mk(spark, d).groupBy("k", F.floor(F.col("t") / 12).alias("y")).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("months"))
    docs = years.groupBy("k").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("y", "months"))).alias("years"))).alias("doc"))  # a number a month
    return D.walk(docs, "doc", "years[*].months[*].v").withColumnRenamed("at", "place")
