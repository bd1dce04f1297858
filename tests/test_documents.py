"""Canonical digests and paths."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import documents as D


def test_digests_don_t_depend_on_the_order_of_keys(spark):
    same = ['{"b": 1, "a": {"d": [1, 2, {"z": null, "y": "x"}], "c": 2.5}}', '{"a":{"c":2.5,"d":[1,2,{"y":"x","z":null}]},"b":1}']
    other = ['{"a":{"c":2.5,"d":[2,1,{"y":"x","z":null}]},"b":1}', '{"a":{"c":2.5,"d":[1,2,{"y":"x"}]},"b":1}', '{"a": 1', None]
    got = [r["h"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(same + other)], "i int, t string").select("i", D.canonical_digest(F.col("t")).alias("h")).orderBy("i").collect()]
    assert got[0] == got[1] and len({got[0], got[2], got[3]}) == 3 and got[4] is None and got[5] is None


def test_paths(spark):
    df = spark.createDataFrame([(1, '{"a": [{"b": [1, 2.5]}, {"b": []}, {"b": [null]}], "c": {"d": "7"}}')], "id int, doc string").withColumn("at_", F.lit(1))
    rows = lambda path, kind="double": [(r["at"], r["value"]) for r in D.walk(df, "doc", path, kind).orderBy("at").collect()]
    assert rows("a[*].b[*]") == [("a[0].b[0]", 1.0), ("a[0].b[1]", 2.5), ("a[2].b[0]", None)]
    assert rows("a[0].b[1]") == [("a[0].b[1]", 2.5)] and rows("c.d", "string") == [("c.d", "7")]
    assert D.pattern_of("a[0].b[12].c") == "a[*].b[*].c"
    for path, message in (("a[*].x", "no .x"), ("c[*]", "not a list"), ("a[9]", r"no \[9\]")):
        with pytest.raises(Exception, match=message):
            rows(path)
    for wrong in ("", "a b", ".a", "a[x]", "a..b", "a["):
        with pytest.raises(ValueError, match="not a path"):
            D.steps(wrong)
