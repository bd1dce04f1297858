"""One defect a page, and none."""

import pytest

from tidemark.operators import formulas_in_pages as P

NONE = dict(control_bytes=0, tabs=0, torn_commands=0, unpaired_sides=0, unbalanced_braces=0, open_delimiters=0)
PAGES = [
    (r"<p>\(\frac{a}{b} \left( x \right)\) and \[\text{t} \rho_1\] and $$\{ -4; 3 \}$$</p>", 3, {}),
    ("<p>\\(a\x0crac{b}{c}\\)</p>", 1, dict(control_bytes=1, torn_commands=1)),
    ("a\x07b", 0, dict(control_bytes=1)),
    ("\\(a\tb\\) a\tb", 1, dict(tabs=1)),
    (r"\(2 imes 3\) \(\left( x ight)\)", 2, dict(torn_commands=2, unpaired_sides=1)),
    (r"\(\left( x \rightarrow y\)", 1, dict(unpaired_sides=1)),
    (r"\(a}{b\)", 1, dict(unbalanced_braces=1)),
    (r"\[x_{1\]", 1, dict(unbalanced_braces=1)),
    (r"\(a\\{b}\)", 1, {}),
    (r"\(a\) \( b", 1, dict(open_delimiters=1)),
    ("$$a$$ $$b \\[ c", 1, dict(open_delimiters=2)),
    (r"times ight) in words alone", 0, {}),
    (None, 0, {}),
    ("", 0, {}),
]


def test_each_defect(spark):
    got = P.damage(spark.createDataFrame([(i, p) for i, (p, _, _) in enumerate(PAGES)], "i int, html string"), "html").orderBy("i").collect()
    for r, (page, n, defects) in zip(got, PAGES, strict=True):
        assert (r["n_formulas"], {k: r[k] for k in NONE}) == (n, NONE | defects), page


@pytest.mark.parametrize(("body", "bad"), [("", False), ("{}", False), ("}{", True), ("{{}", True), ("\\{", False), ("\\\\{", True)])
def test_braces(spark, body, bad):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(body,)], "b string").select(P.unbalanced(F.col("b")).alias("x")).first()["x"] is bad
