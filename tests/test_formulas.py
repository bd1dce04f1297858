"""Formulas: values against Python, and refusal of everything that is none."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.functions import formulas as R


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, 4.0, -2.5, [1.0, 2.0, 4.0, None], [2.0, 1.0, 7.0]), (2, 0.0, 0.0, [], [1.0]), (3, None, 1.0, None, None)], "id int, a double, b double, xs array<double>, ys array<double>")


def value(rows, formula, of=1):
    return R.evaluate(rows.where(F.col("id") == of), {"out": formula}).first()["out"]


def test_values(rows):
    xs, ys = [1.0, 2.0, 4.0], [2.0, 1.0, 7.0]
    for formula, want in {
        "{a} + {b} * 2 - -1": 0.0, "({a} - 1) ** 2 / 3": 3.0, "sqrt({a})": 2.0, "ceil({b}) + floor({b})": -5.0, "log({a})": math.log(4), "exp({b})": math.exp(-2.5),
        "abs({b})": 2.5, "round({b} / 3, 2)": -0.83, "sum({xs[*]})": 7.0, "mean({xs[*]})": 7 / 3, "sd({xs[*]})": statistics.stdev(xs), "len({xs[*]})": 3.0,
        "corr({xs[*]}, {ys[*]})": statistics.correlation(xs, ys), "min({xs[*]}) + max({ys[*]})": 8.0, "max({a}, {b}, 3)": 4.0, "min({a}, 1e-3)": 0.001, " { a } ": 4.0,
    }.items():
        assert value(rows, formula) == pytest.approx(want, abs=1e-12), formula


def test_undefined_is_null(rows):
    for formula in ("1 / {a}", "log({a})", "sqrt({a} - 1)", "mean({xs[*]})", "sd({ys[*]})", "corr({xs[*]}, {ys[*]})", "corr({ys[*]}, {ys[*]})", "max({xs[*]})"):
        assert value(rows, formula, 2) is None, formula
    assert value(rows, "{a} + 1", 3) is None and value(rows, "sum({xs[*]})", 3) is None


def test_the_normal_distribution(spark):
    xs = [-40.0, -9.0, -7.2, -3.0, -0.5, 0.0, 0.1, 1.96, 5.0, 7.5, 40.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", R.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), abs=1e-14) for r in got)


@pytest.mark.parametrize(
    "text",
    ["__import__('os')", "{a}.real", "{a} if 1 else 2", "[x for x in {xs[*]}]", "{a}[0]", "lambda: 1", "open('x')", "eval({a})", "'a'", "{a} < 2", "{a} and 1", "True", "a + 1", "1j", "{xs[*]}", "{xs[*]} + 1", "sqrt({xs[*]})",
     "mean({a})", "sum()", "round({a}, {b})", "max({a})", "max({xs[*]}, 1)", "sqrt(x={a})", "sqrt(*{xs[*]})", "{a;b}", "{a} {", "", "1 +", "{a} := 1", "f'{1}'", "{a} // 2", "{a} % 2", "~1", "field_a_s", "(" * 300],
)
def test_all_else_is_refused(text):
    with pytest.raises(R.Refused):
        R.column(text)


def test_a_formula_that_does_not_depend_on_its_field_is_dead(rows):
    got = R.liveness(rows.where("id = 1"), ["id"], {"live": "{a} + {b}", "dead": "0 * {a} + {b}", "list": "sd({xs[*]})"}, {"live": 1, "dead": 1, "list": 2})
    found = {(r["field"], r["formula"]): (r["reads"], r["moved"], r["dead"]) for r in got.collect()}
    assert found["a", "dead"] == (True, False, True) and found["b", "dead"] == (True, True, False) and found["a", "live"] == (True, True, False)
    assert found["xs", "live"] == (False, False, False) and found["xs", "list"] == (True, True, False) and len(found) == 9
