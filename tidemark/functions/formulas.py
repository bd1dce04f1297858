"""Formulas over named fields, as text, turned into columns.

A formula has numbers, fields in braces ({name} a number, {name[*]} a list of numbers),
+ - * / ** and parentheses, and calls of FUNCTIONS by name.  Anything else is refused
before a column is made: no other name, attribute, index, comparison, keyword or string
gets through, and nothing is ever executed as code.

Undefined results are null: division by 0, roots and logarithms outside their domain,
statistics of too few numbers.  Nulls in a list are left out.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD = re.compile(r"\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*(\[\*\])?\s*\}")
_NAME = "field_{}_"

#: Coefficients of a rational approximation of the normal distribution function, good to 1e-14 (Hart's, 1968).
_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


class Refused(ValueError):
    """The text isn't a formula."""


def normal_cdf(x: Column) -> Column:
    """Share of the standard normal distribution below x."""
    z = F.abs(x)

    def poly(terms: tuple[float, ...]) -> Column:
        out = F.lit(terms[0])
        for t in terms[1:]:
            out = out * z + t
        return out

    tail = F.exp(-z * z / 2)
    near = tail * poly(_ABOVE) / poly(_BELOW)
    far = tail / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / 2.506628274631
    below = F.when(z > 37, 0.0).when(z < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - below).otherwise(below)


def _fold(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0.0), step)


def _sum(v: Column) -> Column:
    return _fold(v, lambda a, x: a + x)


def _mean(v: Column) -> Column:
    return F.when(F.size(v) > 0, _sum(v) / F.size(v))


def _squares(v: Column, middle: Column) -> Column:
    return _fold(v, lambda a, x: a + (x - middle) * (x - middle))


def _sd(v: Column) -> Column:
    return F.when(F.size(v) > 1, F.sqrt(_squares(v, _mean(v)) / (F.size(v) - 1)))


def _corr(x: Column, y: Column) -> Column:
    mx, my = _mean(x), _mean(y)
    both = _fold(F.zip_with(x, y, lambda a, b: (a - mx) * (b - my)), lambda a, v: a + v)
    return F.when(F.size(x) == F.size(y), both / F.nullif(F.sqrt(_squares(x, mx) * _squares(y, my)), F.lit(0.0)))


#: What may be called: name -> (arguments that are lists, least and most arguments, of the rest).
FUNCTIONS: dict[str, tuple[str, int, int, Callable]] = {
    "sqrt": ("number", 1, 1, lambda x: F.when(x >= 0, F.sqrt(x))),
    "ceil": ("number", 1, 1, lambda x: F.ceil(x).cast("double")),
    "floor": ("number", 1, 1, lambda x: F.floor(x).cast("double")),
    "log": ("number", 1, 1, lambda x: F.when(x > 0, F.log(x))),
    "exp": ("number", 1, 1, F.exp),
    "abs": ("number", 1, 1, F.abs),
    "Phi": ("number", 1, 1, normal_cdf),
    "round": ("number", 1, 2, None),
    "sum": ("list", 1, 1, _sum),
    "mean": ("list", 1, 1, _mean),
    "sd": ("list", 1, 1, _sd),
    "len": ("list", 1, 1, lambda v: F.size(v).cast("double")),
    "corr": ("list", 2, 2, _corr),
    "min": ("either", 1, 9, None),
    "max": ("either", 1, 9, None),
}


def fields(formula: str) -> list[tuple[str, bool]]:
    """(name, is a list) of the fields that a formula reads, in order."""
    return list(dict.fromkeys((m[1], bool(m[2])) for m in FIELD.finditer(formula)))


def column(formula: str, of: Callable[[str], Column] = F.col) -> Column:
    """A formula as a column; of gives the column of a field."""
    read = fields(formula)
    text = FIELD.sub(lambda m: f" {_NAME.format(m[1])}{'l' if m[2] else 's'} ", formula)
    if "{" in text or "}" in text:
        raise Refused(f"braces that hold no field: {formula}")
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise Refused(f"not a formula: {formula}") from e
    known = {_NAME.format(n) + ("l" if many else "s"): (n, many) for n, many in read}

    def number(node: ast.AST) -> Column:
        kind, made = visit(node)
        if kind != "number":
            raise Refused(f"a list stands where a number must: {formula}")
        return made

    def visit(node: ast.AST) -> tuple[str, Column]:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return "number", F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in known:
            name, many = known[node.id]
            return ("list", F.filter(F.transform(of(name), lambda x: x.cast("double")), lambda x: x.isNotNull())) if many else ("number", of(name).cast("double"))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
            return "number", -number(node.operand) if isinstance(node.op, ast.USub) else number(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = number(node.left), number(node.right)
            if isinstance(node.op, ast.Add):
                return "number", a + b
            if isinstance(node.op, ast.Sub):
                return "number", a - b
            if isinstance(node.op, ast.Mult):
                return "number", a * b
            if isinstance(node.op, ast.Div):
                return "number", a / F.nullif(b, F.lit(0.0))
            if isinstance(node.op, ast.Pow):
                return "number", F.pow(a, b)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and not node.keywords:
            return "number", call(node.func.id, node.args)
        raise Refused(f"{type(node).__name__} has no place in a formula: {formula}")

    def call(name: str, args: list[ast.AST]) -> Column:
        takes, least, most, make = FUNCTIONS[name]
        if not least <= len(args) <= most:
            raise Refused(f"{name} takes {least} to {most} arguments: {formula}")
        if name == "round":
            places = args[1].value if len(args) == 2 and isinstance(args[1], ast.Constant) and type(args[1].value) is int else 0
            if len(args) == 2 and not (isinstance(args[1], ast.Constant) and type(args[1].value) is int):
                raise Refused(f"round takes a whole number of places: {formula}")
            return F.round(number(args[0]), places)
        made = [visit(a) for a in args]
        kinds = {k for k, _ in made}
        if takes == "either":
            if kinds == {"list"} and len(made) == 1:
                return (F.array_min if name == "min" else F.array_max)(made[0][1])
            if kinds == {"number"} and len(made) > 1:
                return (F.least if name == "min" else F.greatest)(*[c for _, c in made])
            raise Refused(f"{name} takes one list or several numbers: {formula}")
        if kinds != {takes}:
            raise Refused(f"{name} takes a {takes}: {formula}")
        return make(*[c for _, c in made])

    return number(tree)


def evaluate(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """df with a column for each formula."""
    return df.withColumns({name: column(text) for name, text in formulas.items()})


def shifted(value: Column, place: Column | int) -> Column:
    """A number moved by 0.6 to 2.0, by its place in its list."""
    place = F.lit(place) if isinstance(place, int) else place
    return value.cast("double") + 1.3 + 0.7 * F.sin(3.1 * place + 1.0)


def liveness(df: DataFrame, keys: list[str], formulas: dict[str, str], places: dict[str, int]) -> DataFrame:
    """(keys, field, formula, reads, moved, dead): whether each formula's printed value moves when one field is shifted, and which that read it don't.

    places: decimals to which a formula is printed; it moves if it changes by more than
    half a unit of the last.  df: a row a key.  Each row goes out once a field, so the
    number of rows is that of fields, not of pairs.
    """
    read = {name: fields(text) for name, text in formulas.items()}
    every = list(dict.fromkeys(f for fs in read.values() for f in fs))
    base = evaluate(df, {f"base_{n}": t for n, t in formulas.items()})
    each = base.withColumn("field", F.explode(F.array(*[F.lit(n) for n, _ in every])))
    moved = {n: F.when(F.col("field") == n, F.transform(F.col(n), lambda x, i: shifted(x, i)) if many else shifted(F.col(n), 0)).otherwise(F.col(n).cast("array<double>" if many else "double")) for n, many in every}
    each = each.select(*keys, "field", *[F.col(f"base_{n}") for n in formulas], *[c.alias(f"moved_{n}") for n, c in moved.items()])
    # null where it was a number, or the other way, is a move too
    change = lambda name, text: ~F.coalesce(F.abs(column(text, lambda f: F.col(f"moved_{f}")) - F.col(f"base_{name}")) <= 0.5 * 10.0 ** -places[name], F.col(f"base_{name}").isNull() & column(text, lambda f: F.col(f"moved_{f}")).isNull())
    rows = F.array(*[F.struct(F.lit(name).alias("formula"), F.col("field").isin(*[n for n, _ in read[name]]).alias("reads"), change(name, text).alias("moved")) for name, text in formulas.items()])
    return each.select(*keys, "field", F.explode(rows).alias("x")).select(*keys, "field", "x.*").withColumn("dead", F.col("reads") & ~F.col("moved"))
