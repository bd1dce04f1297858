"""Damage to formulas in pages: eaten escapes, torn commands, delimiters and braces out of balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is left of a command whose first letter was eaten with its backslash.
TAILS = ("ight)", "ight]", "ight|", "ight.", "ext{", "extbf{", "extit{", "ar{", "rac{", "ho_", "ho}", "au_", "heta", "lpha", "eta_", "pprox", "imes")
#: Formulas: between \\( and \\), \\[ and \\], or two pairs of dollars.
REGION = r"(?s)\\\(.*?\\\)|\\\[.*?\\\]|\$\$.*?\$\$"
_SIGNS = "()[]{}|.^$*+?\\"


def quoted(text: str) -> str:
    """text as a pattern."""
    return "".join("\\" + c if c in _SIGNS else c for c in text)


def formulas(raw: Column) -> Column:
    """Bodies of the formulas of a page, in order."""
    return F.transform(F.regexp_extract_all(raw, F.lit(REGION), F.lit(0)), lambda x: F.substring(x, F.lit(3), F.length(x) - 4))


def _total(bodies: Column, of) -> Column:
    return F.aggregate(bodies, F.lit(0), lambda a, x: a + of(x))


def unbalanced(body: Column) -> Column:
    """Whether braces of a formula close before they open, or are not as many; a sign behind a backslash is none."""
    signs = F.split(F.regexp_replace(F.regexp_replace(body, r"(?s)\\.", ""), r"[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    step = lambda a, c: F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
    end = F.aggregate(signs, start, lambda a, c: F.struct((a["depth"] + step(a, c)).alias("depth"), F.least(a["least"], a["depth"] + step(a, c)).alias("least")))
    return (end["depth"] != 0) | (end["least"] < 0)


def damage(pages: DataFrame, raw: str) -> DataFrame:
    """pages with n_formulas and counts of damage: control bytes that no page has, tabs and torn commands within formulas, formulas with unlike numbers of \\left and \\right or with braces out of balance, and kinds of delimiters that don't pair up.  A null page has no formulas and no damage."""
    text = F.coalesce(F.col(raw), F.lit(""))
    bodies, count = formulas(text), lambda pattern: (lambda x: F.regexp_count(x, F.lit(pattern)))
    torn = r"(?<![A-Za-z\\])(?:" + "|".join(map(quoted, TAILS)) + ")"
    flag = lambda c: F.when(c, 1).otherwise(0)
    unlike = lambda a, b: flag(F.regexp_count(text, F.lit(quoted(a))) != F.regexp_count(text, F.lit(quoted(b))))
    return pages.withColumns(
        {
            "n_formulas": F.size(bodies),
            "control_bytes": count(r"[\x07\x08\x0B\x0C]")(text),
            "tabs": _total(bodies, count(r"\t")),
            "torn_commands": _total(bodies, count(torn)),
            "unpaired_sides": _total(bodies, lambda x: flag(count(r"\\left(?![A-Za-z])")(x) != count(r"\\right(?![A-Za-z])")(x))),
            "unbalanced_braces": _total(bodies, lambda x: flag(unbalanced(x))),
            "open_delimiters": unlike("\\(", "\\)") + unlike("\\[", "\\]") + flag(F.regexp_count(text, F.lit(r"\$\$")) % 2 == 1),
        }
    )
