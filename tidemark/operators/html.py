"""Page operators: visible text, words, links, counts of defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, white space single."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))


def tag_count(html: Column, tag: str) -> Column:
    return F.regexp_count(html, F.lit(rf"(?i)<{tag}[\s>]"))


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def defects(pages: DataFrame, html: str) -> DataFrame:
    """Counts of text defects: doubled words, doubled spaces within a line, space before a mark, tags that show as text, control bytes, unbalanced braces."""
    text = visible_text(F.col(html))
    bare = F.regexp_replace(F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", ""), r"<[^>]*>", "")
    return pages.withColumns(
        {
            "double_spaces": F.regexp_count(bare, F.lit(r"[^\s] {2,}(?=[^\s])")),
            "stray_tags": F.regexp_count(text, F.lit(r"(?i)&lt;/?[a-z][a-z0-9]*\b")),
            "double_words": F.regexp_count(text, F.lit(r"(?i)\b(\w+) \1\b")),
            "space_before_mark": F.regexp_count(text, F.lit(r" [,.;:!?]")),
            "control_bytes": F.regexp_count(F.col(html), F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")),
            "brace_balance": F.regexp_count(F.col(html), F.lit(r"\{")) - F.regexp_count(F.col(html), F.lit(r"\}")),
        }
    )
