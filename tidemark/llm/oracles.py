"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import COUNTS, FENCE, LIFT, MEASURES, PRIOR, SCALE, SHARE, ZEROS

_WORD = "'[^\\x20\\x09-\\x0D]+'"
_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') g FROM (SELECT doc_id, w, unnest(range(1, CAST(greatest(len(w) - 18, 1) AS BIGINT))) s FROM w)),
d AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) rn FROM g) WHERE rn > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) i FROM d),
x AS (SELECT doc_id, unnest(w) word, generate_subscripts(w, 1) i FROM w),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i WHERE c.i IS NULL GROUP BY 1),
n AS (SELECT doc_id, count(*) n FROM c GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(kept, '')) kept_sha256
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id
"""

_ITEM_WORDS = "regexp_extract_all(" + _LOWER.format(t="coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP9 = f"""
WITH w AS (SELECT doc_id, {_ITEM_WORDS} w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) k FROM (SELECT item_id, {_ITEM_WORDS} w FROM benchmark) WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') g FROM (SELECT *, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) s FROM b)),
g AS (SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') g FROM (SELECT doc_id, w, k, unnest(range(1, CAST(greatest(len(w) - k + 2, 1) AS BIGINT))) s FROM w, (SELECT DISTINCT k FROM bg))),
h AS (SELECT g.doc_id, g.s, g.k, bg.item_id FROM g JOIN bg ON g.k = bg.k AND g.g = bg.g),
n AS (SELECT doc_id, count(DISTINCT i) n FROM (SELECT doc_id, unnest(range(s, s + k)) i FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) n, string_agg(v, ',' ORDER BY v) l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) v FROM h) GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n.n, 0) AS BIGINT) n_hit, CAST(coalesce(t.n, 0) AS BIGINT) n_items, sha256(coalesce(l, '')) items_sha256, coalesce(n.n, 0) > 0 AND 20 * coalesce(n.n, 0) >= len(w) contaminated
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id
"""

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format(t="coalesce(text, '')")}, {_WORD}) w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') g FROM (SELECT doc_id, w, unnest(range(1, CAST(CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 2, 2) END AS BIGINT))) i FROM w)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) n_shingles, m component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) m FROM r GROUP BY 1) z ON z.a = w.doc_id
"""


def _merged(sketch: str, keys: str, above: str, on: str, groups: str, prior: int = PRIOR) -> str:
    """Sketches by keys, merged with those of the table above at the weight of prior documents."""
    own = f"SELECT {keys}measure, bucket, low, CAST(sum(n) AS BIGINT) * {SCALE} w FROM {sketch} GROUP BY {keys}measure, bucket, low"
    if not above:
        return own
    share = f"SELECT *, {prior} * CAST(floor(w * {SCALE}.0::DOUBLE / sum(w) OVER (PARTITION BY {on}measure)) AS BIGINT) v FROM {above}"
    named = "".join(f"g.{k}, " for k in keys.replace(" ", "").split(",") if k)
    same = "".join(f" AND g.{k} IS NOT DISTINCT FROM p.{k}" for k in on.replace(" ", "").split(",") if k)
    return f"SELECT {keys}measure, bucket, low, CAST(sum(w) AS BIGINT) w FROM ({own} UNION ALL SELECT {named}g.measure, p.bucket, p.low, p.v FROM (SELECT DISTINCT {keys}measure FROM {groups}) g JOIN ({share}) p ON g.measure = p.measure{same}) GROUP BY {keys}measure, bucket, low"


def _levels(name: str, sketch: str, above: str, groups: str, first: int = PRIOR) -> str:
    """Tables name_1 of the corpus, name_2 of the languages and name of the groups."""
    return f"{name}_1 AS ({_merged(sketch, '', above, '', groups, first)}), {name}_2 AS ({_merged(sketch, 'lang, ', name + '_1', '', groups)}), {name} AS ({_merged(sketch, 'lang, source, ', name + '_2', 'lang, ', groups)})"


def _op1() -> str:
    value = lambda k: f"CASE WHEN {MEASURES[k][1]} > 0 THEN CAST(trunc(1000.0::DOUBLE * {MEASURES[k][0]} / {MEASURES[k][1]}) AS BIGINT) ELSE 0 END"
    each = lambda source, pairs, more="": " UNION ALL ".join(f"SELECT lang, source{more}, '{k}' measure, {x} v FROM {source}" for k, x in pairs)
    bucketed = lambda rows, more="": f"SELECT lang, source{more}, measure, sh * 32 + (v >> sh) bucket, min((v >> sh) << sh) low, count(*) n FROM (SELECT *, CASE WHEN v < 64 THEN 0 ELSE length(bin(v)) - 6 END sh FROM ({rows})) GROUP BY ALL"
    width = lambda q: f"CASE WHEN {q} < 64 THEN 1.0::DOUBLE ELSE pow(2.0::DOUBLE, length(bin(CAST({q} AS BIGINT))) - 6) END"
    quantile = lambda q: f"CAST(min(CASE WHEN upto * 100 >= total * {q} THEN low END) AS DOUBLE)"
    failed = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"
    group = "t.lang IS NOT DISTINCT FROM b.lang AND t.source IS NOT DISTINCT FROM b.source"
    reach = f"{FENCE} * greatest(q75 - q25, {width('q50')})"
    wider = "sqrt(greatest(1.0::DOUBLE, size / greatest(n_words, 1)))"
    inside = f"{value('word_len')} <= q50 + (q75 + {reach} - q50) * {wider} AND {value('word_len')} >= q50 + (q25 - {reach} - q50) * {wider}"
    marks = f"bucket > 0 AND from_o >= {SHARE}::DOUBLE * all_o AND from_o * all_i >= {LIFT}.0::DOUBLE * from_i * all_o"
    high = f"q75 + {FENCE} * greatest(q75 - q25, {width('q75')})"
    fences = ", ".join(f"max(CASE WHEN measure = '{k}' THEN {x} END) {k}_{x}" for k in COUNTS for x in ("marks", "high"))
    reached = " OR ".join(f"coalesce({value(k)} >= {k}_marks, false) OR coalesce({value(k)} > {k}_high, false)" for k in COUNTS)
    return f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), {_WORD}) w FROM documents),
l AS (SELECT doc_id, count(*) n_lines, count(*) - count(DISTINCT x) n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) x FROM w) WHERE regexp_matches(x, {_WORD}) GROUP BY 1),
g AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, g) c FROM (SELECT doc_id, s, array_to_string(w[s : s + 4], ' ') g FROM (SELECT doc_id, w, unnest(range(1, CAST(greatest(len(w) - 3, 1) AS BIGINT))) s FROM w))),
r AS (SELECT doc_id, count(DISTINCT i) n FROM (SELECT doc_id, unnest(range(s, s + 5)) i FROM g WHERE c > 1) GROUP BY 1),
b AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) n_words, CAST(length(array_to_string(w, '')) AS BIGINT) word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) n_repeat_words, coalesce(n_lines, 0) n_lines FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id),
o AS (SELECT * FROM b WHERE NOT {failed}),
s1 AS ({bucketed(each("o", [("word_len", value("word_len")), ("n_words", "n_words")]))}),
{_levels("m", "s1", "", "s1")},
q AS (SELECT lang, source, measure, {", ".join(f"{quantile(q)} q{q}" for q in (25, 50, 75))} FROM (SELECT *, sum(w) OVER (PARTITION BY lang, source, measure ORDER BY bucket) upto, sum(w) OVER (PARTITION BY lang, source, measure) total FROM m) GROUP BY 1, 2, 3),
t AS (SELECT lang, source, {", ".join(f"max(CASE WHEN measure = 'word_len' THEN q{q} END) q{q}" for q in (25, 50, 75))}, greatest(1.0::DOUBLE, max(CASE WHEN measure = 'n_words' THEN q50 END)) size FROM q GROUP BY 1, 2),
p AS (SELECT b.*, {inside} inside FROM o b JOIN t ON {group}),
s2 AS ({bucketed(each("p", [(k, value(k)) for k in COUNTS], ", inside"), ", inside")}),
s_in AS (SELECT * FROM s2 WHERE inside), s_some AS (SELECT * FROM s2 WHERE inside AND bucket > 0), s_out AS (SELECT * FROM s2 WHERE NOT inside),
{_levels("i", "s_in", "", "s2")}, {_levels("u", "s_out", "i_1", "s2")}, nothing AS (SELECT DISTINCT measure, 0 bucket, 0 low, CAST(1 AS BIGINT) w FROM s2), {_levels("z", "s_some", "nothing", "s2", ZEROS)},
e AS (SELECT lang, source, measure, bucket, low, CAST(sum(i) AS DOUBLE) i, CAST(sum(o) AS DOUBLE) o FROM (SELECT lang, source, measure, bucket, low, w i, 0 o FROM i UNION ALL SELECT lang, source, measure, bucket, low, 0, w FROM u) GROUP BY 1, 2, 3, 4, 5),
f AS (SELECT *, sum(i) OVER g all_i, sum(o) OVER g all_o, sum(i) OVER d from_i, sum(o) OVER d from_o FROM e WINDOW g AS (PARTITION BY lang, source, measure), d AS (PARTITION BY lang, source, measure ORDER BY bucket DESC)),
x AS (SELECT lang, source, measure, {", ".join(f"{quantile(q)} q{q}" for q in (25, 75))} FROM (SELECT *, sum(w) OVER (PARTITION BY lang, source, measure ORDER BY bucket) upto, sum(w) OVER (PARTITION BY lang, source, measure) total FROM z) GROUP BY 1, 2, 3),
h AS (SELECT lang, source, measure, max(marks) marks, max(q25) q25, max(q75) q75 FROM (SELECT lang, source, measure, CAST(min(CASE WHEN {marks} THEN low END) AS DOUBLE) marks, NULL q25, NULL q75 FROM f GROUP BY 1, 2, 3 UNION ALL SELECT lang, source, measure, NULL, q25, q75 FROM x) GROUP BY 1, 2, 3),
c AS (SELECT lang, source, {fences} FROM (SELECT *, {high} high FROM h) GROUP BY 1, 2)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} base_failed, NOT {failed} AND coalesce({inside}, true) AND NOT ({reached}) kept
FROM b LEFT JOIN t ON {group} LEFT JOIN c ON c.lang IS NOT DISTINCT FROM b.lang AND c.source IS NOT DISTINCT FROM b.source
"""


_TERMS = "regexp_extract_all(" + _LOWER.format(t="coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13 = f"""
WITH d AS (SELECT doc_id, {_TERMS} w FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) docs, CAST(sum(len(w)) AS BIGINT) terms FROM d WHERE len(w) > 0),
f AS (SELECT doc_id, t, n, CAST(count(*) AS BIGINT) tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) n, unnest(w) t FROM d) GROUP BY 1, 2, 3),
w AS (SELECT t, CAST(floor(1000.0::DOUBLE * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) w FROM f, s GROUP BY t),
q AS (SELECT item_id, t, CAST(count(*) AS BIGINT) c FROM (SELECT item_id, unnest({_TERMS}) t FROM benchmark) GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) score FROM q JOIN w USING (t) JOIN f USING (t), s GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) rank FROM r WHERE score > 0) WHERE rank <= 10
"""

ORACLES = {"op1_quality_rules": _op1(), "op6_jaccard_join": OP6, "op9_decontamination": OP9, "op10_substring_dedup": OP10, "op13_lexical_search": OP13}
