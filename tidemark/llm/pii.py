"""Operator 7: personal data, in DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97
for account numbers, 0..255 for address parts, digit counts for phones), and words
near a span adjust its score.  Spans of the base kinds stay whatever their score;
spans of the added kinds stay from ACCEPT on.

Java's backtracking is kept out: quantifiers are possessive wherever what follows
cannot match what they took, and runs are entered at their start only.  An account
number is proposed by its first four characters; where it ends is tried by mod-97 at
the end of each group that follows, so upper-case words behind it don't hide it.

Edge cases: a null or empty text has no spans; offsets are code points, end
exclusive; spans may overlap across kinds; equal starts are ordered by kind;
masking joins overlapping spans under the first kind.  Other columns pass through,
whatever their names, but for one named spans, which is replaced; no rows give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: kind -> (pattern, characters or text without which it cannot match, score, context words)
KINDS = {
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@", 0.9, "mail|contact|write"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", 0.6, "address|server|host|login|\\bip\\b"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None, 0.8, "card|visa|credit|payment|pay"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|call|tel|mobile|fax"),
    "iban": (r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])))[A-Z]{2}[0-9]{2}", None, 0.7, "iban|account|bank|transfer|konto|compte|cuenta"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, "ssn|social security"),
    "secret": (r"(?:password|passwd|api_key|apikey|secret|token)[=:][^\x20\x09-\x0D]{6,}+", None, 0.5, "login|user|key"),
}
#: Characters of an account number by country; others may have 15 to 34.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI FK GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: A match of a kind named here is this long in the text; the pattern's first group is what may follow from its start on.
HEADS = {"iban": 4}
BASE_KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.5
CONTEXT = 40
CONTEXT_BONUS = 0.25


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(number: Column) -> Column:
    """Whether an account number passes mod-97."""
    plain = F.regexp_replace(number, " ", "")
    moved = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97) == 1


def account(run: Column) -> Column:
    """The account number that a run of groups starts with, null if none: of the starts that end with a group and pass mod-97 the one of its country's length, else the longest."""
    groups = F.split(run, " ")
    plain = lambda c: F.length(F.replace(c, F.lit(" "), F.lit("")))
    starts = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda i: F.array_join(F.slice(groups, F.lit(1), i), " "))
    good = F.filter(starts, lambda c: F.when(plain(c).between(15, 34), mod97(c)).otherwise(False))
    length = F.create_map(*[F.lit(x) for n, names in IBAN_LENGTHS.items() for name in names.split() for x in (name, n)])
    listed = F.filter(good, lambda c: plain(c) == F.try_element_at(length, c.substr(1, 2)))
    return F.coalesce(F.try_element_at(listed, F.lit(1)), F.try_element_at(good, F.lit(-1)))


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        small = lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(256)) <= 255
        return F.forall(F.split(m, r"\."), lambda p: part(p) & small(p))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return account(m).isNotNull() if kind == "iban" else F.lit(True)


def _located(text: Column, matches: Column, pattern: str, head: int | None = None) -> Column:
    """Matches with their offsets: what lies between them, by split, gives the distances.  head: what the pattern takes of each."""
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), (F.lit(head) if head else F.length(m)).alias("n"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,m:string>>").alias("out"))
    add = lambda a, x: F.struct((a["at"] + x["g"] + x["n"]).alias("at"), F.array_append(a["out"], F.struct((a["at"] + x["g"]).alias("start"), (a["at"] + x["g"] + x["n"]).alias("end"), x["m"].alias("m"))).alias("out"))
    return F.aggregate(steps, start, add, lambda a: a["out"])


def _apart(spans: Column) -> Column:
    """Spans without those that start within an earlier one."""
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(0))
    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), lambda a, x: F.when(x["start"] >= last(a), F.array_append(a, x)).otherwise(a))


def _scored(text: Column, kind: str, rank: int) -> Column:
    """The valid spans of one kind, with the score that its kind and the words near it give."""
    pattern, _, score, context = KINDS[kind]
    near = lambda x: F.lower(text.substr(F.greatest(x["start"] + 1 - CONTEXT, F.lit(1)), x["end"] - x["start"] + 2 * CONTEXT))
    bonus = lambda x: F.when(near(x).rlike(context), CONTEXT_BONUS).otherwise(0.0)
    good = F.filter(_located(text, F.col(f"m_{kind}"), pattern, HEADS.get(kind)), lambda x: _valid(kind, x["m"]))
    if kind in HEADS:
        good = _apart(F.transform(good, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(account(x["m"]))).alias("end"))))
    return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"), (F.lit(score) + bonus(x)).alias("score")))


def find_spans(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """docs with column spans: array of (start, rank, kind, end, score), by start and then kind; a column spans of docs is replaced."""
    columns = [c for c in docs.columns if c != "spans"]
    out = docs.select(F.coalesce(docs[text], F.lit("")).alias("whole"), F.struct(*[docs[c] for c in columns]).alias("row"))
    whole, matches = F.col("whole"), {}
    for k in kinds:
        pattern, needs, _, _ = KINDS[k]
        every = F.regexp_extract_all(whole, F.lit(pattern), F.lit(int(k in HEADS)))
        matches[f"m_{k}"] = F.when(F.contains(whole, F.lit(needs)), every) if needs else every
    out = out.withColumns(matches)
    some = lambda k: F.exists(f"m_{k}", lambda m: _valid(k, m))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,score:double>>")
    spans = [F.when(some(k), _scored(whole, k, rank)).otherwise(empty) for rank, k in enumerate(kinds)]
    keep = lambda x: x["kind"].isin(*BASE_KINDS) | (x["score"] >= ACCEPT)
    out = out.withColumns({f"s_{k}": s for k, s in zip(kinds, spans, strict=True)})
    return out.select("row.*", F.array_sort(F.filter(F.concat(*[F.col(f"s_{k}") for k in kinds]), keep)).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    put = lambda a, x: F.when(x["start"] < a["at"], F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(x["end"].alias("at"), F.concat(a["out"], text.substr(a["at"] + 1, x["start"] - a["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out")))
    done = lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, put, done)).otherwise(text)


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """docs with personal data in text masked and n_chars brought up to date; null texts stay null."""
    packed = docs.select(docs["text"], F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = find_spans(packed).withColumn("clean", masked(F.col("text"), F.col("spans")))
    fresh = {"text": F.col("clean"), "n_chars": F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("row")["n_chars"])} if "n_chars" in docs.columns else {"text": F.col("clean")}
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col("row")[c].alias(c) for c in docs.columns])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    base = F.filter("spans", lambda x: reduce(lambda a, b: a | b, [x["kind"] == k for k in BASE_KINDS]))
    return out.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
