"""Operators against plain Python on small fixtures, and both sides of every switch."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, decontaminate, jaccard_join, pii, quality_classifier, quality_rules, sharding, substring_dedup

WORDS = ["".join(random.Random(i).choice("abcdefghijklmnop") for _ in range(2 + i % 7)) for i in range(2000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def linked(texts, k=4, link=85):
    """Least document that each reaches, by all pairs."""
    sets = [{tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if (w := t.lower().split()) else set() for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= link * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in range(len(texts))}


def edited(base, n, low, high, seed):
    r, out = random.Random(seed), []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(low, high)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        out.append(" ".join(w))
    return out


def ids(df):
    return {r["doc_id"]: r["component_id"] for r in df.collect()}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_clusters_far_from_their_centre_lose_no_link(spark):
    # the centre itself isn't there; edits come from few words, so that members share differences and chains form
    base = prose(120, 5).split()
    chain, texts = list(base), edited(base, 120, 2, 9, 6)
    for i in range(80):
        chain[i] = WORDS[i % 5]
        if i % 3 == 0:
            texts.append(" ".join(chain))
    texts += edited(prose(60, 8).split(), 60, 0, 3, 9) + [prose(50, 100 + i) for i in range(20)]
    assert ids(jaccard_join.link_components(frame(spark, texts))) == linked(texts)


def test_a_thousand_near_copies(spark):
    texts = edited(prose(90, 15).split(), 1000, 1, 3, 16)
    got = ids(jaccard_join.link_components(frame(spark, texts), k=5, link=80))
    assert got == linked(texts, 5, 80)


def test_every_way_of_the_join_gives_the_same(spark, monkeypatch):
    texts = edited(prose(80, 25).split(), 60, 0, 5, 26) + edited(prose(70, 27).split(), 30, 0, 3, 28) + ["a b c", "a b c d e", ""]
    want, docs = linked(texts), frame(spark, texts)
    monkeypatch.setattr(jaccard_join, "BROADCAST_NODES", 0)
    monkeypatch.setattr(jaccard_join, "BROADCAST_VALUES", 0)
    monkeypatch.setattr(jaccard_join, "BROADCAST_PARTS", 0)
    monkeypatch.setattr(components, "ONE_PARTITION", 0)
    monkeypatch.setattr(jaccard_join, "LEAF", 2)
    assert ids(jaccard_join.link_components(docs)) == want


def test_a_header_that_all_share(spark, monkeypatch):
    header = prose(12, 70)
    texts = [header + " " + prose(80 + i % 5, 7000 + i) for i in range(150)] + edited((header + " " + prose(90, 71)).split(), 40, 0, 3, 72)
    want = linked(texts)
    assert ids(jaccard_join.link_components(frame(spark, texts))) == want
    for often, parts in ((2, 300_000), (2, 0), (10**9, 300_000)):  # nearly all parts dealt out, joined in either way; none dealt out
        monkeypatch.setattr(jaccard_join, "OFTEN", often)
        monkeypatch.setattr(jaccard_join, "BROADCAST_PARTS", parts)
        assert ids(jaccard_join.link_components(frame(spark, texts))) == want


def test_short_sets_have_an_exact_way(spark, monkeypatch):
    texts = edited(prose(80, 35).split(), 20, 0, 5, 36) + ["a b c", ""]
    parts_of = jaccard_join._parts_of

    def fewer(shingles, counts, scheme, eighths):
        keys, n = parts_of(shingles, counts, scheme, eighths)
        ends = np.cumsum(n)
        keep = np.minimum(n, 3)  # as if the parts of a set were three at most
        return np.concatenate([keys[e - c : e - c + k] for e, c, k in zip(ends, n, keep, strict=True)] or [keys]), keep

    monkeypatch.setattr(jaccard_join, "_parts_of", fewer)
    assert ids(jaccard_join.link_components(frame(spark, texts))) == linked(texts)


def test_sets_of_one_hash_stay_apart(spark, monkeypatch):
    nodes = jaccard_join._nodes

    def clashing(shingles, counts):
        n, node, twin = nodes(shingles, counts)
        return [n, pa.array(np.full(len(counts), 7, np.int64)), twin]

    monkeypatch.setattr(jaccard_join, "_nodes", clashing)
    texts = [prose(40, 1), prose(40, 1), prose(40, 2), prose(30, 3)]
    assert ids(jaccard_join.link_components(frame(spark, texts))) == {0: 0, 1: 0, 2: 2, 3: 3}


def measured(spark, groups, num):
    """Rows of groups (source, value of num, documents), otherwise alike."""
    usual = dict(n_words=400, word_chars=2000, n_symbols=4, n_dup_lines=1, n_repeat_words=8, n_lines=40)
    rows = [("en", s, usual | {num: v + i % 7}) for s, v, k in groups for i in range(k)]
    return spark.createDataFrame(rows, f"lang string, source string, m {quality_rules.MEASURE_TYPE}")


@pytest.mark.parametrize("measure", list(quality_rules.MEASURES))
def test_a_groups_fence_moves_with_its_distribution(spark, measure):
    num, _ = quality_rules.MEASURES[measure]

    def fence(value, n):
        limits = quality_rules.thresholds(measured(spark, [("a", value, n), ("b", 3, 300)], num))
        return {r["t_source"]: r[f"t_{measure}"] for r in limits.collect()}["a"]

    # the farther the group lies, the farther its fence; the more documents it has, the more they count
    assert fence(20, 300)["high"] < fence(60, 300)["high"]
    if measure == "word_len":
        assert fence(60, 20)["mid"] < fence(60, 90)["mid"] <= fence(60, 300)["mid"]


def test_fences_of_counts_are_one_plan_of_few_steps(spark):
    """What the driver plans, compiles and keeps of the tasks doesn't come three times, for the sketches inside, outside and above 0."""
    m = measured(spark, [("a", 1, 40), ("b", 3, 60)], "n_symbols").withColumn("inside", F.col("source") == "a")
    counts = [(k, quality_rules._value(F.col("m"), k)) for k in quality_rules.COUNTS]
    fences = quality_rules.count_fences(quality_rules.cut(quality_rules.sketches(m, counts, ("lang", "source", "inside"))))
    plan = fences._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) <= 20 and len(re.findall(r"\bHashAggregate\b", plan)) <= 30
    assert {r["t_source"] for r in fences.collect() if r["t_symbols"]["high"] > 0} == {"a", "b"}


def test_fences_of_counts_start_no_python_rows(spark):
    sketch = spark.range(3).select(F.lit("en").alias("lang"), F.lit("a").alias("source"), (F.col("id") < 2).alias("inside"), F.lit("symbols").alias("measure"), F.col("id").cast("int").alias("bucket"), F.lit(5).cast("long").alias("n"))
    levels = quality_rules.count_levels(sketch)
    assert "ExistingRDD" not in levels._jdf.queryExecution().executedPlan().toString()  # rows that come from Python
    got = {(r["measure"], r["bucket"]): r["w"] for r in levels.collect()}
    # 4 documents of value 0 and 5 of value 1 above the language and the group, whose own 5 count in full: 5 + 100 * (5 + 100 * 5 / 9) / 105
    assert got["tsymbols", 1] / quality_rules.SCALE == pytest.approx(5 + 100 * (5 + 500 / 9) / 105, rel=1e-3)
    assert got["tsymbols", 0] / quality_rules.SCALE == pytest.approx(100 * (400 / 9) / 105, rel=1e-3)


@pytest.mark.parametrize("measure", list(quality_rules.COUNTS))
def test_each_count_rejects_what_its_group_does_not_have(spark, measure):
    num, den = quality_rules.MEASURES[measure]
    value = {"n_words": 70, "n_lines": 30}[den]
    groups = [("a", 2, 300), ("b", value, 300), ("a", value, 1)]
    df = measured(spark, groups, num)
    kept = quality_rules.judge(df, quality_rules.thresholds(df)).groupBy("source").agg(F.sum((~F.col("kept")).cast("int")).alias("n"), F.max(F.when(~F.col("kept"), F.col("m")[num])).alias("m")).collect()
    assert {r["source"]: (r["n"], r["m"]) for r in kept} == {"a": (1, value), "b": (0, None)}


def test_what_goes_with_odd_word_lengths_is_a_mark(spark):
    # symbols are usual in neither group of texts; those of odd word length have them, and so one of usual word length goes too
    base = dict(n_words=400, word_chars=2000, n_symbols=0, n_dup_lines=0, n_repeat_words=0, n_lines=40)
    rows = [base | {"word_chars": 1960 + i % 80} for i in range(400)] + [base | {"word_chars": 3900, "n_symbols": 40 + i % 9} for i in range(25)]
    rows += [base | {"n_symbols": 45}] * 14 + [base | {"n_dup_lines": 2}] * 20 + [base | {"word_chars": 3900, "n_symbols": 44, "n_dup_lines": 2}]
    df = spark.createDataFrame([("en", "a", r) for r in rows], f"lang string, source string, m {quality_rules.MEASURE_TYPE}")
    limits = quality_rules.thresholds(df)
    fence = limits.collect()[0]
    assert fence["t_symbols"]["marks"] and not fence["t_dup_lines"]["marks"]  # lines are repeated as often within
    lost = quality_rules.judge(df, limits).where("not kept").groupBy("m.word_chars", F.col("m.n_symbols") > 0).count().collect()
    assert sorted((r[0], r[1], r[2]) for r in lost) == [(2000, True, 14), (3900, True, 26)]


def test_the_repeats_rule_alone_rejects(spark):
    plain = [(i, prose(300, 3000 + i), "en", "a") for i in range(60)]
    phrase = " ".join(f"zz{i}" for i in range(29))
    odd = (99, prose(121, 5000) + " " + phrase + " " + prose(121, 5001) + " " + phrase, "en", "a")  # 58 of 300 words
    kept = {r["doc_id"] for r in quality_rules.quality_filter(spark.createDataFrame([*plain, odd], "doc_id long, text string, lang string, source string")).collect()}
    assert kept == set(range(60))


LUHN = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and LUHN(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def test_base_spans_of_random_texts(spark):
    r = random.Random(4)
    bits = ["bob@x.org", "a.b@c", "@", ".", "10.0.0.1", "1.2.3.256", "300.1.1.1.1", "4876179267539117", "4876 1792-6753 9117", "+1 (456) 555-2186", "+", "12", " ", "\n", "é", "中", "x", "-", "(", "999999999", "1.2.3.4.5.6.7.8", "%+", "0.0.0.0"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(1500)] + [None, ""]
    got = {row["doc_id"]: row["spans"] for row in pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), kinds=tuple(BASE)).collect()}
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, kind, m.end()) for k, (kind, (p, ok)) in enumerate(BASE.items()) for m in re.finditer(p, t or "") if ok(m.group()))
        assert [(s["start"], s["rank"], s["kind"], s["end"]) for s in got[i]] == want, t


def jump(key, shards):
    """The published function, one key at a time."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_sizes_and_slots(spark):
    keys = [random.Random(i).getrandbits(64) for i in range(500)]
    for n in (1, 2, 8, 9, 100):
        assert sharding.jump(np.array(keys, dtype=np.uint64), n).tolist() == [jump(k, n) for k in keys]
    rows = [(i if i % 5 else None, f"t{i % 40}é" if i % 7 else None) for i in range(400)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("s", "b", "bucket", "slot", "row", "shard")})).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    for s in range(8):
        mine = sorted(r["slot"] for r in got if r["shard"] == s)
        assert mine == list(range(len(mine)))
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1


def test_a_score_doesnt_depend_on_its_neighbours(spark):
    w = np.random.default_rng(1).normal(size=quality_classifier.DIM + 1)
    docs = spark.createDataFrame([(i, prose(i % 50, i)) for i in range(300)] + [(300, None)], "doc_id long, text string")
    score = lambda n: {r["doc_id"]: r["s"] for r in docs.repartition(n).select("doc_id", quality_classifier.score(F.col("text"), spark, w).alias("s")).collect()}
    assert score(1) == score(23)


def test_contamination_of_clashing_columns_and_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_HITS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    items = spark.createDataFrame([(10, prose(30, 1)), (9, prose(30, 1) + " more words"), (3, "just three words")], "item_id long, text string")
    texts = [prose(100, 2) + " " + prose(30, 1), prose(50, 3), "Just, THREE words!", prose(400, 4) + " " + " ".join(prose(30, 1).split()[:13]), None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("d", "th", "hits", "w", "h", "k", "pos", "id", "n_words")})
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in decontaminate.judged(decontaminate.find_hits(docs, items)).collect())
    assert got == [(0, 130, 30, ["10", "9"], True), (0, 130, 30, ["10", "9"], True), (1, 50, 0, [], False), (2, 3, 3, ["3"], True), (3, 413, 13, ["10", "9"], False), (4, 0, 0, [], False)]
    clean = decontaminate.remove_contaminated(docs, items)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [1, 3, 4]


def test_words_of_the_benchmark_are_the_same_whatever_the_character(spark):
    chars = [chr(c) for c in (*range(0x3000), *range(0xD7F0, 0xD800), *range(0xE000, 0xE010), *range(0xFFF0, 0x10010), *range(0x10FFF0, 0x110000))]
    texts = ["".join(f"{c}Ab{c}{c}9" for c in chars[at : at + 128]) for at in range(0, len(chars), 128)] + [None, "", "Z", "-"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", decontaminate.words(F.col("text")).alias("w")).collect()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert {r["i"]: r["w"] for r in got} == {i: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold)) for i, t in enumerate(texts)}
    # a class of ranges is asked range by range, for each character of every text
    assert "-" not in decontaminate.WORD


def test_personal_data_of_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org", 1, 2, 3)], "doc_id long, text string, m_ip int, s_email int, row int")
    got = pii.find_spans(docs).first()
    assert (got["m_ip"], got["s_email"], got["row"]) == (1, 2, 3) and [s["kind"] for s in got["spans"]] == ["email"]
    assert hashlib.sha256(pii.mask_personal_data(docs).first()["text"].encode()).hexdigest() == hashlib.sha256(b"mail [EMAIL]").hexdigest()


def _kept_by_hand(rows, window):
    """doc_id -> (words, removed, digest, removed spans), text by text in the order of doc_id."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words = (text or "").split()
        drop = [False] * len(words)
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            if key in seen:
                drop[at : at + window] = [True] * window
            seen.add(key)
        spans = [k for k in range(len(words) + 1) if (drop[k - 1] if k else False) != (drop[k] if k < len(words) else False)]
        digest = hashlib.sha256(" ".join(w for w, d in zip(words, drop, strict=True) if not d).encode()).hexdigest()
        out[doc_id] = (len(words), sum(drop), digest, list(zip(spans[::2], spans[1::2], strict=True)))
    return out


@pytest.mark.parametrize(("window", "leaves"), [(20, 20_000), (20, 3), (20, 1), (13, 5)])
def test_repeats_are_those_found_by_hand_whatever_the_length_of_prefixes(spark, monkeypatch, window, leaves):
    if leaves == 3:
        monkeypatch.setattr(substring_dedup, "BROADCAST_LONG", 0)
    draw = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    passages = [[draw.choice(vocabulary) for _ in range(60)] for _ in range(6)]
    rows = [(500, None), (501, ""), (503, "a " * 100), (504, "b c " * 40)]
    for doc_id in range(120):
        words = []
        for _ in range(draw.randrange(1, 5)):
            at = draw.randrange(40)
            words += draw.choice(passages)[at : at + draw.randrange(5, 60)] + draw.choices(vocabulary, k=draw.randrange(9))
        rows.append((doc_id, " ".join(words)))
    rows.append((502, rows[7][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.remove_repeats(docs.unionByName(docs), window=window, leaves=leaves).collect()
    want = _kept_by_hand(rows, window)
    assert len(got) == 2 * len(want)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"], [tuple(s) for s in r["spans"]]) == want[r["doc_id"]]
