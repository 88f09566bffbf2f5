"""Text operators against plain versions on the smallest tables, and on rows with nulls, ties, repeats and odd columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

import corpus_pipeline
from cohortpref.llm import blocks, components, fingerprints, lm_scoring, mixing, near_dedup, packing, quality_rules, substring_dedup, token_counts, toxicity, url_filters
from cohortpref.llm.common import words_of
from cohortpref.llm.oracle import SQL
from cohortpref.llm.queries import QUERIES, tokenizer_path
from cohortpref.session import work_path

LONG = " ".join(f"w{i}" for i in range(3000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, None), (4, LONG, "en", "b"), (5, LONG, "en", "b"),
    (6, "one", "en", "a"), (6, "one", "en", "a"), (None, "one two", "en", "a"), (8, f"x {PASSAGE} y", "fr", None),
    (9, f"z {PASSAGE}", "fr", "b"), (10, "Ünïcode 日本 <|endoftext|> it's 12\x1c3", "xx", "c"), (11, LONG + " tail", "en", "c"),
    (12, "idiot idiot # | $ same\nsame\nsame", "en", "c"), (13, "ONE", "en", "a"),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, keys string, component_id long, kept boolean, host string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, len(r[1] or ""), 0.5, 7, "k", 1, True, "h") for r in ODD]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


def result(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).toPandas().set_index("doc_id")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) == []


def likeness(a, b):
    a, b = Counter((a or "").split()), Counter((b or "").split())
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 1.0


def test_fingerprints(spark, sf_dir, docs):
    got = result(spark, sf_dir, "op1_fingerprints")
    docs = docs.sort_values("doc_id")
    texts, off = list(docs.text), []
    for i, (doc_id, text) in enumerate(zip(docs.doc_id, texts)):
        following, cut = texts[(i + 1) % len(texts)], len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        row = got.loc[doc_id]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        off += [row.near_edited - likeness(text, edited), row.near_next - likeness(text, following)]
    assert abs(np.mean(off)) < 0.02 and np.sqrt(np.mean(np.square(off))) < 0.1
    same = got.join(docs.set_index("doc_id").text).groupby("text").fingerprint.nunique()
    assert same.max() == 1


def test_fingerprints_err_little(spark):
    rng = random.Random(6)
    texts = [" ".join(f"v{rng.randrange(400)}" for _ in range(200)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    off = []
    rows = {row.doc_id: row for row in fingerprints.fingerprints(docs).collect()}
    equal = lambda a, b: sum(a[i : i + 4] == b[i : i + 4] for i in range(0, 512, 4)) / 128
    for row in rows.values():
        assert row.near_edited == equal(row.fingerprint, row.edited_fingerprint)
        assert row.near_next == equal(row.fingerprint, rows[(row.doc_id + 1) % len(texts)].fingerprint)
        text, following = texts[row.doc_id], texts[(row.doc_id + 1) % len(texts)]
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        off += [row.near_edited - likeness(text, edited), row.near_next - likeness(text, following)]
    assert abs(np.mean(off)) < 0.02 and np.sqrt(np.mean(np.square(off))) < 0.05, np.sqrt(np.mean(np.square(off)))


def test_fingerprints_do_not_depend_on_the_bound(spark, monkeypatch):
    rng = random.Random(9)
    often = lambda n: " ".join(f"v{int(rng.paretovariate(0.7)) % 300}" for _ in range(n))
    texts = [often(n) for n in (1, 2, 5, 30, 300, 300, 4000)] + ["the " * 5000, "a b " * 700 + "c", None, "", " \n", often(60)]
    rows = [*enumerate(texts), (3, often(50)), (3, often(50)), (None, often(40)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {}
    for far in (float("inf"), fingerprints.FAR, 5.0, 0.5):
        monkeypatch.setattr(fingerprints, "FAR", far)
        found[far] = sorted(map(repr, fingerprints.fingerprints(docs).collect()))
    assert len(found[0.5]) == len(rows)
    assert all(got == found[float("inf")] for got in found.values())


def test_fingerprints_compute_few_values(spark):
    rng = random.Random(10)
    texts = [" ".join(f"v{rng.randrange(3000)}" for _ in range(600)) for _ in range(40)]
    rows = spark.createDataFrame([(i, text, text) for i, text in enumerate(texts)], "row long, text string, edited string")
    whole = fingerprints.draw(rows, ["row"], "text", "edited").collect()
    assert sorted(fingerprints.draw(rows, ["row"], "text", "edited", fingerprints.FAR).collect()) == sorted(whole)
    # Of 600 words the values of some 5 % are low enough to be computed; a null means that too few were.
    terms = fingerprints._weighted_terms(rows, ["row"], "text", "edited")
    terms = terms.select("term", F.col("weight").cast("double"), F.log("weight").alias("log_weight"), (fingerprints.FAR / F.col("least")).alias("far"))
    values = terms.select(*[F.xxhash64("term", F.lit(j)).alias(f"h{j}") for j in range(4)], "weight", "log_weight", "far")
    values = values.select(F.explode(F.array(*[fingerprints._sample(j) for j in range(4)])).alias("value"))
    assert 0.01 < values.agg(F.avg((F.col("value") < float("inf")).cast("int"))).first()[0] < 0.15
    low = fingerprints.draw(rows, ["row"], "text", "edited", 0.5).collect()
    assert all(row.first_fingerprint is None and row.second_fingerprint is None for row in low)


def test_quality_statistics_and_list(spark, sf_dir, docs):
    got = result(spark, sf_dir, "op2_quality_rules")
    for doc_id, text in zip(docs.doc_id, docs.text):
        row, words = got.loc[doc_id], words_of(text)
        lines = [line for line in text.split("\n") if line.encode().split()]
        assert row.n_repeat_words == quality_rules.repeated_words_brute(text)
        assert row.n_words == len(words) and row.word_chars == sum(len(w.decode()) for w in words)
        assert row.n_dup_lines == len(lines) - len(set(lines)) and row.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert row.base_failed == (len(words) < 50 or 100 * row.n_repeat_words > 50 * len(words))
        assert not (row.base_failed and row.kept)


def test_sequential_covering_finds_the_rule():
    rng = np.random.default_rng(3)
    columns = {"mean_word": rng.uniform(0, 10, 4000), "digit_share": rng.uniform(0, 1, 4000)}
    bad = (columns["mean_word"] > 8) & (columns["digit_share"] <= 0.5)
    rules = quality_rules.sequential_covering(columns, bad, np.arange(4000) % 3 == 0)
    found = np.zeros(4000, bool)
    for rule in rules.rules:
        found |= quality_rules._holds(list(rule), columns)
    assert (found != bad).mean() < 0.03


def brute_removed(texts, width=35):
    words = [words_of(t) for t in texts]
    starts = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if starts[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        yield len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()


def test_substring_dedup(spark, sf_dir, docs, odd):
    got = result(spark, sf_dir, "op3_substring_dedup")
    for doc_id, (n, gone, kept) in zip(docs.doc_id, brute_removed(docs.text)):
        assert tuple(got.loc[doc_id]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
    out = substring_dedup.remove_repeats(odd, ("doc_id", "text", "keys")).toPandas()
    want = Counter((r[1], *b) for r, b in zip(ODD, brute_removed([r[1] for r in ODD])))
    assert Counter(zip(out.text.where(out.text.notna(), None), out.n_words, out.n_removed, out.kept_text)) == want


def test_every_pair_of_positions_shares_an_aligned_anchor():
    cover, period = set(substring_dedup.COVER), substring_dedup.PERIOD
    for a in range(period):
        for b in range(period):
            assert any((a + k) % period in cover and (b + k) % period in cover for k in range(period))


def brute_components(rows, width, percent):
    sets = []
    for doc_id, text in rows:
        w = words_of(text, lower=True)
        sets.append((doc_id, {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()))
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: root(d) for d in parent}, {d: len(s) for d, s in sets}


def test_near_dedup(spark, sf_dir, docs):
    got = result(spark, sf_dir, "op4_near_dedup")
    want, sizes = brute_components(list(zip(docs.doc_id, docs.text)), 4, 80)
    assert {d: int(c) for d, c in got.component_id.items()} == want
    assert {d: int(n) for d, n in got.n_shingles.items()} == sizes
    assert (got.kept == (got.component_id == got.index)).all()


def test_near_dedup_of_a_chain_and_odd_rows(spark, odd):
    rng = random.Random(5)
    base = [f"t{i}" for i in range(200)]
    rows, words = [], list(base)
    for k in range(60):  # a drifting chain: neighbours are similar, the ends are not
        rows.append((100 + k, " ".join(words)))
        words = list(words)
        words[rng.randrange(200)] = f"n{k}"
    rows += [(r[0], r[1]) for r in ODD]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).toPandas()
    want, _ = brute_components(rows, 4, 80)
    known = got[got.doc_id.notna()]
    assert {int(d): int(c) for d, c in zip(known.doc_id, known.component_id)} == want
    assert len(got) == len(rows) and got[got.doc_id.isna()].kept.all()


def test_near_dedup_links_through_a_shared_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    rows = [(3, a), (7, a), (7, b), (8, b), (11, None), (11, b + " more"), (12, ""), (None, a), (20, "x y z"), (20, a[::-1]), (21, a[::-1])]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).toPandas()
    want, _ = brute_components(rows, 4, 80)
    known = got[got.doc_id.notna()]
    assert len(got) == len(rows) and want[3] == want[7] == want[8] == want[11] == 3
    assert all(int(c) == want[int(d)] and k == (c == d) for d, c, k in zip(known.doc_id, known.component_id, known.kept))
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert Counter(r.doc_id for r in left.collect()) == Counter([3, 12, None, 20, 20])


def test_super_min_hash_estimates_similarity():
    rng = np.random.default_rng(1)
    for shared in (10, 90, 400):
        errors = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, 2 * 450 - shared, dtype=np.uint64)
            a, b = near_dedup.super_min_hash(pool[:450]), near_dedup.super_min_hash(pool[450 - shared :])
            errors.append((a == b).mean() - shared / (900 - shared))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_group_links_join_groups_only():
    sets = [np.arange(i, i + 20, dtype=np.uint64) for i in (0, 1, 2, 500, 501)]
    links = near_dedup.group_links(sets, [1, 1, 3, 4, 5], 80)
    assert len(links) == 2


def brute_model(tokens, training, order):
    """P(w | context) by the definition: back off word by word from the longest context seen in training."""
    counts = Counter()
    for t, known in zip(tokens, training):
        if known:
            padded = ["<s>", *t]
            counts.update(tuple(padded[i - j : i]) for i in range(1, len(padded) + 1) for j in range(1, order + 1) if j <= i)
    words = {g[0]: c for g, c in counts.items() if len(g) == 1 and g[0] != "<s>"}
    n, v = sum(words.values()), len(words)
    once, twice = (sum(c == k for c in words.values()) for k in (1, 2))
    d, k = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5, lm_scoring.K

    def step(context, w):
        context = tuple(context)[-(order - 1) :] if order > 1 else ()
        while context and not counts[context]:
            context = context[1:]
        if not context:
            return (words[w] - d) / n if w in words else d * v / n
        if counts[(*context, w)]:
            return (counts[(*context, w)] + k * step(context[1:], w)) / (counts[context] + k)
        return k / (counts[context] + k) * step(context[1:], w)

    return words, step


def test_lm_scoring(spark, sf_dir, docs):
    got = result(spark, sf_dir, "op5_lm_scoring")
    tokens = [[*words_of(t, lower=True), None] for t in docs.text]
    training = [zlib.crc32(str(i).encode()) % 10 != 0 for i in docs.doc_id]
    counts, step = brute_model(tokens, training, lm_scoring.ORDER)
    n, v = sum(counts.values()), len(counts)
    for doc_id, t, known in zip(docs.doc_id, tokens, training):
        row = got.loc[doc_id]
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        score = sum(math.log10(step(["<s>", *t[:i]], w)) for i, w in enumerate(t))
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (not known, len(t), sum(w in counts for w in t), n)
        assert row.base_score == pytest.approx(base) and row.score == pytest.approx(score)
    # A state's probabilities sum to 1 over the training words and one unknown word.
    for state in ([], ["<s>"], tokens[0][:1], tokens[0][:2], ["<s>", tokens[1][0]], tokens[2][5:7], ["never seen", tokens[0][0]]):
        assert sum(step(state, w) for w in counts) + step(state, "never seen") == pytest.approx(1)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_lm_scoring_backs_off_over_several_levels(spark, order):
    rng = random.Random(order)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.choice((0, 1, 2, 7, 40)))) for _ in range(60)]
    texts += ["a b zz c d e", "zz", "zz zz a b c", "A B C D E", " ".join(rng.choice("abcdez") for _ in range(3000)), None]
    training = [i % 4 != 0 for i in range(len(texts))]
    rows = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(texts, training))], "doc_id long, text string, known boolean")
    got = {r.doc_id: r for r in lm_scoring.score(rows, F.col("known"), order=order).collect()}
    tokens = [[*words_of(t, lower=True), None] for t in texts]
    _, step = brute_model(tokens, training, order)
    for doc_id, t in enumerate(tokens):
        want = sum(math.log10(step(["<s>", *t[:i]], w)) for i, w in enumerate(t))
        assert got[doc_id].score == pytest.approx(want)


@pytest.mark.parametrize("size", [0, 1, 2, 10, 17, 40, 300, 5000])
def test_numbers_travel_whole(size):
    rng = np.random.default_rng(size)
    for top in (1, 2, 200, 5_000_000_000, 2**63):
        for _ in range(20):
            numbers = rng.integers(0, top, size).astype(np.uint64)
            assert (blocks.numbers_from_bytes(blocks.numbers_to_bytes(numbers)) == numbers).all()
            keys = np.unique(numbers)
            assert (blocks.keys_from_bytes(blocks.keys_to_bytes(keys)) == keys).all()


def test_counts_beyond_32_bits():
    totals = np.array([5_000_000_000, 7], np.int64)
    answers = [blocks.counts_elsewhere(np.arange(2), np.array([1, 7], np.uint64), totals, np.array([3, 1]))]
    others, elsewhere = blocks.read_elsewhere(answers)
    assert others.tolist() == [4_999_999_999, 0] and elsewhere.tolist() == [True, False]


def test_lm_traversal_does_not_depend_on_lanes():
    rng = random.Random(3)
    table = lm_scoring.WordHashes()
    edge = (np.array([lm_scoring.START]), np.array([lm_scoring.END]))
    tokens = [np.concatenate([edge[0], table.of([rng.choice([b"a", b"b", b"c"]) for _ in range(n)]), edge[1]]) for n in (0, 1, 5, 64, 500)]
    grams = lm_scoring.grams_of(tokens, 3)
    counts = np.array([rng.choice((0, 1, 3)) for _ in grams.distinct])
    for j in (2, 3):  # counts of a real corpus: no n-gram is seen without its parts
        for g in np.flatnonzero(grams.length == j):
            at = grams.place[g]
            counts[g] = min(counts[g], counts[grams.at[j - 1][at]], counts[grams.at[j - 1][at - 1]])
    automaton = lm_scoring.build_automaton(grams, counts, lm_scoring.CorpusTotals(600, 4, 1, 1), 50.0)
    whole = lm_scoring.traverse(grams, automaton, 10_000)
    for lane in (1, 2, 7, 64):
        assert lm_scoring.traverse(grams, automaton, lane) == pytest.approx(whole)


def test_longer_contexts_predict_better(spark):
    rng = random.Random(1)
    # The next word follows from the two before it, hardly from one.
    follow = {(a, b): rng.choice("abcdefgh") for a in "abcdefgh" for b in "abcdefgh"}
    texts = []
    for _ in range(300):
        t = [rng.choice("abcdefgh"), rng.choice("abcdefgh")]
        while len(t) < 100:
            t.append(follow[t[-2], t[-1]] if rng.random() < 0.8 else rng.choice("abcdefgh"))
        texts.append(" ".join(t))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    held = F.col("doc_id") % 10 == 0
    total = {n: lm_scoring.score(rows, ~held, order=n).where(held).agg(F.sum("score")).first()[0] for n in (2, 3)}
    assert total[3] > 0.8 * total[2] and total[3] > total[2]


def test_url_filters_follow_redirects(spark):
    html = '<html><head><LINK href="https://bad.example.org/es/7" rel=canonical></head>'
    move = "<meta http-equiv='refresh' content='0; URL=/fr/start'>"
    pages = spark.createDataFrame(
        [(1, "https://a.net/x", html), (2, "http://www.a.net/x.html#top", ""), (3, "https://q.com/de/1", html), (4, None, None),
         (5, "no scheme", html), (6, "HTTP://B.COM/go?utm_source=u", move), (7, "https://c.net/", "<p>canonical</p>"), (7, "https://c.net/", None)],
        "page_id long, url string, html string",
    ).withColumn("verdict", F.lit("clash"))
    from cohortpref.llm.queries import URL_RULES

    rows = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_pages(pages, url_filters.rule_table(spark, URL_RULES)).collect()}
    assert rows == {
        (1, "a.net", "/x", None, "block"), (2, "www.a.net", "/x.html", None, "block"), (3, "q.com", "/de/1", "com/de/", "block"),
        (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "b.com", "/go", None, "allow"), (7, "c.net", "/", None, "allow"),
    }
    assert url_filters.judge_pages(pages.where("false"), url_filters.rule_table(spark, URL_RULES)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    found = components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert {(r.node, r.component) for r in found} == {(i, 0) for i in range(1, 41)} | {(101, 100), (200, 100)}


def test_token_counts(spark, sf_dir, docs, odd):
    counted, packed = result(spark, sf_dir, "op7_token_counts"), result(spark, sf_dir, "op8_packing")
    assert len(counted) == len(docs)
    want = packed[~packed.index.duplicated()].doc_tokens - 1
    assert counted.n_tokens.sort_index().equals(want.sort_index())


def test_token_counts_hold_when_the_splits_change(spark, sf_dir, docs, odd, empty):
    """The files are written before the result is read; splits in between may be planned anew."""
    want = result(spark, sf_dir, "op8_packing").groupby(level=0).doc_tokens.first() - 1
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        counted = QUERIES["op7_token_counts"](spark, sf_dir)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        counted = counted.toPandas().set_index("doc_id")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(counted) == len(docs) and counted.n_tokens.sort_index().equals(want.sort_index())
    path = work_path(spark, "test-flat")
    got = token_counts.count_tokens(odd, tokenizer_path(), path).toPandas()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    sizes = Counter((r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in ODD)
    assert Counter((None if pd.isna(d) else int(d), n) for d, n in zip(got.doc_id, got.n_tokens)) == sizes
    assert token_counts.count_tokens(empty, tokenizer_path(), path).count() == 0
    named = odd.withColumn("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(" \u0080\n")))
    got = token_counts.count_tokens(named, tokenizer_path(), work_path(spark, "test-flat")).toPandas()
    assert Counter((None if pd.isna(d) else int(d[:-3]), n) for d, n in zip(got.doc_id, got.n_tokens)) == sizes


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    rng, sep = np.random.default_rng(block), token_counts.SEPARATOR
    for name, size in (("a", 50), ("b", 0), ("c", 23)):
        ids = np.where(rng.random(size) < 0.2, sep, rng.integers(0, 9, size))
        (tmp_path / name).write_bytes(ids.astype(">u2").tobytes())
    want = set()
    for name in ("a", "b", "c"):
        start, index, ids = 0, 0, np.frombuffer((tmp_path / name).read_bytes(), ">u2")
        for end in [*np.flatnonzero(ids == sep), len(ids)]:
            if end < len(ids) or end > start:
                want.add((name, index, start, int(end) - start, bool(end == len(ids))))
            start, index = int(end) + 1, index + 1
    rows = token_counts.document_tokens(token_counts.scan_blocks(spark, str(tmp_path), sep, block)).collect()
    assert {(r.file.rsplit("/", 1)[1], r["index"], r.start, r.n_tokens, r.open) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("split", [41, 100])
def test_separator_scan_reads_ranges_of_a_file(spark, tmp_path, split):
    """One file in many tasks; separator bytes across two ids, a byte order mark, an open end and empty documents."""
    rng, sep = np.random.default_rng(split), token_counts.SEPARATOR
    some = [sep, 0x00C2, 0x8000, 0xC2C2, 0x8080, 5, 6]
    files = {"a": rng.choice(some, 300), "b": np.array([0xEFBB, 0xBF07, 1, sep, 2, sep]), "c": np.array([0xEFBB, 0xBF07, 1]), "d": np.array([sep, sep]),
             "e": np.append(rng.choice(some, 90), sep)}
    want = set()
    for name, ids in files.items():
        (tmp_path / name).write_bytes(ids.astype(">u2").tobytes())
        start, index = 0, 0
        for end in [*np.flatnonzero(ids == sep), len(ids)]:
            if end < len(ids) or end > start:
                want.add((name, index, start, int(end) - start, bool(end == len(ids))))
            start, index = int(end) + 1, index + 1
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    held = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], str(split))
        spark.conf.set(names[1], "0")
        blocks = token_counts.scan_blocks(spark, str(tmp_path), sep, 16)
        assert blocks.rdd.getNumPartitions() > len(files)
        rows = token_counts.document_tokens(blocks).collect()
    finally:
        for n, v in zip(names, held):
            spark.conf.set(n, v)
    assert {(r.file.rsplit("/", 1)[1], r["index"], r.start, r.n_tokens, r.open) for r in rows} == want and len(rows) == len(want)


def check_pieces(pieces, texts):
    """texts: Counter of (doc_id, text)."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for (doc_id, text), times in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        rows = pieces[pieces.doc_id.isna() if doc_id is None else pieces.doc_id == doc_id]
        assert rows.length.sum() % len(ids) == 0 and (rows.doc_tokens == len(ids)).all()
        for row in rows.itertuples():
            assert zlib.crc32(ids[row.start : row.start + row.length].tobytes()) == row.ids_crc32
        want[doc_id] += times * len(ids)
    for _, rows in pieces.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum()[:-1]] and rows.length.sum() <= 4096
    assert pieces.length.sum() == sum(want.values())


def test_packing(spark, sf_dir, docs, odd, empty):
    pieces = QUERIES["op8_packing"](spark, sf_dir).toPandas()
    check_pieces(pieces, Counter(zip(docs.doc_id, docs.text)))
    sizes = pieces.groupby("sequence_id").length.sum()
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in sizes)
    assert padding < 0.05 * sizes.sum()
    check_pieces(packing.pack(odd, tokenizer_path()).toPandas(), Counter((r[0], r[1]) for r in ODD))
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_best_cuts_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        length = 16
        places = sorted(rng.sample(range(1, 60), 25)) + [60]
        places = sorted(set(places) | set(range(8, 60, 8)))
        penalty = [rng.choice([0.0, 2.0, 5.0]) for _ in places]
        best = {0: 0.0}
        for p, fine in zip(places, penalty):
            best[p] = min((c + fine + (0 if (p - i) & (p - i - 1) == 0 else length - (p - i)) for i, c in best.items() if p - i <= length), default=math.inf)
        cuts, cost = packing.best_cuts(places, penalty, length), 0.0
        for a, b in zip([0, *cuts], cuts):
            assert b - a <= length
            cost += (0 if (b - a) & (b - a - 1) == 0 else length - (b - a)) + penalty[places.index(b)]
        # Only windows near the end may have a short length without padding.
        assert cost <= best[60] + 2 * length


def test_mixing_on_odd_rows(spark, odd, empty):
    got = mixing.mix(odd).toPandas()
    assert len(got) == len(ODD) and (got.taken <= 2 * got["size"]).all() and got["size"].sum() == sum(len(words_of(r[1])) for r in ODD)
    assert got.groupby("source", dropna=False).target.first().sum() == pytest.approx(1.5 * got["size"].sum())
    assert mixing.mix(empty).count() == 0


def test_mixing_comes_near_its_targets(spark, docs):
    rows = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 5}") for i in range(5000)], "doc_id long, text string, source string")
    got = mixing.mix(rows).toPandas()
    sums = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(sums.target - sums.taken) <= 7).all()
    again = mixing.mix(rows.repartition(3)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_mixing_stage_takes_each_row_as_its_own_source_does(spark):
    rows = [(i % 40 if i % 3 else None, "w " * (1 + i % 7), "en", (None, "a", "b", "c")[i // 40 % 4], i) for i in range(320)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source, r["size"]] += r.passes
    got = Counter((r.doc_id, r.source, len(r.text.split())) for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    assert len({p for p in want.values()}) > 1 and got == +want


def test_toxicity_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = QUERIES["op10_toxicity"](spark, sf_dir).toPandas().merge(pd.read_parquet(f"{sf_dir}/labels.parquet"), on="doc_id")
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out]
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.9


def test_counterfactual_penalty_shrinks_identity_weights(monkeypatch):
    rng, table = np.random.default_rng(4), toxicity.Slots()
    words = [f"w{i}" for i in range(50)]
    texts, toxic = [], []
    for i in range(1500):
        bad = i % 3 == 0
        text = " ".join(rng.choice(words, 12)) + (" insult" if bad and i % 2 else "") + (" muslim" if bad or i % 11 == 0 else "")
        texts.append(toxicity.slots_of(text, table))
        toxic.append(float(bad))
    with_penalty = toxicity.train(texts, np.array(toxic))
    monkeypatch.setattr(toxicity, "SWAP_PENALTY", 0.0)
    without = toxicity.train(texts, np.array(toxic))
    slot = table["muslim"]
    assert abs(with_penalty.weights[slot]) < 0.5 * abs(without.weights[slot])


def test_odd_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (12, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for docs in (odd, empty):
        n = docs.count()
        stats = quality_rules.statistics(docs)
        assert quality_rules.judge(stats, quality_rules.fit_decision_list(stats, labels)).count() == n
        assert toxicity.score(docs, toxicity.fit(docs, labels), ("doc_id", "size")).count() == n
        assert lm_scoring.score(docs, F.lit(True), ("doc_id", "keys")).count() == n
        assert fingerprints.fingerprints(docs).count() == n
        assert near_dedup.near_duplicates(docs).count() == n
        assert substring_dedup.remove_repeats(docs).count() == n


CLASHES = (
    "gone", "n_removed", "n_words", "kept_text", "kept", "score", "toxicity", "passes", "size", "hash", "__score", "__text",
    "__block", "__part", "__training", "learns0", "__passes", "__pass", "__plan", "ts", "__k0", "__k7", "a.b", "toxic", "n_lines",
)


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{c}:"), F.coalesce("text", F.lit("?"))).alias(c) for c in CLASHES])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_carry_columns_named_like_their_own(spark, sf_dir, clashing, name, stage):
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    with_them, without = stage(spark, clashing, sf_dir), stage(spark, clashing.select(*plain), sf_dir)
    if name == "packing":
        assert Counter(map(tuple, with_them.collect())) == Counter(map(tuple, without.collect()))
        return
    assert with_them.columns == clashing.columns
    got = with_them.collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(map(tuple, without.collect()))
    texts = {"?" if r.text is None else r.text for r in clashing.select("text").collect()}
    for row in got:
        for c in CLASHES:
            head, _, value = row[c].partition(":")
            assert head == c and value in texts


def test_operators_carry_columns_named_like_their_own(spark, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (12, 0, 1)], "doc_id long, quality int, toxic int")
    keep = ("doc_id", "text", *CLASHES)
    model = toxicity.fit(clashing, labels)
    made = {
        "n_words n_removed kept_text": substring_dedup.remove_repeats(clashing, keep),
        "n_tokens n_known train_tokens base_score score": lm_scoring.score(clashing, F.lit(True), keep),
        "score": toxicity.score(clashing, model, keep),
        " ".join(quality_rules.STATS): quality_rules.statistics(clashing, keep),
    }
    for names, out in made.items():
        names = names.split()
        assert out.columns == [*[c for c in keep if c not in names], *names]
        rows = out.collect()
        assert len(rows) == len(ODD)
        for row in rows:
            carried = "?" if row.text is None else row.text
            assert all(row[c] == f"{c}:{carried}" for c in CLASHES if c not in names)


def test_fit_samples_rows_of_one_id(spark):
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("idiot w"), (F.col("id") % 500).cast("string")).alias("text"))
    clean = spark.range(20_000).select((F.col("id") + 2).alias("doc_id"), F.concat(F.lit("fine w"), (F.col("id") % 500).cast("string")).alias("text"))
    labels = spark.range(1, 20_002).select(F.col("id").alias("doc_id"), (F.col("id") == 1).cast("int").alias("toxic"))
    model = toxicity.fit(rows.unionByName(clean), labels, fit_rows=4000)
    table = toxicity.Slots()
    assert model.scores(["idiot w3"], table)[0] > model.scores(["fine w3"], table)[0]


def test_pipeline(spark, sf_dir):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "substring_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.snapshot(stage(spark, docs, sf_dir), f"test-{name}")
        seen[name] = (before.toPandas(), docs.toPandas())
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    labels = duckdb.sql(f"select doc_id from '{sf_dir}/labels.parquet' where toxic = 1").df()
    first, left = seen["toxicity"]
    assert len(left) > 0.85 * len(first) and len(set(left.doc_id) & set(labels.doc_id)) <= 0.2 * len(labels)
    before, after = seen["near_duplicates"]
    want, _ = brute_components(list(zip(before.doc_id, before.text)), 5, 80)
    assert set(after.doc_id) == set(want.values())
    before, after = seen["substring_dedup"]
    kept = {d: k for d, (n, gone, k) in zip(before.doc_id, brute_removed(before.text)) if gone and k}
    whole = {d: t for d, t, (n, gone, k) in zip(before.doc_id, before.text, brute_removed(before.text)) if not gone}
    assert dict(zip(after.doc_id, after.text)) == kept | whole
    before, after = seen["mixing"]
    assert set(after.doc_id) <= set(before.doc_id) and Counter(after.doc_id).most_common(1)[0][1] <= 2
    check_pieces(seen["packing"][1], Counter(zip(after.doc_id, after.text)))
