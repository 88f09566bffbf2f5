"""Importance resampling, collocations and piece encoding against plain versions, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortpref.llm import blocks, byte_views, collocations, importance, lm_scoring, piece_encoding
from cohortpref.llm.queries import QUERIES, tokenizer_path

LONG = " ".join(f"word{i % 700}" for i in range(6000))
TWENTY = "alpha beta gamma delta " * 6
ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t.;", None), (4, LONG, "en"), (4, LONG, "en"), (5, TWENTY, None), (5, TWENTY, None),
    (None, TWENTY, "und"), (None, TWENTY, "und"), (6, TWENTY.upper(), "fr"), (7, "Ünïcode 日本 \U0001F600 ▁x▁ </s> 12\x1c3\x00z", "xx"),
    (8, "x" * 50_000, "en"), (9, "a" * 65 + " " + "b" * 64, "en"), (10, "ALPHA, beta? gamma", "fr"),
]
COLUMNS = "doc_id long, text string, lang string, rank int, score string, n int, ids string, word string, part int, document int, t string, k0 string"
MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "s", 2, "i", "w", 3, 4, "t", "k") for r in ODD], COLUMNS)


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


# Byte helpers


def test_flat_and_runs_of_sliced_arrays():
    texts = pa.array(["zz", "a b", None, "", "cd "]).slice(1)
    data, at = byte_views.flat(texts)
    assert (data.tobytes(), at.tolist()) == (b"a bcd ", [0, 3, 3, 3, 6])
    begins, ends = byte_views.runs(data != 32, at)
    assert [data[a:b].tobytes() for a, b in zip(begins, ends)] == [b"a", b"b", b"cd"]
    assert [len(x) for x in byte_views.runs(np.empty(0, bool), np.zeros(1, np.int64))] == [0, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(["aaa", None, "bb", "c" * 9, "d"])], names=["x"])
    assert [b.num_rows for b in byte_views.bounded(iter([batch]), "x", 4)] == [2, 1, 1, 1]


def test_totals_of_blocks_have_64_bits():
    totals = np.array([1, 5_000_000_000, 1 << 52, 0], np.int64)
    assert blocks.counts_from_bytes(blocks.total_counts(totals, totals, totals)).tolist() == totals.tolist()
    assert blocks.counts_from_bytes(b"").tolist() == []


# 11


def features_brute(text, width):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i : i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)], len(words)


def resample_brute(rows, target, width, buckets, percent, least_words, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    made = [(i, *features_brute(t, width)) for i, t in rows]
    s = Counter(bucket(f) for _, fs, _ in made for f in fs)
    t = Counter(bucket(f) for x in target for f in features_brute(x, width)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for doc_id, fs, n_words in made:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, n_words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], -r[2]))
    drawn = percent * len(able) // 100
    ranks = {id(r): k + 1 for k, r in enumerate(able[:drawn])}
    return sorted(([*r, ranks.get(id(r))] for r in out), key=str)


@pytest.mark.parametrize("width, buckets, percent, least_words", [(1, 10_000, 10, 20), (3, 97, 60, 3)])
def test_resampling_equals_brute_force(spark, sf_dir, docs, odd, width, buckets, percent, least_words):
    rows = [(r.doc_id, r.text) for r in docs.head(60).itertuples()] + [(i, t) for i, t, _ in ODD]
    target = pd.read_parquet(f"{sf_dir}/benchmark.parquet")["text"].tolist()
    given = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = importance.resample(given, benchmark, width, buckets, percent, least_words).collect()
    columns = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert sorted(([r[c] for c in columns] for r in found), key=str) == resample_brute(rows, target, width, buckets, percent, least_words, 2024)


def test_resampling_of_copies_over_small_ranges(spark):
    """Half of all rows are copies of one row; the ranks stay 1, 2, 3, ... over many range partitions."""
    copies = spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.lit(5).cast("long").alias("score"))
    others = spark.range(300).select((F.col("id") % 100).alias("doc_id"), (F.col("id") % 11).alias("score"))
    both = copies.unionByName(others).withColumns({c: F.lit(30).cast("long") for c in ("n_words", "n_features", "weight")})
    found = importance.draw(importance.snapshot(both, "scored"), 95, 20, ranked_rows=25).collect()
    ranked = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 571)) and len(found) == 600
    assert [(-r["score"], r["doc_id"]) for r in ranked] == sorted((-r["score"], r["doc_id"]) for r in found)[:570]


def test_resampling_odd_rows(spark, odd):
    found = importance.resample(odd, odd, whole_rows=True)
    assert found.where("document.score = 's' and document.document = 4").count() == len(ODD)
    assert {r["weight"] for r in found.where("n_features = 0").collect()} == {0}
    empty = odd.where("false")
    assert importance.resample(empty, odd).count() == 0
    assert importance.resample(odd, empty).count() == len(ODD)


@given(st.lists(st.binary(max_size=80), max_size=30))
@settings(max_examples=50, deadline=None)
def test_crc_matrices(parts):
    sizes = np.array([len(p) for p in parts], np.int64)
    sums = importance.crc32_by_length(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert sums.tolist() == [zlib.crc32(p) for p in parts]


# 12


def phrases_brute(rows, longest, least):
    counts, words = Counter(), Counter()
    for _, text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            cut = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(cut)
            counts.update((lang or "und", tuple(cut[i : i + n])) for n in range(1, longest + 1) for i in range(len(cut) - n + 1))
    return {k: v for k, v in counts.items() if v >= least}, words


def collocations_brute(rows, longest, least, top, percent):
    f, words = phrases_brute(rows, longest, least)
    kept = []
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        longer = [b for (other, q), b in f.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * b >= percent * a for b in longer):
            kept.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], words[lang], score))
    out = []
    for lang in {k[0] for k in kept}:
        ranked = sorted((k for k in kept if k[0] == lang), key=lambda k: (-k[6], -k[2], k[1].encode()))[:top]
        out += [(lang, n + 1, *k[1:]) for n, k in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("part_keys, fan_bits, shard_bytes, longest, least, top", [(10**6, 8, 4 << 20, 4, 30, 2000), (300, 2, 20_000, 4, 3, 5), (50, 1, 5_000, 3, 2, 2000)])
def test_collocations_equal_brute_force(spark, docs, monkeypatch, part_keys, fan_bits, shard_bytes, longest, least, top):
    """Also in many shards and several rounds of merging."""
    monkeypatch.setattr(collocations, "FAN_BITS", fan_bits)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.head(25).itertuples()] + [r for r in ODD if r[0] != 4]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = collocations.collocations(given, longest, least, top, shard_bytes=shard_bytes, part_keys=part_keys)
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == collocations_brute(rows, longest, least, top, 80)


def test_rounds_keep_groups_in_proportion():
    assert collocations._rounds(100, 10**6, 0, 20) == [(0, 1)]
    assert collocations._rounds(10**12, 10**6, 0, 32) == [(8, 3907), (16, 16), (20, 1)]
    assert collocations._rounds(10**12, 10**6, 0, 6) == [(6, 1)]


@pytest.mark.parametrize("n, bits", [(2, 1), (2, 16), (3, 17), (4, 16), (4, 17), (4, 32), (3, 32)])
def test_filters_lose_nothing(n, bits):
    rng = np.random.default_rng(n * 100 + bits)
    ids = rng.integers(0, 1 << bits, (400, n))
    sizes = collocations.halves(n, bits)
    left, right = collocations.permute(*collocations.pack(list(ids.T), bits), sizes)
    counts = rng.integers(1, 400, 400)
    counts[7] = 3 << 40
    entries = collocations.add_up(left, right, counts, sizes)
    wanted = Counter()
    for row, count in zip(map(tuple, ids.tolist()), counts.tolist()):
        wanted[row] += count
    for prefix_bits in {0, 1, min(5, sizes[0]), min(32, sizes[0])}:
        found = Counter()
        for prefix, blob in collocations.slices(*entries, sizes, prefix_bits):
            a, b, c = collocations.from_filter(blob, sizes, prefix, prefix_bits)
            back = collocations.unpack(*collocations.permute(a, b, sizes, undo=True), n, bits)
            found.update(dict(zip(map(tuple, back.tolist()), c.tolist())))
        assert found == wanted
    ones = collocations.count_equal(left, right, sizes)
    assert [x.tolist() for x in ones] == [x.tolist() for x in collocations.add_up(left, right, np.ones(400, np.int64), sizes)]


def test_scores_are_exact_beyond_64_bits(spark):
    huge = (1 << 62) + 12345
    grams = spark.createDataFrame([("en", [1, 2], huge)], collocations.GRAMS)
    words = spark.createDataFrame([("en", 1, huge + 7, "a"), ("en", 2, huge + 9, "b")], "lang string, id long, f long, word string")
    assert collocations._scored(grams, words).first()["score"] == 2_000_000 * huge // (2 * huge + 16)


def test_collocations_odd_rows(odd):
    found = collocations.collocations(odd, least=2).collect()
    # TWENTY ends where the next one would begin: no phrase joins two documents.
    assert {(r["a"], r["n"]) for r in found if r["lang"] == "und" and r["phrase"] == "alpha beta gamma delta"} == {(24, 96)}
    assert collocations.collocations(odd.where("false")).collect() == []
    assert collocations.collocations(odd.where("doc_id < 3")).collect() == []


# 13


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_are_those_of_the_library(spark, sf_dir, odd):
    model = piece_encoding.PieceModel(MODEL)
    assert model.differing(spark.read.parquet(f"{sf_dir}/documents.parquet")).count() == 0
    assert model.differing(odd).count() == 0
    assert model.encode(odd.where("false")).count() == 0


alphabet = st.sampled_from(" ab▁\n\t.Éé日\U0001F600\x00ー´ttheing1")


@given(st.lists(st.one_of(st.text(alphabet, max_size=90), st.text(max_size=40)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_any_text_as_the_library(library, texts):
    own = piece_encoding.vocabulary(MODEL)
    assert own.encode(pa.array(texts, pa.string())).to_pylist() == [library.encode(t) for t in texts]


def test_both_agendas_agree(docs):
    own = piece_encoding.vocabulary(MODEL)
    words = sorted({"▁" + w for t in docs["text"].dropna().head(40) for w in t.split()})
    assert [np.frombuffer(b, "<i4").tolist() for b in own.merge_side_by_side(words)] == [own.merge(w) for w in words]


def test_texts_are_encoded_whole_where_pieces_cross_spaces(library, docs, monkeypatch):
    own = piece_encoding.PieceVocabulary(MODEL)
    own.cuts = False
    texts = ["", " a b ", docs["text"].dropna().iloc[0][:500]]
    assert own.encode(pa.array(texts)).to_pylist() == [library.encode(t) for t in texts]


def test_query_digests(spark, sf_dir, docs, library):
    found = {r["doc_id"]: r for r in QUERIES["op13_piece_encoding"](spark, sf_dir).collect()}
    assert len(found) == len(docs)
    for doc in docs.itertuples():
        ids = library.encode(doc.text or "")
        row = found[doc.doc_id]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_round_trip_of_odd_rows(odd, library):
    model = piece_encoding.PieceModel(MODEL)
    found = model.round_trip(odd.select("doc_id", "text", "t"), ("doc_id", "t")).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in found) == sorted((str(i), library.decode(library.encode(t or ""))) for i, t, _ in ODD)
    with pytest.raises(ValueError, match="rename"):
        model.encode(odd, ("doc_id", "ids"))


def test_other_vocabularies_are_refused(tmp_path):
    path = tmp_path / "trimmed.model"
    # The same pieces with the white-space rule of another kind of model.
    path.write_bytes(open(MODEL, "rb").read() + b"\x1a\x02\x20\x01")
    with pytest.raises(ValueError, match="merge-type"):
        piece_encoding.PieceVocabulary(str(path))


def test_totals_of_the_words_come_with_their_answers():
    """Several blocks, several parts: the headings add up to the totals, and the rest of every answer is as without them."""
    rng = np.random.default_rng(5)
    held = rng.random(400) < 0.3
    flat = np.append(rng.integers(1, 1 << 60, 60).astype(np.uint64)[rng.integers(0, 60, 396)], [lm_scoring.START] * 4)
    distinct, counts = lm_scoring.counted(flat, ~held)
    want = Counter(flat[~held].tolist())
    assert dict(zip(distinct.tolist(), counts.tolist())) == {w: want[w] for w in set(flat.tolist())}
    assert [len(x) for x in lm_scoring.counted(flat[:0], held[:0])] == [0, 0]
    heads = [lm_scoring.totals_heading(distinct[i::3], counts[i::3]) for i in range(3)] + [lm_scoring.totals_heading(distinct[:0], counts[:0])]
    totals, rest = lm_scoring.read_totals([h + b"ab" for h in heads] + [b"cd"], 4)
    words = [n for w, n in want.items() if w != int(lm_scoring.START)]
    assert totals == lm_scoring.CorpusTotals(sum(words), len(words), words.count(1), words.count(2))
    assert rest == [b"ab"] * 4 + [b"cd"]
    empty = np.empty(0, np.uint64)
    assert blocks.asked(1, empty, empty, 3, every=True).num_rows == 3 and blocks.asked(1, empty, empty, 3).num_rows == 0
