"""Importance resampling, collocations and packing against brute force on awkward
rows: nulls, empty and long texts, ties, repeated rows, clashing names, no rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from leadsmith.llm import collocations as col
from leadsmith.llm import common, packing, resampling
from leadsmith.llm.collocations import collocations
from leadsmith.llm.packing import pack_documents
from leadsmith.llm.resampling import importance_resample
from tests.llm.conftest import PASSAGE, as_docs

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return (text or "").translate(LOW)


# ---------------------------------------------------------------- resampling

def features(text):
    w = WORD.findall(low(text))
    return len(w), [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(rows, target, percent=5, min_words=20, buckets=10_000):
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            counts.update(zlib.crc32(f.encode()) % buckets for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)}
    out = []
    for i, x in rows:
        n, f = features(x)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("percent", [5, 60])
def test_resampling_equals_brute_force(spark, messy, messy_rows, percent, monkeypatch):
    target = [PASSAGE, None, "", "Gnu general PUBLIC license of the thing"]
    aim = spark.createDataFrame([(str(k), x, 1) for k, x in enumerate(target)], "item_id string, text string, weight int")
    got = importance_resample(messy, aim, percent=percent)
    want = resampled(messy_rows, target, percent)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()) == want


def test_resampling_parts_of_a_text_give_the_same_features(monkeypatch):
    text = ("one two  Three, four! " * 40 + "x" * 90 + " five. é 日本 ").encode()
    pattern = resampling.run_pattern(3)
    n, whole = resampling.feature_crcs(text, pattern, 3)
    for size in (1, 7, 50, 300):
        monkeypatch.setattr(resampling, "PART_BYTES", size)
        m, parts = resampling.feature_crcs(text, pattern, 3)
        assert n == m and Counter(np.concatenate(whole).tolist()) == Counter(np.concatenate(parts).tolist())
    assert Counter(np.concatenate(whole).tolist()) == Counter(zlib.crc32(f.encode()) for f in features(text.decode())[1])
    assert resampling.feature_crcs(b"one", pattern, 3)[0] == 1 and resampling.feature_crcs(b" .", pattern, 3) == (0, [])


def test_resampling_repeated_rows_and_empty_tables(spark, no_docs):
    aim = spark.createDataFrame([("a", "alpha beta")], "item_id string, text string")
    long = " ".join(f"w{k}" for k in range(25))
    rows = [(None, long)] * 30 + [(7, long)] * 30 + [(8, long + " alpha beta")] + [(9, "short")]
    got = importance_resample(as_docs(spark, rows), aim, percent=50).collect()
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got) \
        == resampled(rows, ["alpha beta"], 50)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 31))
    assert importance_resample(no_docs, aim).count() == 0
    none = spark.createDataFrame([], "item_id string, text string")
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"])
                   for r in importance_resample(as_docs(spark, rows), none).collect()) == resampled(rows, [])


def test_ranked_equals_a_sort(spark):
    rows = [(k * 37 % 101, k % 3, k % 5) for k in range(1_000)]
    got = common.ranked(spark.createDataFrame(rows, "a int, b int, c int").repartition(6), [F.col("a").desc(), F.col("b"), F.col("c")])
    assert [(r["a"], r["b"], r["c"]) for r in sorted(got.collect(), key=lambda r: r["rank"])] \
        == sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    weighted = common.ranked(spark.createDataFrame([(1, 5), (2, 1), (3, 4)], "a int, n long"), [F.col("a").desc()], "n")
    assert {r["a"]: r["rank"] for r in weighted.collect()} == {3: 0, 2: 4, 1: 5}


# ---------------------------------------------------------------- collocations

def phrases_of(rows, min_count, max_words=5, percent=100, top=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, max_words + 1):
                f[lang].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = set()
    for lang, counts in f.items():
        able = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        gone = {p[i:j] for p, a in able.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1)
                if j - i < len(p) and 100 * a >= percent * counts[p[i:j]]}
        best = []
        for p, a in able.items():
            if p in gone:
                continue
            cuts = [((1000 * a * total[lang]) // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return out


def lang_docs(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").selectExpr(
        "lang", "text", "1 AS f", "2 AS word", "3 AS rank", "4 AS a", "5 AS words", "6 AS n", "7 AS ids")


def found(df):
    got = [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(set(got)) == len(got)
    return set(got)


@pytest.fixture(scope="module")
def lang_rows(messy_rows):
    rows = [(["en", "de", None, "und"][k % 4], t) for k, (_, t) in enumerate(messy_rows)]
    rows += [("en", "New York City. new\tyork city? New York")] * 40 + [("fr", "a b c d e f, " * 30), (None, "x  y\x0bx y\x85z\xa0x y")]
    return rows


@pytest.mark.parametrize("min_count, percent, top", [(3, 100, 2000), (5, 100, 7), (3, 60, 2000)])
def test_collocations_equal_brute_force(spark, lang_rows, min_count, percent, top):
    got = collocations(lang_docs(spark, lang_rows).repartition(4), min_count=min_count, percent=percent, top=top)
    assert found(got) == phrases_of(lang_rows, min_count, percent=percent, top=top)


def test_collocations_bounded_tables_give_the_same_result(spark, lang_rows, monkeypatch):
    want = phrases_of(lang_rows, 3)
    monkeypatch.setattr(col, "TILE", 8)
    monkeypatch.setattr(col, "PAIRS_HELD", 500)
    monkeypatch.setattr(col, "WORDS_HELD", 100)
    docs = lang_docs(spark, lang_rows).repartition(3)
    assert found(collocations(docs, min_count=3, head_words=40, block_phrases=300)) == want
    assert found(collocations(docs, min_count=3, head_words=0, block_phrases=1_000_000)) == want


def test_pair_counter_sorts_wide_ids(monkeypatch):
    a, b = np.array([1 << 40, 5, 1 << 40, 5, 1 << 62]), np.array([7, 1 << 40, 7, 2, 1 << 40])
    counter = col.PairCounter(4)
    counter.add(a, b)
    got = {(int(x), int(y)): int(n) for x, y, n in zip(*counter.sparse(), strict=True)}
    assert got == Counter(zip(a.tolist(), b.tolist(), strict=True))


def test_collocations_of_nothing(spark):
    empty = lang_docs(spark, [])
    assert collocations(empty).count() == 0
    assert collocations(lang_docs(spark, [("en", "only once here"), (None, None), ("en", "")])).count() == 0


# ---------------------------------------------------------------- packing

@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library_ids(vocabulary):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary[0])
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_agree_with_the_tokenizers_library(vocabulary, library_ids):
    own = packing.load_encoding(*vocabulary)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4_096):
        text = "".join(f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}'s\n{chr(c)}x" for c in points[k:k + 4_096:7])
        assert own.encode_ordinary(text) == library_ids(text)[:-1]
    text = "an <|endoftext|> in a text"
    assert own.encode_to_numpy(text, disallowed_special=()).tolist() == library_ids(text)[:-1]


def check_packing(got, rows, ids_of, capacity):
    want = Counter()
    for i, text in rows:
        ids = ids_of(text)
        first = len(ids) % capacity or capacity
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        want.update((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r["length"] for r in got)


@pytest.mark.parametrize("capacity, open_bins, group_rows", [(2048, 256, 16_384), (64, 4, 20), (300, 16, 50), (1, 2, 10)])
def test_packing_pieces_and_places(spark, messy, messy_rows, vocabulary, library_ids, capacity, open_bins, group_rows):
    got = pack_documents(messy, *vocabulary, capacity=capacity, open_bins=open_bins, group_rows=group_rows,
                         carry=("size",), with_ids=True).collect()
    check_packing(got, messy_rows, library_ids, capacity)
    assert all(r["size"] == 6 and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)


def test_packing_wastes_little(spark, vocabulary, library_ids):
    rng = np.random.default_rng(3)
    rows = [(k, " a" * int(n)) for k, n in enumerate(rng.integers(1, 90, 4_000))]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), *vocabulary, capacity=100,
                         group_rows=1_000, open_bins=64).collect()
    bins, total = check_packing(got, rows, library_ids, 100)
    assert bins <= 1.03 * total / 100


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.add(n) for n in (6, 7, 3, 4, 9, 5, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (2, 9)]
    fit = packing.BestFit(10, 2)
    assert [fit.add(n) for n in (5, 8, 6, 4, 5)] == [(0, 0), (1, 0), (2, 0), (2, 6), (0, 5)]


def test_best_fit_equals_a_search_of_all_bins():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 65, 3_000).tolist()
    fit, free = packing.BestFit(64, 9), {}
    for n in lengths:
        able = [x for x in free.values() if x >= n]
        b, at = fit.add(n)
        if able:
            assert free[b] == min(able) == 64 - at
        else:
            if len(free) == 9:
                full = min(free.values())
                gone = set(free) - {c for some in fit.at.values() for c in some} - {b}
                assert len(gone) == 1 and free[gone.pop()] == full
                free = {c: x for c, x in free.items() if c in {d for some in fit.at.values() for d in some}}
            free[b] = 64
        free[b] -= n
        if not free[b]:
            del free[b]


def test_packing_repeated_rows_and_empty_table(spark, no_docs, vocabulary, library_ids):
    rows = [(None, "same text again")] * 300 + [(1, None)] * 20
    got = pack_documents(as_docs(spark, rows), *vocabulary, capacity=16, group_rows=64, open_bins=4).collect()
    check_packing(got, rows, library_ids, 16)
    assert pack_documents(no_docs, *vocabulary).count() == 0


def test_overlapped_scan_emits_every_run():
    text = b" one two three four "
    assert [m.group() for m in resampling.run_pattern(3).finditer(text, overlapped=True)] \
        == [b" one two three", b" two three four", b" three four", b" four"]
    assert regex.__version__
