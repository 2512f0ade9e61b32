"""Each operator against a brute-force version on awkward rows: nulls, empty and
long texts, ties, repeated rows, clashing extra columns, and an empty table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leadsmith.llm import bpe, fingerprints, simhash, suffix_dedup
from leadsmith.llm.decontaminate import contamination
from leadsmith.llm.license_scan import scan_licenses
from leadsmith.llm.queries import bpe_vocabulary
from leadsmith.llm.sharding import ring_points, shard_bounds, shard_rows, walk

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return (text or "").translate(LOW)


def counted(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


# ---------------------------------------------------------------- sharding

def test_sharding_rows_are_even_and_slots_gapless(messy, messy_rows):
    got = shard_rows(messy, 16).collect()
    assert len(got) == len(messy_rows)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in messy_rows)


def test_sharding_repeated_rows_and_empty_table(spark, no_docs, monkeypatch):
    from tests.llm.conftest import as_docs
    many = as_docs(spark, [(1, "same")] * 500 + [(i, "t") for i in range(2, 52)])
    monkeypatch.setattr("leadsmith.llm.sharding.COPIES_PER_CHUNK", 7)
    sizes = Counter(r["shard"] for r in shard_rows(many, 16).collect())
    assert sum(sizes.values()) == 550 and max(sizes.values()) - min(sizes.values()) <= 1
    assert shard_rows(no_docs, 16).count() == 0


def test_sharding_splits_the_rows_of_one_id(spark, monkeypatch):
    from tests.llm.conftest import as_docs
    rows = [(None, f"text {i}") for i in range(600)] + [(None, "again")] * 200 + [(i, f"t{i}") for i in range(400)]
    monkeypatch.setattr("leadsmith.llm.sharding.ROWS_PER_PART", 50)
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = shard_rows(as_docs(spark, rows), 16).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len(t) + 1, zlib.crc32(t.encode())) for i, t in rows)
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(1200 // 16))
    tasks = Counter(r["task"] for r in got if r["doc_id"] is None and r["text_crc32"] != zlib.crc32(b"again"))
    assert len(tasks) > 1 and max(tasks.values()) < 0.8 * 600


def test_walk_equals_key_by_key_insertion():
    rng = np.random.default_rng(1)
    _, owners = ring_points(range(5), 6)
    counts = {int(c): int(n) for c, n in zip(range(len(owners)), rng.integers(0, 9, len(owners)), strict=True)}
    bounds = shard_bounds(sum(counts.values()), range(5), 1.2)
    got = Counter()
    for cell, lo, hi, shard, _ in walk(counts, owners, 1, bounds):
        got[cell, shard] += hi - lo
    room, want = dict(bounds), Counter()
    waiting = [(c, c) for c in counts for _ in range(counts[c])]
    while waiting:      # a round offers every waiting key to the point it has reached
        later = []
        for cell, at in sorted(waiting, key=lambda x: (x[1], x[0])):
            if room[owners[at]]:
                room[owners[at]] -= 1
                want[cell, int(owners[at])] += 1
            else:
                later.append((cell, (at + 1) % len(owners)))
        waiting = later
    # Which of the waiting cells is served first is a matter of order; loads are not.
    assert all(sum(n for (c, _), n in got.items() if c == cell) == counts[cell] for cell in counts)
    assert Counter({s: sum(n for (_, x), n in got.items() if x == s) for s in bounds}) == Counter(
        {s: sum(n for (_, x), n in want.items() if x == s) for s in bounds})


def test_sharding_moves_few_keys_with_spare_capacity(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text")
    a = {r["doc_id"]: r["shard"] for r in shard_rows(docs, 16, capacity_factor=1.25).collect()}
    b = {r["doc_id"]: r["shard"] for r in shard_rows(docs, 17, capacity_factor=1.25).collect()}
    assert max(Counter(a.values()).values()) <= 1.25 * 20_000 / 16 + 1
    assert sum(a[k] != b[k] for k in a) < 0.25 * len(a)


# ---------------------------------------------------------------- licence scan

def test_license_scan_base_phrases(messy, messy_rows, no_docs):
    phrases = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
    want = Counter()
    for i, t in messy_rows:
        w = WORD.findall(low(t))
        at = sorted((k, name) for name, p in phrases.items() for k in range(len(w))
                    if w[k:k + len(p.split())] == p.split())
        want[i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None,
             ",".join(sorted({n for _, n in at}))] += 1
    got = scan_licenses(messy)
    assert counted(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    rows = {r["doc_id"]: r for r in got.where("doc_id = 12").collect()}
    assert rows[12]["labels"] == "apache,apache-2.0,cc-by,cc-by-nc" and rows[12]["score"] == 1.0
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
               for r in got.collect())
    assert scan_licenses(no_docs).count() == 0


def test_license_scan_long_template(spark):
    from tests.llm.conftest import as_docs
    notice = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
              "associated documentation files (the Software)")
    got = {r["doc_id"]: r for r in scan_licenses(as_docs(spark, [
        (1, "x y " + notice), (2, notice.replace("free of charge", "at a price")), (3, "of this software")])).collect()}
    assert got[1]["labels"] == "mit" and got[1]["base_labels"] == "" and got[1]["score"] > 0.99
    assert got[2]["labels"] == "" and got[3]["labels"] == ""


# ---------------------------------------------------------------- simhash

def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, most):
    distinct = sorted(set(fps))
    parent = {f: f for f in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if (a ^ b).bit_count() <= most:
                parent[root(a)] = root(b)
    first = defaultdict(list)
    for f, i in zip(fps, ids, strict=True):
        first[root(f)].append(i)
    return [min((x for x in first[root(f)] if x is not None), default=None) for f in fps]


def test_near_duplicates(messy, messy_rows, no_docs):
    fps = [brute_simhash(t) for _, t in messy_rows]
    comps = brute_components(fps, [i for i, _ in messy_rows], 3)
    got = simhash.near_duplicates(messy).withColumn("hex", simhash.hex_digits("fp"))
    assert counted(got, "doc_id", "hex", "component_id") == Counter(
        (i, f"{f:016x}", c) for (i, _), f, c in zip(messy_rows, fps, comps, strict=True))
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("most,block", [(3, 4096), (3, 16), (2, 4096), (4, 64)])
def test_components_of_clustered_fingerprints(spark, monkeypatch, most, block):
    rng = np.random.default_rng(most)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = set()
    for c in centres:
        for _ in range(60):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 300, dtype=np.uint64)} | {0, (1 << 64) - 1}
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(df, most).collect()}
    want = brute_components([x % (1 << 64) for x in signed], signed, most)
    groups, theirs = defaultdict(set), defaultdict(set)
    for x, w in zip(signed, want, strict=True):
        groups[w].add(x)
        theirs[roots.get(x, x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))


def test_wider_partitions_give_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 200)
    fps = sorted({int(x) for x in base} | {int(x) ^ 5 for x in base[:50]} | {int(x) ^ (1 << 40) ^ 3 for x in base[:50]})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = []
    for chance in (64, 1e-3, 1e-9):
        monkeypatch.setattr(simhash, "CHANCE_ROWS", chance)
        found.append((len(simhash.make_plan(df, 3).parts),
                      sorted(tuple(r) for r in simhash.components(df, 3).collect())))
    assert [n for n, _ in found] == [4, 3, 2]
    assert found[0][1] == found[1][1] == found[2][1]


# ---------------------------------------------------------------- repeated passages

def brute_repeats(rows, length):
    """The defined order: (id, start), a null id first; equal (id, start) is no earlier one."""
    place = {}
    for i, t in rows:
        raw = (t or "").encode()
        for s in range(len(raw) - length + 1):
            at = (-(1 << 63) if i is None else i, s)
            w = raw[s:s + length]
            place[w] = min(place.get(w, at), at)
    out = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if place[raw[s:s + length]] < (-(1 << 63) if i is None else i, s):
                cover[s:s + length] = b"\1" * length
        kept = bytes(c for c, x in zip(raw, cover, strict=True) if not x)
        runs = sum(1 for k in range(len(raw)) if cover[k] and not (k and cover[k - 1]))
        out[i, len(raw), sum(cover), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


REPEAT_COLS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("length,full", [(100, 20_000), (100, 1), (40, 20_000)])
def test_remove_repeats(messy, messy_rows, length, full):
    got = suffix_dedup.remove_repeats(messy, min_length=length, max_contexts=full)
    assert counted(got, *REPEAT_COLS) == brute_repeats(messy_rows, length)


@pytest.mark.parametrize("share", [0.0, 0.01])
def test_remove_repeats_with_frequent_anchors(messy, messy_rows, monkeypatch, share):
    find = suffix_dedup.frequent_anchors
    monkeypatch.setattr(suffix_dedup, "FREQUENT_LEAST", 1)
    monkeypatch.setattr(suffix_dedup, "frequent_anchors", lambda d, m, sample, _: find(d, m, sample, share))
    got = suffix_dedup.remove_repeats(messy, min_length=100)
    assert counted(got, *REPEAT_COLS) == brute_repeats(messy_rows, 100)


def test_remove_repeats_in_small_batches(messy, messy_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 2_000)
    got = suffix_dedup.remove_repeats(messy, min_length=100)
    assert counted(got, *REPEAT_COLS) == brute_repeats(messy_rows, 100)


def test_remove_repeats_looks_at_a_repeated_row_once(spark, monkeypatch):
    from tests.llm.conftest import PASSAGE, as_docs
    rows = [(None, f"Start {PASSAGE} end of it.")] * 300 + [(7, f"Another start {PASSAGE} tail.")] * 300 \
        + [(8, f"Third {PASSAGE}"), (None, f"Start {PASSAGE} in another text without id.")]
    seen, compared = [], suffix_dedup.compared

    def watched(found, min_length):
        seen.append(counted(found, "mh", "id", "tag", "start"))
        return compared(found, min_length)

    monkeypatch.setattr(suffix_dedup, "compared", watched)
    got = suffix_dedup.remove_repeats(as_docs(spark, rows).repartition(7), min_length=100)
    assert counted(got, *REPEAT_COLS) == brute_repeats(rows, 100)
    assert seen[0] and set(seen[0].values()) == {1}


def test_remove_repeats_empty(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_interval_expansion_equals_a_dictionary():
    rng = np.random.default_rng(2)
    for trial in range(150):
        length = int(rng.integers(2, 9))
        top = int(rng.choice([2, 3, 256]))
        base = rng.integers(0, top, 30).astype(np.uint8).tobytes()
        texts = [rng.integers(0, top, rng.integers(0, 20)).astype(np.uint8).tobytes()
                 + (base[int(rng.integers(0, 9)):] if trial % 2 else b"") for _ in range(rng.integers(1, 6))]
        a, b = suffix_dedup.repeated_strings(texts, np.arange(len(texts)), np.zeros(len(texts), int), length)
        seen, want = set(), set()
        for i, t in enumerate(texts):
            for s in range(len(t) - length + 1):
                (want.add((i, s)) if t[s:s + length] in seen else seen.add(t[s:s + length]))
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


# ---------------------------------------------------------------- fingerprints

def test_edited_pairs_and_sketches(spark, messy_rows, no_docs):
    from tests.llm.conftest import as_docs
    rows = sorted(dict(messy_rows).items(), key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    docs = as_docs(spark, rows).repartition(4)
    got = {r["doc_id"]: r for r in fingerprints.edited_pairs(docs, rows_per_range=9)
           .withColumn("edited", fingerprints.edited_text("text", "next_text"))
           .withColumn("near_next", fingerprints.containment("sketch", "next_sketch")).collect()}
    assert len(got) == len(rows)
    texts = [t or "" for _, t in rows]
    for k, (i, _) in enumerate(rows):
        own, nxt = texts[k], texts[(k + 1) % len(texts)]
        half = len(own) // 2
        assert got[i]["edited"] == own[:len(own) - half] + nxt[:half]
        assert got[i]["next_text"] == nxt and 0 <= got[i]["near_next"] <= 1
    same = {got[8]["text"]: tuple(got[8]["sketch"])}
    assert same[got[10]["text"]] == tuple(got[10]["sketch"])
    assert fingerprints.edited_pairs(no_docs).count() == 0


def test_edited_pairs_repeated_rows_and_null_ids(spark):
    from tests.llm.conftest import as_docs
    for rows in ([(5, "a b"), (5, "a b"), (5, "c d"), (None, "e"), (2, "f g")], [(None, "a"), (None, "b")], [(1, "one")]):
        got = counted(fingerprints.edited_pairs(as_docs(spark, rows), rows_per_range=2), "text", "next_text")
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
        assert got == Counter((order[k][1], order[(k + 1) % len(order)][1]) for k in range(len(order)))


def test_containment_estimates_the_share(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 20_000)]
    small, large = " ".join(words[:4000]), " ".join(words)
    other = " ".join(f"v{i}" for i in rng.integers(0, 10**6, 4000))
    df = spark.createDataFrame([(small, large, other, "a b", "a b", "")], "s string, l string, o string, x string, y string, e string")
    for c in df.columns:
        df = fingerprints.with_sketch(df, c, f"k_{c}")
    near = {f"{a}{b}": fingerprints.containment(f"k_{a}", f"k_{b}").alias(f"{a}{b}")
            for a, b in ("sl", "ls", "so", "xy", "xe", "ee")}
    r = df.select(*near.values()).first()
    assert r["sl"] == 1.0 and abs(r["ls"] - 0.2) < 0.05 and r["so"] == 0.0
    assert (r["xy"], r["xe"], r["ee"]) == (1.0, 0.0, 1.0)


def test_share_of_short_texts_inside_long_ones(spark):
    rng = np.random.default_rng(4)
    rows = []
    for n in (1, 3, 5, 6, 10, 20, 30, 54, 104, 300):
        for _ in range(20):
            words = [f"w{i}" for i in rng.integers(0, 10**9, n)]
            around = [f"v{i}" for i in rng.integers(0, 10**9, 2000)]
            # whole inside; half of it inside
            rows.append((n, " ".join(words), " ".join(around[:900] + words + around[900:]),
                         " ".join(around + words[:n // 2])))
    df = spark.createDataFrame(rows, "n int, s string, l string, h string")
    for c in "slh":
        df = fingerprints.with_sketch(df, c, f"k_{c}")
    for r in df.select("n", fingerprints.share("k_s", "k_l", "s", "l").alias("whole"),
                       fingerprints.share("k_s", "k_h", "s", "h").alias("part")).collect():
        assert r["whole"] == (1.0 if r["n"] >= 5 else 0.0), r       # fewer words than a shingle: another one
        if r["n"] >= 300:
            assert abs(r["part"] - (r["n"] // 2 - 4) / (r["n"] - 4)) < 0.2
    unknown = spark.createDataFrame([([1 << 62], list(range(-9, 0)), "a b c d e", "x a b c d e")],
                                    "o array<long>, t array<long>, a string, b string")
    below = unknown.withColumn("t", F.expr("transform(sequence(1, 99), i -> -9223372036854775807L + i)"))
    got = below.select(fingerprints.containment("o", "t", unknown=F.lit(-1.0)).alias("c"),
                       fingerprints.share("o", "t", "a", "b").alias("s")).first()
    assert got["c"] == -1.0 and got["s"] == 1.0


# ---------------------------------------------------------------- byte-level BPE

@pytest.mark.parametrize("chunk,overlap", [(32_768, 1_024), (64, 24)])
def test_bpe_equals_tiktoken(messy, messy_rows, no_docs, chunk, overlap):
    import tiktoken
    path, pattern = bpe_vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = Counter()
    for i, t in messy_rows:
        ids = own.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = bpe.encode_documents(messy, path, pattern, chunk_chars=chunk, overlap_chars=overlap)
    assert counted(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.encode_documents(no_docs, path, pattern).count() == 0


def test_bpe_stitches_any_chunks():
    path, pattern = bpe_vocabulary()
    find = bpe.Codec(path, pattern).find
    rng = np.random.default_rng(1)
    bits = [" ", "  ", "\n", "\n\n", "'", "'re", "'ll", "a", "bc", "é", "12", "!", "漢", "\t", "　", "😀", "'v"]
    for trial in range(300):
        text = "".join(rng.choice(bits, rng.integers(0, 200))) + "x" * (120 if trial % 4 == 0 else 0)
        bounds = bpe.chunk_bounds(len(text), 40, int(rng.choice([5, 12, 20])))
        scans = [bpe.piece_starts(find, text[a:b], a, b == len(text)) for a, b in bounds]
        pieces = [text[a:b] for r in bpe.stitch(find, text, scans) for a, b in zip(r, r[1:], strict=False)]
        assert pieces == find.findall(text)


# ---------------------------------------------------------------- decontamination

ITEMS = [("b1", " ".join(f"Item{i}" for i in range(40))), ("b2", "short one, two"), ("a3", None), ("a4", ""),
         ("b5", " ".join(f"item{i}" for i in range(10, 30))), ("b5", "short ONE two"), (None, "null item text words")]


def brute_contamination(rows, items, window=13):
    wins = defaultdict(set)
    for i, t in items:
        w = WORD.findall(low(t))
        for k in range(len(w) - window + 1) if len(w) >= window else range(1 if w else 0):
            wins[tuple(w[k:k + window])].add(i or "")
    out = Counter()
    for i, t in rows:
        w = WORD.findall(low(t))
        hit, ids = set(), set()
        for win, names in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    ids |= names
        out[i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


@pytest.mark.parametrize("block", [200_000, 9])
def test_contamination(spark, messy_rows, no_docs, block):
    from tests.llm.conftest import as_docs
    rows = [*messy_rows[:60], (50, ITEMS[0][1].upper()), (51, "x " * 300 + " ".join(f"item{i}" for i in range(12, 27))),
            (52, "a short: one two"), (52, "a short: one two"), (53, "item10 " * 20 + "short one")]
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert counted(contamination(as_docs(spark, rows), items, block_windows=block), *cols) == brute_contamination(rows, ITEMS)
    assert contamination(no_docs, items).count() == 0
    none = contamination(as_docs(spark, rows), items.limit(0))
    assert none.where("contaminated or n_hit > 0").count() == 0 and none.count() == len(rows)


# ---------------------------------------------------------------- scaled sketches

def brute_sketch(text, fraction=1 / 4, floor=64):
    words = [w for w in re.split(r"[ \t-\r]+", text or "") if w]
    top = (1 << 32) - 1

    def hashed(value):
        return fingerprints_xxhash(value) & top

    word = [fingerprints_xxhash_string(w) for w in words]
    all_ = sorted({hashed(word[i:i + 5]) for i in range(len(word) - 4)} if len(word) >= 5 else {hashed(word)} if word else set())
    limit = int(top * fraction)
    low_ = [h for h in all_ if h <= limit]
    if len(low_) >= floor:
        return limit, low_
    return (top, all_) if len(all_) <= floor else (all_[floor - 1], all_[:floor])


def fingerprints_xxhash_string(word):
    return xxhash.xxh64_intdigest(word.encode(), seed=42)


def fingerprints_xxhash(values):
    """Spark's ``xxhash64`` of longs, one after another (also of an array of longs): each
    seeds the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little"), seed=seed)
    return seed


def test_scaled_sketch_equals_brute_force(messy, messy_rows):
    got = fingerprints.with_scaled_sketch(messy, "text", "sketch").select("doc_id", "text", "sketch")
    want = {(i, t): brute_sketch(t) for i, t in messy_rows}
    for r in got.collect():
        assert (r["sketch"]["limit"], r["sketch"]["hashes"]) == want[r["doc_id"], r["text"]]
    import base64
    strings = got.select("doc_id", "text", fingerprints.sketch_string("sketch").alias("f")).collect()
    for r in strings:
        limit, hashes = want[r["doc_id"], r["text"]]
        assert base64.b64decode(r["f"]) == (b"".join(x.to_bytes(4, "big") for x in [limit, *hashes]) if hashes else b"")
    long = [r for r in strings if r["text"] and len(r["text"]) > 50]
    assert sum(len(r["f"]) for r in long) < 0.3 * sum(len(r["text"].encode()) for r in long)


def test_merged_sketches_estimate_containment(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(40):
        a, b = ([f"{c}{i}" for i in rng.integers(0, 10**9, n)] for c, n in (("a", 84), ("b", 200)))
        x = b[20:120]
        c = [f"c{i}" for i in rng.integers(0, 10**9, 3_000)] + b[:60]
        rows.append((k, *(" ".join(w) for w in (a, b, x, c))))
    df = spark.createDataFrame(rows, "k int, a string, b string, x string, c string")
    for c in "abxc":
        df = fingerprints.with_scaled_sketch(df, c, f"k_{c}")
    df = df.withColumn("ab", fingerprints.merge_sketches("k_a", "k_b")).withColumn("abc", fingerprints.merge_sketches("ab", "k_c"))
    near = {f"{x}_{y}": fingerprints.contained_share(x, y).alias(f"{x}_{y}") for x, y in
            (("k_x", "k_b"), ("k_x", "ab"), ("k_x", "abc"), ("k_b", "ab"), ("k_b", "k_c"), ("k_a", "k_b"), ("ab", "k_b"))}
    got = df.select(*near.values()).collect()
    mean = {n: sum(r[n] for r in got) / len(got) for n in near}
    assert mean["k_x_k_b"] == mean["k_x_ab"] == mean["k_x_abc"] == mean["k_b_ab"] == 1.0 and mean["k_a_k_b"] == 0.0
    assert abs(mean["k_b_k_c"] - 56 / 196) < 0.05 and abs(mean["ab_k_b"] - 196 / 276) < 0.05
    # The order of merging does not matter, nor does merging a sketch with itself.
    again = df.select("ab", fingerprints.merge_sketches("k_b", "k_a").alias("ba"), fingerprints.merge_sketches("ab", "k_b").alias("abb")).collect()
    assert all(r["ab"] == r["ba"] and r["ab"]["hashes"] == r["abb"]["hashes"] for r in again)
    long = df.select("k", F.explode(F.array("k_a", "k_b", "k_c", "k_b")).alias("sketch"))
    groups = {r["k"]: r["sketch"] for r in fingerprints.merged(long, ["k"]).collect()}
    assert groups == {r["k"]: r["abc"] for r in df.select("k", "abc").collect()}


def test_merged_sketches_of_groups_without_words(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, ""), (2, None), (2, "x")], "k int, t string")
    got = {r["k"]: r["sketch"]["hashes"] for r in fingerprints.merged(fingerprints.with_scaled_sketch(df, "t", "sketch"), ["k"]).collect()}
    assert len(got[None]) == 1 and got[1] == [] and len(got[2]) == 1


def test_edited_pairs_split_the_rows_of_one_id(spark):
    from tests.llm.conftest import as_docs
    rows = [(None, f"{k:03d} text") for k in range(60)] + [(5, f"{k:03d} more") for k in range(60)] + [(9, "same")] * 20
    got = fingerprints.edited_pairs(as_docs(spark, rows), rows_per_range=10, sketch=fingerprints.with_scaled_sketch)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    assert counted(got, "doc_id", "text", "next_text") == Counter(
        (*order[k], order[(k + 1) % len(order)][1]) for k in range(len(order)))


def test_a_passage_of_every_piece_is_handed_on_once_per_task(spark, monkeypatch):
    passage = " ".join(f"common{i}" for i in range(40))
    rng = np.random.default_rng(9)
    rows = [(int(i), f"{passage} own text {i} {passage}") for i in rng.permutation(400)] + [(7, f"{passage} own text 7 {passage}")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    sent = {}
    for most in (0, 100_000):
        monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 4_000)
        monkeypatch.setattr(suffix_dedup, "SEEN_MOST", most)
        keyed = docs.select(*suffix_dedup._keys("doc_id", "text"))
        handed = suffix_dedup.context_rows(keyed, 100, np.zeros(0, np.int64)).where("strings > 0")
        sent[most] = handed.groupBy("mh", "ctx").count().agg(F.max("count")).first()[0]
        assert counted(suffix_dedup.remove_repeats(docs, min_length=100), *cols) == brute_repeats(rows, 100)
    assert sent[0] > 40 and sent[100_000] <= 12      # a running minimum of 400 ids in random order
