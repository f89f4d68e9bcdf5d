"""The corpus operators against plain Python on small tables, odd rows included."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerlark.llm import bytepair, lm, neardup, ordermin, packing, quality, sharding, shared, stages, substring, toxicity, trees, vectors
from ledgerlark.llm import arrays as A
from pyspark.sql import functions as F

import public_tokenizers as P

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def texts(seed=0, n=160):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    some = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = some(70)
    out = [None, "", " \t\n", "one", "two words", "x" * 3000, "a " * 400, "a b " * 300, passage]
    while len(out) < n:
        kind, base = rng.random(), rng.choice(out[9:] or ["seed text of some words here"])
        if kind < 0.15:
            out.append(base)
        elif kind < 0.4 and base:
            w = base.split()
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
        elif kind < 0.55:
            out.append(some(rng.randint(0, 40)) + " " + passage + " " + some(rng.randint(0, 40)))
        else:
            out.append(some(rng.randint(1, 200)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(3 * k, t, "en", "s", len(t or ""), "clash") for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def raw(t):
    return (t or "").encode()


def test_words_match_the_pattern():
    import pyarrow as pa

    for block in A.blocks(pa.array(texts()), 5000):
        w = A.words(block)
        for i in range(block.n):
            assert [block.data[s : s + n].tobytes() for s, n in zip(w.start[w.first[i] : w.first[i + 1]], w.length[w.first[i] : w.first[i + 1]], strict=True)] == WORD.findall(block.text(i))


def test_components_both_ways(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 540)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    want = {x: root(x) for p in pairs for x in p if p[0] != p[1]}
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(5)
    for local in (10**6, 0):
        assert {r["node"]: r["root"] for r in shared.components(edges, local).collect()} == want
        assert shared.components(edges.limit(0), local).count() == 0


def test_fingerprints(spark, docs, empty):
    got, rows = by_id(ordermin.fingerprints(docs)), [(r["doc_id"], r["text"] or "") for r in docs.orderBy("doc_id").collect()]
    seen = {}
    for k, (i, t) in enumerate(rows):
        q = len(t) // 4
        edited = t[: len(t) - q] + rows[(k + 1) % len(rows)][1][:q]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(t, r["fingerprint"]) == r["fingerprint"] and 0 <= r["near_next"] <= 1
    near = [got[i]["near_edited"] for i, t in rows if len(t) > 200]
    assert np.mean(near) > 0.25
    assert ordermin.fingerprints(empty).count() == 0
    alone = ordermin.fingerprints(docs.where("doc_id = 30")).first()
    assert alone["near_next"] == 1.0


def plain_print(text):
    """Order MinHash from its definition: every element of every sketch, no shortcuts."""
    import struct

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    xx = lambda data, seed: xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1)
    of_long = lambda x, seed: xx(struct.pack("<q", signed(x & (1 << 64) - 1)), seed)
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,8}", text)
    if len(tokens) >= 2:
        kmers = [xx(b.encode(), xx(a.encode(), 42)) for a, b in zip(tokens, tokens[1:])]
    else:
        kmers = [xx(" ".join(tokens).encode(), 42)] if tokens else []
    if not kmers:
        return None
    seen, places = {}, []
    for i, h in enumerate(kmers):
        name = signed(h << 24 & (1 << 64) - 1) >> 24
        o = seen[name] = seen.get(name, -1) + 1
        element = xx(struct.pack("<i", o), of_long(name, 42))
        places.append((element >> 25 << 24) | i)
    places.sort()
    out = []
    for j in range(32):
        later = [p for p in places if p >= j << 58]
        taken = sorted(p & 0xFFFFFF for p in (later + places)[: min(2, len(places))])
        h = 42
        for p in taken:
            h = of_long(kmers[p], h)
        out.append(f"{h & 0xFFFFFFFF:08x}")
    return out


def test_fingerprints_equal_the_definition(docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.orderBy("doc_id").collect()]
    got = by_id(ordermin.fingerprints(docs))

    def like(a, b):
        return 1.0 if a == b else 0.0 if a is None or b is None else sum(x == y for x, y in zip(a, b)) / 32

    prints = [plain_print(t) for _, t in rows]
    for k, (i, t) in enumerate(rows):
        q, n = len(t) // 4, (k + 1) % len(rows)
        edited = plain_print(t[: len(t) - q] + rows[n][1][:q])
        assert got[i]["fingerprint"] == "".join(prints[k] or []) and got[i]["edited_fingerprint"] == "".join(edited or [])
        assert got[i]["near_edited"] == pytest.approx(like(prints[k], edited)) and got[i]["near_next"] == pytest.approx(like(prints[k], prints[n]))


def test_fingerprints_of_repeated_and_null_ids(spark):
    rows = [(7, "a b c d"), (7, "a b c d"), (7, "b c d e"), (None, "z y x"), (None, None), (9, "word " * 40_000)]
    got = [tuple(r) for r in ordermin.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    prints = {}
    for r in got:
        prints.setdefault((r[0], r[1], r[3]), 0)
        prints[r[0], r[1], r[3]] += 1
    assert len(got) == 6 and sorted(prints.values()) == [1, 1, 1, 1, 2]


def test_order_matters(spark):
    words = [f"w{k}" for k in range(60)]
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words[30:] + words[:30]))], "doc_id long, text string")
    assert ordermin.fingerprints(df).where("doc_id = 0").first()["near_next"] < 0.9


def plain_near(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(raw(t).lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = list(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_equal_all_pairs(docs, empty):
    want = plain_near([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = by_id(neardup.near_duplicates(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_half_alike_groups(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame([*rows, (7, rows[7][1]), (None, rows[0][1])], "doc_id long, text string")
    got = [r for r in neardup.near_duplicates(df).collect()]
    want = plain_near(rows)
    assert len(got) == 62 and {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {i: c for i, (_, c) in want.items()}


def test_near_duplicates_block_by_block(spark, monkeypatch):
    """Small blocks, so that groups have several, components have blocks of their own, and stars leave much open."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(8)
    rows, k = [], 0
    for g in range(3):
        base = [f"g{g}w{j}" for j in range(100 + 20 * g)]
        for n in range(45):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 2, 3, 4])):
                w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
            rows.append((k, " ".join(w)))
            k += 1
    rng.shuffle(rows)
    got = by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == plain_near(rows)


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one doc_id with unlike texts stay apart, whatever their order."""
    rng = random.Random(12)
    some = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    a, b, c = some(), some(), some()
    rows = [(5, a), (5, b), (3, b + " x"), (7, a + " y"), (None, c), (None, c), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 3, False), (3, 3, True), (7, 5, False), (None, None, True), (None, None, True), (9, 9, True)], key=str)


def test_near_dedup_stage_decides_on_rows(spark):
    rng = random.Random(3)
    some = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    a, b, c, d, e = (some(60) for _ in range(5))
    rows = [(4, a), (4, b), (4, a + " x"), (None, a), (None, c), (None, c + " y"), (None, d), (9, b), (2, d), (2, e), (4, None), (None, "")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, at int").repartition(5)
    got = stages.drop_near_copies(spark, df, "")
    left = {r["at"] for r in got.collect()}
    assert got.columns == df.columns and len(left) == got.count()
    # a: one of rows 0 and 2 (same id); b: 1; c: one of 4 and 5 (no id); d: 8; e: 9; texts without words: all
    assert left - {0, 2, 4, 5} == {1, 8, 9, 10, 11} and len(left & {0, 2}) == 1 and len(left & {4, 5}) == 1


def plain_repeats(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = raw(t).split()
        gone = [False] * len(w)
        mine = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        for k, x in enumerate(mine):
            if seen.get(x, i) < i:
                gone[k : k + 50] = [True] * 50
        for x in mine:
            seen.setdefault(x, i)
        left = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(left).hexdigest())
    return out


def test_substring_dedup_equals_all_windows(docs, empty):
    want = plain_repeats([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = by_id(substring.without_repeats(docs))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == want
    assert sum(v[1] > 0 for v in want.values()) > 10
    assert substring.without_repeats(empty).count() == 0


def test_substring_dedup_cuts_by_row(spark):
    """Several rows without an id and with one id, unlike and equal texts: each row is cut by its own text."""
    rng = random.Random(9)
    some = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    p, q = some(60), some(70)
    rows = [(1, p + " " + some(20)), (2, some(30) + " " + q), (5, some(200) + " " + p), (5, some(80)), (5, q + " " + some(5))]
    rows += [(None, some(150) + " " + p), (None, some(55)), (None, q), (None, some(3)), (None, None), (7, p + " " + some(20))]
    rows += [(None, rows[5][1]), (None, "  " + rows[5][1]), (5, rows[2][1]), (None, rows[0][1]), (None, some(90) + " " + rows[3][1])]
    big = 1 << 62
    want = []
    for i, t in rows:
        w = raw(t).split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if any((j or big) < (i or big) and " ".join(x.decode() for x in w[k : k + 50]) in " ".join((u or "").split()) for j, u in rows):
                gone[k : k + 50] = [True] * 50
        want.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    assert sum(x[2] > 0 for x in want) > 6
    df = spark.createDataFrame([(i, t, "en", k, len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, at int, n_chars long").repartition(5)
    order = lambda x: [str(y) for y in x]
    got = [tuple(r) for r in substring.without_repeats(df).collect()]
    assert sorted(got, key=order) == sorted([(i, n, m, hashlib.sha256(x).hexdigest()) for i, n, m, x in want], key=order)
    left = {r["at"]: r for r in stages.cut_repeats(spark, df, "").collect()}
    assert len(left) == len(rows) and df.columns == list(left[0].asDict())
    for k, (i, _, m, x) in enumerate(want):
        text = x.decode() if m else rows[k][1]
        assert (left[k]["doc_id"], left[k]["text"], left[k]["n_chars"]) == (i, text, len(text or ""))


def test_bytepair_equals_the_library(docs, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bytepair.load_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bytepair.encode_and_decode(docs, path))
    for r in docs.collect():
        ids = enc.encode_ordinary(r["text"] or "")
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert g["decoded_sha256"] == hashlib.sha256(raw(r["text"])).hexdigest()
    assert bytepair.encode_and_decode(empty, path).count() == 0


def thue_morse():
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_clash_under_polynomials(spark):
    """Two words whose polynomial hashes modulo 2**64 agree for every odd base, in one batch."""
    import tiktoken

    one, two = thue_morse()
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytepair.load_ranks(path), special_tokens={})
    df = spark.createDataFrame([(0, one), (1, two), (2, f"{two} {one}"), (3, one)], "doc_id long, text string").coalesce(1)
    got = by_id(bytepair.encode_and_decode(df, path))
    for i, t in ((0, one), (1, two), (2, f"{two} {one}")):
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(enc.encode_ordinary(t), "<u4").tobytes()).hexdigest()
    assert {i: r["component_id"] for i, r in by_id(neardup.near_duplicates(df)).items()} == {0: 0, 1: 1, 2: 2, 3: 0}


def test_clashing_hashes_are_found_out(monkeypatch):
    """With a hash of two bits every pre-token clashes; the ids are still the library's."""
    import pyarrow as pa
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bytepair.load_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, true = bytepair.Encoder(ranks), A.hash_spans
    monkeypatch.setattr(A, "hash_spans", lambda *a: true(*a) & A.U64(3))
    for block in A.blocks(pa.array(texts(n=60)), 3000):
        ids, first = encoder.encode(block)
        for i in range(block.n):
            assert ids[first[i] : first[i + 1]].tolist() == enc.encode_ordinary(block.text(i).decode())


def test_pretokens_of_odd_texts():
    import pyarrow as pa
    import regex

    rng, pattern = random.Random(2), regex.compile(P.PATTERN)
    parts = ["a", "s", " ", "  ", "\n", "'", "'s", "'re", "'ll", "é", "1", "!", "..", " ", "　", "中", "🙂", "\x85", "\t", "'T", "²"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for block in A.blocks(pa.array(odd), 4000):
        at, first = bytepair.pretokens(block)
        cuts = np.append(at, len(block.data))
        for i in range(block.n):
            own = cuts[first[i] : first[i + 1] + 1]
            got = [block.data[a : min(b, block.off[i + 1])].tobytes() for a, b in zip(own, own[1:], strict=False)]
            assert got == [x.encode() for x in pattern.findall(block.text(i).decode())]


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rows = packing.pack(docs, path).collect()
    have = {}
    for r in rows:
        have.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for d in docs.collect():
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        lo, hi, want = 0, len(ids) % 2048 or 2048, []
        while lo < len(ids):
            want.append((len(want), lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())))
            lo, hi = hi, hi + 2048
        assert sorted(have[d["doc_id"]]) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack(empty, path).count() == 0


def test_plans_are_valid_and_near_the_bound():
    rng = np.random.default_rng(0)
    for case in range(60):
        size, n = int(rng.integers(3, 80)), int(rng.integers(1, 200))
        items = rng.integers(1, size + 1, n) if case % 2 else np.minimum(size, rng.geometric(0.2, n))
        p = packing.plan(np.bincount(items, minlength=size + 1), size)
        rows, used = p.table(), np.zeros(p.sequences, int)
        key = rows[:, 0] << 42 | rows[:, 1]
        rank = {}
        for x in items.tolist():
            k = rank[x] = rank.get(x, -1) + 1
            _, lo, s, per, _ = rows[np.searchsorted(key, x << 42 | k, "right") - 1]
            used[s + (k - lo) // per] += x
        assert used.max() <= size and (used > 0).all() and p.sequences <= 11 / 9 * max(-(-items.sum() // size), (items > size / 2).sum()) + 2


def least_sequences(items, size):
    """The fewest sequences, by trying everything (few items)."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= items[k]:
                rest = list(rooms)
                rest.remove(r)
                place(k + 1, [*rest, r - items[k]])
        place(k + 1, [*rooms, size - items[k]])

    place(0, [])
    return best[0]


def test_reduction_loses_no_sequence():
    """What dominance fixes is part of a best packing: the fixed sequences and the best of the rest are the best of all."""
    rng, triples = np.random.default_rng(6), 0
    for case in range(250):
        size = int(rng.integers(8, 24))
        items = rng.integers(max(1, size // 5), size + 1, int(rng.integers(3, 10)))
        p = packing.plan(np.bincount(items, minlength=size + 1), size)
        rows, held = p.table(), {}
        key = rows[:, 0] << 42 | rows[:, 1]
        rank = {}
        for x in items.tolist():
            k = rank[x] = rank.get(x, -1) + 1
            _, lo, s, per, _ = rows[np.searchsorted(key, x << 42 | k, "right") - 1]
            held.setdefault(int(s + (k - lo) // per), []).append(x)
        rest = [x for s, own in held.items() if s >= p.fixed for x in own]
        triples += sum(len(own) == 3 for s, own in held.items() if s < p.fixed)
        assert p.fixed + (least_sequences(rest, size) if rest else 0) == least_sequences(items.tolist(), size)
    assert triples > 5


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 5).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for v in by.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
    for r in rows:
        assert r["size"] == len(raw(text[r["doc_id"]])) + 16 and r["text_crc32"] == zlib.crc32(raw(text[r["doc_id"]]))
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert len(rows) == len(text) and len(by) == 5 and max(sizes) <= 1.02 * min(sizes)
    assert sharding.shard(empty).count() == 0


def test_sharding_by_classes(spark):
    """More groups than are placed one by one: most go by classes, and all three measures come out near equal."""
    rng = random.Random(21)
    rows = [(k, " \t\n".join("w" * rng.randint(1, 12) + str(k) for _ in range(int(rng.lognormvariate(2, 1)) + 1))) for k in range(6000)]
    rows += [(10_000 + k, "copies of one text") for k in range(2500)] + [(20_000, None), (20_000, ""), (None, "x y z"), (20_001, "long " * 30_000)]
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, size int, shard string").repartition(5)
    got = sharding.shard(df, 8, singles=300).collect()
    text = {}
    for i, t in rows:
        text.setdefault(i, []).append(t or "")
    assert len(got) == len(rows) and {r["shard"] for r in got} == set(range(8))
    loads = np.zeros((8, 3))
    for r in got:
        loads[r["shard"]] += [r["size"], r["n_tokens"], 1]
    for i in (5, 77, 20_001):
        assert [r["n_tokens"] for r in got if r["doc_id"] == i] == [len(text[i][0].split())]
    big = 150_016  # one text that no shard can share
    assert loads[:, 0].max() - loads[:, 0].min() <= max(big, 0.02 * loads[:, 0].mean())
    light = np.sort(loads[:, 2])
    assert light[-1] <= 1.5 * light[0] or loads[:, 0].max() >= big
    by = {}
    for r in got:
        by.setdefault((r["group"], r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert max(len(v) for k, v in by.items() if k[1] != len("copies of one text") + 16) == 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(int(loads[s, 2])))


def test_measures_are_balanced_jointly(spark):
    rng = random.Random(22)
    rows = [(k, " ".join(["a" * rng.choice([2, 30])] * rng.randint(1, 60)) + str(k)) for k in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 10, singles=500).collect()
    loads = np.zeros((10, 3))
    for r in got:
        loads[r["shard"]] += [r["size"], r["n_tokens"], 1]
    assert (loads.max(axis=0) / loads.min(axis=0) < [1.002, 1.15, 1.15]).all()


def test_a_hot_group_is_split(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, "same text " * 20).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    n = {r["shard"]: r["n"] for r in sharding.shard(df, 4).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert len(n) == 4 and max(n.values()) <= 1.05 * min(n.values())


def test_toxicity_learns_pairs_alone(spark):
    """Neither of two words tells anything alone: a text is marked if it has both or neither. A linear model can't do better than chance."""
    rng = random.Random(11)
    plain = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [rng.choice(plain) for _ in range(12)] + ["mountain" if a else "river", "people" if b else "stones"]
        rng.shuffle(w)
        rows.append((k, " ".join(w), "clash"))
        labels.append((k, int(a == b)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = by_id(toxicity.score_toxicity(docs, marks))
    held = [k for k, _ in labels if got[k]["held_out"]]
    assert np.mean([(got[k]["score"] >= 0.5) == dict(labels)[k] for k in held]) > 0.95


def test_machine_equals_the_plain_sum():
    """score = sigmoid(bias + weights + <factors, factors> over all pairs), summed pair by pair."""
    import math

    rng, m = np.random.default_rng(3), toxicity.Machine()
    m.w[:] = rng.normal(size=toxicity.SPACE)
    m.v[:] = rng.normal(size=m.v.shape)
    m.bias = 0.3
    sets = [sorted(rng.choice(toxicity.SPACE, n, replace=False).tolist()) for n in (0, 1, 2, 7, 20)]
    off = np.append(0, np.cumsum([len(s) for s in sets]))
    got = m.score(np.array([x for s in sets for x in s], np.int64), off)
    for s, g in zip(sets, got, strict=True):
        z = m.bias + sum(float(m.w[x]) for x in s) + sum(float(m.v[x] @ m.v[y]) for i, x in enumerate(s) for y in s[:i])
        assert g == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-4)


def test_toxicity_learns_words_and_pairs(spark, empty):
    rng = random.Random(5)
    plain = [f"word{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(1500):
        w = [rng.choice(plain) for _ in range(20)]
        toxic = k % 5 == 0
        if toxic:
            w[3] = rng.choice(["slurry", "slurring", "slurs", "nasty"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    rows += [(9000, None), (9001, ""), (9002, "Nasty!")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = by_id(toxicity.score_toxicity(docs, marks))
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k]["held_out"] for k in held) and np.mean([got[k]["predicted"] == dict(labels)[k] for k in held]) > 0.97
    assert got[9000]["score"] == got[9001]["score"] < 0.5 < got[9002]["score"]
    assert toxicity.score_toxicity(empty, marks).count() == 0
    assert toxicity.score_toxicity(docs, marks.limit(0)).where("score > 0.01").count() == 0
    left = {r["doc_id"] for r in toxicity.without_toxic(docs, marks).collect()}
    assert left == {k for k, r in got.items() if r["predicted"] == 0}


def test_quality_keeps_the_good(spark, docs):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(400)]
    rows = [(k, " ".join(rng.choice(words) + ("***" if k % 6 == 0 else "") for _ in range(60)), k, "clash") for k in range(900)] + [(2000, None, 1, ""), (2001, " ", 2, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _weight int, _KEY string")
    marks = spark.createDataFrame([(k, int(k % 6 != 0)) for k in range(0, 900, 2)] + [(5000, None), (None, 1)], "doc_id long, quality int")
    got = by_id(quality.resample(d, marks, share=750 / 900))
    assert {k for k, r in got.items() if r["kept"]} == {k for k in range(900) if k % 6}
    assert abs(quality.labelled_share(marks) - 2 / 3) < 1e-9 and quality.resample(d, marks).where("kept").count() == 600
    kept = quality.accepted(d, marks, share=750 / 900)
    assert kept.count() == 750 and kept.columns == d.columns
    assert quality.resample(d.limit(0), marks).count() == 0
    assert quality.resample(d, marks.limit(0)).where("kept").count() == 900


def test_resampling_follows_the_target(spark):
    """Short texts of two words, drawn unlike in target and raw: the log ratios are those of a plain model, the noise decides, and
    the kept texts have the target's mix."""
    import math

    rows = [(k, "apple" if k % 2 else "stone") for k in range(6000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(k, 1) for k in range(0, 6000) if (k % 2 and k % 100 < 60) or (not k % 2 and k % 100 < 20)], "doc_id long, quality int")
    got = by_id(quality.resample(d, marks, share=0.2))
    weight = {t: [got[k]["weight"] for k, u in rows if u == t][0] for t in ("apple", "stone")}
    # a text of one word has two n-grams, the word and its shape, which all texts share
    assert weight["apple"] == pytest.approx(math.log(0.75 / 0.5), abs=0.02) and weight["stone"] == pytest.approx(math.log(0.25 / 0.5), abs=0.02)
    kept = [k for k, r in got.items() if r["kept"]]
    assert len(kept) == 1200
    share = sum(k % 2 for k in kept) / len(kept)
    assert 0.70 < share < 0.80  # a threshold would give 1.0, chance 0.5


def test_quality_of_long_and_repeated_texts(spark):
    rows = [(1, "good words here " * 30_000), (1, "good words here " * 30_000), (None, "good words"), (2, "x" * 300_000), (2, ""), (3, "bad *** !!! " * 5)]
    d = spark.createDataFrame(rows * 4, "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    got = [tuple(r) for r in quality.resample(d, marks, share=0.5).collect()]
    assert len(got) == 24 and sorted(got, key=str) == sorted([g for g in set(got) for _ in range(got.count(g))], key=str)
    assert all(r[3] for r in got if r[0] == 1) and not any(r[3] for r in got if r[0] == 3)


def test_kth_is_exact(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=500), np.full(100, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in x], "_key double")
    for k in (1, 37, 250, 600):
        assert quality.kth(df, k, 8) == np.sort(x)[::-1][k - 1]


def test_language_model(spark, docs, empty):
    got = by_id(lm.score_texts(docs, toxicity.fold(F.col("id"), 7) != 2))
    count, rows = {}, [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    for i, t in rows:
        if not held[i]:
            for w in [*WORD.findall(raw(t).lower()), "end"]:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        tokens, r = [*WORD.findall(raw(t).lower()), "end"], got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens), sum(w in count for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in tokens))
    long_ = [i for i, t in rows if held[i] and len(t or "") > 300]
    assert sum(got[i]["score"] for i in long_) > sum(len(raw(dict(rows)[i])) for i in long_) * -0.9
    assert lm.score_texts(empty, F.lit(True)).count() == 0
    nothing = by_id(lm.score_texts(docs.limit(20), F.lit(False)))
    assert all(r["base_score"] == 0 and r["train_tokens"] == 0 for r in nothing.values())


def test_scores_equal_one_model_over_all_texts(spark, docs):
    """The trees of all grams, grown at once, score each text as the ranges and buckets do."""
    import pyarrow as pa

    rows = docs.orderBy("doc_id").collect()
    grams = {}
    for r in rows:
        block = next(A.blocks(pa.array([r["text"]], pa.string())))
        grams[r["doc_id"]] = trees.grams(block)[0]
    learnt = np.concatenate([g for i, g in grams.items() if zlib.crc32(str(i).encode()) % 7 != 2])
    others = np.setdiff1d(np.concatenate(list(grams.values())), learnt)
    key, count = np.unique(learnt, return_counts=True)
    key, count = np.concatenate([key, others]), np.concatenate([count, np.zeros(len(others), np.int64)])
    order = np.argsort(key)
    levels = trees.grow(key[order], count[order], 0)
    got = by_id(lm.score_texts(docs, toxicity.fold(F.col("id"), 7) != 2))
    for i, g in grams.items():
        assert got[i]["score"] == pytest.approx(float(-trees.lengths(g, levels).sum() * np.log10(2)), rel=1e-4)


def test_language_model_of_repeated_and_long_texts(spark):
    rows = [(3, "a b c"), (3, "a b c"), (3, "q r"), (None, "a b c"), (4, "lorem ipsum " * 60_000), (5, None)]
    got = [tuple(r) for r in lm.score_texts(spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, id string, score double"), F.lit(True)).collect()]
    assert len(got) == 6 and got.count(next(g for g in got if g[0] == 3 and g[2] == 4)) == 2
    assert {g[2] for g in got if g[0] == 4} == {120_001}


def test_trees_are_a_distribution_and_equal_the_recursion():
    rng = np.random.default_rng(2)
    gram = np.unique(rng.integers(0, 3, (200, 4)) @ (1 << 8 * np.arange(4)))
    count = rng.integers(1, 9, len(gram))
    levels = trees.grow(gram, count, 0, 3)
    context = (gram[5] >> 8) << 8
    p = 2.0 ** -trees.lengths(context + np.arange(256), levels)
    assert p.sum() == pytest.approx(1)
    node, bit = trees.bits(gram)

    def weighted(suffix, d, at):
        m = ((gram >> 8) & ((1 << 8 * d) - 1)) == suffix
        hit = (node == at) & m[:, None]
        zeros, ones = (count[:, None] * (hit & (bit == 0))).sum(), (count[:, None] * (hit & (bit == 1))).sum()
        kt = float(trees.log_kt(np.array([zeros * 1.0]), np.array([ones * 1.0]))[0]) if zeros + ones else 0.0
        if d == 3 or not zeros + ones:
            return kt
        return float(np.logaddexp(kt, sum(weighted(suffix | c << 8 * d, d + 1, at) for c in range(3))) - np.log(2))

    assert levels[0].log[levels[0].find(np.array([1]))[0][0]] == pytest.approx(weighted(0, 0, 1))


def plain_vectors(rows, dim):
    ids, x = [], []
    for i, v in rows:
        if v and None not in v and len(v) == dim and np.isfinite(v).all() and any(v):
            ids.append(i)
            x.append(np.array(v, float) / np.linalg.norm(v))
    s = np.array(x) @ np.array(x).T >= 0.95
    label = np.arange(len(ids))
    for _ in range(len(ids)):
        new = np.array([label[r].min() for r in s])
        if (new == label).all():
            break
        label = new
    return {i: (int(s[k].sum()) - 1, ids[label[k]]) for k, i in enumerate(ids)}


def test_near_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = [(k, [float(np.float32(v)) for v in centres[k % 12] + rng.normal(size=16) * (0.02 + 0.25 * (k % 5 == 0))]) for k in range(240)]
    rows += [(300 + k, rows[0][1]) for k in range(40)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "clash") for r in rows + odd], "vec_id long, embedding array<double>, rep string")
    want = plain_vectors(rows, 16)
    for block in (2048, 16):
        got = {r["vec_id"]: r for r in vectors.near_vectors(df, block=block).collect()}
        assert {i: (got[i]["n_links"], got[i]["component_id"]) for i in want} == want
        assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in odd)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = vectors.rotation(32, 256)
    code, f = vectors.encode(x, turn)
    estimate = (x @ turn.T) @ (np.where(code, 1, -1) / 16).T / f
    error = np.abs(estimate - x @ x.T)
    assert (error <= vectors.EPSILON * np.sqrt((1 - f * f) / (f * f) / 255) + 1e-9).mean() > 0.9999 and abs((estimate - x @ x.T).mean()) < 0.002


def test_stages_with_clashing_columns_and_odd_rows(spark):
    """Extra columns named like our own, repeated and null ids, null and very long texts, nulls everywhere: rows come through whole."""
    sf = "/root/testdata/sf0.001"
    extra = ["_weight", "_KEY", "_row", "_of", "_left", "_gone", "_id", "row", "id", "kind", "part", "stand", "sha", "label", "score", "terms", "component_id"]
    rng = random.Random(31)
    vocabulary = [f"{a}{b}" for a in ("sol", "mar", "ven", "tor", "lin") for b in ("a", "os", "en", "ita", "ar", "us")]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = some(80)
    rows = [(k if k % 9 else None, None if k == 5 else "" if k == 6 else some(30) + " " + passage if k % 4 == 0 else some(60)) for k in range(60)]
    rows += [(3, rows[3][1]), (3, some(70)), (100, some(50_000)), (101, None)]
    df = spark.createDataFrame([(i, t, None, "s", len(t or ""), *[None if k % 3 else f"{c}{k}" for c in extra]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)).repartition(3)
    for stage in (stages.keep_good, stages.drop_toxic, stages.drop_near_copies, stages.cut_repeats):
        out = stage(spark, df, sf)
        got = out.collect()
        assert out.columns == df.columns and len(got) <= len(rows)
        if stage is stages.cut_repeats:
            assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"] or "") for r in got)
            assert sum(passage in (r["text"] or "") for r in got) == 1
        if stage is stages.drop_near_copies:
            assert len(got) == len(rows) - 1  # one exact copy; texts without words are like none
    packed = stages.pack(spark, df, sf)
    assert packed.groupBy("doc_id", "piece").count().count() <= packed.count() and packed.agg(F.max("length")).first()[0] <= 2048


def test_toxicity_of_odd_rows(spark):
    rows = [(k, "calm words " * 5 if k % 2 else "vile words " * 5) for k in range(60)] + [(1, "vile " * 50_000), (1, "calm words"), (None, "vile words"), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, label int, terms string")
    marks = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)] + [(0, 1), (1, 7), (2, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == 1 - r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] > 1]) == 1
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = shared.stored(stage(spark, docs, sf))
        if name != "packing":
            assert docs.columns == before.columns
        if name == "near_dedup":
            want = plain_near([(r["doc_id"], r["text"]) for r in before.collect()])
            assert {r["doc_id"] for r in docs.collect()} == {i for i, (_, c) in want.items() if i == c}
        if name == "substring_dedup":
            want = plain_repeats([(r["doc_id"], r["text"]) for r in before.collect()])
            for r in docs.collect():
                assert hashlib.sha256(b" ".join(raw(r["text"]).split())).hexdigest() == want[r["doc_id"]][2]
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] > counts[3] == counts[4] and labels
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
    assert stages
