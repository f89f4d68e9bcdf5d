"""Language-model scores of texts by context-tree weighting, beside a unigram base score.

The model is counted over all texts that `learns` admits (see trees.py for the mathematics) and grows with them:
 1. texts are dealt into buckets by a hash of the id; a bucket counts its distinct grams and tokens, and writes them as
    sorted, compressed arrays, cut by range: grams by their last two context bytes, tokens by their hash;
 2. a task takes one range of all buckets, sums the counts, and grows the trees from depth 2 on; what depths 0 and 1
    need from these is at most 256 * 255 sums, which the driver turns into the upper levels;
 3. the tasks of the ranges give each bucket the code lengths of its grams and the counts of its tokens, in the order of
    the bucket's own arrays, and the buckets score their texts.
So no task sees more than a range or a bucket, and the frequent grams and tokens are pre-aggregated in every bucket.

Defined cases: null and empty texts are coded as the end symbol alone and have one token, the end; a null id is learnt
from and not held out; without any text to learn from each choice costs one bit and base_score is 0; rows are scored
one by one, repeated or not. Positions before a text count as byte 0 in contexts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import trees as T
from .shared import bare, parts_of, small_batches, stored

#: The hash that stands for the end token.
STOP = A.U64(0x5F3759DF5F3759DF)
#: Bytes of a bucket's cut-up texts that are kept from counting to scoring; the rest is cut up again.
KEPT_BYTES = 120_000_000


def _pack(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), kind)


def _steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, byte planes apart, which compress well."""
    keys = keys.view(A.U64)
    d = np.diff(keys, prepend=A.U64(0)) if len(keys) else keys
    return d.view(np.uint8).reshape(-1, 8).T.copy()


def _unsteps(blob: bytes) -> np.ndarray:
    planes = _unpack(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(A.U64).ravel(), dtype=A.U64)


def _range(kind: int, key: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each key: grams with the same last two context bytes lie together."""
    part = A.mix(key >> A.U64(8) & A.U64(0xFFFF)) if kind == 0 else key
    return (part % A.U64(ranges)).astype(np.int64)


class Tally:
    """Distinct keys with their learnt counts, gathered block by block."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, key: np.ndarray, learnt: np.ndarray) -> None:
        # the learnt mark rides in the order: count all, then those marked
        uniq, _, back = A.distinct(key)
        order = np.argsort(uniq)
        self.parts.append((uniq[order], np.bincount(back, learnt, len(uniq))[order].astype(np.int64)))
        if len(self.parts) > 15:
            self.parts = [self.total()]

    def add_distinct(self, uniq: np.ndarray) -> None:
        self.parts.append((np.sort(uniq), np.zeros(len(uniq), np.int64)))
        if len(self.parts) > 15:
            self.parts = [self.total()]

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, A.U64), np.zeros(0, np.int64)
        if len(self.parts) == 1:
            return self.parts[0]
        return merged([p[0] for p in self.parts], [p[1] for p in self.parts])


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    if not len(key):
        return key, count
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return key[new], np.add.reduceat(count, np.flatnonzero(new))


def _tokens(block: A.Block) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row's end token last, and where each row's begin."""
    w = A.words(block, lower=True)
    first = w.first + np.arange(block.n + 1)
    out = np.full(first[-1], STOP, A.U64)
    body = np.ones(first[-1], bool)
    body[first[1:] - 1] = False
    out[body] = w.hash
    return out, first


def _keys(block: A.Block):
    """For grams and for tokens: keys of all rows, and where each row's begin."""
    gram, first = T.grams(block)
    yield 0, gram.view(A.U64), first
    yield 1, *_tokens(block)


def _by_bucket(batches, bucket_column: int):
    """(bucket, batch slice) for batches that are sorted by bucket."""
    for b in batches:
        bucket = b.column(bucket_column).to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.diff(bucket)) + 1
        for lo, hi in zip([0, *edge], [*edge, len(bucket)], strict=True):
            if hi > lo:
                yield int(bucket[lo]), b.slice(lo, hi - lo)


def _count(ranges: int):
    def run(batches):
        def out(bucket, tallies):
            for kind, tally in enumerate(tallies):
                key, count = tally.total()
                at = _range(kind, key, ranges)
                order = np.argsort(at, kind="stable")
                bounds = np.searchsorted(at[order], np.arange(ranges + 1))
                rows = [(r, order[bounds[r] : bounds[r + 1]]) for r in range(ranges) if bounds[r] < bounds[r + 1]]
                for k in range(0, len(rows), 256):
                    part = rows[k : k + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(part), pa.int32()), pa.array([kind] * len(part), pa.int32()), pa.array([r for r, _ in part], pa.int32()), pa.array([_pack(_steps(key[o])) for _, o in part], pa.binary()), pa.array([_pack(count[o].astype(np.int32)) for _, o in part], pa.binary())], ["bucket", "kind", "range", "keys", "counts"])

        now, tallies = None, None
        for bucket, b in _by_bucket(batches, 0):
            if bucket != now:
                if tallies:
                    yield from out(now, tallies)
                now, tallies = bucket, [Tally(), Tally()]
            learns = b.column(1).to_numpy(zero_copy_only=False)
            for block in A.blocks(b.column(2)):
                mine = learns[block.rows]
                for kind, key, first in _keys(block):
                    tallies[kind].add(key, np.repeat(mine, np.diff(first)))
        if tallies:
            yield from out(now, tallies)

    return run


def _ranges(batches):
    """(range, kind, [(bucket, keys, counts)]) for rows sorted by range and kind."""
    now, held = None, []
    for b in batches:
        for bucket, kind, at, keys, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (at, kind) != now:
                if held:
                    yield *now, held
                now, held = (at, kind), []
            held.append((bucket, _unsteps(keys), _unpack(counts, np.int32).astype(np.int64)))
    if held:
        yield *now, held


def _survey(batches):
    """What depth 1 needs from the trees of a range, and how many tokens it has, distinct and in all (at key -1)."""
    for _, kind, held in _ranges(batches):
        key, count = merged([h[1] for h in held], [h[2] for h in held])
        if kind == 1:
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([0.0]), pa.array([int((count > 0).sum())]), pa.array([int(count.sum())])], ["key", "log", "zeros", "ones"])
            continue
        low = T.grow(key.view(np.int64), count, 2)[0]
        if len(low.key):
            parent, log, zeros, ones = T.gathered(low.key & 0xFFFF, low.log, low.zeros, low.ones)
            yield pa.RecordBatch.from_arrays([pa.array(parent), pa.array(log), pa.array(zeros.astype(np.int64)), pa.array(ones.astype(np.int64))], ["key", "log", "zeros", "ones"])


def _answer(shared):
    def run(batches):
        upper = shared.value
        for at, kind, held in _ranges(batches):
            key, count = merged([h[1] for h in held], [h[2] for h in held])
            if kind == 0:
                gram = key.view(np.int64)
                levels, value = [*upper, *T.grow(gram, count, 2)], np.empty(len(key), np.float32)
                for k in range(0, len(key), 100_000):
                    value[k : k + 100_000] = T.lengths(gram[k : k + 100_000], levels)
            else:
                value = count
            for k in range(0, len(held), 64):
                part = held[k : k + 64]
                blobs = [_pack(value[np.searchsorted(key, own)]) for _, own, _ in part]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in part], pa.int32()), pa.array([kind] * len(part), pa.int32()), pa.array([at] * len(part), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "range", "values"])

    return run


def _score(ranges: int, tokens: int, distinct: int):
    def run(batches):
        def out(answers, held):
            tallies, kept, room = [Tally(), Tally()], [], KEPT_BYTES
            for b in held:
                for block in A.blocks(b.column(5)):
                    parts = [(kind, *A.distinct(key)[::2], first) for kind, key, first in _keys(block)]
                    for kind, uniq, _, _ in parts:
                        tallies[kind].add_distinct(uniq)
                    room -= sum(uniq.nbytes + back.nbytes // 2 for _, uniq, back, _ in parts)
                    kept.append([(kind, uniq, back.astype(np.int32), first) for kind, uniq, back, first in parts] if room > 0 else None)
            kept = iter(kept)
            tables = []
            for kind in (0, 1):
                key = tallies[kind].total()[0]
                at = _range(kind, key, ranges)
                value = np.zeros(len(key), np.float64)
                order = np.argsort(at, kind="stable")
                bounds = np.searchsorted(at[order], np.arange(ranges + 1))
                for (k, r), blob in answers.items():
                    if k == kind:
                        value[order[bounds[r] : bounds[r + 1]]] = _unpack(blob, np.float32 if kind == 0 else np.int64)
                tables.append((key, value))
            for b in held:
                known, count, base, score = [], [], [], []
                for block in A.blocks(b.column(5)):
                    parts = next(kept) or [(kind, *A.distinct(key)[::2], first) for kind, key, first in _keys(block)]
                    for kind, uniq, back, first in parts:
                        value = tables[kind][1][np.searchsorted(tables[kind][0], uniq)]
                        if kind == 0:
                            score.append(np.add.reduceat(value[back], first[:-1]) * -np.log10(2))
                        else:
                            known.append(np.add.reduceat((value > 0)[back].astype(np.int64), first[:-1]))
                            count.append(np.diff(first))
                            base.append(np.add.reduceat(np.log10((value + 1) / (tokens + distinct + 1))[back], first[:-1]))
                yield pa.RecordBatch.from_arrays([b.column(3), b.column(4), *(pa.array(np.concatenate(x)) for x in (count, known, base, score))], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        now, answers, held = None, {}, []
        for bucket, b in _by_bucket(batches, 0):
            if bucket != now:
                if held:
                    yield from out(answers, held)
                now, answers, held = bucket, {}, []
            kinds = b.column(1).to_numpy(zero_copy_only=False)
            split = int(np.searchsorted(kinds, 2))
            if split:
                table = b.slice(0, split)
                for kind, r, blob in zip(table.column(1).to_pylist(), table.column(2).to_pylist(), table.column(6).to_pylist(), strict=True):
                    answers[kind, r] = blob
            if split < len(kinds):
                held.append(b.slice(split))
        if held:
            yield from out(answers, held)

    return run


def score_texts(docs: DataFrame, learns: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score. learns: a condition on column id.

    Texts are dealt by id and text, so texts of one id, or of none, lie in different parts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = bare(docs, id=id, text=text)
    n = parts_of(spark, texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    texts = texts.select("id", F.coalesce(learns, F.lit(True)).alias("learns"), "text", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int").alias("bucket"))
    dealt = texts.select("bucket", "learns", "text").repartition(n, "bucket").sortWithinPartitions("bucket")
    counts = stored(dealt.mapInArrow(_count(n), "bucket int, kind int, range int, keys binary, counts binary"))
    by_range = counts.repartition(n, "range").sortWithinPartitions("range", "kind")
    sums = by_range.mapInArrow(_survey, "key long, log double, zeros long, ones long").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("log", "zeros", "ones")]).orderBy("key").toPandas()
    whole, sums = sums[sums["key"] == -1], sums[sums["key"] >= 0]
    distinct, tokens = (int(whole[c].sum()) for c in ("zeros", "ones"))
    one = T.Level(sums["key"].to_numpy(), sums["zeros"].to_numpy(float), sums["ones"].to_numpy(float), sums["log"].to_numpy())
    zero = T.Level(*T.gathered(one.key & 255, one.zeros, one.ones, one.log))
    shared = spark.sparkContext.broadcast([zero, one])
    answers = by_range.mapInArrow(_answer(shared), "bucket int, kind int, range int, values binary")
    rows = answers.select("bucket", "kind", "range", F.lit(None).cast("long").alias("id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("string").alias("text"), "values")
    rows = rows.union(texts.select("bucket", F.lit(2), F.lit(None).cast("int"), "id", ~F.col("learns"), "text", F.lit(None).cast("binary")))
    rows = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "kind")
    out = rows.mapInArrow(_score(n, tokens, distinct), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
