"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and the first 4, 5 and 6 bytes of longer words (so that an inflected insult shares
terms with the ones seen), lower-cased and hashed into SPACE weights. The machine (Rendle 2010) adds to the linear
weights a product of two factor vectors for each pair of terms, so a pair such as an insult with a group mention weighs
more than the sum of its parts; with sums of factors this takes time linear in the terms.

It is fitted by AdaGrad in EPOCHS rounds on the driver on at most SAMPLE labelled rows, chosen by a hash of their id; only rows
that `learns` admits are used. Everything else covers all texts. Defined cases: null, empty and blank texts have no terms
and score the bias alone; rows without label are scored but not learnt from; without any label all scores are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .shared import bare, small_batches

SPACE, FACTORS, SAMPLE, EPOCHS, THRESHOLD = 1 << 18, 8, 15_000, 10, 0.7
STEMS = (4, 5, 6)
#: A term has a linear weight if LEAST learnt texts have it and its share of marked ones is off by more than DEVIATIONS standard errors.
#: It has factors if it has a weight, or if a share PAIRED of the learnt texts has it: a term that tells nothing alone may tell with another.
LEAST, DEVIATIONS, PAIRED = 3, 2.5, 0.015
#: Steps of the factors of terms without a weight are shorter by this factor, so that chance pairs weigh little.
CAREFUL = 0.1

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte letters U+00C0 to U+00DE."""
    out = A._LOWER[data]
    if len(data) > 1:
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        upper = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
        out[upper] += 32
    return out


def terms(block: A.Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each row: (values below SPACE, offsets)."""
    data = folded(block.data)
    start, length = A.cut(_WORD[data], block.off)
    row = np.searchsorted(block.off, start, "right") - 1
    values, rows = [A.hash_spans(data, start, length)], [row]
    for n in STEMS:
        m = length > n
        values.append(A.mix(A.hash_spans(data, start[m], np.full(int(m.sum()), n, np.int64)) + A.U64(n)))
        rows.append(row[m])
    key = np.concatenate(rows) * SPACE + (np.concatenate(values) % A.U64(SPACE)).astype(np.int64)
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return key % SPACE, np.searchsorted(key, np.arange(block.n + 1) * SPACE)


class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of <factors, factors>)."""

    def __init__(self, factors: int = FACTORS, seed: int = 7):
        self.fitted, self.bias, self.w, self.known = False, 0.0, np.zeros(SPACE, np.float32), np.ones(SPACE, bool)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (SPACE, factors)).astype(np.float32)

    def raw(self, term: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(off) - 1
        row = np.repeat(np.arange(n), np.diff(off))
        used = self.known[term] if self.fitted else slice(None)
        term, row = term[used], row[used]
        line = np.bincount(row, self.w[term], n)
        v = self.v[term]
        total = np.stack([np.bincount(row, v[:, f], n) for f in range(v.shape[1])], axis=1)
        square = np.bincount(row, np.einsum("ij,ij->i", v, v), n)
        return self.bias + line + 0.5 * ((total * total).sum(axis=1) - square), total

    def score(self, term: np.ndarray, off: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(term, off)[0], -40, 40)))

    def fit(self, term: np.ndarray, off: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, rate: float = 0.4, decay: float = 1e-5, batch: int = 64, seed: int = 7) -> None:
        rng, n = np.random.default_rng(seed), len(label)
        p = (label.sum() + 0.5) / (n + 1)
        seen = np.bincount(term, minlength=SPACE)
        marked = np.bincount(term, np.repeat(label, np.diff(off)), SPACE)
        telling = (seen >= LEAST) & (np.abs(marked - seen * p) > DEVIATIONS * np.sqrt(seen * p * (1 - p)))
        self.known = known = telling | (seen >= max(LEAST, PAIRED * n))
        self.v[~known] = 0
        line, pair = telling.astype(np.float32), np.where(telling, 1, CAREFUL).astype(np.float32)[:, None]
        row = np.repeat(np.arange(n), np.diff(off))[known[term]]
        term, off = term[known[term]], np.searchsorted(row, np.arange(n + 1))
        self.bias = float(np.log(p / (1 - p)))
        gw, gv, gb = np.full(SPACE, 1e-2, np.float32), np.full(self.v.shape, 1e-2, np.float32), 1.0
        for _ in range(epochs):
            order = rng.permutation(n)
            for lo in range(0, n, batch):
                pick = order[lo : lo + batch]
                size = off[pick + 1] - off[pick]
                upto = np.cumsum(size)
                at = np.arange(upto[-1]) + np.repeat(off[pick] - (upto - size), size)
                t = term[at]
                row = np.repeat(np.arange(len(pick)), size)
                z, total = self.raw(t, np.append(upto - size, upto[-1]))
                slope = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[pick]) / len(pick)
                uniq, back = np.unique(t, return_inverse=True)
                dw = np.bincount(back, slope[row], len(uniq)) + decay * self.w[uniq]
                dv = np.empty((len(uniq), self.v.shape[1]), np.float32)
                for f in range(self.v.shape[1]):
                    dv[:, f] = np.bincount(back, slope[row] * (total[row, f] - self.v[t, f]), len(uniq))
                dv += decay * self.v[uniq]
                np.clip(dv, -1, 1, out=dv)
                gw[uniq] += dw * dw
                gv[uniq] += dv * dv
                self.w[uniq] -= line[uniq] * (rate * dw / np.sqrt(gw[uniq])).astype(np.float32)
                self.v[uniq] -= pair[uniq] * (0.3 * rate * dv / np.sqrt(gv[uniq]))
                gb += float(slope.sum()) ** 2
                self.bias -= rate * float(slope.sum()) / gb**0.5
        self.fitted = True


def _featured(batches):
    for b in batches:
        for block in A.blocks(b.column(1)):
            term, off = terms(block)
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(term.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists, b.column(2).slice(block.rows.start, block.n)], ["terms", "label"])


def learn(docs: DataFrame, labels: DataFrame, learns: Column, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most `sample` rows of docs with a label of 0 or 1, however often ids are repeated; learns is a condition on column id."""
    texts = bare(docs, id=id, text=text)
    marked = bare(labels, id=id, label=label).where(learns & F.col("id").isNotNull() & F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    n = max(marked.count(), 1)
    u = F.pmod(F.xxhash64("id", F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
    chosen = marked.where(u < min(1.0, 0.95 * sample / n)).orderBy(u, "id").limit(sample)
    rows = texts.join(F.broadcast(chosen), "id").select("id", "text", F.col("label").cast("int"))
    if rows.count() > sample:  # repeated ids: each text of an id once, and of these a share by their hash
        rows = rows.groupBy("id", "text").agg(F.max("label").alias("label"))
        u = F.pmod(F.xxhash64("id", "text", F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
        rows = rows.where(u < min(1.0, 0.95 * sample / max(rows.count(), 1))).limit(sample)
    got = rows.mapInArrow(_featured, "terms array<int>, label int").toArrow()
    machine = Machine()
    if not got.num_rows:
        machine.bias = -40.0
        return machine
    column = got["terms"].combine_chunks()
    off = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    machine.fit(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), off, got["label"].to_numpy().astype(np.float64))
    return machine


def scored(docs: DataFrame, machine: Machine, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns id and score, for every row of docs. The machine has a fixed size and is broadcast."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(machine)

    def run(batches):
        machine = shared.value
        for b in batches:
            score = [machine.score(*terms(block)) for block in A.blocks(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(score) if score else np.zeros(0))], ["id", "score"])

    return bare(docs, id=id, text=text).mapInArrow(run, "id long, score double").withColumnRenamed("id", id)


def fold(id: Column, parts: int) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % parts


def score_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id, held_out, score, predicted. Rows whose crc32(id) mod 3 is 1 are never learnt from."""
    machine = learn(docs, labels, fold(F.col("id"), 3) != 1, id, text)
    out = scored(docs, machine, id, text)
    return out.select(id, F.coalesce(fold(F.col(id), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score below THRESHOLD."""
    machine = learn(docs, labels, fold(F.col("id"), 3) != 1, id, text)
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(machine)
    at = docs.columns.index(text)

    def run(batches):
        machine = shared.value
        for b in batches:
            score = [machine.score(*terms(block)) for block in A.blocks(b.column(at))]
            if score:
                yield b.filter(pa.array(np.concatenate(score) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
