"""Alignment of two tokenizations of the same bytes.

Every byte gets a label: 0 none, 1 a token of A ends here, 2 one of B does, 3 both do. A regular expression cuts the label
string into spans that reach up to each 3; the labels of a span say how many tokens of A and of B form the group. Two
tokens are linked when their byte ranges overlap: at every label but 0 exactly one pair of tokens covers the byte.

Texts are cut before each space that follows neither white space nor U+2581. Neither tokenizer joins bytes over such a
place, so a piece of text between two of them is worked out once a task, while it is remembered.

How many documents hold a pair of ids linked is counted over the corpus. The most frequent pairs, a bounded number, are
broadcast; all others, none of them frequent, are looked up by a shuffled join.

Defined cases: null and empty texts, and texts whose pieces of B don't decode to the text, have no tokens (zeros, empty
digest, no pairs); repeated rows count as documents of their own; null and repeated ids change nothing; an empty table
gives no rows; other columns of docs are not read.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import bytepair
from .bytepair import spread
from .shared import bare, small_batches, stored

#: Pieces of text that a task remembers.
KEPT = 150_000
#: Pairs whose counts are broadcast, 17 bytes each.
HEADS = 1_000_000
#: White space and U+2581 before a space: no place to cut.
_JOINED = re.compile("[\t-\r\x1c-\x20\x85\xa0  -     　▁] ")
_SPAN = re.compile(rb"[012]*3")


def cut(text: str) -> list[str]:
    """The pieces of space + text, each without its first space."""
    words = text.split(" ")
    if text[:1] != " " and not _JOINED.search(text):
        return words
    out, open_ = [], False
    for w in words:
        if open_:
            out[-1] += " " + w
        else:
            out.append(w)
        open_ = not out[-1] or out[-1][-1].isspace() or out[-1][-1] == "▁"
    return out


class Pieces:
    """Ids of B by sentencepiece, and the bytes of its pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.size = len(names)
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)]
        # pieces with U+2581 after another letter would join what cut() takes apart
        self.whole = any("▁" in x.lstrip("▁") for x in names)
        self.space = [self.model.piece_to_id("▁")]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of space + text. The library gives none for an empty text, which here is a lone space."""
        return [ids if t else self.space for t, ids in zip(texts, self.model.encode(texts, num_threads=1), strict=True)] if texts else []


def proto(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def labels(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> np.ndarray:
    """The label string of `size` bytes; ends are places after the last byte of each token."""
    out = np.full(size, 48, np.uint8)
    out[ends_a - 1] += 1
    out[ends_b - 1] += 2
    return out


class Aligner:
    """What is known of each piece of text: counts, groups as text, and linked pairs."""

    def __init__(self, vocabulary: tuple, model: bytes):
        import tiktoken

        ranks, table = vocabulary
        core = tiktoken.Encoding("own", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.a = bytepair.Encoder(ranks, table, core.encode_single_piece)
        self.b = Pieces(model)
        self.length_b = np.array([len(x) for x in self.b.bytes], np.int64)
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links; links -1: bytes differ
        self.pairs = np.zeros(0, np.int64)
        self.begin = np.zeros(0, np.int64)

    def known(self, pieces: list[str]) -> np.ndarray:
        """Index of each piece; new ones are worked out."""
        if len(self.at) > KEPT:
            self.forget()
        if new := [w for w in set(pieces) if w not in self.at]:
            self._add(new)
        return np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))

    def _add(self, new: list[str]) -> None:
        column = pa.array([" " + w for w in new], pa.large_string())
        data, off = A.buffers(column)
        ids_a, first_a = self.a.encode(A.Block(slice(0, len(new)), data, off))
        ids_a = ids_a.astype(np.int64)
        ends_a = np.cumsum(self.a.decoder.length[ids_a])
        lists = self.b.encode(new)
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        ids_b = np.fromiter(chain.from_iterable(lists), np.int64, int(n_b.sum()))
        first_b = np.append(0, np.cumsum(n_b))
        length_b = np.append(0, np.cumsum(self.length_b[ids_b]))
        good = (np.diff(length_b[first_b]) == np.diff(off)) & (n_b > 0)
        for k in np.flatnonzero(good).tolist():
            own = b"".join([self.b.bytes[x] for x in lists[k]])
            good[k] = own == data[off[k] : off[k + 1]].tobytes()
        row_b = np.repeat(np.arange(len(new)), n_b)
        ok_b = good[row_b]
        ends_b = length_b[1:] - length_b[first_b[:-1]][row_b] + off[:-1][row_b]
        row_a = np.repeat(np.arange(len(new)), np.diff(first_a))
        ok_a = good[row_a]
        string = labels(ends_a[ok_a], ends_b[ok_b], len(data))
        size = np.diff(off)
        # at each label but 0: which tokens cover the byte
        marked = np.flatnonzero(string != 48)
        kind = string[marked] - 48
        ka, kb = np.cumsum(kind & 1) - (kind & 1), np.cumsum(kind >> 1) - (kind >> 1)
        of_a, of_b = ids_a[ok_a], ids_b[ok_b]
        pairs = of_a[ka] * self.b.size + of_b[kb]
        links = np.diff(np.searchsorted(marked, off))
        texts, n_groups = [], np.zeros(len(new), np.int64)
        raw, upto = string.tobytes(), off.tolist()
        list_a, list_b = list(map(str, of_a.tolist())), list(map(str, of_b.tolist()))
        i = j = 0
        for k, fine in enumerate(good.tolist()):
            own = []
            if fine:
                for span in _SPAN.findall(raw, upto[k], upto[k + 1]):
                    na, nb = span.count(b"1") + 1, span.count(b"2") + 1
                    own.append(",".join(list_a[i : i + na]) + "|" + ",".join(list_b[j : j + nb]))
                    i, j = i + na, j + nb
            n_groups[k] = len(own)
            texts.append(";".join(own))
        links[~good] = 0
        counts = np.stack([np.diff(first_a), n_b, n_groups, np.where(good & (size > 0), links, -1)], 1)
        base = len(self.groups)
        self.at.update(zip(new, range(base, base + len(new)), strict=True))
        self.groups += texts
        self.counts = np.concatenate([self.counts, counts])
        self.begin = np.append(self.begin, len(self.pairs) + np.cumsum(links) - links)
        self.pairs = np.append(self.pairs, pairs)

    def block(self, texts: list[str]):
        """(counts of each text, digests, and of all texts: text, pair, how often)."""
        cuts = [(cut(t) if not self.b.whole else [t]) if t else [] for t in texts]
        at = self.known(list(chain.from_iterable(cuts)))
        n = np.fromiter(map(len, cuts), np.int64, len(cuts))
        row = np.repeat(np.arange(len(cuts)), n)
        own = self.counts[at]
        bad = np.bincount(row, own[:, 3] < 0, len(cuts)) > 0
        good = (n > 0) & ~bad
        upto = np.append(0, np.cumsum(n))
        total = np.vstack([np.zeros((1, 4), np.int64), np.cumsum(own, axis=0)])
        counts = np.where(good[:, None], total[upto[1:]] - total[upto[:-1]], 0)
        digests, where, bounds = [], at.tolist(), upto.tolist()
        for k, fine in enumerate(good.tolist()):
            said = ";".join([self.groups[x] for x in where[bounds[k] : bounds[k + 1]]]) if fine else ""
            digests.append(hashlib.sha256(said.encode()).hexdigest() if fine else "")
        keep = good[row]
        size = own[keep, 3]
        held, times = np.unique(np.repeat(row[keep], size) << 40 | self.pairs[spread(self.begin[at[keep]], size)], return_counts=True)
        return counts, digests, held >> 40, held & ((1 << 40) - 1), times


def aligned(docs: DataFrame, vocabulary: str, model: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct linked pairs (A's id times the size of B's vocabulary,
    plus B's id) with how often each occurs. vocabulary: ranks of A; model: sentencepiece file of B; both of bounded size."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((bytepair.prepared(vocabulary), proto(model)))

    def run(batches):
        aligner = Aligner(*shared.value)
        for b in batches:
            for block in A.blocks(b.column(1)):
                texts = [x or "" for x in b.column(1)[block.rows].to_pylist()]
                counts, digests, row, pair, times = aligner.block(texts)
                off = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(x, t)) for x, t in ((pair, pa.int64()), (times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0)[block.rows], *(pa.array(c) for c in counts.T), pa.array(digests, pa.string()), *lists], ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return bare(docs, id=F.col(id).cast("long"), text=text).mapInArrow(run, "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(table: DataFrame, size_b: int) -> DataFrame:
    """pair, n (how many documents hold it linked), best (n is the highest of its id of A). table: what aligned() gives."""
    counts = stored(table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    a = F.floor(F.col("pair") / size_b)
    best = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))  # a row for each id of A's vocabulary
    return counts.withColumn("a", a).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def alignment(docs: DataFrame, vocabulary: str, model: str, id: str = "doc_id", text: str = "text", heads: int = HEADS) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    table = stored(aligned(docs, vocabulary, model, id, text).withColumn("row", F.monotonically_increasing_id()))
    counts = stored(pair_counts(table, Pieces(proto(model)).size))
    few = counts.count() <= heads
    picked = (counts if few else counts.orderBy(F.col("n").desc(), "pair").limit(heads)).toArrow()
    order = np.argsort(picked["pair"].to_numpy())
    shared = spark.sparkContext.broadcast(tuple(picked[c].to_numpy()[order] for c in ("pair", "n", "best")))

    def look_up(batches):
        key, n, best = shared.value
        for b in batches:
            pairs, times = b.column("pairs"), b.column("times")
            off = pairs.offsets.to_numpy().astype(np.int64)
            pair, often = (x.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]] for x in (pairs, times))
            off = off - off[0]
            at = np.searchsorted(key, pair) if len(key) else np.zeros(len(pair), np.int64)
            hit = np.zeros(len(pair), bool)
            hit[at < len(key)] = key[at[at < len(key)]] == pair[at < len(key)]
            total, top = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
            total[hit] = often[hit] * n[at[hit]]
            top[hit] = often[hit] * best[at[hit]]
            sums = [np.append(0, np.cumsum(x))[off] for x in (top, total)]
            left = pa.array(np.append(0, np.cumsum(~hit))[off].astype(np.int32))
            rest = [pa.ListArray.from_arrays(left, pa.array(x[~hit], pa.int64())) for x in (pair, often)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(np.diff(x)) for x in sums), *rest], [*names, "n_best", "count_sum", "pairs", "times"])

    counted = ["n_a", "n_b", "n_groups", "n_links"]
    names = ["row", "id", "groups_sha256", *counted]
    out = table.select(*names, "pairs", "times").mapInArrow(look_up, "row long, id long, groups_sha256 string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, pairs array<long>, times array<long>")
    if not few:
        out = stored(out)
        rest = out.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
        rest = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_top"))
        out = out.join(rest, "row", "left").withColumns({"count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("_top", F.lit(0))})
    return out.select(F.col("id").alias(id), *counted, "n_best", "count_sum", "groups_sha256")
