"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups are the rows of equal text. A group's vector is its bytes, tokens and rows; it goes whole to the shard where the dot
product of its vector with the residual capacity is highest, largest groups first. A group that is large against a shard is
split into parts by the ranks of its rows, and its parts are placed like groups. The driver places a table of bounded size:

* parts of large groups, of which there are at most 3 * PART * shards;
* up to SINGLES groups, all of them if there are no more and else a share drawn by a hash: they are placed last and one by one, on the
  room that the others have in fact left, and then moved and exchanged as long as that brings the shards nearer to each other in
  bytes, tokens and rows;
* the other groups by classes of nearly equal vectors (equal logarithms, in steps). A class is placed by its mean vector, a small
  multiple of it at a time, and Spark numbers the groups of a class and looks their shards up. The steps are as fine as the number of
  classes allows.

The law that holds is `bytes`: sizes near equal. Tokens are words `[^\\x20\\x09-\\x0D]+`.

Defined cases: a null text has no bytes (size 16) and is one group with the empty text; an empty table gives no rows;
rows of equal text and id are numbered in any order; rows with one id and unlike texts are in unlike groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SMALL_ROWS, bare, ranked, scratch, stored

SHARDS, SINGLES, CLASSES, PART, GRAIN = 40, 20_000, 20_000, 16, 1 / 200
MEASURES = ["bytes", "tokens", "n"]
KEY = ["group", "crc", "size"]


def fill(vectors: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Shard of each item, largest first, by the dot product with the room, which shrinks. Vectors and room are shares of a shard."""
    out = np.zeros(len(vectors), np.int64)
    for k in np.argsort(-vectors.max(axis=1, initial=0), kind="stable"):
        s = out[k] = int(np.argmax(room @ vectors[k]))
        room[s] -= vectors[k]
    return out


def level(vectors: np.ndarray, at: np.ndarray, load: np.ndarray, steps: int) -> None:
    """Moves and exchanges items (at is changed, and load with it) between the two shards that are furthest apart in a measure, while
    the squared distances of their loads shrink."""
    tired: set[tuple[int, int]] = set()
    for _ in range(steps):
        spread = load.max(axis=0) - load.min(axis=0)
        pairs = [(int(load[:, m].argmax()), int(load[:, m].argmin())) for m in np.argsort(-spread)]
        pair = next((p for p in pairs if p not in tired and p[0] != p[1]), None)
        if pair is None:
            return
        a, b = pair
        gap = load[a] - load[b]
        mine, theirs = np.flatnonzero(at == a), np.flatnonzero(at == b)
        # what leaves a: an item, or an item less one of theirs that is near to it in bytes, less half the gap
        theirs = theirs[np.argsort(vectors[theirs, 0], kind="stable")]
        given, taken = [vectors[mine]], [np.full(len(mine), -1)]
        if len(theirs):
            near = np.searchsorted(vectors[theirs, 0], vectors[mine, 0] - gap[0] / 2)
            for shift in (-1, 0, 1):
                k = theirs[np.clip(near + shift, 0, len(theirs) - 1)]
                given.append(vectors[mine] - vectors[k])
                taken.append(k)
        moved, taken = np.concatenate(given), np.concatenate(taken)
        gain = 2 * (moved * (gap - moved)).sum(axis=1)
        k = int(gain.argmax()) if len(gain) else -1
        if k < 0 or gain[k] <= 1e-15:
            tired.add(pair)
            continue
        tired.clear()
        at[mine[k % len(mine)]] = b
        if taken[k] >= 0:
            at[taken[k]] = a
        load[a] -= moved[k]
        load[b] += moved[k]


def even_bytes(size: np.ndarray, at: np.ndarray, held: np.ndarray, steps: int) -> None:
    """Moves or exchanges between the fullest and the emptiest shard, while their bytes come nearer."""
    for _ in range(steps):
        a, b = int(held.argmax()), int(held.argmin())
        gap = held[a] - held[b]
        mine, theirs = np.flatnonzero(at == a), np.flatnonzero(at == b)
        theirs = theirs[np.argsort(size[theirs], kind="stable")]
        have = np.concatenate([[0], size[theirs]])
        k = np.clip(np.searchsorted(have, size[mine] - gap // 2), 0, len(have) - 1)
        k = np.where((k > 0) & (np.abs(size[mine] - have[k - 1] - gap // 2) < np.abs(size[mine] - have[k] - gap // 2)), k - 1, k)
        diff = size[mine] - have[k]
        if not len(diff) or np.abs(diff - gap / 2).min() >= gap / 2 - 0.5:
            return
        i = int(np.abs(diff - gap / 2).argmin())
        at[mine[i]] = b
        if k[i]:
            at[theirs[k[i] - 1]] = a
        held[a] -= diff[i]
        held[b] += diff[i]


def _classed(groups: DataFrame, most: int) -> DataFrame:
    """groups with class: their measures' logarithms in steps as fine as at most `most` classes allow, one step in every octave at least."""
    for steps in (16, 8, 4, 2, 1):
        parts = [F.floor(F.log2(F.col(m) + 1) * steps).cast("string") for m in MEASURES]
        out = groups.withColumn("class", F.concat_ws("/", *parts))
        if steps == 1 or out.select("class").distinct().count() <= most:
            return out


def _values(rows: list, names: list[str]) -> np.ndarray:
    return np.array([[float(r[m]) for m in names] for r in rows], np.float64).reshape(-1, len(names))


def shard(docs: DataFrame, shards: int = SHARDS, id: str = "doc_id", text: str = "text", singles: int = SINGLES) -> DataFrame:
    """Per row of docs: id, size, text_crc32, law, shard, slot, grown_shard, n_tokens, group."""
    with scratch(docs.sparkSession):
        out = ranked(stored(_placed(docs, shards, id, text, singles)), "shard", ["id"], F.xxhash64("id"), "slot")
        out = out.select(F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), F.col("tokens").alias("n_tokens"), "group")
        return stored(out, keep=1)


def _placed(docs: DataFrame, shards: int, id: str, text: str, singles: int) -> DataFrame:
    spark = docs.sparkSession
    rows = bare(docs, id=id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    rows = stored(rows.select("id", (F.octet_length("text") + 16).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("crc"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"), F.xxhash64("text").alias("group")))
    groups = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    groups = stored(groups.withColumn("bytes", F.col("n") * F.col("size")))
    total = groups.agg(F.count("*").alias("groups"), *[F.sum(c).cast("double").alias(c) for c in MEASURES]).first()
    if not total["groups"]:
        return rows.withColumn("shard", F.lit(0))
    cap = np.array([max(total[m], 1.0) / shards for m in MEASURES])
    share = F.greatest(*[F.col(m) / float(c) for m, c in zip(MEASURES, cap, strict=True)])
    groups = groups.withColumn("parts", F.when((F.col("n") > 1) & (share > 1 / PART), F.least("n", F.ceil(share * PART))).otherwise(1).cast("int"))
    large, others = groups.where("parts > 1"), groups.where("parts = 1")
    u = F.pmod(F.xxhash64(*KEY, F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    alone = u < (2.0 if total["groups"] <= 1.5 * singles else singles / total["groups"])
    many = _classed(others.where(~alone), CLASSES)
    many = stored(many) if total["groups"] > 1.5 * singles else many.limit(0)

    # large groups' parts and classes, on empty shards
    items, names = [], []
    for g in large.orderBy(*KEY).collect():  # at most 3 * PART * shards
        for p in range(g["parts"]):
            n = g["n"] // g["parts"] + (p < g["n"] % g["parts"])
            items.append((n * g["size"], g["tokens"] * n / g["n"], n))
            names.append((g["group"], g["crc"], g["size"], p))
    table = many.groupBy("class").agg(F.count("*").alias("groups"), *[F.sum(m).alias(m) for m in MEASURES]).orderBy("class").collect()  # at most CLASSES
    mean = _values(table, MEASURES) / np.maximum(_values(table, ["groups"]), 1) / cap
    dealt = np.array([r["groups"] for r in table], np.int64)
    step = np.clip(GRAIN // np.maximum(mean.max(axis=1, initial=0), 1e-300), 1, np.maximum(dealt, 1)).astype(np.int64)
    chunks = -(-dealt // step)
    of = np.repeat(np.arange(len(dealt)), chunks)
    count = np.minimum(step[of], dealt[of] - (np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * step[of])
    parts = np.array(items, np.float64).reshape(-1, 3) / cap
    at = fill(np.concatenate([parts, mean[of] * count[:, None]]), np.ones((shards, 3)))
    per = np.zeros((len(dealt), shards), np.int64)
    np.add.at(per, (of, at[len(parts) :]), count)
    ends = np.cumsum(per, axis=1)
    lots = spark.createDataFrame([(r["class"], ends[k].tolist()) for k, r in enumerate(table)], "class string, ends array<long>")
    # the groups of a class in the order of a hash: the first so many to shard 0, and so on
    numbered = ranked(many, "class", KEY, F.xxhash64(*KEY), "rank").join(F.broadcast(lots), "class")
    numbered = stored(numbered.select(*KEY, *MEASURES, F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard")))
    in_fact = numbered.groupBy("shard").agg(*[F.sum(m).alias(m) for m in MEASURES]).collect()
    load = np.zeros((shards, 3))
    for r in in_fact:
        load[r["shard"]] = [r[m] for m in MEASURES]
    load /= cap
    np.add.at(load, at[: len(parts)], parts)

    # single groups on what is left, then moves and exchanges of all that is known one by one
    lone = others.where(alone).orderBy(*KEY).collect()  # at most about 1.5 * SINGLES
    own = _values(lone, MEASURES) / cap
    mine = fill(own, 1 - load)
    np.add.at(load, mine, own)
    vectors, at = np.concatenate([parts, own]), np.concatenate([at[: len(parts)], mine])
    level(vectors, at, load, 40 * shards)
    size = np.concatenate([np.array([i[0] for i in items], np.int64), np.array([r["bytes"] for r in lone], np.int64)])
    held = np.rint(load[:, 0] * cap[0]).astype(np.int64)
    even_bytes(size, at, held, 20 * shards)

    where = [(*names[k], int(at[k])) for k in range(len(names))]
    big = F.broadcast(spark.createDataFrame(where, "group long, crc long, size long, part int, shard int"))
    few = spark.createDataFrame([(r["group"], r["crc"], r["size"], int(s)) for r, s in zip(lone, at[len(parts) :], strict=True)], "group long, crc long, size long, shard int")
    wide = F.broadcast(large.select(*KEY, "parts"))
    split = ranked(rows.join(wide, KEY).withColumn("name", F.struct(*KEY)), "name", ["id"], F.xxhash64("id"), "rank").drop("name")
    split = split.withColumn("part", (F.col("rank") % F.col("parts")).cast("int")).join(big, [*KEY, "part"])
    rest = rows.join(wide, KEY, "left_anti")
    whole = few.union(numbered.select(*KEY, "shard")) if table else few
    whole = rest.join(F.broadcast(whole) if total["groups"] <= SMALL_ROWS else whole, KEY)
    columns = ["id", *KEY, "tokens", "shard"]
    return whole.select(columns).union(split.select(columns))
