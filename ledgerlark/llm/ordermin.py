"""Order MinHash fingerprints (Marcais et al. 2019), by DataFrame functions only.

A text's tokens are the pieces of its words, of at most PIECE code points; a k-mer is K tokens in a row (the whole
sequence where there are fewer), numbered by occurrence, so repeated k-mers are different elements. Each element has one
hash on a circle of 2**40; sketch j orders the elements by their distance from the point j / SKETCHES of the circle, which
for any one j is a random order, and takes the first TUPLE of them. Put back into text order, their k-mers are hashed to
entry j. Two texts' entries agree with a probability that falls with their edit distance; the likeness is the share of
entries that agree. Both texts without k-mers: 1; one of them: 0.

Everything is computed within a row, in time linear in the text but for two sorts of long values. The next document in
the order of ids is found by cutting the ids into ranges of about equal counts and copying the first row of a range
to the one before, so no task sees more than a range.
Defined cases: null texts count as empty; the only row of a table is its own next one; rows with one id follow
each other in the order of their texts; null ids come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import bare, partitions

PIECE, K, SKETCHES, TUPLE = 8, 2, 32, 2
#: Bits of an element's place on the circle, and of its position in the text.
CIRCLE, PLACE = 39, 24


def let(value: Column, body) -> Column:
    """body(value), where value is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _kmers(text: Column) -> Column:
    """Hashes of the k-mers, in text order."""

    def of(tokens: Column) -> Column:
        n = F.size(tokens)
        many = F.transform(F.slice(tokens, 1, F.greatest(n - (K - 1), F.lit(0))), lambda t, i: F.xxhash64(t, *[F.get(tokens, i + k) for k in range(1, K)]))
        few = F.when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", tokens)))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n >= K, many).otherwise(few)

    return let(F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0)), of)


def _places(kmers: Column) -> Column:
    """place on the circle << PLACE | position, sorted: one long for each k-mer, told apart by occurrence."""
    mask = (1 << PLACE) - 1

    def numbered(ordered: Column) -> Column:
        # equal k-mers lie together, in text order; a stretch of them begins where the k-mer changes
        n = F.size(ordered)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.shiftright(F.get(ordered, i), PLACE) != F.shiftright(F.get(ordered, i - 1), PLACE)))

        def stretches(begins: Column) -> Column:
            def one(begin: Column, r: Column) -> Column:
                size = F.coalesce(F.get(begins, r + 1), n) - begin
                return F.transform(F.slice(ordered, begin + 1, size), lambda x, o: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.shiftright(x, PLACE), o), 64 - CIRCLE), PLACE).bitwiseOR(x.bitwiseAND(F.lit(mask))))

            return F.sort_array(F.flatten(F.transform(begins, one)))

        return F.when(n > 0, let(starts, stretches)).otherwise(F.array().cast("array<bigint>"))

    packed = F.transform(kmers, lambda h, i: F.shiftleft(h, PLACE).bitwiseOR(i.cast("long")))
    return let(F.sort_array(packed), numbered)


def fingerprint(text: Column) -> Column:
    """Array of SKETCHES 32-bit entries; empty for a text without k-mers."""
    step = 1 << (CIRCLE + PLACE - (SKETCHES.bit_length() - 1))
    mask = (1 << PLACE) - 1

    def of(kmers: Column) -> Column:
        def sketch(places: Column) -> Column:
            # what any sketch takes is among the first TUPLE elements of each arc
            near = F.filter(places, lambda x, i: (i < TUPLE) | (F.floor(x / step) != F.floor(F.coalesce(F.get(places, i - TUPLE), F.lit(0)) / step)))

            def entries(near: Column) -> Column:
                def entry(j: Column) -> Column:
                    after = F.filter(near, lambda x: x >= j.cast("long") * F.lit(step))
                    taken = F.slice(F.concat(F.slice(after, 1, TUPLE), F.slice(near, 1, TUPLE)), 1, F.least(F.lit(TUPLE), F.size(near)))
                    return let(F.sort_array(F.transform(taken, lambda x: x.bitwiseAND(F.lit(mask)))), lambda at: F.xxhash64(F.transform(at, lambda p: F.get(kmers, p.cast("int"))))).bitwiseAND(F.lit(0xFFFFFFFF))

                return F.transform(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), entry)

            return F.when(F.size(places) > 0, let(near, entries)).otherwise(F.array().cast("array<bigint>"))

        return let(_places(kmers), sketch)

    return let(_kmers(text), of)


def likeness(a: Column, b: Column) -> Column:
    """Share of entries that agree."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), lambda i: F.get(a, i) == F.get(b, i))) / float(SKETCHES)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same)


def shown(a: Column) -> Column:
    return F.concat_ws("", F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows (id, ...) with next_<column>: the value of the next row by (id, text), the first row's for the last."""
    spark = rows.sparkSession
    ids = rows.select(F.coalesce("id", F.lit(-(1 << 63))).alias("id"))
    ranges = 4 * partitions(spark)
    cuts = ids.select(F.percentile_approx("id", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(100 * ranges))).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<bigint>"), lambda c: c < F.coalesce("id", F.lit(-(1 << 63)))))
    marked = rows.withColumn("_part", part)
    heads = marked.groupBy("_part").agg(F.min(F.coalesce("id", F.lit(-(1 << 63)))).alias("_least")).orderBy("_part").collect()  # a row for each range
    before = {h["_part"]: heads[k - 1]["_part"] for k, h in enumerate(heads)}
    least = F.create_map(*[F.lit(x) for h in heads for x in (h["_part"], h["_least"])]) if heads else F.lit(None).cast("map<int,bigint>")
    last = F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)]) if heads else F.lit(None).cast("map<int,int>")
    is_head = F.element_at(least, F.col("_part")) == F.coalesce("id", F.lit(-(1 << 63)))
    own = F.struct(F.col("_part").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.element_at(last, F.col("_part")).alias("part"), F.lit(True).alias("guest"))
    dealt = marked.withColumn("_to", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))))
    order = W.partitionBy("_to.part").orderBy("_to.guest", F.col("id").asc_nulls_first(), "text")
    out = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return out.where(~F.col("_to.guest")).drop("_to", "_part")


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = bare(docs, id=id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("print", fingerprint(F.col("text")))
    rows = with_next(rows, ["text", "print"])
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "print", "next_print")
    rows = rows.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_print"), "print", "next_print")
    return rows.select(
        F.col("id").alias(id),
        "n_chars",
        "edited_sha256",
        shown(F.col("print")).alias("fingerprint"),
        shown(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
