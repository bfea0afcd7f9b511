"""Exact dedup: a counting Bloom filter finds hashes that may repeat; only their rows shuffle.

First pass: every text gives a 64-bit hash, the hash two slots, and slots met
at least twice become a bitmap.  Second pass: a row whose slots are both set
may have a twin and is grouped exactly by its SHA-256; every other row has none
and passes straight through.

The bitmap has 16 bits a row up to ``max_bits`` (2**28 bits, 32 MB, by
default), so what is broadcast has a fixed bound.  Past it more rows than need
be are grouped; the result stays the same.

Cases: a null text counts as empty; texts of white space only are equal to the
empty one; a null doc_id comes after all others; rows repeated under one doc_id
with texts of one length are all marked ``kept``, and ``drop_copies`` leaves one
of them; input columns named like an output column give way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.texts import SPACES, as_bytes, free_name, give_back, others, row_function, with_fields
from netloom.session import cut_lineage

BITS_PER_ROW, MAX_BITS = 16, 1 << 28
DIGEST = "digest binary, n_points long, slot_hash long"


def _digests(texts: list[bytes | None]) -> pa.Array:
    found = [hashlib.sha256((t or b"").translate(None, SPACES)).digest() for t in texts]
    points = [len(t) if t.isascii() else len(t.decode("utf-8", "replace")) for t in (t or b"" for t in texts)]
    hashes = np.frombuffer(b"".join(d[:8] for d in found), "<i8")
    return pa.StructArray.from_arrays(
        [pa.array(found, pa.binary()), pa.array(points, pa.int64()), pa.array(hashes)],
        names=["digest", "n_points", "slot_hash"])


def _bits_set(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether both slots of each hash are set."""
    h, hit = hashes.view(np.uint64), np.ones(len(hashes), bool)
    for slot in (h & np.uint64((1 << bits) - 1), h >> np.uint64(64 - bits)):
        hit &= (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    return hit


def with_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds SHA-256 of the text without white space, its code points, and a slot hash."""
    return with_fields(docs, row_function(_digests, DIGEST)(F.col(text)), ["digest", "n_points", "slot_hash"])


def filter_bits(n_rows: int, max_bits: int = MAX_BITS) -> int:
    """Exponent of the filter's size."""
    return int(np.ceil(np.log2(min(max(n_rows * BITS_PER_ROW, 1 << 12), max_bits))))


def repeated_slots(hashes: DataFrame, bits: int) -> np.ndarray:
    """First pass: the bitmap of slots that at least two rows set."""
    h = F.col("slot_hash")
    slots = hashes.select(F.explode(F.array(
        h.bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(h, 64 - bits))).alias("slot"))
    words = (slots.groupBy("slot").count().where("count > 1")
             .groupBy(F.shiftright("slot", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow())
    bitmap = np.zeros(1 << max(bits - 6, 0), np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bitmap


def may_repeat(spark, bitmap: np.ndarray, bits: int):
    """Second pass: a function of the slot hash, true where both slots are set."""
    shared = spark.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def test(hashes: pa.Array) -> pa.Array:
        return pa.array(_bits_set(shared.value, hashes.to_numpy(zero_copy_only=False), bits))

    return test


def _winners(maybe: DataFrame) -> DataFrame:
    """Of each group the row that stays: most code points, then smallest doc_id."""
    first = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id")))
    grouped = maybe.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size"))
    # written, so that the join below shuffles both sides and its hot keys can be split
    return cut_lineage(grouped.select("digest", "group_size", F.col("first.id").alias("keep_id"),
                                      (-F.col("first.n")).alias("keep_points")))


def exact_groups(docs: DataFrame, text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest."""
    rows = cut_lineage(with_digests(docs.select("doc_id", F.col(text).alias("text"))).drop("text"))
    bits = filter_bits(rows.count(), max_bits)
    flagged = rows.withColumn("maybe", may_repeat(docs.sparkSession, repeated_slots(rows, bits), bits)("slot_hash"))
    maybe = flagged.where("maybe")
    alone = flagged.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "digest")
    grouped = maybe.join(_winners(maybe), "digest").select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))).alias("kept"),
        "digest")
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The documents that stay, with all their columns; one row of each group of equal texts."""
    spark = docs.sparkSession
    rows = cut_lineage(with_digests(docs.select("doc_id", F.col(text).alias("text"))).drop("text"))
    bits = filter_bits(rows.count(), max_bits)
    bitmap = repeated_slots(rows, bits)
    winners = _winners(rows.where(may_repeat(spark, bitmap, bits)("slot_hash")))
    shared, name = spark.sparkContext.broadcast(bitmap), free_name(docs, "digests")

    @F.arrow_udf("digest binary, n_points long, maybe boolean")
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:  # digest and filter in one step, so one worker a task
        for texts in batches:
            digest, points, hashes = _digests(as_bytes(texts)).flatten()
            maybe = _bits_set(shared.value, hashes.to_numpy(zero_copy_only=False), bits)
            yield pa.StructArray.from_arrays([digest, points, pa.array(maybe)], names=["digest", "n_points", "maybe"])
        give_back()

    keyed = docs.select(*others(docs), look(F.col(text)).alias(name))
    own = F.col(name)
    same = ((own["digest"] == winners["digest"]) & keyed["doc_id"].eqNullSafe(winners["keep_id"])
            & (own["n_points"] == winners["keep_points"]))
    stays = keyed.where(own["maybe"]).join(winners, same, "left_semi")
    once = stays.withColumn(name + "_key", own["digest"]).dropDuplicates([name + "_key"])
    return keyed.where(~own["maybe"]).select(*others(docs)).unionByName(once.select(*others(docs)))
