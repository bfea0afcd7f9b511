"""SimHash near-dedup with pigeonring filtering.

A fingerprint of 64 bits is seen as a ring of five segments.  If two
fingerprints differ in at most four bits, some segment starts a chain in which
every first ``l`` segments differ in at most ``4 l / 5`` bits, rounded down: the
first in none, the first two in at most one, the first three in at most two, and
so on round the ring.  The chain's start gives the keys by which candidates
meet: with the next two segments cut in halves, at least two of the four halves
are equal, one of them of the second segment, so a key is the start segment and
two halves (26 bits or more; 25 keys a fingerprint).  Candidates must keep all
of the chain's budgets before their full distance is taken.

Fingerprints are made distinct first; keys held by one fingerprint never move
on.  A key with many holders is split into blocks of about ``BLOCK`` holders and
each pair of blocks is its own group, so no group is large; within a group only
the links of a spanning forest are emitted.  Links become components, whose id
is the smallest doc_id in them.

Cases: a null text, and one without words, has fingerprint zero, linked like any
other; fewer words than a shingle give one shingle; rows repeated under one
doc_id are rows of their own; a null doc_id never names a component that has
another; an empty table gives an empty result; input columns named like an
output column give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.components import components
from netloom.llm.texts import as_bytes, free_name, give_back, others, slices, with_fields
from netloom.session import cut_lineage, write_table

SHINGLE, SEED, DISTANCE = 4, 42, 4
SEGMENTS = (13, 13, 13, 13, 12)
BLOCK = 2048
_ALL = (1 << 64) - 1


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Bits set in more than half of the shingles' hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter([one(whole[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Adds ``fp`` (the fingerprint as a signed long)."""

    @F.arrow_udf("fp long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made = np.array([fingerprint(t, shingle) for part in slices(batch) for t in as_bytes(part)], np.uint64)
            yield pa.StructArray.from_arrays([pa.array(made.view(np.int64))], names=["fp"])
        give_back()

    return with_fields(docs, run(F.col(text)), ["fp"])


def _ring() -> list[int]:
    """Mask of each segment."""
    out, at = [], 0
    for size in SEGMENTS:
        out.append(((1 << size) - 1) << at)
        at += size
    return out


def _halves(mask: int) -> tuple[int, int]:
    bits = [i for i in range(64) if mask >> i & 1]
    low = sum(1 << i for i in bits[:(len(bits) + 1) // 2])
    return low, mask ^ low


def key_masks() -> list[tuple[int, int]]:
    """(start segment, bits of the key) of each kind of key."""
    ring, out = _ring(), []
    for start in range(len(ring)):
        second = _halves(ring[(start + 1) % len(ring)])
        third = _halves(ring[(start + 2) % len(ring)])
        pairs = [p for p in combinations(second + third, 2) if p[0] in second or p[1] in second]
        out += [(start, ring[start] | a | b) for a, b in pairs]
    return out


def keeps_budgets(differ: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether chains from ``start`` stay within their budgets, segment by segment round the ring."""
    masks = np.array(_ring(), np.uint64)
    total, ok = np.zeros(len(differ), np.int64), np.ones(len(differ), bool)
    for step in range(len(masks)):
        total += np.bitwise_count(differ & masks[(start + step) % len(masks)])
        ok &= total <= (step + 1) * DISTANCE // len(masks)
    return ok


def _forest(group: np.ndarray, side: np.ndarray, fp: np.ndarray, start: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of sorted groups; pairs of one side only count where both sides are one."""
    n = len(fp)
    label, out = np.arange(n), []

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    at = np.arange(n)
    for gap in range(1, n):
        at = at[at + gap < n]
        at = at[group[at] == group[at + gap]]
        if not len(at):
            break
        ask = at[(label[at] != label[at + gap]) & ((side[at] != side[at + gap]) | (side[at] == 2))]
        differ = fp[ask] ^ fp[ask + gap]
        ok = keeps_budgets(differ, start[ask])
        ask, differ = ask[ok], differ[ok]
        ask = ask[np.bitwise_count(differ) <= DISTANCE]
        for i in ask.tolist():
            a, b = root(i), root(i + gap)
            if a != b:
                label[max(a, b)] = min(a, b)
                out.append((i, i + gap))
        if len(ask):
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return out


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by group; a group that goes on in the next batch waits for its rest."""
    starts = np.array([s for s, _ in key_masks()])

    def links(frame: pd.DataFrame) -> pa.RecordBatch:
        group = frame.groupby(["kind", "key", "i", "j"], sort=False).ngroup().to_numpy()
        fp = frame["fp"].to_numpy().astype(np.int64).view(np.uint64)
        side = np.where(frame["i"] == frame["j"], 2, frame["block"] == frame["j"]).astype(np.int64)
        found = np.array(_forest(group, side, fp, starts[frame["kind"].to_numpy()]), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(fp[found[:, k]].view(np.int64)) for k in (0, 1)], names=["a", "b"])

    rest = None
    for batch in batches:
        frame = batch.to_pandas()
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if frame.empty:
            continue
        same = (frame[["kind", "key", "i", "j"]] == frame[["kind", "key", "i", "j"]].iloc[-1]).all(axis=1).to_numpy()
        cut = len(frame) - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = frame.iloc[cut:].reset_index(drop=True)
        if cut:
            yield links(frame.iloc[:cut].reset_index(drop=True))
    if rest is not None and len(rest):
        yield links(rest)
    give_back()


def fingerprint_links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join the same components as all links do."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key"))
                      for i, (_, m) in enumerate(key_masks())])
    keys = distinct.select("fp", F.explode(kinds).alias("k")).select("fp", "k.kind", "k.key")
    held = keys.groupBy("kind", "key").count().where("count > 1")
    shared = keys.join(held, ["kind", "key"])
    blocks = F.ceil(F.col("count") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    split = shared.select("kind", "key", "fp", own.alias("block"), blocks.alias("blocks"))
    pairs = split.select("kind", "key", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    groups = pairs.select("kind", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                          "block", "fp")
    sorted_groups = groups.repartition("kind", "key", "i", "j").sortWithinPartitions("kind", "key", "i", "j", "fp")
    return sorted_groups.mapInArrow(_link_groups, "a long, b long")


def _components(docs: DataFrame, text: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and of every fingerprint its component's fingerprint and smallest doc_id."""
    rows = cut_lineage(with_fingerprints(docs.select("doc_id", F.col(text).alias("text")), "text", shingle).drop("text"))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(fingerprint_links(distinct.select("fp")), "a", "b")
    of = distinct.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    named = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows, cut_lineage(of.join(named, "component").select("fp", "component", "component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fp, component_id."""
    rows, of = _components(docs, text, shingle)
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest doc_id.

    A null doc_id is larger than any other.  Of rows with equal doc_id in one
    component, any one stays.
    """
    rows, of = _components(docs, text, shingle)
    found = rows.join(of, "fp")
    heads = found.where("doc_id <=> component_id").select("doc_id").distinct()
    every = rows.groupBy("doc_id").agg(F.count("*").alias("rows"))
    ids = cut_lineage(heads.join(every.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id"))).select(
        "id", (F.col("rows") > 1).alias("doubtful")))
    mark = free_name(docs, "kept_id")
    ids = ids.withColumnRenamed("id", mark)
    kept = docs.join(ids.where("not doubtful"), F.col("doc_id").eqNullSafe(F.col(mark)), "left_semi").select(*others(docs))
    doubtful = ids.where("doubtful")
    if doubtful.isEmpty():
        return kept
    # one id on several rows: told apart by their fingerprints
    rest = write_table(docs.join(doubtful, F.col("doc_id").eqNullSafe(F.col(mark)), "left_semi").select(
        F.struct(*others(docs)).alias("row"), F.col(text).alias("text")))
    printed = with_fingerprints(rest, "text", shingle)
    once = printed.join(of, "fp").where("row.doc_id <=> component_id").dropDuplicates(["component"])
    return kept.unionByName(once.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
