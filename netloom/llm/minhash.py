"""MinHash near-dedup with b-bit signatures.

A document's set is that of its hashed five-word shingles.  ``BANDS`` times
``ROWS`` hash functions give its minima; the minima of a band, hashed, are a band
key, and of every minimum the low ``BITS`` bits stay, packed into a signature.
Documents that share a band key are candidates.  Two signatures agree in a
position by chance once in 2**BITS, so from the share of equal positions, counted
by bit operations, the similarity is estimated as (share - chance) / (1 - chance);
a candidate goes on if the estimate is at most ``SLACK`` below the threshold (six
standard errors; a pair at the threshold shares no key once in 10**8).

Equal sets become one set first.  Under a band key only links of a spanning forest
are given out, and a key with many sets is split into blocks, each pair of blocks
a group of its own.  What such links join is a neighbourhood: any two sets similar
enough are in the same one.  In a neighbourhood the full sets meet, in blocks of
bounded size, and links are those pairs whose exact overlap is large enough;
again only a spanning forest is given out, which joins what all links join.

Texts are not shuffled.  The full sets of documents in a neighbourhood are made in
a second pass over the texts, past a Bloom filter of their ids.

Cases: a document without words, or with a null text, has the empty set and is
linked with nothing; fewer than five words are one shingle; rows repeated under
one doc_id are rows of their own; a null doc_id never names a component that has
another; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.components import components
from netloom.llm.texts import as_bytes, slices
from netloom.session import cut_lineage, write_table

SHINGLE, PERCENT = 5, 85
BANDS, ROWS, BITS = 32, 5, 4
SLACK = 0.17
BLOCK, BLOCK_SHINGLES = 1024, 500_000  # sets, and shingles of them, in a block
FILTER_BITS, MAX_FILTER_BITS = 16, 1 << 28  # a document in a neighbourhood, and in all (32 MB)
WORD_STORE = 100_000
_DRAWN = np.random.default_rng(13)
_PLACES = _DRAWN.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_FACTORS = _DRAWN.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_ADDED = _DRAWN.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_LOW_BITS = np.uint64(0x1111111111111111)


class _Words(dict):
    """Hashes of words; bounded."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= WORD_STORE:
                self.clear()
            self[word] = found
        return found


def shingle_set(text: bytes | None, words: dict, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles."""
    cut = (text or b"").lower().split()
    if not cut:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(words.__getitem__, cut), np.uint64, len(cut))
    size = min(shingle, len(each))
    mixed = np.full(len(each) - size + 1, size, np.uint64)
    for i in range(size):
        mixed += each[i:len(each) - size + 1 + i] * _PLACES[i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def minima(shingles: np.ndarray) -> np.ndarray:
    """Least value of each hash function."""
    low, least = (shingles >> np.uint64(32)).astype(np.uint32)[:, None], np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(least, (low[at:at + 1024] * _FACTORS + _ADDED).min(0), out=least)
    return least


def signature(least: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Band keys, and the low bits of the (mixed) minima packed together."""
    keys = [xxhash.xxh64_intdigest(least[i * ROWS:(i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    mixed = least ^ (least >> np.uint32(16))
    mixed = (mixed * np.uint32(0x85EBCA6B)) >> np.uint32(28)
    return np.array(keys, np.uint64).view(np.int64), (mixed[::2] | mixed[1::2] << np.uint32(4)).astype(np.uint8).tobytes()


_SIGNED = "doc_id long, n_shingles long, digest binary, keys array<long>, packed binary"


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        at = 0
        for part in slices(batch.column(1), 1024):
            sizes, digests, keys, packed = [], [], [], []
            for text in as_bytes(part):
                shingles = shingle_set(text, words)
                sizes.append(len(shingles))
                made = signature(minima(shingles)) if len(shingles) else (None, None)
                digests.append(_digest(shingles) if len(shingles) else None)
                keys.append(made[0])
                packed.append(made[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(sizes)), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "keys", "packed"])
            at += len(sizes)


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions in which packed signatures (rows of 64-bit words) differ."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & _LOW_BITS).sum(1, dtype=np.int64)


def estimate(differ: np.ndarray) -> np.ndarray:
    """Similarity from the number of different positions, corrected for chance."""
    chance = 0.5 ** BITS
    return (1 - differ / (BANDS * ROWS) - chance) / (1 - chance)


def _root(label: np.ndarray, i: int) -> int:
    while label[i] != i:
        label[i] = label[label[i]]
        i = label[i]
    return i


def _union(label: np.ndarray, pairs) -> list[tuple[int, int]]:
    """Joins the pairs; those that joined something."""
    joined = []
    for i, j in pairs:
        a, b = _root(label, i), _root(label, j)
        if a != b:
            label[max(a, b)] = min(a, b)
            joined.append((i, j))
    return joined


def _flat(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def candidate_links(group: np.ndarray, side: np.ndarray, size: np.ndarray, words: np.ndarray,
                    percent: int) -> list[tuple[int, int]]:
    """Spanning links of sorted groups by estimate; ``side`` 2 marks groups of one block."""
    label, out, at = np.arange(len(group)), [], np.arange(len(group))
    for gap in range(1, len(group)):
        at = at[at + gap < len(group)]
        at = at[group[at] == group[at + gap]]
        if not len(at):
            break
        ask = at[(label[at] != label[at + gap]) & ((side[at] != side[at + gap]) | (side[at] == 2))]
        small, large = np.minimum(size[ask], size[ask + gap]), np.maximum(size[ask], size[ask + gap])
        ask = ask[100 * small >= percent * large]
        ask = ask[estimate(unlike(words[ask], words[ask + gap])) >= percent / 100 - SLACK]
        if len(ask):
            out += _union(label, zip(ask.tolist(), (ask + gap).tolist()))
            label = _flat(label)
    return out


def exact_links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning links between sets whose overlap is large enough, counted in full."""
    n, label, out = len(sets), np.arange(len(sets)), []
    size = np.array([len(s) for s in sets], np.int64)
    values, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1  # shingles of one set only overlap with nothing
    width = int((times > 1).sum())
    bits, ends = np.zeros((n, -(-width // 64)), np.uint64), np.cumsum(size)
    for i in range(n):
        own = where[ends[i] - size[i]:ends[i]]
        row = np.zeros(bits.shape[1] * 64, bool)
        row[column[own[times[own] > 1]]] = True
        bits[i] = np.packbits(row, bitorder="little").view(np.uint64)
    for i in range(n - 1):
        later = np.arange(i + 1, n)
        ask = later[(label[later] != label[i]) & ((side[later] != side[i]) | (side[i] == 2))]
        small, large = np.minimum(size[ask], size[i]), np.maximum(size[ask], size[i])
        ask = ask[100 * small >= percent * large]
        for part in np.array_split(ask, -(-len(ask) * max(bits.shape[1], 1) // (1 << 22)) or 1):
            both = np.bitwise_count(bits[part] & bits[i]).sum(1, dtype=np.int64)
            hit = part[100 * both >= percent * (size[part] + size[i] - both)]
            if len(hit):
                out += _union(label, ((i, j) for j in hit.tolist()))
        label = _flat(label)
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group ends; rows come sorted by ``keys``."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        same = np.ones(table.num_rows, bool)
        for k in keys:
            values = table[k].to_numpy()
            same &= values == values[-1]
        cut = 0 if same.all() else table.num_rows - int(np.argmin(same[::-1]))
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


_GROUP = ["key", "i", "j"]


def _group_numbers(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    for k in _GROUP:
        values = table[k].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def _sides(table: pa.Table) -> np.ndarray:
    i, j, block = (table[c].to_numpy() for c in ("i", "j", "block"))
    return np.where(i == j, 2, block == j)


def _links(digests: list[bytes], found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([digests[pair[k]] for pair in found], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _candidates(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, _GROUP):
            words = np.frombuffer(b"".join(table["packed"].to_pylist()), np.uint64).reshape(table.num_rows, -1)
            found = candidate_links(_group_numbers(table), _sides(table), table["n_shingles"].to_numpy(), words, percent)
            yield _links(table["digest"].to_pylist(), found)

    return run


def _confirmed(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (part for batch in batches for part in (batch.slice(k, 256) for k in range(0, max(batch.num_rows, 1), 256)))
        for table in _whole_groups(parts, _GROUP):
            group, sides, digests = _group_numbers(table), _sides(table), table["digest"].to_pylist()
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist()
            for at, end in zip(starts, [*starts[1:], len(group)]):
                if end - at > 1:
                    sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].slice(at, end - at).to_pylist()]
                    yield _links(digests[at:end], exact_links(sets, sides[at:end], percent))

    return run


def _grouped(rows: DataFrame, blocks) -> DataFrame:
    """Rows by (key, i, j), once for each pair of blocks that theirs is in; ``blocks`` is the number of blocks of the key."""
    own = rows.withColumn("blocks", F.greatest(blocks.cast("int"), F.lit(1))).withColumn(
        "block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = each.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return pairs.drop("other", "blocks").repartition(*_GROUP).sortWithinPartitions(*_GROUP, "digest")


def neighbourhoods(sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(digest, key): sets in one neighbourhood have one key; sets alone in theirs are left out."""
    keys = sets.select("digest", F.explode("keys").alias("key"))
    held = keys.groupBy("key").count().where("count > 1")
    met = keys.join(held, "key").join(sets.select("digest", "n_shingles", "packed"), "digest")
    groups = _grouped(met, F.ceil(F.col("count") / block)).select(*_GROUP, "block", "digest", "n_shingles", "packed")
    links = groups.mapInArrow(_candidates(percent), "a binary, b binary")
    return components(links, "a", "b").select(F.col("node").alias("digest"), F.xxhash64("component").alias("key"))


def filter_of(ids: DataFrame, max_bits: int) -> tuple[np.ndarray, int]:
    """Bloom filter of hashes (``h``), two slots an id, of at most ``max_bits`` bits."""
    bits = int(np.ceil(np.log2(min(max(ids.count() * FILTER_BITS, 1 << 12), max_bits))))
    slots = ids.select(F.explode(F.array(
        F.col("h").bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned("h", 64 - bits))).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table, bits


def full_sets(docs: DataFrame, members: DataFrame, text: str = "text", max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """(digest, shingles) of the sets of ``members`` (digest, least doc_id), from a second pass over the texts."""
    table, bits = filter_of(members.select(F.xxhash64("least").alias("h")), max_bits)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _Words(), shared.value
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            hit = np.ones(len(h), bool)
            for slot in (h & np.uint64((1 << bits) - 1), h >> np.uint64(64 - bits)):
                hit &= (seen[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
            texts = batch.column(1).take(pa.array(np.flatnonzero(hit)))
            for part in slices(texts):
                sets = [shingle_set(t, words) for t in as_bytes(part)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["digest", "shingles"])

    made = docs.select(F.xxhash64("doc_id").alias("h"), F.col(text).alias("text")).mapInArrow(
        make, "digest binary, shingles binary")
    return made.join(members.select("digest"), "digest").groupBy("digest").agg(F.min("shingles").alias("shingles"))


def near_duplicates(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = write_table(docs.mapInArrow(_sign, _SIGNED))
    full = rows.where("digest is not null")
    least = full.groupBy("digest").agg(F.min("doc_id").alias("least"))
    sets = write_table(full.dropDuplicates(["digest"]).drop("doc_id").join(least, "digest"))
    near = cut_lineage(neighbourhoods(sets, percent))
    members = write_table(near.join(sets.select("digest", "least", "n_shingles"), "digest"))
    sizes = members.groupBy("key").agg(F.count("*").alias("count"), F.sum("n_shingles").alias("shingle_sum"))
    blocks = F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(F.col("shingle_sum") / BLOCK_SHINGLES))
    met = members.select("digest", "key").join(sizes, "key").join(full_sets(docs, members), "digest")
    groups = _grouped(met, blocks).select(*_GROUP, "block", "digest", "shingles")
    linked = components(groups.mapInArrow(_confirmed(percent), "a binary, b binary"), "a", "b")
    of = linked.join(sets.select(F.col("digest").alias("node"), "least"), "node")
    named = of.groupBy("component").agg(F.min("least").alias("component_id"))
    names = cut_lineage(of.join(named, "component").select(F.col("node").alias("digest"), "component_id"))
    every = sets.select("digest", "least").join(names, "digest", "left").select(
        "digest", F.coalesce("component_id", "least").alias("component_id"))
    found = full.join(every, "digest").select("doc_id", "n_shingles", "component_id")
    empty = rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(empty).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
