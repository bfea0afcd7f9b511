"""Suffix dedup: removes every byte of a 400-byte string that starts anywhere else too.

Whole texts are parsed at anchors chosen by content: of the 301 strings of 100
bytes in a window of 400, the one with the least hash.  Equal windows have their
anchor at the same place, so every repeat is a repeat of an anchor with equal
surroundings, and only suffixes at anchors (one in about 150) take part in the
sort; what holds for the windows around an anchor is induced from it.

1. Each text gives its anchors, with the range of windows they stand for and a
   hash of all bytes these windows cover (the surroundings).
2. Anchors are grouped by hash.  Surroundings that occur twice are repeated as a
   whole.  Others of the group are compared window by window: their bytes go to
   the group's shard, which Spark's external sort puts in order on disk, and
   equal 128-bit window hashes of one group are repeats.
3. The ranges of repeated windows are collected per text and cut out.

A group with many different surroundings is split by the windows' distance from
the anchor, so that each part holds about ``PART`` windows.  Texts are named by
a 128-bit hash, so copies are compared once and each copy is cut.

A task holds one Arrow batch and, as Python objects, ``HELD`` bytes of its text;
texts without a repeat are not sent to Python to be cut.

Cases: null counts as empty; texts under 400 bytes lose nothing; a repeat may
overlap itself; equal texts of 400 bytes or more lose everything; repeated
doc_ids and null ones keep their rows; input columns named like an output column
give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.exact_dedup import may_repeat
from netloom.llm.minhash import MAX_FILTER_BITS, filter_of
from netloom.llm.texts import as_bytes, frame, free_name, give_back, others, runs_of_bytes
from netloom.session import write_table

LENGTH, GRAM = 400, 100
WINDOW = LENGTH - GRAM + 1
STRETCH = 1 << 16  # windows of one text handled at a time
PART = 3_000_000
HELD = 1 << 20  # bytes of text held as Python objects at a time, and of surroundings given out at a time
_PLACE = np.uint64((1 << 17) - 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Hasher:
    """Hashes of substrings of a byte string by differences of one running sum."""

    def __init__(self, seed: int, base: int, size: int = STRETCH + LENGTH + 1):
        self.values = np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.base, self.up, self.down = base, np.empty(0, np.uint64), np.empty(0, np.uint64)
        self._grow(size)

    def _grow(self, size: int) -> None:
        if len(self.up) < size:
            for name, factor in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                powers = np.full(size, factor, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def sums(self, text: np.ndarray) -> np.ndarray:
        self._grow(len(text) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[text] * self.up[:len(text)], dtype=np.uint64)])

    def between(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (sums[end] - sums[begin]) * self.down[begin]
        x ^= x >> np.uint64(32)
        x *= _MIX
        return x ^ (x >> np.uint64(29))


_hashers: list[Hasher] = []


def hashers() -> list[Hasher]:
    """Two independent hashers, made once per Python worker."""
    if not _hashers:
        _hashers.extend([Hasher(11, 0x9E3779B97F4A7C15), Hasher(12, 0xC2B2AE3D27D4EB4F)])
    return _hashers


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n - width + 1], before[width - 1:n])


def anchors(text: bytes) -> list[np.ndarray]:
    """Columns anchor hash, place, first and last window, hash of the surroundings."""
    found = []
    hasher = hashers()[0]
    for start in range(0, len(text) - LENGTH + 1, STRETCH):
        part = np.frombuffer(text[start:start + STRETCH + LENGTH - 1], np.uint8)
        sums = hasher.sums(part)
        grams = len(part) - GRAM + 1
        places = np.arange(grams)
        hashes = hasher.between(sums, places, places + GRAM)
        least = sliding_min((hashes & ~_PLACE) | places.astype(np.uint64), WINDOW)
        at = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        around = hasher.between(sums, first, last + LENGTH)
        found.append((hashes[at[first]].view(np.int64), at[first] + start, first + start, last + start, around.view(np.int64)))
    return [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 5


_OCCURRENCE = "id {}, name binary, anchor long, place long, first long, last long, around long"


def _name(text: Column) -> Column:
    """128-bit name of a text, made in the JVM."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, length in runs_of_bytes(batch["t"], HELD):
            piece = batch.slice(start, length)
            made = [anchors(t) if t else anchors(b"") for t in as_bytes(piece["t"])]
            rows = pa.array(np.repeat(np.arange(length), [len(columns[0]) for columns in made]))
            yield pa.RecordBatch.from_arrays(
                [piece["id"].take(rows), piece["name"].take(rows), *[pa.array(np.concatenate(c), pa.int64()) for c in zip(*made)]],
                names=["id", "name", "anchor", "place", "first", "last", "around"])
    give_back()


_AROUND = pa.schema([("anchor", pa.int64()), ("part", pa.int32()), ("name", pa.binary()), ("low", pa.int64()),
                     ("whole", pa.bool_()), ("bytes", pa.binary())])


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes around the asked anchors of a text, once for each part of the group."""
    for batch in batches:
        out, held = [], 0
        for start, length in runs_of_bytes(batch["t"], HELD):
            piece = batch.slice(start, length)
            for name, text, asked in zip(piece["name"].to_pylist(), as_bytes(piece["t"]), piece["asked"]):
                for a in asked.as_py():
                    step = -(-WINDOW // a["parts"])
                    for part in range(a["parts"]):
                        # windows whose anchor is part * step bytes or more after their start, and less than the next
                        low = max(a["first"], a["place"] - (part + 1) * step + 1)
                        high = min(a["last"], a["place"] - part * step)
                        if low <= high:
                            out.append((a["anchor"], part, name, low, a["whole"], text[low:high + LENGTH]))
                            held += high + LENGTH - low
                    if held > HELD:
                        yield frame(out, _AROUND)
                        out, held = [], 0
        yield frame(out, _AROUND)
    give_back()


def _window_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and two hashes of every window of the texts."""
    rows, one, two = [], [], []
    for at in range(0, len(texts), 64):
        part = texts[at:at + 64]
        whole = np.frombuffer(b"".join(part), np.uint8)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        counts = sizes - LENGTH + 1
        begin = np.arange(counts.sum()) + np.repeat(np.cumsum(sizes) - sizes - np.cumsum(counts) + counts, counts)
        rows.append(np.repeat(np.arange(at, at + len(part)), counts))
        for hasher, out in zip(hashers(), (one, two)):
            out.append(hasher.between(hasher.sums(whole), begin, begin + LENGTH))
    return np.concatenate(rows), np.concatenate(one), np.concatenate(two)


def _repeated(frame: pa.Table) -> pa.RecordBatch:
    """Ranges of windows that two rows or places of the table share."""
    texts, lows, names, whole = (frame[c].to_pylist() for c in ("bytes", "low", "name", "whole"))
    rows, one, two = _window_hashes(texts)
    order = np.argsort(one)
    same = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    hit = np.zeros(len(one), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    hit &= ~np.array(whole, bool)[rows]  # those are known to be repeated
    starts = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1])
    window = np.arange(len(rows)) - starts[rows]
    at = np.flatnonzero(hit)
    new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(rows[at]) != 0)]) if len(at) else np.empty(0, bool)
    first = at[new]
    last = at[np.concatenate([new[1:], [True]])] if len(at) else at
    low = np.array(lows, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array([names[r] for r in rows[first]], pa.binary()), pa.array(low[rows[first]] + window[first]),
         pa.array(low[rows[last]] + window[last])], names=["name", "first", "last"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats within each (anchor, part) of sorted rows; a group waits for its rest in the next batch."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        anchor, part = table["anchor"].to_numpy(), table["part"].to_numpy()
        edges = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
        at = 0
        for i, edge in enumerate(edges):
            if edge - at >= 1024 or i + 1 == len(edges):
                yield _repeated(table.slice(at, edge - at))
                at = int(edge)
        rest = table.slice(at).combine_chunks()
    if rest is not None and rest.num_rows:
        yield _repeated(rest)
    give_back()


def repeated_windows(docs: DataFrame, text: str = "text", identity: str = "doc_id") -> DataFrame:
    """name (128-bit hash of a text), first and last start of its repeated 400-byte strings."""
    source = docs.select(F.col(identity).alias("id"), F.col(text).alias("t")).where(
        F.octet_length("t") >= LENGTH).withColumn("name", _name(F.col("t")))
    kind = source.schema["id"].dataType.simpleString()
    seen = write_table(source.mapInArrow(_occurrences, _OCCURRENCE.format(kind)))
    around = seen.groupBy("anchor", "around").agg(
        F.count("*").alias("n"), F.min(F.struct("name", "id", "place", "first", "last")).alias("one"))
    group = around.groupBy("anchor").agg(
        F.sum("n").alias("total"), F.count("*").alias("kinds"), F.count(F.when(F.col("n") == 1, 1)).alias("single"))
    known = write_table(around.join(group.where("total > 1"), "anchor"))
    whole = seen.join(known.where("n > 1").select("anchor", "around"), ["anchor", "around"]).select("name", "first", "last")
    parts = F.least(F.lit(WINDOW), F.ceil(F.col("kinds") * WINDOW / F.lit(PART))).cast("int")
    asked = write_table(known.where("kinds > 1 and single > 0").select(
        "one.name", "one.id", F.struct("anchor", "one.place", "one.first", "one.last", parts.alias("parts"),
                                       (F.col("n") > 1).alias("whole")).alias("asked")).groupBy("name", "id").agg(
        F.collect_list("asked").alias("asked")))

    # a Bloom filter of the asked texts, so that few others are shuffled; the join decides
    table, bits = filter_of(asked.select(F.xxhash64("name", "id").alias("h")), MAX_FILTER_BITS)
    asks = may_repeat(docs.sparkSession, table, bits)
    source = source.where(asks(F.xxhash64("name", "id")))

    asked = asked.withColumnRenamed("id", "asked_id").withColumnRenamed("name", "asked_name")
    joined = source.join(asked, (F.col("name") == F.col("asked_name")) & F.col("id").eqNullSafe(F.col("asked_id")))
    bytes_of = joined.select("name", "t", "asked").mapInArrow(
        _surroundings, "anchor long, part int, name binary, low long, whole boolean, bytes binary")
    compared = bytes_of.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(
        _compare, "name binary, first long, last long")
    return whole.distinct().unionByName(compared)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte runs covered by the 400-byte strings of the ranges of starts."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + LENGTH))
        else:
            out.append((first, last + LENGTH))
    return out


def _cut_piece(texts: pa.Array, ranges: pa.Array) -> pa.StructArray:
    kept, removed, spans = [], [], []
    for text, found in zip(as_bytes(texts), ranges.to_pylist()):
        text = text or b""
        runs = merged([(r["first"], r["last"]) for r in found or ()])
        at, parts = 0, []
        for begin, end in runs:
            parts.append(text[at:begin])
            at = end
        kept.append(b"".join([*parts, text[at:]]))
        removed.append(len(text) - len(kept[-1]))
        spans.append(len(runs))
    return pa.StructArray.from_arrays(
        [pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
        names=["n_removed", "n_spans", "kept"])


def _cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, ranges in batches:
        for start, length in runs_of_bytes(texts, HELD):
            yield _cut_piece(texts.slice(start, length), ranges.slice(start, length))
    give_back()


def cut_repeats(docs: DataFrame, text: str = "text", identity: str = "doc_id") -> DataFrame:
    """Adds n_bytes, n_removed, n_spans and kept (the bytes that stay, binary) to every document."""
    found = write_table(repeated_windows(docs, text, identity).groupBy("name").agg(
        F.collect_list(F.struct("first", "last")).alias("ranges")))
    name, ranges, result = (free_name(docs, n) for n in ("name_of_text", "ranges_of_text", "cut_text"))
    named = docs.withColumn(name, _name(F.col(text)))
    joined = named.join(found.select(F.col("name").alias(name), F.col("ranges").alias(ranges)), name, "left")
    cut = F.arrow_udf(_cut, "n_removed long, n_spans long, kept binary")
    repeats = F.col(ranges).isNotNull()
    made = joined.withColumn(result, cut(F.when(repeats, F.col(text)), F.col(ranges)))
    whole = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    none = F.lit(0).cast("long")
    fields = {"n_bytes": F.octet_length(whole).cast("long")} | {
        f: F.when(repeats, F.col(result)[f]).otherwise(alone) for f, alone in (("n_removed", none), ("n_spans", none), ("kept", whole))}
    return made.select(*others(docs, *fields), *[c.alias(f) for f, c in fields.items()])
