"""Benchmark decontamination by an FM-index per shard of documents.

Documents become words; every run of a task's documents (about ``SHARD_WORDS``
words) is one shard.  Its text over the phrases' alphabet - words that no phrase
has are a separator, since no phrase can cross them - gets a Burrows-Wheeler
transform in a wavelet matrix.  All phrases are searched backward together;
rows of their ranges walk back to sampled suffix positions, and the located
spans are merged per document.

The phrases are read in blocks of at most ``BLOCK_BYTES`` of text, one pass over
the documents for each block, so what is broadcast is bounded.  With one block
nothing shuffles; with more, the spans and items of hit documents are merged.

Cases: a null or empty text has no words; an item without words has no window;
an empty benchmark marks nothing; equal windows of several items count for each;
items with a null id hit like any other, count as one item and add nothing to the
digest of ids; items with a null text have no window;
repeated rows and ids stay rows of their own; input columns named like an output
column give way.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.texts import as_bytes, free_name, give_back, others, quoted, with_fields
from netloom.session import cut_lineage

WINDOW = 10
SHARD_WORDS = 400_000
SAMPLE = 8  # every so many-th text position is kept
BLOCK_BYTES = 8 << 20
# Bytes outside a-z, 0-9 and non-ASCII part words; A-Z become a-z.
_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b > 127
               else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def _sorted(items: set[str | None]) -> list[str | None]:
    """Items in order; one without an id comes last."""
    return sorted(items, key=lambda x: (x is None, x or ""))


class Phrases:
    """Windows of benchmark items as words of one alphabet."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW):
        self.alphabet: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            ids = [self.alphabet.setdefault(w, len(self.alphabet) + 2) for w in words_of(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                owners[tuple(ids[i:i + size])].add(None if item is None else str(item))
        self.windows = list(owners)
        self.items = [_sorted(owners[w]) for w in self.windows]
        self.sizes = np.array([len(w) for w in self.windows], np.int64)
        self.table = np.zeros((len(self.windows), max(self.sizes, default=0)), np.int64)
        for row, w in zip(self.table, self.windows):
            row[len(row) - len(w):] = w  # ends are aligned: search goes backward

    @property
    def shortest(self) -> int:
        return int(self.sizes.min()) if len(self.sizes) else 0


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; only suffixes not yet told apart are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while step < n:
        last = np.concatenate([head[1:], [True]])
        open_ = np.flatnonzero(~(head & last))  # places of groups with two suffixes or more
        if not len(open_):
            break
        at = order[open_]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        inner = np.lexsort((after, rank[at]))
        order[open_], after = at[inner], after[inner]
        group = rank[at[inner]]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        head[open_] = new
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        step *= 2
    return order


class Wavelet:
    """Wavelet matrix: access and rank for arrays of positions."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.levels, self.zeros, self.counts = max(1, int(symbols - 1).bit_length()), [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (text >> level) & 1
            ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)])
            self.counts.append(ones)
            self.zeros.append(len(text) - int(ones[-1]))
            text = np.concatenate([text[bit == 0], text[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``at``."""
        begin, end = np.zeros_like(at), at
        for i, (ones, zeros) in enumerate(zip(self.counts, self.zeros)):
            one = (symbol >> (self.levels - 1 - i)) & 1 == 1
            a, b = ones[begin], ones[end]
            begin, end = np.where(one, zeros + a, begin - a), np.where(one, zeros + b, end - b)
        return end - begin

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at a place and how often it stands before it."""
        symbol, begin, end = np.zeros_like(at), np.zeros_like(at), at
        for ones, zeros in zip(self.counts, self.zeros):
            one = ones[end + 1] - ones[end] == 1
            symbol = symbol << 1 | one
            a, b = ones[begin], ones[end]
            begin, end = np.where(one, zeros + a, begin - a), np.where(one, zeros + b, end - b)
        return symbol, end - begin


class FMIndex:
    """Index of one shard's text; it ends with 0, which stands nowhere else."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        order = suffix_order(text)
        self.size, self.before = len(text), np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.bwt = Wavelet(text[order - 1], symbols)  # before the first symbol stands the last
        self.marked = order % sample == 0
        self.marks = np.concatenate([[0], np.cumsum(self.marked)])
        self.sampled = order[self.marked]

    def search(self, table: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows that start with each phrase; phrases end at the table's last column."""
        begin, end = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.size, np.int64)
        on = np.arange(len(sizes))
        for back in range(1, table.shape[1] + 1):
            on = on[(sizes[on] >= back) & (begin[on] < end[on])]
            if not len(on):
                break
            symbol = table[on, -back]
            begin[on] = self.before[symbol] + self.bwt.rank(symbol, begin[on])
            end[on] = self.before[symbol] + self.bwt.rank(symbol, end[on])
        return begin, end

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: back through the transform to the next kept position."""
        out, steps, at, on = np.empty_like(rows), 0, rows.copy(), np.arange(len(rows))
        while len(on):
            kept = self.marked[at]
            out[on[kept]] = (self.sampled[self.marks[at[kept]]] + steps) % self.size
            on, at = on[~kept], at[~kept]
            symbol, before = self.bwt.step(at)
            at, steps = self.before[symbol] + before, steps + 1
        return out


def _shard(ids: list[np.ndarray], phrases: Phrases) -> list[tuple[np.ndarray, list[str]]]:
    """Hit spans (n x 2 word numbers, merged) and hit items of each document of a shard."""
    starts = np.cumsum([0] + [len(x) + 1 for x in ids])
    whole = np.zeros(starts[-1] + 1, np.int64)
    for start, x in zip(starts, ids):
        whole[start:start + len(x)] = x
    # runs of alphabet words long enough for a phrase, each after one separator
    edge = np.diff(np.concatenate([[0], (whole > 0).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    none = (np.empty((0, 2), np.int64), [])
    if not len(begin):
        return [none] * len(ids)
    sizes = end - begin + 1
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - begin + 1, sizes)  # position in ``whole``
    text = whole[np.maximum(place, 0)]
    text[np.cumsum(sizes) - sizes] = 1  # parts the runs
    index = FMIndex(np.append(text, 0), len(phrases.alphabet) + 2)
    low, high = index.search(phrases.table, phrases.sizes)
    count = np.maximum(high - low, 0)
    if not count.sum():
        return [none] * len(ids)
    phrase = np.repeat(np.arange(len(count)), count)
    rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count)
    at = place[index.locate(rows)]
    doc = np.searchsorted(starts, at, "right") - 1
    order = np.lexsort((at, doc))
    at, doc, phrase = at[order], doc[order], phrase[order]
    stop = at + phrases.sizes[phrase]
    out, cuts = [none] * len(ids), np.searchsorted(doc, np.arange(len(ids) + 1))
    for d in np.unique(doc):
        part = slice(cuts[d], cuts[d + 1])
        a, b = at[part] - starts[d], np.maximum.accumulate(stop[part] - starts[d])
        new = np.concatenate([[True], a[1:] > b[:-1]])
        spans = np.stack([a[new], b[np.concatenate([new[1:], [True]])]], 1)
        items = _sorted({x for p in np.unique(phrase[part]) for x in phrases.items[p]})
        out[d] = (spans, items)
    return out


_FIELDS = ["n_words", "spans", "items"]
_TYPE = "n_words long, spans array<struct<begin: int, stop: int>>, items array<string>"


def _search(shared) -> object:
    @F.arrow_udf(_TYPE)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = _search_batch(as_bytes(batch), shared.value)
            spans = [[{"begin": int(a), "stop": int(b)} for a, b in s] for _, s, _ in found]
            yield pa.StructArray.from_arrays([
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())]))),
                pa.array([i for _, _, i in found], pa.list_(pa.string()))], names=_FIELDS)

    return run


def _search_batch(texts: list[bytes | None], phrases: Phrases) -> list[tuple[int, np.ndarray, list[str]]]:
    """Words, spans and items of each text; the texts are indexed shard by shard."""
    known, counts, found, ids, size = phrases.alphabet.get, [], [], [], 0
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        ids.append(np.fromiter(map(known, words, [0] * len(words)), np.int64, len(words)))
        size += len(words)
        if size > SHARD_WORDS:
            found += _shard(ids, phrases)
            ids, size = [], 0
    found += _shard(ids, phrases) if ids else []
    return [(n, *f) for n, f in zip(counts, found)]


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[Phrases]:
    """The items as blocks of bounded size, read one after the other."""
    rows = benchmark.select(quoted(item).alias("i"), quoted(text).alias("t")).where("t is not null")
    part, size = [], 0
    for row in rows.toLocalIterator():
        part.append((row["i"], row["t"].encode()))
        size += len(row["t"])
        if size > block_bytes:
            yield Phrases(part)
            part, size = [], 0
    yield Phrases(part)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                  item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, spans (merged word ranges to be removed) and items (sorted) to every document."""
    spark, found = docs.sparkSession, None
    blocks = [spark.sparkContext.broadcast(p) for p in _blocks(benchmark, item, item_text, block_bytes)]
    if len(blocks) == 1:
        return with_fields(docs, _search(blocks[0])(F.col(text)), _FIELDS)
    # several blocks: one pass each; rows are told apart by a number kept in a written table
    keep = others(docs, *_FIELDS)
    rows = cut_lineage(docs.select(*keep, F.monotonically_increasing_id().alias("row_of_overlap")))
    for block in blocks:
        part = with_fields(rows.select("row_of_overlap", F.col(text).alias("t")), _search(block)(F.col("t")), _FIELDS)
        part = part.select("row_of_overlap", *_FIELDS)
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("row_of_overlap").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.join(merged, "row_of_overlap").select(
        *keep, "n_words", F.arrow_udf(_merge, "array<struct<begin: int, stop: int>>")(F.array_sort("spans")).alias("spans"), "items")


def _merge(column: pa.Array) -> pa.Array:
    out = []
    for spans in column.to_pylist():
        kept = []
        for s in spans or ():
            if kept and s["begin"] <= kept[-1]["stop"]:
                kept[-1]["stop"] = max(kept[-1]["stop"], s["stop"])
            else:
                kept.append(dict(s))
        out.append(kept)
    return pa.array(out, column.type)


def judged(overlaps: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from spans and items."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["begin"])
    return overlaps.select(
        *others(overlaps, "n_hit", "n_items", "items_sha256", "contaminated"), n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def cut_words(text: bytes | None, spans) -> bytes | None:
    """The text without the words of its spans (pairs of first word and the one after the last)."""
    if text is None or not len(spans):
        return text
    clean = np.frombuffer(text.translate(_WORDS), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], clean.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    parts, at = [], 0
    for first, stop in spans:
        parts.append(text[at:begin[first]])
        at = end[stop - 1]
    return b"".join([*parts, text[at:]])


def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    cut = [cut_words(t, [(s["begin"], s["stop"]) for s in c or ()]) for t, c in zip(as_bytes(texts), spans.to_pylist())]
    return pa.array(cut, pa.binary()).cast(pa.string())


def remove_overlaps(overlaps: DataFrame, text: str = "text") -> DataFrame:
    """The documents of ``find_overlaps`` with the words of their spans cut out of the text."""
    return overlaps.withColumn(text, F.arrow_udf(_without, "string")(F.col(text), F.col("spans")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                    item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all of them, without the words of benchmark passages."""
    blocks = _blocks(benchmark, item, item_text, block_bytes)
    first = next(blocks)
    if next(blocks, None) is not None:
        return remove_overlaps(find_overlaps(docs, benchmark, text, item, item_text, block_bytes), text).select(*others(docs))
    # one block: found and cut in one step, so one Python worker a task
    shared, name = docs.sparkSession.sparkContext.broadcast(first), free_name(docs, "cut_text")

    @F.arrow_udf("string")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = as_bytes(batch)
            found = [spans for _, spans, _ in _search_batch(texts, shared.value)]
            out = [None if not len(s) else cut_words(t, s.tolist()) for t, s in zip(texts, found)]
            yield pa.array(out, pa.binary()).cast(pa.string())
        give_back()

    cleaned = docs.select(*others(docs), cut(F.col(text)).alias(name))
    return cleaned.withColumn(text, F.coalesce(name, text)).select(*others(docs))
