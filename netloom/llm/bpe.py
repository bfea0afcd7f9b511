"""Byte-level BPE by prefix dynamic programming.

Of a piece's byte prefixes each has one valid encoding, and that encoding has one
last token.  Going left to right, the last token of prefix ``i`` is the only
vocabulary entry ``t`` that ends there and may follow the last token of prefix
``i - len(t)``: a pair of tokens is valid if merging their bytes anew would give
that same pair.  The stored last tokens give the encoding by walking back, let a
piece be extended without redoing its start, and after an edit let encoding
resume at the edited piece.

A text is first cut into pieces by the vocabulary's pattern.  If, as tried when
the pattern is given, pieces never reach over a lone blank or line break, texts
in which all white space is of that kind are cut into words and looked up in a
bounded store of words already encoded; any other text, and every text under
another pattern, is cut by the pattern as it is.

Cases: a null or empty text has no tokens; invalid UTF-8 is encoded byte by byte
after the usual replacement; very long pieces cost time in proportion to their
length; repeated rows and ids are kept as they are; input columns named like an
output column give way.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.texts import as_bytes, give_back, slices, with_fields

WORD_STORE = 200_000  # words kept while a task runs
SHARE = 1_000_000  # characters of texts encoded at a time
SHORT = 48  # pieces up to so many bytes are encoded many at a time
NO_TOKEN = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: base64 of the token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Table:
    """Whole numbers by whole numbers, asked for many at a time; open addressing."""

    def __init__(self, entries: dict[int, int]):
        self.shift = 64 - (max(len(entries), 1) * 4 - 1).bit_length()
        self.size = 1 << (64 - self.shift)
        self.keys, self.values = np.full(self.size, -1, np.int64), np.full(self.size, NO_TOKEN, np.int32)
        left = np.fromiter(entries, np.int64, len(entries))
        values = np.fromiter(entries.values(), np.int32, len(entries))
        slot = self._slots(left)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = left[put], values[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, values, slot = left[rest], values[rest], (slot[rest] + 1) % self.size

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def views(self) -> tuple[memoryview, memoryview, int, int]:
        """Keys, values, shift and mask, for lookups of one key at a time."""
        return memoryview(self.keys), memoryview(self.values), self.shift, self.size - 1

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        found, out = self.keys[slot], self.values[slot]
        on = np.flatnonzero((found != keys) & (found != -1))
        out[found != keys] = NO_TOKEN
        while len(on):
            slot[on] = (slot[on] + 1) % self.size
            found = self.keys[slot[on]]
            hit = found == keys[on]
            out[on[hit]] = self.values[slot[on[hit]]]
            on = on[~hit & (found != -1)]
        return out


def find_one(views: tuple[memoryview, memoryview, int, int], key: int) -> int:
    """The value of one key, or NO_TOKEN."""
    keys, values, shift, mask = views
    slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> shift
    while keys[slot] != key:
        if keys[slot] == -1:
            return NO_TOKEN
        slot = slot + 1 & mask
    return values[slot]


class Vocabulary:
    """Ranks with, for each token, the pair it was merged from; tables are arrays, so a worker holds little."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.left, self.right = np.arange(size), np.arange(size)
        pairs = {}
        for token, rank in ranks.items():
            parts = self._parts(token, rank)
            if len(token) > 1 and len(parts) == 2:
                a, b = ranks[parts[0]], ranks[parts[1]]
                self.left[rank], self.right[rank], pairs[a << 32 | b] = a, b, rank
        # tokens that no sequence of merges reaches; only a piece equal to one is encoded by it
        self.unreachable = {t for t, r in ranks.items() if len(t) > 1 and self.left[r] == r}
        # tokens by their bytes from the last one on: (node, byte) -> node, and the token of a node
        back, at = {}, [NO_TOKEN]
        for token, rank in ranks.items():
            node = 0
            for byte in reversed(token):
                step = node << 8 | byte
                if step not in back:
                    back[step] = len(at)
                    at.append(NO_TOKEN)
                node = back[step]
            if token not in self.unreachable:
                at[node] = rank
        self.back, self.pairs, self.at = Table(back), Table(pairs), np.array(at, np.int32)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _parts(self, token: bytes, rank: int) -> list[bytes]:
        """Parts of a token before its last merge."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(r, i) for i in range(len(parts) - 1)
                     if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None and r < rank]
            if not found:
                break
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def valid(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of ``a`` and ``b`` together gives these two tokens.

        Undoes the merges of the two tokens from the latest one on; the pair is
        invalid once two parts on both sides of the cut could have merged earlier.
        """
        pairs, lefts, rights = self.pairs.views(), memoryview(self.left), memoryview(self.right)
        bound = len(self.sizes)
        while True:
            merged = find_one(pairs, a << 32 | b)
            if merged != NO_TOKEN and merged < bound:
                return False
            if a > b and rights[a] != a:
                bound, a = a, rights[a]
            elif lefts[b] != b:
                bound, b = b + 1, lefts[b]
            elif rights[a] != a:
                bound, a = a, rights[a]
            else:
                return True

    def valid_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``valid`` for arrays of pairs."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        answer, bound, at = np.zeros(len(a), bool), np.full(len(a), len(self.sizes)), np.arange(len(a))
        while len(at):
            merged = self.pairs.get(a << 32 | b)
            on = (merged == NO_TOKEN) | (merged >= bound)
            a, b, bound, at = a[on], b[on], bound[on], at[on]
            right, left = self.right[a], self.left[b]
            undo_a = ((a > b) | (left == b)) & (right != a)
            undo_b = ~undo_a & (left != b)
            done = ~undo_a & ~undo_b
            answer[at[done]] = True
            bound = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, right, a), np.where(undo_b, left, b)
            on = ~done
            a, b, bound, at = a[on], b[on], bound[on], at[on]
        return answer

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Packed ids of many short pieces: all prefix tables are filled side by side."""
        pieces = sorted(pieces, key=len)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        widest = int(sizes[-1]) if pieces else 0
        text = np.zeros((len(pieces), widest), np.int64)
        text[np.arange(widest) < sizes[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        last = np.full((len(pieces), widest + 1), NO_TOKEN, np.int32)
        for end in range(1, widest + 1):
            rows = np.arange(np.searchsorted(sizes, end), len(pieces))
            node = np.zeros(len(rows), np.int64)
            for begin in range(end - 1, -1, -1):
                node = self.back.get(node << 8 | text[rows, begin]).astype(np.int64)
                on = node != NO_TOKEN
                rows, node = rows[on], node[on]
                token = self.at[node]
                asks = np.flatnonzero(token != NO_TOKEN)
                if begin:
                    asks = asks[self.valid_many(last[rows[asks], begin], token[asks])]
                last[rows[asks], end] = token[asks]
                on = np.ones(len(rows), bool)
                on[asks] = False
                rows, node = rows[on], node[on]
                if not len(rows):
                    break
        at, rows = sizes.copy(), np.arange(len(pieces))
        found = np.full((len(pieces), widest), NO_TOKEN, np.int32)
        count = np.zeros(len(pieces), np.int64)
        while len(rows):
            token = last[rows, at[rows]]
            found[rows, widest - 1 - count[rows]] = token
            count[rows] += 1
            at[rows] -= self.sizes[token]
            rows = rows[at[rows] > 0]
        packed, stops = found[found != NO_TOKEN].astype("<u4").tobytes(), np.cumsum(count) * 4
        begins = stops - count * 4
        return {p: packed[a:b] for p, a, b in zip(pieces, begins.tolist(), stops.tolist())}


class Prefixes:
    """Last token of every byte prefix of one piece; can be extended and cut exactly."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [NO_TOKEN]
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Extends the piece; what is stored of its start stays valid."""
        v, last = self.vocabulary, self.last
        back, at, known = v.back.views(), memoryview(v.at), {}
        piece, start = self.piece + more, len(self.piece)
        for end in range(start + 1, len(piece) + 1):
            node, begin, found = 0, end, NO_TOKEN
            while begin:
                begin -= 1
                node = find_one(back, node << 8 | piece[begin])
                if node == NO_TOKEN:
                    break
                token = at[node]
                if token != NO_TOKEN:
                    if begin == 0:
                        found = token
                        break
                    asked = last[begin], token
                    if asked not in known:
                        known[asked] = v.valid(*asked)
                    if known[asked]:
                        found = token
                        break
            last.append(found)
        self.piece = piece

    def extended(self, more: bytes) -> Prefixes:
        """A longer piece that takes over what is stored of this one."""
        other = Prefixes(self.vocabulary)
        other.piece, other.last = self.piece, self.last.copy()
        other.append(more)
        return other

    def ids(self) -> list[int]:
        v, out, end = self.vocabulary, [], len(self.piece)
        if self.piece in v.unreachable:
            return [v.ranks[self.piece]]
        while end:
            out.append(self.last[end])
            end -= int(v.sizes[self.last[end]])
        return out[::-1]


def cuts_at_blanks(pattern: str) -> bool:
    """Whether pieces begin at blanks and line breaks that stand alone, tried on characters of many kinds on both sides."""
    split = regex.compile(pattern).findall
    sides = ["a", "Z", "ß", "7", "123", ".", "!?", "-", "'s", "_", "漢", "é", "/", "\u0301", "$", "\u200b"]
    return (split(" ab") == [" ab"] and all(split("\n" + x) == split("\n") + split(x) for x in sides)
            and all(split(x + blank + y) == split(x) + split(blank + y) for x in sides for y in sides for blank in " \n"))


class Encoder:
    """Encodes whole texts; keeps a bounded store of encoded words."""

    def __init__(self, vocabulary: Vocabulary, store: int = WORD_STORE, words: bool = True):
        self.vocabulary, self.store, self.by_words = vocabulary, store, words
        self.split = regex.compile(vocabulary.pattern).findall
        self.words = {}
        self.line_break = self._pieces([["\n"]])[0]

    def _pieces(self, words: list[list[str]]) -> list[bytes]:
        """Packed ids of words given as lists of pieces."""
        v, done, short = self.vocabulary, {}, []
        for piece in {p for pieces in words for p in pieces}:
            raw = piece.encode()
            rank = v.ranks.get(raw)
            if rank is not None:
                done[piece] = array("I", [rank]).tobytes()
            elif len(raw) > SHORT:
                done[piece] = array("I", Prefixes(v, raw).ids()).tobytes()
            else:
                short.append((piece, raw))
        made = v.encode_pieces([raw for _, raw in short])
        done.update((piece, made[raw]) for piece, raw in short)
        return [b"".join([done[p] for p in pieces]) for pieces in words]

    def _learn(self, words: list[str]) -> None:
        store = self.words
        if len(store) + len(words) > self.store:  # words met first are the frequent ones
            for word in list(store)[self.store // 2:]:
                del store[word]
        text = [w if w[0] == "\n" else " " + w for w in words]
        cut = [[t] if t[1:].isascii() and t[1:].isalpha() and t[0] == " " else self.split(t) for t in text]
        store.update(zip(words, self._pieces(cut)))

    def _share(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [b"".join(self._pieces([self.split(text)])) for text in texts]
        get, plans, new = self.words.get, [], {}
        for text in texts:
            # words carry the line break before them; the first one gets one that is taken off again
            words = ("\n" + text.replace("\n", " \n")).split(" ")
            ids = list(map(get, words))
            if None in ids:
                missing = {w for w, x in zip(words, ids) if x is None}
                # a word that is empty or holds white space: blanks stand together here
                if any(not (t := w.removeprefix("\n")) or t.split() != [t] for w in missing):
                    words = ids = None
                else:
                    new.update(dict.fromkeys(missing))
            plans.append((words, ids))
        fresh = list(new)
        self._learn(fresh)
        new, out = {w: self.words[w] for w in fresh}, []
        for text, (words, ids) in zip(texts, plans):
            if words is None:
                out.append(b"".join(self._pieces([self.split(text)])))
                continue
            if None in ids:
                ids = [new[w] if x is None else x for w, x in zip(words, ids)]
            out.append(b"".join(ids)[len(self.line_break):])
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, share, size = [], [], 0
        for text in texts:
            share.append(text)
            size += len(text)
            if size > SHARE:
                out += self._share(share)
                share, size = [], 0
        return out + self._share(share)

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        v, tokens = self.vocabulary, np.frombuffer(ids, "<u4")
        sizes = v.sizes[tokens]
        ends = np.cumsum(sizes)
        at = np.repeat(v.starts[tokens] - ends + sizes, sizes)
        at += np.arange(len(at))
        return v.flat[at].tobytes()


class Document:
    """A text held as pieces and their prefix tables, for appends and edits.

    An edit may move piece starts only between the last start before it that no
    white space precedes and the first start after it that both cuts share, so
    the tables of all other pieces are kept.
    """

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.split = vocabulary, regex.compile(vocabulary.pattern)
        self.text, self.pieces, self.encoded_anew = "", [], 0
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, begin: int, end: int, new: str) -> None:
        """Replaces the characters from ``begin`` to ``end`` by ``new``."""
        text = self.text[:begin] + new + self.text[end:]
        moved, kept, start = len(text) - len(self.text), [], 0
        for piece, table in self.pieces:  # a start is safe once a whole word stands between it and the edit
            if start + len(piece) >= begin:
                break
            kept.append((piece, table))
            start += len(piece)
        for _ in range(2):
            if kept:
                start -= len(kept.pop()[0])
        while kept and kept[-1][0].isspace():
            start -= len(kept.pop()[0])
        old_starts, at = {}, 0
        for i, (piece, _) in enumerate(self.pieces):
            if at >= end:
                old_starts[at + moved] = i
            at += len(piece)
        redone, self.encoded_anew = dict(self.pieces[len(kept):len(kept) + 8]), 0
        for found in self.split.finditer(text, start):
            if found.start() in old_starts and found.start() > begin + len(new):
                kept += self.pieces[old_starts[found.start()]:]
                break
            piece = found[0]
            table = redone.get(piece)
            if table is None:
                stem = next((p for p in redone if piece.startswith(p)), None)
                if stem is None:
                    table = Prefixes(self.vocabulary, piece.encode())
                    self.encoded_anew += len(piece)
                else:  # an append: what is stored of the stem stays
                    table = redone[stem].extended(piece[len(stem):].encode())
                    self.encoded_anew += len(piece) - len(stem)
            kept.append((piece, table))
        self.text, self.pieces = text, kept

    def ids(self) -> list[int]:
        return [i for _, table in self.pieces for i in table.ids()]


class Tokenizer:
    """Vocabulary made once and broadcast as arrays; every task has an encoder of its own.

    ``pattern`` must cut no piece across a lone blank that has other characters on
    both sides (as in ``a b``), unless ``words`` is false: then every text is cut by
    the pattern as it is.  By default the pattern is tried on a few texts.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str, words: bool | None = None):
        self.words = cuts_at_blanks(pattern) if words is None else words
        self.shared = spark.sparkContext.broadcast(Vocabulary(read_ranks(path), pattern))  # of the file's fixed size

    @contextmanager
    def borrowed(self) -> Iterator[Encoder]:
        """An encoder for one task; its memory is given back with the task."""
        encoder = Encoder(self.shared.value, words=self.words)
        try:
            yield encoder
        finally:
            encoder.words.clear()
            give_back()

    def close(self) -> None:
        """Frees the broadcast on all executors; frames made with it must have been written."""
        self.shared.destroy()


def _strings(column: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in as_bytes(column)]


def _ids_array(ids: list[bytes]) -> pa.Array:
    sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode_texts(docs: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """Adds ``ids`` (array of int) and ``n_tokens``."""

    @F.arrow_udf("ids array<int>, n_tokens long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with tokenizer.borrowed() as encoder:
            for column in batches:
                out = [ids for part in slices(column) for ids in encoder.encode_many(_strings(part))]
                yield pa.StructArray.from_arrays(
                    [_ids_array(out), pa.array([len(x) // 4 for x in out], pa.int64())], names=["ids", "n_tokens"])

    return with_fields(docs, run(F.col(text)), ["ids", "n_tokens"])


def decode_ids(encoded: DataFrame, tokenizer: Tokenizer, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary); null ids decode to empty bytes."""

    @F.arrow_udf("decoded binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with tokenizer.borrowed() as encoder:
            for column in batches:
                out = [encoder.decode(np.array(x or (), "<u4").tobytes()) for part in slices(column) for x in part.to_pylist()]
                yield pa.StructArray.from_arrays([pa.array(out, pa.binary())], names=["decoded"])

    return with_fields(encoded, run(F.col(ids)), ["decoded"])


def round_trip(docs: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """Adds n_tokens and the digests of ids and of the bytes decoded from them, in one pass."""
    fields = ["n_tokens", "ids_sha256", "decoded_sha256"]

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with tokenizer.borrowed() as encoder:
            for column in batches:
                counts, ids, texts = [], [], []
                for part in slices(column):
                    for x in encoder.encode_many(_strings(part)):
                        counts.append(len(x) // 4)
                        ids.append(hashlib.sha256(x).hexdigest())
                        texts.append(hashlib.sha256(encoder.decode(x)).hexdigest())
                yield pa.StructArray.from_arrays(
                    [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=fields)

    return with_fields(docs, run(F.col(text)), fields)
