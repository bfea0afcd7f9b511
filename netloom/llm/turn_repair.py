"""Conversation structure repair by weighted CYK interval parsing.

A conversation is legal if the initials of its roles, in order, read
``(s?(ua)+)?``.  Its rows may be kept (K), given the role user or assistant (R,
2), deleted (D, 3; a must for blank and duplicate rows), and empty user or
assistant turns may be inserted (I, 2); a truncated row that stays adds 1.

The repair grammar in Chomsky normal form, over spans of rows::

    Dialogue -> Pair Dialogue | Pair       Pair -> User Assistant
    Opened -> System Dialogue              X -> Deleted X  (X a terminal)

with the insertion closure: User and Assistant also span no row, or only deleted
ones, by an insertion.  A cell holds the least (cost, audit) of its span, where
the audit spells the edits; cells are combined bottom-up by span length.  The
least cells of two spans side by side give the least cell of both: of two audits
of one span and one cost neither starts the other, as what the longer one adds
could only be insertions, which cost.

Long conversations are cut into spans of ``SPAN`` turns that are parsed side by
side.  A span's cells say for each pair of states of the legal order (start,
after the system turn, after a user turn, after an assistant turn) what it
costs to get from one to the other; neighbours are then joined from left to
right.  So a conversation with a large share of all rows is parsed by many
tasks; only its audit and the running hash of its repaired text go through one.

Cases: a null role or text counts as one blank; rows of a null conv_id are one
conversation; rows with a null turn come first; rows of one turn are ordered by
a digest of role and text, so equal ones stand together; a row whose role is
empty can only be given a role or be deleted; repeated rows are duplicates; an
empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.texts import SPACES, frame, streamed
from netloom.session import write_table

SPAN = 256
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
ROLES = {"s": "system", "u": "user", "a": "assistant"}
START, OPENED, ASKED, ANSWERED = range(4)
_NEVER = 1 << 28
_EMPTY = hashlib.sha256(b"").hexdigest()
VERDICT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")

Cell = tuple[int, str]


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn`` modulo 20."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", known("conv_id"), known("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), kind.alias("kind"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"),
                                          F.explode(times).alias("copy")).drop("copy")


def _marked(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the digest that orders rows of one turn."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", "turn", known("role"), known("text"))
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.withColumn("same", same)


def _as(token: str, role: str) -> Cell | None:
    """Cost and letter of a row that becomes a turn of ``role``; none if it can't."""
    late = TRUNCATED if token.isupper() else 0
    if token == "d":
        return None
    if token.lower() == role:
        return late, "K"
    return (REROLE + late, "R") if role in "ua" else None


class _Terminal:
    """User or Assistant: rows deleted before one that takes the role, or rows deleted before an insertion."""

    def __init__(self, tokens: str, role: str):
        self.taken = [_as(t, role) for t in tokens]
        self.inserts = np.array([True] + [t is None for t in self.taken])  # by the span's end
        self.last = np.array([0] + [INSERT + DELETE if t is None else t[0] for t in self.taken])

    def cell(self, i: int, j: int) -> Cell:
        if i == j:
            return INSERT, "I"
        taken = self.taken[j - 1]
        if taken is None:
            return DELETE * (j - i) + INSERT, "D" * (j - i) + "I"
        return DELETE * (j - i - 1) + taken[0], "D" * (j - i - 1) + taken[1]

    def costs(self, size: np.ndarray, end: np.ndarray) -> np.ndarray:
        return np.where(size == 0, INSERT, DELETE * (size - 1) + self.last[end])


class Chart:
    """Cells of all spans of a row of tokens: u, a, s, x by the role, upper case if truncated, d if it must go."""

    def __init__(self, tokens: str):
        self.tokens, n = tokens, len(tokens)
        self.user, self.assistant = _Terminal(tokens, "u"), _Terminal(tokens, "a")
        pair_cost = np.full((n + 1, n + 1), _NEVER)  # by size and start
        dialogue_cost = np.full((n + 1, n + 1), _NEVER)  # by size and end
        self.pairs = np.zeros((n + 1, n + 1), np.int64)
        self.dialogues: list[list[str]] = [[]]
        self.costs = dialogue_cost
        for size in range(1, n + 1):
            start, first = np.arange(n - size + 1), np.arange(size + 1)[:, None]
            cut = start + first
            cost = self.user.costs(first, cut) + self.assistant.costs(size - first, np.broadcast_to(start + size, cut.shape))
            # Equal costs: more deletions first, then an insertion, make the lesser audit.
            inserts = self.user.inserts[cut] | (first == 0)
            lead = 2 * np.where(inserts, first, first - 1) + inserts
            best = (cost * (4 * n + 8) - lead).argmin(0)
            pair_cost[size, start] = cost[best, start]
            self.pairs[size, start] = best
            whole = np.concatenate([pair_cost[1:size, start] + dialogue_cost[size - 1:0:-1, size:n + 1],
                                    pair_cost[size:size + 1, start]])
            least = whole.min(0)
            dialogue_cost[size, size:n + 1] = least
            audits = [""] * len(start)
            for k, i in zip(*(x.tolist() for x in np.nonzero(whole == least))):
                k += 1
                audit = self.pair(i, i + k) + (self.dialogues[size - k][i + k] if k < size else "")
                if not audits[i] or audit < audits[i]:
                    audits[i] = audit
            self.dialogues.append(audits)

    def pair(self, i: int, j: int) -> str:
        cut = i + int(self.pairs[j - i, i])
        return self.user.cell(i, cut)[1] + self.assistant.cell(cut, j)[1]

    def dialogue(self, i: int, j: int) -> Cell:
        if i == j:
            return 2 * INSERT, "II"
        return int(self.costs[j - i, j]), self.dialogues[j - i][i]

    def system(self, j: int) -> Cell | None:
        """A kept system row behind deleted ones, over the first ``j`` rows."""
        taken = _as(self.tokens[j - 1], "s") if j else None
        return taken and (DELETE * (j - 1) + taken[0], "D" * (j - 1) + taken[1])


def _add(*cells: Cell | None) -> Cell | None:
    return None if None in cells else (sum(c[0] for c in cells), "".join(c[1] for c in cells))


def _least(cells) -> Cell | None:
    return min((c for c in cells if c is not None), default=None)


@lru_cache(maxsize=20_000)
def span_cells(tokens: str) -> tuple[tuple[Cell | None, ...], ...]:
    """Least cell from each state to each state over all of ``tokens``."""
    chart, n = Chart(tokens), len(tokens)
    rest = [(DELETE * (n - j), "D" * (n - j)) for j in range(n + 1)]
    ask = [_least(_add(chart.user.cell(j, k), rest[k]) for k in range(j, n + 1)) for j in range(n + 1)]
    opened = [chart.system(j) for j in range(n + 1)]
    answers = [chart.assistant.cell(0, j) for j in range(n + 1)]
    plain = [chart.dialogue(0, j) for j in range(n + 1)]
    after_s = [_least([plain[j], *(_add(opened[k], chart.dialogue(k, j)) for k in range(1, j + 1))]) for j in range(n + 1)]
    after_u = [_least([answers[j], *(_add(answers[k], chart.dialogue(k, j)) for k in range(j))]) for j in range(n + 1)]
    closed = lambda cells: _least(map(_add, cells, rest))
    asked = lambda cells: _least(map(_add, cells, ask))
    none = rest[0]
    return (
        (none, closed(opened), _least([ask[0], asked(opened), asked(after_s)]), closed(after_s)),
        (None, none, _least([ask[0], asked(plain)]), closed(plain)),
        (None, None, _least([none, asked(after_u)]), closed(after_u)),
        (None, None, _least([ask[0], asked(plain)]), _least([none, closed(plain)])),
    )


def join_spans(state: list[Cell | None], cells) -> list[Cell | None]:
    """Least cells from the conversation's start to each state, one span further."""
    return [_least(_add(state[p], cells[p][q]) for p in range(4)) for q in range(4)]


def repair_tokens(tokens: str, span: int = SPAN) -> Cell:
    """Least cost and audit of a whole conversation."""
    state: list[Cell | None] = [(0, ""), None, None, None]
    for at in range(0, len(tokens), span):
        state = join_spans(state, span_cells(tokens[at:at + span]))
    return _least([state[START], state[ANSWERED]])


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


_SPAN_ROW = ("conv_id long, span long, blank long, duplicate long, truncated long, illegal long, first string, "
             "last string, low long, high long, turns long, costs array<long>, audits array<string>")


class _Span:
    """Counts and cells of the rows of one span, fed in order."""

    def __init__(self, key):
        self.key, self.tokens, self.first, self.last, self.before = key, [], None, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.state = None

    def feed(self, turn, same: bytes, initial: str, blank: bool, open_end: bool, later: bool) -> None:
        if self.before is not None and not _legal(self.last, initial):
            self.illegal += 1
        token = initial if initial in ROLES else "x"
        if blank:
            self.blank += 1
            token = "d"
        elif later or self.before == (turn, same):
            self.duplicate += 1
            token = "d"
        elif open_end:
            self.truncated += 1
            token = token.upper()
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.first = initial if self.first is None else self.first
        self.last, self.before = initial, (turn, same)
        self.tokens.append(token)
        if len(self.tokens) == SPAN:
            self._close()

    def _close(self) -> None:
        """Joins the cells of the rows so far, for spans with many rows of one turn."""
        cells = span_cells("".join(self.tokens))
        self.state = [list(r) for r in cells] if self.state is None else [join_spans(r, cells) for r in self.state]
        self.tokens = []

    def row(self) -> tuple:
        if self.tokens:
            self._close()
        flat = [c for r in self.state for c in r]
        return (*self.key, self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.low,
                self.high, self.turns, [c and c[0] for c in flat], [c and c[1] for c in flat])


_SPAN_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("span", pa.int64()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")),
    ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()),
    ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
_VERDICT_SCHEMA = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in (
    "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])


class _Conversation:
    """Spans of one conversation, joined from left to right."""

    def __init__(self, key):
        self.key, self.counts, self.last = key, [0, 0, 0, 0], None
        self.low, self.high, self.turns = None, None, 0
        self.state: list[Cell | None] = [(0, ""), None, None, None]

    def feed(self, span, blank, duplicate, truncated, illegal, first, last, low, high, turns, costs, audits) -> None:
        crossing = self.last is not None and not _legal(self.last, first)
        self.counts = [a + b for a, b in zip(self.counts, (blank, duplicate, truncated, illegal + crossing))]
        self.last = last
        if low is not None:
            self.low, self.high = low if self.low is None else self.low, high
        self.turns += turns
        cells = [None if c is None else (c, a) for c, a in zip(costs, audits)]
        self.state = join_spans(self.state, [cells[p * 4:p * 4 + 4] for p in range(4)])

    def row(self) -> tuple:
        cost, audit = _least([self.state[START], self.state[ANSWERED]])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (*self.key, gaps, *self.counts, cost, audit)


def judge_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation that has turns: faults, least cost and audit.

    Only digests and flags are shuffled.  A span's rows meet by (conv_id, turns
    of one span), its cells by conv_id.
    """
    whole = F.rtrim(F.col("text"), F.lit(SPACES.decode()))
    rows = write_table(_marked(turns).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "same",
        F.substring("role", 1, 1).alias("initial"), (whole == "").alias("blank"),
        (~F.substring(whole, -1, 1).isin(".", "!", "?")).alias("open_end")))
    first = rows.groupBy("conv_id", "same").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("met"))
    met = first.select(F.col("conv_id").alias("c"), F.col("same").alias("s"), F.col("met.turn").alias("met"))
    flagged = rows.join(met, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s"))).select(
        "conv_id", F.floor(F.coalesce(F.col("turn"), F.lit(0)) / SPAN).alias("at"), F.col("turn").isNotNull().alias("known"),
        "turn", "same", "initial", "blank", "open_end", (~F.col("turn").eqNullSafe(F.col("met"))).alias("later"))
    span = F.when(F.col("known"), F.col("at")).otherwise(F.lit(-(1 << 62)).cast("long"))
    fed = flagged.select("conv_id", span.alias("span"), "turn", "same", "initial", "blank", "open_end", "later")
    order = [F.col("conv_id"), F.col("span"), F.col("turn").asc_nulls_first(), F.col("same")]
    spans = fed.repartition("conv_id", "span").sortWithinPartitions(*order).mapInArrow(
        lambda batches: streamed(batches, 2, _Span, _SPAN_SCHEMA), _SPAN_ROW)
    return spans.repartition("conv_id").sortWithinPartitions("conv_id", "span").mapInArrow(
        lambda batches: streamed(batches, 1, _Conversation, _VERDICT_SCHEMA), VERDICT)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns of conversations whose audit comes before their rows."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    out, conv, audit, at, place, odd = [], None, "", 0, 0, 0

    def insert():
        nonlocal at, place
        while at < len(audit) and audit[at] == "I":
            out.append((conv, place, ROLES["ua"[(place + odd) % 2]], ""))
            at, place = at + 1, place + 1

    for batch in batches:
        for conv_id, is_row, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not is_row:
                conv, audit, at, place = conv_id, text, 0, 0
                odd = (len(audit) - audit.count("D")) % 2  # a system turn leads
            else:
                edit, at = audit[at], at + 1
                if edit != "D":
                    out.append((conv, place, role if edit == "K" else ROLES["ua"[(place + odd) % 2]], text))
                    place += 1
            insert()
            if len(out) >= 4096:
                yield frame(out, schema)
                out.clear()
    yield frame(out, schema)


def repaired_turns(turns: DataFrame, verdicts: DataFrame) -> DataFrame:
    """conv_id, place, role, text after the edits of the audits; a conversation's rows stand together, in order."""
    rows = _marked(turns).select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(True).alias("is_row"),
                                 F.col("turn").cast("long").alias("turn"), "same", "role", "text")
    heads = verdicts.select("conv_id", F.lit(False).alias("is_row"), F.lit(None).cast("long").alias("turn"),
                            F.lit(None).cast("binary").alias("same"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return (rows.unionByName(heads).repartition("conv_id")
            .sortWithinPartitions("conv_id", "is_row", F.col("turn").asc_nulls_first(), "same")
            .select("conv_id", "is_row", "role", "text")
            .mapInArrow(_edited, "conv_id long, place long, role string, text string"))


class _Digest:
    def __init__(self, key):
        self.key, self.hash, self.any = key, hashlib.sha256(), False

    def feed(self, role, text) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True

    def row(self) -> tuple:
        return (*self.key, self.hash.hexdigest())


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines; takes ``repaired_turns`` as it comes, row by row."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    return repaired.select("conv_id", "role", "text").mapInArrow(
        lambda batches: streamed(batches, 1, _Digest, schema), "conv_id long, repaired_sha256 string")


def repair(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Verdict and digest of the repaired text for every conversation; ``turns`` are the rows to judge."""
    verdicts = write_table(judge_turns(turns))
    hashed = digests(repaired_turns(turns, verdicts)).withColumnRenamed("conv_id", "h")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    judged = verdicts.withColumnRenamed("conv_id", "c")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (every.join(judged, F.col("conv_id").eqNullSafe(F.col("c")), "left")
            .join(hashed, F.col("conv_id").eqNullSafe(F.col("h")), "left")
            .select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(_EMPTY)).alias("repaired_sha256")))
