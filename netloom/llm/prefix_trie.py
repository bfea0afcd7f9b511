"""Prefix trie over conversations, by van Emde Boas recursion.

The sequences of turns are cut at half their depth, the halves at half of theirs,
and so on down to windows of ``BASE`` turns.  A cut prefix is named by the digests
of the halves that lie before it, all named side by side: the digest of a window
comes from its turns, that of a pair of windows from the two, and the name of the
prefix before a window from the digests of the pairs, pairs of pairs ... that
make it up.  Inside a window, names of prefixes follow from its root's name.
Equal names are one node; its key is (smallest member, depth).

Totals are grafted upward the same way: first within windows, then the root of
every tree in a lower half adds its total to its ancestors in the upper half
above it, for halves of ``BASE`` turns, twice as many, and so on.  Each round
moves a part of the rows only, and only conversations that are long enough.

No list of a node's members is gathered.  The digest of the conversations that
end at a node takes their ids from a global sort, as joined pieces.

Cases: a null role or text is empty; turns of one number are ordered by a digest
of role and text; a null conv_id counts as the largest long, takes no turns from
another conversation, gives a null id and an empty decimal; repeated rows are
turns of their own; a conversation without turns is a member of the root only;
an empty table has no node; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.texts import streamed
from netloom.session import write_table

BASE_BITS = 4
BASE = 1 << BASE_BITS  # turns of the windows in which names and totals are taken directly
PIECE = 1 << 16  # characters of joined ids that move on together
RANKED = 4096  # turns ranked together, so that a long conversation is ranked by many tasks
NO_ID = (1 << 63) - 1
_ROOT = hashlib.sha256(b"").digest()
_NONE = hashlib.sha256(b"").hexdigest()


def _sha(*columns):
    return F.unhex(F.sha2(F.concat(*columns), 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv, place (0 for the first turn), token (digest of role and text), size (bytes of the text)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), F.col("turn").cast("long").alias("turn"),
        _sha(F.length(role).cast("string"), F.lit(":"), role, text).alias("token"),
        F.octet_length(text).cast("long").alias("size")).withColumn(
        "part", F.coalesce(F.floor(F.col("turn") / RANKED), F.lit(-(1 << 62))))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("conv", "part").count().select(
        "conv", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), "token")
    return rows.join(starts, ["conv", "part"]).select(
        "conv", (F.col("start") + F.row_number().over(inside) - 1).alias("place"), "token", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's sequences: (conv, depth, token, size) from depth 1, and (conv, length) of every conversation."""
    known = F.col("conv") != NO_ID
    ids = turns.groupBy("conv").count().select(
        "conv", F.col("count").alias("n"),
        F.when(known, F.crc32(F.col("conv").cast("string").cast("binary")) % 9).otherwise(0).alias("head"),
        F.when(known, F.col("conv") - F.col("conv") % 5).otherwise(F.col("conv")).alias("source"))
    sizes = ids.select(F.col("conv").alias("source"), F.col("n").alias("there"))
    plan = write_table(ids.join(sizes, "source", "left").select(
        "conv", "source", "head", F.least("head", F.coalesce("there", F.lit(0))).alias("taken"), "n"))
    rest = turns.join(plan, "conv").where("place >= head").select(
        "conv", (F.col("taken") + F.col("place") - F.col("head") + 1).alias("depth"), "token", "size")
    heads = turns.where("place < 8").withColumnRenamed("conv", "source")
    taken = heads.join(plan, "source").where("place < head").select("conv", (F.col("place") + 1).alias("depth"), "token", "size")
    lengths = plan.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length"))
    return taken.unionByName(rest), lengths


def named_prefixes(sequences: DataFrame) -> DataFrame:
    """(conv, depth, size, name): equal prefixes have equal names."""
    item = F.struct("depth", "token", "size")
    windows = write_table(sequences.groupBy("conv", F.shiftright(F.col("depth") - 1, BASE_BITS).alias("window"))
                          .agg(F.sort_array(F.collect_list(item)).alias("turns"))  # at most BASE of them
                          .withColumn("digest", _sha(F.array_join(F.transform("turns", lambda t: F.hex(t["token"])), ""))))
    last = windows.agg(F.max("window")).first()[0] or 0
    rooted = windows.where("window = 0").select("conv", "window", "turns", F.lit(_ROOT).alias("root"))
    if last:
        halves = windows.select("conv", "window", "digest", F.lit(0).alias("level"))
        level, every = halves, halves
        for k in range(1, int(last).bit_length()):
            pairs = level.groupBy("conv", F.shiftright("window", 1).alias("window")).agg(
                F.min_by("digest", "window").alias("a"), F.max_by("digest", "window").alias("b"))
            level = write_table(pairs.select("conv", "window", _sha("a", "b").alias("digest"), F.lit(k).alias("level")))
            every = every.unionByName(level)
        # the prefix before window 0b1011 is made of the halves 0b1 (level 3), 0b100 (level 1) and 0b1010 (level 0)
        bits = F.filter(F.sequence(F.lit(0), F.lit(int(last).bit_length() - 1)),
                        lambda k: F.col("window").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0)
        parts = windows.where("window > 0").select("conv", F.col("window").alias("of"), F.explode(bits).alias("level"))
        parts = parts.withColumn("window", F.expr("shiftleft(shiftright(of, level + 1), 1)"))
        names = parts.join(every, ["conv", "level", "window"]).groupBy("conv", F.col("of").alias("window")).agg(
            F.sort_array(F.collect_list(F.struct("level", "digest"))).alias("parts"))
        root = _sha(F.array_join(F.transform("parts", lambda p: F.concat(p["level"].cast("string"), F.lit(":"), F.hex(p["digest"]))), ","))
        rooted = rooted.unionByName(
            windows.where("window > 0").join(names.select("conv", "window", root.alias("root")), ["conv", "window"])
            .select("conv", "window", "turns", "root"))
    chain = F.aggregate("turns", F.array("root"), lambda names, t: F.concat(
        names, F.array(_sha(F.element_at(names, -1), t["token"]))))
    each = rooted.select("conv", F.explode(F.arrays_zip("turns", F.slice(chain, 2, BASE).alias("names"))).alias("x"))
    return each.select("conv", F.col("x.turns.depth").alias("depth"), F.col("x.turns.size").alias("size"),
                       F.col("x.names").alias("name"))


def graft_totals(nodes: DataFrame, paths: DataFrame, deepest: int, values: list[str]) -> DataFrame:
    """Sums of ``values`` over the subtree of every node, by (node, depth).

    ``paths`` has the node of every prefix (conv, depth, node); the path of a
    node is that of its smallest member.
    """
    path = paths.select(F.col("conv").alias("node"), F.col("depth").alias("up"), F.col("node").alias("above"))
    summed = [F.sum(v).alias(v) for v in values]
    window = nodes.withColumn("window", F.shiftright("depth", BASE_BITS))
    inside = path.withColumn("window", F.shiftright("up", BASE_BITS))
    totals = (window.join(inside, ["node", "window"]).where("up <= depth")
              .groupBy(F.col("above").alias("node"), F.col("up").alias("depth")).agg(*summed))
    bits = BASE_BITS
    while 1 << bits <= deepest:
        totals = write_table(totals)
        half = F.shiftright("depth", bits)
        roots = totals.where((F.col("depth") % (1 << bits) == 0) & (half % 2 == 1)).withColumn("window", half - 1)
        grafts = (roots.join(path.withColumn("window", F.shiftright("up", bits)), ["node", "window"])
                  .select(F.col("above").alias("node"), F.col("up").alias("depth"), *values))
        totals = totals.unionByName(grafts).groupBy("node", "depth").agg(*summed)
        bits += 1
    return totals


_PIECES = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
_ENDS = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


class _Pieces:
    """Ids of one node that one task holds; a piece is given out whenever it is long enough."""

    def __init__(self, key):
        self.key, self.ids, self.size, self.first = key, [], 0, None

    def feed(self, conv: int) -> tuple | None:
        self.first = conv if self.first is None else self.first
        self.ids.append("" if conv == NO_ID else str(conv))
        self.size += len(self.ids[-1]) + 1
        return self.row() if self.size >= PIECE else None

    def row(self) -> tuple | None:
        piece = (*self.key, self.first, ",".join(self.ids)) if self.ids else None
        self.ids, self.size, self.first = [], 0, None
        return piece


class _Joined:
    def __init__(self, key):
        self.key, self.hash, self.any = key, hashlib.sha256(), False

    def feed(self, first: int, ids: str) -> None:
        self.hash.update((("," if self.any else "") + ids).encode())
        self.any = True

    def row(self) -> tuple:
        return (*self.key, self.hash.hexdigest())


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids (``conv``) of each (node, depth)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return streamed(batches, 2, _Pieces, _PIECES)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return streamed(batches, 2, _Joined, _ENDS)

    cut = write_table(ends.select("node", "depth", "conv")).repartitionByRange("node", "depth", "conv").sortWithinPartitions(
        "node", "depth", "conv").mapInArrow(pieces, "node long, depth long, first long, ids string")
    return cut.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(
        joined, "node long, depth long, ends_sha256 string")


def build_trie(sequences: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``sequences`` has (conv, depth, token, size) of every turn, ``lengths`` the
    (conv, length) of every conversation, those without a turn included.
    """
    everyone = lengths.agg(F.min("conv"), F.count("*"), F.max("length")).first()  # three numbers
    top, members, deepest = everyone[0] or 0, everyone[1], int(everyone[2] or 0)
    prefixes = write_table(named_prefixes(sequences))
    grouped = write_table(prefixes.groupBy("depth", "name").agg(
        F.min("conv").alias("node"), F.count("*").alias("n_convs"), F.max("size").alias("size")))
    below = prefixes.join(grouped.select("depth", "name", "node"), ["depth", "name"]).select("conv", "depth", "node")
    root = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(top).cast("long").alias("node"))
    paths = write_table(below.withColumn("depth", F.col("depth").cast("long")).unionByName(root))
    node = grouped.select("node", F.col("depth").cast("long").alias("depth"), "n_convs", "size")
    spark = lengths.sparkSession
    first = spark.createDataFrame([(top, 0, members, 0)] if members else [], "node long, depth long, n_convs long, size long")
    up = paths.select(F.col("conv").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = write_table(node.unionByName(first).join(up, ["node", "depth"], "left").select(
        "node", "depth", "n_convs", "size", F.when(F.col("depth") > 0, F.col("parent")).alias("parent")))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"))
    known = write_table(nodes.join(children, ["node", "depth"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    valued = known.select("node", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                          ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    totals = graft_totals(valued, paths, deepest, ["n_leaves", "saved_tokens"])
    ends = end_digests(lengths.withColumnRenamed("length", "depth").join(paths, ["conv", "depth"]))
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return known.join(totals, ["node", "depth"]).join(ends, ["node", "depth"], "left").select(
        named("node").alias("conv_id"), "depth", named("parent").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    sequences, lengths = rebuilt(write_table(ordered_turns(conversations)))
    return build_trie(sequences, write_table(lengths))
