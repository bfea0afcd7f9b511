"""Repair of conversations and their prefix trie, against plain Python on hand-made rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.llm import prefix_trie, queries, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, Cost string, depth int"
SPACE = " \t\n\x0b\x0c\r"


def least_edits(tokens):
    """(cost, audit) by a table of the four states, row by row."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def with_inserts(best):
        for _ in range(4):
            for p in range(4):
                for role, q in after[p].items():
                    if best[p] and role in "ua":
                        best[q] = min(filter(None, (best[q], (best[p][0] + 2, best[p][1] + "I"))))
        return best

    best = with_inserts([(0, ""), None, None, None])
    for token in tokens:
        new, late = [[] for _ in range(4)], int(token.isupper())
        for p in range(4):
            if best[p]:
                cost, audit = best[p]
                new[p].append((cost + 3, audit + "D"))
                for role, q in after[p].items() if token != "d" else ():
                    if token.lower() == role:
                        new[q].append((cost + late, audit + "K"))
                    elif role in "ua":
                        new[q].append((cost + 2 + late, audit + "R"))
        best = with_inserts([min(n, default=None) for n in new])
    return min(filter(None, (best[0], best[3])))


@given(st.text(alphabet="uasxUASXdua", max_size=12), st.sampled_from([1, 2, 3, 5, 256]))
@settings(max_examples=300, deadline=None)
def test_chart_finds_the_least_edits(tokens, span):
    assert turn_repair.repair_tokens(tokens, span) == least_edits(tokens)


def test_chart_of_long_rows():
    rng = random.Random(5)
    for tokens in ("d" * 300, "u" * 300, "".join(rng.choices("uauauauAUdsx", k=700))):
        assert turn_repair.repair_tokens(tokens) == least_edits(tokens)


def repaired_by_hand(turns):
    """Verdict of one conversation's damaged rows (turn, role, text), in any order."""
    key = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    rows = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, key(*r[1:])))
    tokens, faults, seen, legal = "", [0, 0, 0], set(), 0
    for i, (_, role, text) in enumerate(rows):
        body = text.rstrip(SPACE)
        if not body:
            faults[0], token = faults[0] + 1, "d"
        elif (role, text) in seen:
            faults[1], token = faults[1] + 1, "d"
        else:
            token = role[:1] if role[:1] in ("u", "a", "s") else "x"
            if body[-1] not in ".!?":
                faults[2], token = faults[2] + 1, token.upper()
        seen.add((role, text))
        tokens += token
        legal += i > 0 and rows[i - 1][1][:1] + role[:1] in ("su", "ua", "au")
    cost, audit = least_edits(tokens)
    lines, at, odd = [], iter(rows), (len(audit) - audit.count("D")) % 2
    for edit in audit:
        _, role, text = (None, "", "") if edit == "I" else next(at)
        if edit != "D":
            lines.append(f"{role if edit == 'K' else ('user', 'assistant')[(len(lines) + odd) % 2]}:{text}")
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = max(len(rows) - 1, 0) - legal
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made_turns(rng, conversations, longest):
    texts = ["Yes.", "No!", "Why?", "well", "", None, " \t", "Ünï 漢字.", "end. \n", "a" * 50_000]
    rows = []
    for conv in [*range(conversations), None]:
        for turn in range(rng.randrange(1, longest)):
            number = rng.choice([turn, turn, turn, turn * 3, None, 1])
            rows.append((conv, number, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts), "c", 1))
    return rows + rows[:5]


def by_conversation(rows):
    groups = defaultdict(list)
    for conv, *rest in rows:
        groups[conv].append(rest)
    return groups


def test_repair(spark):
    rows = made_turns(random.Random(1), 12, 9)
    rows += [(77, i, ("user", "assistant")[i % 2], f"line {i}.", "c", 1) for i in range(700)]  # more than one span
    rows += [(78, None, "user", f"same {i % 400}.", "c", 1) for i in range(600)]  # one turn, more rows than a span
    table = spark.createDataFrame(rows, SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in turn_repair.repair(table, table).collect()}
    hand = {c: repaired_by_hand([(r[0], r[1] if r[1] is not None else " ", r[2] if r[2] is not None else " ") for r in group])
            for c, group in by_conversation(rows).items()}
    assert got == hand


def test_repaired_turns_are_legal(spark):
    table = spark.createDataFrame(made_turns(random.Random(2), 20, 9), SCHEMA)
    verdicts = turn_repair.judge_turns(table)
    found = by_conversation(tuple(r) for r in turn_repair.repaired_turns(table, verdicts).collect())
    for conv, turns in found.items():
        roles = "".join(r[1][0] for r in sorted(turns))
        assert roles.removeprefix("s") == "ua" * (len(roles) // 2) and roles != "s"
    # repaired turns need no edit but for texts that are cut, or empty because inserted
    full = spark.createDataFrame([(c, *t[:2], t[2] or "x", "", 0) for c, ts in found.items() for t in ts], SCHEMA)
    assert {r["illegal"] for r in turn_repair.judge_turns(full).collect()} == {0}


def test_conversation_without_rows_after_damage(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 0, "user", "Hi.", "c", 1)], SCHEMA)
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in turn_repair.repair(table, turn_repair.damage(table)).collect()] == [
        (gone, 0, 0, 0, 0, 0, 0, "", empty)]
    assert turn_repair.repair(table.limit(0), turn_repair.damage(table.limit(0))).count() == 0


def test_damage(spark):
    kind = lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    rows = [(c, t, "system", "A. B! c?", "c", 1) for c in [*range(30), None] for t in (0, 1, None)]
    got = sorted(map(str, (tuple(r) for r in turn_repair.damage(spark.createDataFrame(rows, SCHEMA)).collect())))
    want = []
    for c, t, role, text, *_ in rows:
        k = kind(c, t)
        row = (c, t, "user" if k == 4 else role, {1: "", 2: "A B c"}.get(k, text))
        want += [row] * {0: 0, 3: 2}.get(k, 1)
    assert got == sorted(map(str, want)) and {kind(*r[:2]) for r in rows} >= {0, 1, 2, 3, 4}


def trie_by_hand(rows):
    """Nodes of the rebuilt conversations."""
    token = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    groups = by_conversation([(c, t, r or "", x or "") for c, t, r, x, *_ in rows])
    own = {c: [(r[1], r[2]) for r in sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, token(r)))] for c, g in groups.items()}
    made = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        made[c] = (own.get(c - c % 5, [])[:h] if c is not None else []) + turns[h:]
    last = lambda c: float("inf") if c is None else c
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for key, ids in members.items():
        below = [k for k in members if k[:len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(m[:-1] == k for m in members if m)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join("" if c is None else str(c) for c in sorted((c for c in ids if made[c] == list(key)), key=last))
        out.append((min(ids, key=last), len(key), min(members[key[:-1]], key=last) if key else None, len(ids), len(children),
                    len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def test_trie(spark):
    rng = random.Random(3)
    rows = [(c, rng.choice([t, t, t, None]), rng.choice(["user", None]), rng.choice(["yes", "nö", "", None]), "c", 1)
            for c in [*range(3, 40), 1000, None] for t in range(rng.randrange(1, 10))]
    rows += rows[:7]
    # long conversations that part late, so that totals are grafted across several windows
    for c, part in ((100, 75), (105, 75), (110, 40), (115, 16), (120, 17), (125, 75)):
        rows += [(c, t, "user", f"long {t}" if t < part else f"own {c} {t}", "c", 1) for t in range(rng.randrange(76, 90))]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(tuple(r)) for r in got) == trie_by_hand(rows)


def test_trie_with_common_ends(spark, monkeypatch):
    rows = [(c, 0, "user", "hi", "c", 1) for c in range(0, 3000)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(tuple(r)) for r in got) == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pieces_of_ids():
    pieces = prefix_trie._Pieces((1, 2))
    ids = list(range(0, 90_000, 3))
    rows = [r for r in [*map(pieces.feed, ids), pieces.row()] if r]
    assert len(rows) > 1 and ",".join(r[3] for r in rows) == ",".join(map(str, ids)) and [r[2] for r in rows][0] == 0


@pytest.mark.parametrize("name", ["op11_turn_repair", "op12_prefix_trie"])
def test_query_keeps_every_conversation(spark, sf, name):
    ids = {r[0] for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().collect()}
    got = queries.QUERIES[name](spark, sf)
    if name == "op11_turn_repair":
        assert sorted(r[0] for r in got.select("conv_id").collect()) == sorted(ids)
    else:
        assert got.where("depth = 0").select("n_convs").first()[0] == len(ids)
