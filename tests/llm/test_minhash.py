"""MinHash near-dedup against all pairs of full shingle sets."""

import random
import re

import duckdb
import numpy as np
import pytest

from netloom.llm import minhash, queries


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]


def set_of(text):
    words = words_of(text)
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def by_hand(rows, percent=85):
    """(doc_id, n_shingles, component_id, kept) from the exact overlap of all pairs that share a shingle."""
    sets = [set_of(t) for _, t in rows]
    holders, label = {}, list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            holders[x].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n) and root(i) != root(j):
                label[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(str((d, len(s), least.get(root(i)), d == least.get(root(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def copies():
    """Texts of 20 to 500 words, each with copies around the threshold."""
    rng, rows = random.Random(4), []
    vocabulary = [f"w{i}" for i in range(3000)]
    for length in (20, 50, 100, 200, 350, 500):
        for _ in range(12):
            words = rng.choices(vocabulary, k=length)
            rows.append(" ".join(words))
            rows += [edited(rng, words, max(1, round(length * share))) for share in (0.003, 0.01, 0.014, 0.018, 0.03)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_equal_to_all_pairs(spark, docs, copies):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows += [(20, "A b C d"), (21, "a B c  D"), (22, "a b c"), (23, ""), (None, "a b c d"), (7, "another text of the id seven")]
    rows += [(1000 + i, t) for i, t in copies]
    table = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, kept int")
    hand = by_hand(rows)
    assert got(minhash.near_duplicates(table)) == hand
    linked = sum(not h.endswith("True)") for h in hand)
    assert linked > 100


def test_blocks_lose_no_link(spark, copies, monkeypatch):
    """A large group of near copies that only meet each other in pairs of small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, edited(rng, words, rng.choice([1, 2, 3, 4]))) for i in range(300)] + [(300 + i, t) for i, t in copies]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(table)) == by_hand(rows)


def test_full_filter_changes_nothing(spark, copies):
    table = spark.createDataFrame(copies, "doc_id long, text string")
    members = spark.createDataFrame([(minhash._digest(minhash.shingle_set(t.encode(), minhash._Words())), i)
                                     for i, t in copies[:50]], "digest binary, least long")
    sets = minhash.full_sets(table, members, max_bits=1 << 6)
    assert sets.count() == 50


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.3, 0.85):
        found = []
        for _ in range(30):
            both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (int(2000 * share), int(2000 * (1 - share)) // 2, int(2000 * (1 - share)) // 2))
            packed = [np.frombuffer(minhash.signature(minhash.minima(np.concatenate([both, x])))[1], np.uint64)[None] for x in (a, b)]
            found.append(minhash.estimate(minhash.unlike(*packed))[0])
        assert abs(np.mean(found) - share) < 0.03


def test_links_count_full_sets():
    rng = np.random.default_rng(2)
    base = np.sort(rng.choice(1 << 40, 2000, replace=False).astype(np.uint64))
    near = np.sort(np.concatenate([base[:1900], rng.integers(1 << 41, 1 << 42, 100, dtype=np.uint64)]))
    far = np.sort(np.concatenate([base[:1800], rng.integers(1 << 41, 1 << 42, 200, dtype=np.uint64)]))
    sets, side = [base, near, far], np.array([2, 2, 2])
    assert minhash.exact_links(sets, side, 85) == [(0, 1)]  # 1900/2100 and 1800/2200
    assert minhash.exact_links(sets, side, 81) == [(0, 1), (0, 2)]
    assert minhash.exact_links(sets, np.array([0, 0, 1]), 81) == [(0, 2), (1, 2)]


def test_empty_table(spark, nothing):
    assert minhash.near_duplicates(nothing).count() == 0


def test_query_equals_all_pairs(spark, sf):
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert got(queries.QUERIES["op13_minhash"](spark, sf)) == by_hand(rows)
