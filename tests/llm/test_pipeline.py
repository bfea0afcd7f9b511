"""The pipeline's stages against brute force, stage by stage."""

import hashlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import tiktoken
from netloom.llm import bpe, decontaminate, exact_dedup, simhash
from test_operators import near_by_hand


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "decontamination", "byte_bpe"]
    (_, language), (_, exact), (_, near), (_, clean), (_, encode) = corpus_pipeline.STAGES
    one = language(spark, docs, sf).cache()
    assert one.count() == docs.count() and one.columns == docs.columns

    rows, best = {r["doc_id"]: r for r in one.collect()}, {}
    for r in rows.values():
        key = r["text"].encode().translate(None, b" \t\n\x0b\x0c\r")
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(r["text"]), r["doc_id"]))
    two = exact(spark, one, sf).cache()
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(d for _, d in best.values())

    rows = [(r["doc_id"], simhash.fingerprint(r["text"].encode())) for r in two.collect()]
    three = near(spark, two, sf).cache()
    assert sorted(str(r["doc_id"]) for r in three.collect()) == sorted(d for d, _, c in near_by_hand(rows) if d == c)

    four = clean(spark, three, sf).cache()
    windows = set()
    for (text,) in duckdb.sql(f"select text from '{sf}/benchmark.parquet'").fetchall():
        w = decontaminate.words_of(text.encode())
        windows |= {tuple(w[i:i + 10]) for i in range(len(w) - 9)}
    before, after = ({r["doc_id"]: r["text"] for r in f.collect()} for f in (three, four))
    for doc, text in before.items():
        w = decontaminate.words_of(text.encode())
        hit = {k for i in range(len(w) - 9) if tuple(w[i:i + 10]) in windows for k in range(i, i + 10)}
        assert decontaminate.words_of(after[doc].encode()) == [x for i, x in enumerate(w) if i not in hit]
        assert hit or after[doc] == text

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in encode(spark, four, sf).collect():
        ids = np.array(oracle.encode_ordinary(r["text"]), "<u4").tobytes()
        assert r["n_tokens"] * 4 == len(ids) and r["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    assert exact_dedup.filter_bits(10) == 12


def test_one_row_of_each_component_stays(spark):
    """Null and repeated ids: of each group of linked texts exactly one row stays, that of the smallest id."""
    a, b, c = "one two three four five six", "another text of its own kind here", "third thing that is like nothing else"
    rows = [(5, a, "x"), (None, a, "y"), (7, b, "x"), (7, b, "y"), (None, c, "x"), (None, c, "y"), (9, "", "z"), (9, a, "w")]
    table = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.drop_near_copies(table)
    assert kept.columns == table.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("5", a), ("7", b), ("None", c), ("9", "")])
    single = spark.createDataFrame([r for r in rows if r[0] in (5, None)][:2], table.schema)
    assert [r.doc_id for r in simhash.drop_near_copies(single).collect()] == [5]
    assert simhash.drop_near_copies(table.limit(0)).count() == 0
