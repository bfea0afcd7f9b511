"""Operators on hand-made rows and registered queries on the small tables."""

import hashlib
import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checking import compare, duck
from netloom.llm import bpe, decontaminate, exact_dedup, html_main, language_id, licenses, queries, simhash
from netloom.llm import suffix_dedup, toxicity, url_filter


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_equals_sql(spark, sf, name):
    assert compare(queries.QUERIES[name](spark, sf), queries.CHECKS[name], duck(sf)) is None


def table(sf, name):
    return duckdb.sql(f"select * from '{sf}/{name}.parquet'").fetchall()


def test_exact_groups(docs):
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs).collect()}
    assert len(got) == 10
    # equal texts: most code points first, then smallest doc_id
    assert {i: got[i]["keep_id"] for i in (1, 2, 6, None)} == {1: 1, 2: 1, 6: 1, None: 1}
    assert got[1]["group_size"] == 5 and got[5]["keep_id"] == 5 and got[3]["keep_id"] == 5
    kept = exact_dedup.drop_copies(docs).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in kept] == [1, 5, 7, 8, 9] and kept[0].asDict().keys() == {"doc_id", "text", "Kept"}


def test_exact_groups_with_a_full_filter(docs):
    small = exact_dedup.exact_groups(docs, max_bits=1 << 12).select("doc_id", "keep_id").collect()
    assert sorted(map(str, small)) == sorted(map(str, exact_dedup.exact_groups(docs).select("doc_id", "keep_id").collect()))


def near_by_hand(rows):
    """component by doc row: union-find over fingerprints."""
    fps = sorted({f for _, f in rows})
    label = {f: f for f in fps}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4 and root(a) != root(b):
                label[root(a)] = root(b)
    ids = {}
    for d, f in rows:
        if d is not None:
            ids[root(f)] = min(d, ids.get(root(f), d))
    return sorted((str(d), f"{f:016x}", str(ids.get(root(f)))) for d, f in rows)


def test_near_duplicates(spark, sf, docs):
    rows = [(d, simhash.fingerprint((t or "").encode())) for d, t, *_ in table(sf, "documents")]
    got = sorted((str(r[0]), r[1], str(r[2])) for r in queries.op7_simhash(spark, sf).collect())
    assert got == near_by_hand(rows)
    made = simhash.near_duplicates(docs).collect()
    assert {r["component_id"] for r in made if r["doc_id"] in (3, 4, 5)} == {3} and len(made) == 11


def test_links_survive_split_groups(spark):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(3)]
    fps = {b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(40)} | set(base)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), block=4)
    from netloom.llm.components import components

    found = {x["node"] & (2**64 - 1): x["component"] for x in components(links, "a", "b").collect()}
    expect = {d: c for d, _, c in near_by_hand([(f, f) for f in fps])}
    groups = {}
    for f in fps:
        groups.setdefault(found.get(f, f), set()).add(expect[str(f)])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expect.values()))


def test_components_of_a_long_chain(spark):
    from netloom.llm.components import components

    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(links, "a", "b").agg(F.max("component"), F.count("*")).first()[:] == (0, 301)


def repeats_by_hand(texts, length):
    where = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            where.setdefault(t[p:p + length], []).append((i, p))
    covered = [bytearray(len(t)) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for i, p in places:
                covered[i][p:p + length] = b"\x01" * length
    return [(len(t), sum(c), len(re.findall(b"\x01+", bytes(c))), bytes(b for b, x in zip(t, c) if not x))
            for t, c in zip(texts, covered)]


@pytest.mark.parametrize("part", [suffix_dedup.PART, 700])
def test_repeats(spark, monkeypatch, part):
    monkeypatch.setattr(suffix_dedup, "PART", part)
    r = random.Random(10)
    words = ["alpha", "beta", "gamma", "delta", "é", "zeta", "eta"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = text(300)
    texts = [base, base, None, "", "short", text(300), text(90) + base[100:700] + text(90), base[:650] + "X" + base[651:],
             "ab" * 600, base[3:420], text(50) + base[200:600] + text(40) + base[200:600], text(40) + base[200:599] + text(9)]
    texts += [base[:r.randrange(400, 900)] + text(30) + base[r.randrange(500, 900):] for _ in range(12)]
    texts += [base[:at] + "Q" + base[at + 1:] for at in range(100, 1000, 37)]
    rows = spark.createDataFrame([(i if i != 4 else None, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = {r["text"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans")) + (bytes(r["kept"]),)
           for r in suffix_dedup.cut_repeats(rows).collect()}
    for t, expect in zip(texts, repeats_by_hand([(t or "").encode() for t in texts], 400)):
        assert got[t] == expect


def test_repeats_take_a_batch_in_pieces():
    r = random.Random(11)
    texts = ["".join(r.choices("abcdefgh \n", k=400_000)) for _ in range(8)] + [None, "", "short"]
    batch = pa.record_batch({"id": list(range(11)), "t": texts, "name": [b"%d" % i for i in range(11)]})
    made = list(suffix_dedup._occurrences(iter([batch])))
    assert len(made) > 2 and max(b.num_rows for b in made) < sum(b.num_rows for b in made) // 2
    seen = pa.Table.from_batches(made).to_pylist()
    assert {x["id"] for x in seen} == set(range(8)) and all(x["name"] == b"%d" % x["id"] for x in seen)

    asked = [[x | {"parts": 4, "whole": False} for x in seen if x["id"] == i] for i in range(11)]
    around = list(suffix_dedup._surroundings(iter([batch.append_column("asked", pa.array(asked))])))
    assert max(b.nbytes for b in around) < 2 * suffix_dedup.HELD
    rows = pa.Table.from_batches(around).to_pylist()
    assert sum(len(x["bytes"]) - 399 for x in rows) == sum(x["last"] - x["first"] + 1 for x in seen)
    assert all(texts[int(x["name"])].encode()[x["low"]:].startswith(x["bytes"]) for x in rows)

    ranges = pa.array([[{"first": 5, "last": 9}]] * 8 + [None] * 3)
    cut = list(suffix_dedup._cut(iter([(batch["t"], ranges)])))
    assert len(cut) > 2 and [x["n_removed"] for c in cut for x in c.to_pylist()] == [404] * 8 + [0] * 3


def test_repeats_on_the_small_table(spark, sf):
    rows = table(sf, "documents")
    expect = dict(zip([r[0] for r in rows], repeats_by_hand([(r[1] or "").encode() for r in rows], 400)))
    for r in queries.op1_suffix_dedup(spark, sf).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == expect[r["doc_id"]][:3]


def test_html_article_of_every_page(spark, sf):
    import html

    expect = {}
    for page, _, source in table(sf, "pages"):
        body = source[source.index("<article>") + 9:].split("</article>")[0]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", body)))
        expect[page] = "\n".join(x for x in (re.sub(r"\s+", " ", html.unescape(b)).strip() for b in blocks) if x)
    got = {r["page_id"]: r for r in queries.op2_html_extraction(spark, sf).collect()}
    assert {k: r["text"] for k, r in got.items()} == expect
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_template_text_is_left_out(spark):
    page = "<html><body><div>Site of all</div><div><p>{0} text that differs {0}</p></div><p>All rights kept</p></body></html>"
    rows = [(i, "http://h.example/" + str(i), page.format(i)) for i in range(6)] + [(9, None, None), (10, "x", page.format(1))]
    got = {r["page_id"]: r["text"] for r in html_main.extract_main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "3 text that differs 3" and got[9] == "" and got[10].count("\n") == 2


def test_template_of_one_kind_of_page_of_a_host(spark):
    kind = "<html><body class={1}><div class={1}>Only on {1} pages</div><div>" + (
        "<p>{0} text that differs {0}</p><p>Another text, that is {0}</p><p>The third text of page {0}</p></div></body></html>")
    copy = ("<html><body class=post7><div class=post7>A long first paragraph of one article</div><p>Its second paragraph</p>"
            "<i>Seen {0}</i></body></html>")
    rows = [(i, "http://h.example/" + str(i), kind.format(i, "a" if i < 4 else "b")) for i in range(14)]
    rows += [(20 + i, "http://h.example/c" + str(i), copy.format(i)) for i in range(3)]
    # a page captured twice stands in its class twice and must not cancel out
    rows += [(30, "http://h.example/30", rows[0][2])]
    got = {r["page_id"]: r["text"] for r in html_main.extract_main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = "{0} text that differs {0}\nAnother text, that is {0}\nThe third text of page {0}".format
    assert got[30] == own(0) and all(got[i] == own(i) for i in range(14))
    # copies of one article are no template
    assert got[21] == "A long first paragraph of one article\nIts second paragraph\nSeen 1"


def test_article_text_is_kept(spark):
    # near copies of an article are most of the host
    page = "<html><body><nav>Menu</nav><article><h1>One title</h1><p>Shared paragraph</p><p>As of day {0}</p></article></body></html>"
    rows = [(i, "http://h.example/" + str(i), page.format(i)) for i in range(5)]
    got = html_main.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"One title\nShared paragraph\nAs of day {i}" for i in range(5)}
    # end tags that may be left out, or are missing
    head = "<html><head><meta charset=utf-8><title>T</title><script>'<div>'</script>{0}<article><p>Text</article>"
    assert {html_main.main_text(head.format(x), set()) for x in ("<body>", "", "</head><body>")} == {"Text"}
    for tag in ("select", "svg", "noscript", "object"):
        assert html_main.main_text(f"<div><{tag}>gone</{tag}></div><{tag}><p>Text</p>", set()) == "Text"


def test_language_query(spark, sf):
    got = queries.op4_language_id(spark, sf).collect()
    truth = {r[0]: r[2] for r in table(sf, "documents")}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) > 0.9 * len(held)
    assert not any(r["rejected"] for r in got)


def test_texts_far_from_every_language_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, r = language_id.fit(docs), random.Random(3)
    polish = ("Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem "
              "i sumieniem i powinni postępować wobec innych w duchu braterstwa. ")
    strange = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)) for n in (200, 1000, 5000, 30000)]
    strange += ["".join(chr(0x4E00 + r.randrange(2000)) for _ in range(4000)), polish, polish * 8,
                "".join(r.choice("абвгдежзиклмнопрстуфхцчшщыэюя     ") for _ in range(4000))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(strange)], "doc_id long, text string")
    assert [x["rejected"] for x in language_id.predict_language(rows, model).collect()] == [True] * len(strange)
    held = language_id.predict_language(docs.where(language_id.held_out()), model)
    assert held.where("rejected").count() <= 0.01 * held.count()


def test_language_without_letters_or_labels(docs, nothing):
    learned = docs.withColumn("lang", F.lit("en"))
    out = {r["doc_id"]: r for r in language_id.predict_language(learned, language_id.fit(learned)).collect()}
    assert out[3]["lang_pred"] == out[5]["lang_pred"] == "und" and out[1]["lang_pred"] == "en" and out[3]["rejected"]
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.predict_language(unknown, language_id.fit(unknown)).collect()} == {"und"}


def test_toxicity_of_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r[0]: r[2] for r in table(sf, "labels")}
    got = {r["doc_id"]: r["toxic"] for r in queries.op6_toxicity(spark, sf).collect()}
    wrong = [d for d, t in truth.items() if got[d] != bool(t)]
    assert len(wrong) <= 0.02 * len(truth)


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, none, ["quality", "toxic"])
    out = toxicity.predict_toxicity(docs, chain).collect()
    assert len(out) == 11 and {r["p_toxic"] for r in out if r["doc_id"] in (3, 4, 5)} == {0.0}


def test_urls(spark):
    urls = ["http://A.Example.com/en/x", "http://www.example.com/en/?q", "https://x.net/es/1#f", "http://net/fr/", "http://b.org/",
            None, "no scheme", "http://example.com", "http://evilexample.com/en/", "http://q.net/de/", "ftp://com/://x"]
    rows = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(list(url_filter.CONTRACT_RULES), "verdict string, host string, path string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(rows, rules).collect()}
    assert got == {
        0: ("a.example.com", "example.com/en/", "block"), 1: ("www.example.com", "www.example.com/en/", "allow"),
        2: ("x.net", "net/es/", "block"), 3: ("net", "net/fr/", "block"), 4: ("b.org", None, "allow"), 5: ("", None, "allow"),
        6: ("", None, "allow"), 7: ("example.com", None, "allow"), 8: ("evilexample.com", "com/", "allow"),
        9: ("q.net", None, "allow"), 10: ("com", "com/", "allow")}
    assert url_filter.judge_urls(rows, rules.limit(0)).where("verdict = 'allow' and rule is null").count() == len(urls)


def test_licenses(spark, docs):
    mit = licenses.KNOWN[5][1]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper()), (2, "text\nreleased under the MIT licence!\nmore"), (3, None),
            (4, "Licensed under CC BY-NC 4.0."), (4, "Licensed under CC BY-NC 4.0."), (5, "!!!")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_table(spark))
    assert sorted((r["doc_id"], str(r["license_id"]), r["notices"], r["n_notices"]) for r in got.collect()) == [
        (1, "MIT", "", 0), (2, "None", "MIT", 1), (3, "None", "", 0), (4, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1),
        (4, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1), (5, "None", "", 0)]


def test_whole_licenses_in_any_wrapping(spark):
    import textwrap

    def wrapped(text, width):
        parts = re.split(r"\n\s*\n", text)
        return "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in parts)

    def found(rows):
        scanned = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_table(spark))
        return {r["doc_id"]: r["license_id"] for r in scanned.collect()}

    texts = licenses.whole_texts()
    assert len(texts) == 16
    assert found([(i, t) for i, (_, t) in enumerate(texts)]) == dict(enumerate(x for x, _ in texts))
    short = {"MIT": licenses.KNOWN[5][1], "ISC": licenses.KNOWN[6][1]} | {k: t for k, t in texts if k in ("BSD-2-Clause", "BSD-3-Clause")}
    rows, expect = [], []
    for name, text in short.items():
        for width in range(20, 120):
            title = {"MIT": "MIT License", "ISC": "ISC License"}.get(name, name.replace("-", " ") + " License")
            rows.append((len(rows), f"{title}\n\nCopyright (c) 2024, Some Author\nAll rights reserved.\n\n{wrapped(text, width)}\n"))
            expect.append(name)
    rows.append((len(rows), "Copyright Some Author\n" + short["MIT"] + " and one clause more"))
    assert found(rows) == dict(enumerate([*expect, None]))


def test_bpe_columns(spark, docs):
    t = queries.tokenizer(spark)
    out = bpe.decode_ids(bpe.encode_texts(docs, t), t).collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") and len(r["ids"]) == r["n_tokens"] for r in out)
    trip = {(r["doc_id"], r["n_tokens"]) for r in bpe.round_trip(docs, t).collect()}
    assert trip == {(r["doc_id"], r["n_tokens"]) for r in out}


def test_overlaps_in_blocks_equal_one_pass(spark, sf):
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = decontaminate.judged(decontaminate.find_overlaps(d, b)).drop("spans", "items")
    many = decontaminate.judged(decontaminate.find_overlaps(d, b, block_bytes=1500)).drop("spans", "items")
    assert sorted(map(str, one.collect())) == sorted(map(str, many.select(*one.columns).collect()))


def test_passages_are_cut_out(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Before, {passage.upper()}! After."), (2, "clean text"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, passage), (2, None), (3, "..")], "item_id long, text string")
    for cleaned in (decontaminate.remove_overlaps(decontaminate.find_overlaps(docs, items)),
                    decontaminate.clean_documents(docs, items), decontaminate.clean_documents(docs, items, block_bytes=1)):
        assert {r["doc_id"]: r["text"] for r in cleaned.collect()} == {1: "Before, ! After.", 2: "clean text", 3: None, 4: ""}


def test_empty_tables(spark, nothing):
    rules = spark.createDataFrame(list(url_filter.CONTRACT_RULES), "verdict string, host string, path string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    frames = [
        suffix_dedup.cut_repeats(nothing), html_main.extract_main_text(pages), exact_dedup.exact_groups(nothing),
        exact_dedup.drop_copies(nothing), simhash.near_duplicates(nothing), simhash.drop_near_copies(nothing),
        licenses.scan_licenses(nothing, licenses.known_table(spark)), url_filter.judge_urls(pages, rules),
        bpe.round_trip(nothing, queries.tokenizer(spark)),
        decontaminate.find_overlaps(nothing, spark.createDataFrame([], "item_id long, text string"))]
    assert all(f.count() == 0 for f in frames)


def test_hand_made_rows_everywhere(spark, docs):
    assert suffix_dedup.cut_repeats(docs).count() == 11
    assert simhash.drop_near_copies(docs).columns == docs.columns
    assert licenses.scan_licenses(docs, licenses.known_table(spark)).count() == 11
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_overlaps(docs, none).where("size(spans) = 0").count() == 11


def test_benchmark_items_without_an_id(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"x {passage} y"), (2, "short item"), (3, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage), (None, "short item"), (5, passage), (6, None), (None, None)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.judged(decontaminate.find_overlaps(docs, items)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_hit, got[1].n_items, got[1].items_sha256) == (11, 2, sha("5"))
    assert (got[2].n_hit, got[2].n_items, got[2].items_sha256) == (2, 1, sha("")) and not got[3].contaminated
    # blocks of one item each give the same, and so does the checking SQL
    parts = decontaminate.judged(decontaminate.find_overlaps(docs, items, block_bytes=1)).collect()
    assert {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in parts} == {
        i: (r.n_hit, r.n_items, r.items_sha256) for i, r in got.items()}
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.execute("create table benchmark (item_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", [tuple(r) for r in docs.collect()])
    c.executemany("insert into benchmark values (?, ?)", [tuple(r) for r in items.collect()])
    sql = c.execute(queries.CHECKS["op10_decontamination"] + " order by 1").fetchall()
    assert [(r[0], r[2], r[3], r[4]) for r in sql] == [(i, got[i].n_hit, got[i].n_items, got[i].items_sha256) for i in (1, 2, 3)]
    assert decontaminate.clean_documents(docs, items).where("doc_id = 1").first().text.split() == ["x", "y"]


def test_fit_takes_no_more_than_its_sample(spark, monkeypatch):
    """Rows that share one id, or no id, and one text do not pass the bound; nor do many languages."""
    seen = []
    monkeypatch.setattr(language_id, "Model", lambda counts, languages: seen.append((len(counts), set(languages))))
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("ab "), (F.col("id") % 50).cast("string"), F.lit("c")).alias("text"),
                                    F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("lang"))
    language_id.fit(same, sample=400)
    many = spark.range(3000).select("id", F.concat(F.lit("ab c"), F.col("id").cast("string")).alias("text"),
                                    (F.col("id") % 90).cast("string").alias("lang")).withColumnRenamed("id", "doc_id")
    language_id.fit(many, sample=400)
    assert seen[0][0] <= 400 and seen[0][1] == {"x", "y"} and 0 < seen[1][0] <= 400 and len(seen[1][1]) <= 20


def test_pieces_across_blanks_are_cut_by_the_pattern():
    import public_tokenizers

    assert bpe.cuts_at_blanks(public_tokenizers.PATTERN)
    assert not bpe.cuts_at_blanks(r"\w+ \w+|\S+|\s+") and not bpe.cuts_at_blanks(r"\d+ \d+|\S+|\s+") and not bpe.cuts_at_blanks(r"\S+|\s+")
    ranks = {bytes([b]): b for b in range(256)} | {b"a b": 256, b"ab": 257, b" b": 258}
    ranks[b"a b"], ranks[b" b"] = 258, 256
    vocabulary = bpe.Vocabulary(ranks, r"\w+ \w+|\S+|\s+")
    encoder = bpe.Encoder(vocabulary, words=bpe.cuts_at_blanks(vocabulary.pattern))
    assert encoder.decode(encoder.encode("a b ab a\nb")) == b"a b ab a\nb"
    assert list(encoder.encode("a b"))[::4] == [2] or encoder.encode("a b")[:4] == (258).to_bytes(4, "little")


def test_articles_in_wrappers_are_found():
    """Layouts in which a name, a form or an element left open stands around the article."""
    article = "<article><h1>Head</h1><p>First paragraph.</p><p>Second paragraph.</p></article>"
    want = "Head\nFirst paragraph.\nSecond paragraph."
    whole = "<html><head><title>T</title></head><body>{}</body></html>".format
    layouts = [
        f'<div id="page" class="has-sidebar">{article}</div>', f'<div class="no-sidebar"><main>{article}</main></div>',
        f'<div class="social-science-post">{article}</div>', f'<form action="/x"><input type=hidden name=v>{article}</form>',
        f'<nav><a href="/">Home</a>{article}', f'<div class="sidebar">{article}</div>', f'<div class="page-with-header">{article}</div>',
        f'<header class="site-header">Logo{article}', f'<div class="related-content">{article}</div>']
    for layout in layouts:
        assert html_main.main_text(whole(layout), set()) == want, layout
    assert html_main.main_text(f"<html><head><title>Never closed<body>{article}", set()) == want
    headline = '<article><div class="article-header"><h1>Head</h1></div><p>First paragraph.</p><p>Second paragraph.</p></article>'
    assert html_main.main_text(whole(headline), set()) == want
    text = "<p>" + "A long paragraph of a page without an article. " * 20 + "</p>"
    assert html_main.main_text(whole(f"<form><div>{text}<input name=q></div></form>"), set()) == text[3:-5]
    assert html_main.main_text(whole(f'<div class="sidebar">{text}</div>'), set()) == text[3:-5]


def test_parts_of_other_kinds_stay_hidden():
    article = "<article><p>Text</p></article>"
    for part in ('<div class="sidebar">x</div>', '<div id="site-header">x</div>', '<ul class="comment-list"><li>x</ul>',
                 '<section class="related"><article><p>x</p></article></section>', "<aside><article>x</article></aside>",
                 '<div class="comments"><article class="comment">x</article></div>', '<div class="cookie-notice">x</div>',
                 '<form><label>x</label><input name=q><button>go</button></form>', "<nav>x</nav>", '<div class="main-nav">x</div>',
                 '<div class="ad">x</div>', "<div hidden>x</div>", '<div role="navigation">x</div>'):
        for page in (f"<body>{part}{article}</body>", f"<body>{article}{part}</body>"):
            assert html_main.main_text(page, set()) == "Text", page
        plain = f"<body>{part}<p>Only text</p></body>"
        assert html_main.main_text(plain, set()) == "Only text" or "<article" in part, plain


def test_deep_pages_take_memory_in_proportion():
    import time
    import tracemalloc

    page = "<body>" + "<div class=x>" * 100_000 + "<article><p>Deep</p></article>" + "</div>" * 100_000
    tracemalloc.start()
    began = time.time()
    assert html_main.main_text(page, set()) == "Deep"
    assert tracemalloc.get_traced_memory()[1] < 100 << 20 and time.time() - began < 60
    tracemalloc.stop()
