"""Queries over tables that are folders, hold equal URLs or long lines."""

import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import checking
from netloom.operators import crawl as C
from netloom.operators import search as M
from netloom.suite.catalog import CHECKS, QUERIES


def on_table(spark, folder, name, table, rows, parts=1):
    """Runs a query and its SQL over one small table, written as a folder of files."""
    rows.repartition(parts).write.parquet(f"{folder}/{table}.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    return checking.compare(QUERIES[name](spark, str(folder)), CHECKS[name], duck)


def turns(spark, n):
    return spark.range(n).select(
        F.expr("id div 4").alias("conv_id"), F.expr("id % 4").alias("turn"),
        F.expr("case id % 2 when 0 then 'user' else 'assistant' end").alias("role"),
        F.concat(F.lit("said "), F.col("id").cast("string")).alias("text"))


@pytest.mark.parametrize("n", [40, 0])
def test_stream_over_a_folder(spark, tmp_path, n):
    assert on_table(spark, tmp_path, "t07_exchange_stream", "conversations", turns(spark, n), 3) is None


def test_a_page_fetched_twice_is_one_result(spark):
    results = spark.createDataFrame([("u", 1, "a", "x"), ("v", 2, "b", "y")], "url string, position int, title string, description string")
    docs = spark.createDataFrame([("u", "late", None, None, None), ("u", "good", None, "md", 200)],
                                 "url string, title string, description string, markdown string, status int")
    got = M.merge_fetched(results, docs).select("position", "title", "markdown", "status").orderBy("position").collect()
    assert got == [Row(position=1, title="good", markdown="md", status=200),
                   Row(position=2, title="b", markdown=None, status=None)]


def test_equal_attempts_in_any_order(spark):
    rows = [("u", 1, 404, ""), ("u", 1, 200, "text"), ("u", 2, 200, "text")]
    got = [C.best_attempt(spark.createDataFrame(r, "url string, attempt int, status int, content string").coalesce(1)).collect()
           for r in (rows, rows[::-1])]
    assert got[0] == got[1] and got[0][0].status == 200


def test_site_map_keeps_the_first_position(spark):
    schema = "url string, title string, description string, pos bigint"
    known = spark.createDataFrame([("https://a.org/long/en/page?and=more", None, None, 3), ("https://a.org/long/en/page", "T", None, 8)], schema)
    row = M.site_map(known, known.where("false"), "https://a.org/", "en page").collect()
    assert [(r.url, r.title, r.first_pos) for r in row] == [("https://a.org/long/en/page", "T", 3)]


@pytest.mark.parametrize("name", ["p04_items_to_tables", "p05_tables_to_markdown"])
def test_tables_of_long_lines(spark, tmp_path, name):
    text = F.concat_ws("\n", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(9000)), lambda i: i.cast("string")), " "),
                       F.lit("a b c"), F.lit("d e f"))
    docs = spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text"))
    assert on_table(spark, tmp_path, name, "documents", docs) is None


def test_pages_are_parsed_in_pieces():
    from netloom.operators import blocks as B

    html = ["<p>" + "word <b>bold</b> " * 500 + f"{i}</p>" for i in range(300)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(302)), "html": html})
    out = list(B._parse_batches(iter([batch])))
    assert max(o.num_rows for o in out) < 60 and sum(o.num_rows for o in out) == 302
    table = pa.Table.from_batches(out)
    assert table["page_id"].to_pylist() == list(range(302))
    texts = [b[0]["text"].rsplit(" ", 1)[-1] for b in table["blocks"].to_pylist()[:300]]
    assert texts == [str(i) for i in range(300)]
    assert list(B.pieces(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("made", ["page_markdown", "markdown_with_fallback"])
def test_filtered_markdown_is_made_once(spark, made):
    from netloom.operators import blocks as B

    html = '<article><p>a <a href="u">b<br>c</a></p><p>d</p></article>'
    pages = spark.createDataFrame([(1, "http://a.org/", html), (2, "http://a.org/b", "")], "page_id long, url string, html string")
    got = getattr(B, made)(B.page_trees(pages)).where("markdown <> ''")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython [") == 1
    assert [(r.page_id, r.markdown) for r in got.collect()] == [(1, "a [b  \\\nc](u)\n\nd")]


def test_value_cells_carry_no_arrays(spark):
    from netloom.operators import layout as L

    items = spark.createDataFrame(
        [(1, "$  5 (1.5) — 7%", 0.0, 300.0, 10.0), (2, "plain", 0.0, 20.0, 10.0), (3, "1 ab 2 3", 0.0, 300.0, 10.0)],
        "doc_id int, text string, x double, width double, font_size double")
    got = L.split_value_cells(items)
    # the array of parts ends where it is exploded
    assert re.search(r"Generate posexplode\(_parts#\d+\), \[\d+\]", got._jdf.queryExecution().optimizedPlan().toString())
    assert [r.text for r in got.orderBy("doc_id", "part").collect()] == ["$ 5", "(1.5)", "—", "7%", "plain", "1 ab 2 3"]


def planned(spark, folder, name):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a b c\nd e f").alias("text"))
    docs.write.parquet(f"{folder}/documents.parquet")
    return QUERIES[name](spark, str(folder))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["p04_items_to_tables", "p05_tables_to_markdown"])
def test_words_meet_once(spark, tmp_path, name):
    """Documents are dealt, not their words; one aggregation holds memory in a task, no window, sort or join beside it."""
    plan = planned(spark, tmp_path, name)
    assert plan.count("Exchange") == 1 and re.search(r"Exchange hashpartitioning\(doc_id#\d+L, \d+\), REPARTITION_BY_NUM", plan)
    assert plan.count("ObjectHashAggregate(") == 2 and not re.search(r"Window|Join|[+:]- (\*\(\d+\) )?Sort ", plan)


def test_document_meets_once(spark, tmp_path):
    """Lines and tables of a document meet in one aggregation, without join, sort or window."""
    plan = planned(spark, tmp_path, "p13_assemble_document")
    assert plan.count("ObjectHashAggregate(") == 4 and not re.search(r"Window|Join|[+:]- (\*\(\d+\) )?Sort ", plan)
