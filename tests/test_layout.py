"""Hand-written cases for document layout."""

from pyspark.sql import functions as F

from netloom.operators import layout as L


def text(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr("t")).first()[0]


def test_clean_text(spark):
    got = text(spark, "Intro......1\na - b\n\n12\n\nsee http://x.org/a. [y](http://z.org) 7\nPage 3 of 9\n---\n\n\n\nend", L.clean_text)
    assert got == "Intro ... 1\na-b\n\nsee [http://x.org/a](http://x.org/a). [y](http://z.org) 7\n---\n\nend\n"


def test_page_numbers_inside_text_stay(spark):
    assert text(spark, "a\n12\nb", L.clean_text) == "a\n12\nb\n"


def test_padded_table(spark):
    rows = [["Name", "Value"], ["alpha", "1"], ["beta", "2"], ["", "longer words wrap"], ["(1)", "a note"], ["", ""]]
    df = spark.createDataFrame([(rows,)], "rows array<array<string>>")
    assert df.select(L.padded_table_markdown("rows")).first()[0] == (
        "| Name  | Value               |\n| ----- | ------------------- |\n| alpha | 1                   |\n"
        "| beta  | 2 longer words wrap |\n\n(1) a note\n")


def test_line_kinds(spark):
    cases = [("Figure 1: x", "caption"), ("• item", "list_item"), ("12. item", "list_item"), ("(a) x", "list_item"),
             ("a) x", "list_item"), ("let x = 1;", "code"), ("plain words", "text"), ("f(a)[b]", "code")]
    df = spark.createDataFrame(cases, "t string, k string")
    assert df.where(L.line_kind("t") != F.col("k")).collect() == []


def test_heading_without_tiers(spark):
    df = spark.range(1).select(
        L.heading_level(F.lit(24.0), F.lit(12.0), F.array().cast("array<double>")).alias("a"),
        L.heading_level(F.lit(15.0), F.lit(12.0), F.array().cast("array<double>")).alias("b"),
        L.heading_level(F.lit(20.0), F.lit(12.0), F.array(F.lit(30.0))).alias("c"),
        L.heading_level(F.lit(15.0), F.lit(12.0), F.array(F.lit(30.0))).alias("d"))
    assert tuple(df.first()) == (1, 3, 2, None)


def test_page_selection(spark):
    df = spark.range(1).select(L.page_selection(F.lit("3-1, 2-4 ,9,x,-2,4"), F.lit(5)))
    assert df.first()[0] == [2, 3, 4]


def test_long_padded_table(spark):
    """100,000 rows, every third one continuing the row above."""
    n = 100_000
    table = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(
        (i % 3 == 2), F.array(F.lit(""), F.lit("more than ten letters"))).otherwise(
        F.array(F.concat(F.lit("k"), i.cast("string")), F.lit("v")))).alias("rows"))
    out = table.select(L.padded_table_markdown("rows").alias("t")).select(
        F.size(F.split("t", "\n")).alias("lines"), F.regexp_count("t", F.lit("v more than ten letters")).alias("joined")).first()
    assert out.joined == n // 3 and out.lines == n - n // 3 + 2


def test_continuations_of_header_and_first_row_stay(spark):
    rows = [["Name", "Value"], ["", "longer words wrap"], ["", "and wrap again"], ["b", "1"], ["", "last long words"], ["", "end of it all"]]
    df = spark.createDataFrame([(rows,)], "rows array<array<string>>")
    lines = df.select(L.padded_table_markdown("rows")).first()[0].splitlines()
    assert [c.strip() for c in lines[2].split("|")[1:-1]] == ["", "longer words wrap and wrap again"]
    assert [c.strip() for c in lines[3].split("|")[1:-1]] == ["b", "1 last long words end of it all"] and len(lines) == 4


def test_long_headings(spark):
    """100,000 lines of one page: headings of three lines each, as far down as the first line allows."""
    lines = spark.range(100_000).select(
        F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.col("id").alias("line_no"),
        (F.lit(10_000_000) - F.col("id") * 15).cast("double").alias("y"), F.lit(20.0).alias("font_size"),
        F.when(F.col("id") < 90_000, 2).alias("level"), F.concat(F.lit(" t"), F.col("id").cast("string")).alias("text"))
    merged = L.merge_headings(lines)
    heads = merged.where("level is not null")
    assert heads.count() == 30_000 and merged.where("level is null").count() == 10_000
    assert heads.where("line_no = 3").first().text == " t3 t4 t5"


def test_repeated_lines_of_one_long_document(spark):
    """A running header over 20,000 pages goes, with the fragments at its height; the rest of 200,000 lines stays."""
    lines = spark.range(200_000).select(
        F.lit(7).alias("doc_id"), (F.col("id") / 10).cast("int").alias("page"), (F.col("id") % 10).alias("line_no"),
        (F.lit(700.0) - F.when(F.col("id") % 10 == 1, 0).otherwise(F.col("id") % 10) * 40.0).alias("y"),
        F.when(F.col("id") % 10 == 0, F.lit("Annual Report of the Company")).otherwise(
            F.concat(F.lit("unlike text number "), F.xxhash64("id").cast("string"), F.lit("x"))).alias("text"))
    left = L.strip_repeated_lines(lines)
    assert left.columns == lines.columns and left.count() == 160_000
    assert left.where("line_no < 2").count() == 0
    short = lines.where("page < 2")
    assert L.strip_repeated_lines(short).count() == 20


def test_table_of_odd_items(spark):
    """Items in any order, without x, y or text; bands of several heights, also below zero."""
    items = spark.createDataFrame([
        (1, 1, 100.4, 50.0, 2, "b"), (1, 1, 98.0, 0.0, 1, "a"), (1, 1, 95.0, 52.0, 0, "c"), (1, 1, -2.5, 3.0, 1, "e"),
        (1, 1, -2.5, 3.0, 0, "d"), (1, 1, None, 41.0, 0, " f "), (1, 1, -6.0, None, 0, "g"), (1, 1, -6.0, 200.0, 0, None),
        (1, 2, 9.0, 0.0, 0, "few"), (1, 2, 1.0, 90.0, 1, "items"), (None, 1, 9.0, 0.0, 0, "no document"),
    ], "doc_id long, page long, y double, x double, word_no long, text string")
    for order in ("word_no", "y", "text"):
        got = L.items_to_tables(items.orderBy(order)).collect()
        assert [(r.doc_id, r.page, r.rows, r.row_count, r.col_count, r.confidence) for r in got] == [
            (1, 1, [["a", "b c", ""], ["g d e", "f", ""]], 2, 3, 0.67)]


def test_document_of_odd_rows(spark):
    """Pages and lines in any order, lines without text, a page without number, a document without lines or id."""
    lines = spark.createDataFrame([
        (1, 2, 0, "c"), (1, 1, 1, "b"), (1, 1, 0, "a"), (1, 1, 2, None), (1, 3, 0, None), (1, None, 0, "lost"),
        (2, 1, 0, "x"), (None, 1, 0, "no id")], "doc_id long, page long, line_no long, text string")
    tables = spark.createDataFrame([
        (1, 2, [["h"], ["v"]]), (1, 1, [["k", "l"], ["m", ""]]), (3, 1, [["no"], ["lines"]]), (None, 1, [["no"], ["id"]])],
        "doc_id long, page long, rows array<array<string>>")
    got = {r.doc_id: r.markdown for r in L.assemble_document(lines, tables).collect()}
    assert got == {
        1: "<!-- Page 1 -->\na\nb\n\n<!-- Page 2 -->\nc\n\n<!-- Page 3 -->\n\n\n## Detected Tables\n\n"
           "| k | l |\n| --- | --- |\n| m |  |\n\n| h |\n| --- |\n| v |",
        2: "<!-- Page 1 -->\nx", None: "<!-- Page 1 -->\nno id"}
