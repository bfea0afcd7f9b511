"""Hand-written rows for URL expressions."""

import pytest
from pyspark.sql import functions as F

from netloom.functions import url as U


def values(spark, rows, schema, *exprs):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*exprs).collect()]


@pytest.mark.parametrize("href,base,expected", [
    ("https://a.com/x", "https://b.com/y", "https://a.com/x"),
    ("//c.com/p", "https://b.com/y", "https://c.com/p"),
    ("//c.com", "https://b.com/y", "https://c.com/"),
    ("/p?q=1", "https://B.com:443/y/z", "https://b.com/p?q=1"),
    ("p", "https://b.com/y/z", "https://b.com/y/p"),
    ("../p", "https://b.com/y/z/w", "https://b.com/y/p"),
    ("../../../p", "https://b.com/y/z", "https://b.com/p"),
    ("./a/./b/..", "https://b.com/y/", "https://b.com/y/a/"),
    ("?q", "https://b.com/y/z?old#f", "https://b.com/y/z?q"),
    ("#top", "https://b.com/y", ""),
    ("mailto:a@b.c", "https://b.com", "mailto:a@b.c"),
    ("http:/x.com/a", "https://b.com", "http://x.com/a"),
    ("p", "https://b.com", "https://b.com/p"),
    ("", "https://b.com/y#f", "https://b.com/y"),
    ("javascript:void(0)", "https://b.com", "javascript:void(0)"),
])
def test_resolve(spark, href, base, expected):
    got = values(spark, [(href, base)], "h string, b string", U.resolve_url("h", "b"))
    assert got == [(expected,)]


@pytest.mark.parametrize("url,expected", [
    ("https://example.com/a#section", "https://example.com/a"),
    ("https://example.com/#/route", "https://example.com/#/route"),
    ("https://example.com/#!/route", "https://example.com/#!/route"),
    ("https://example.com/##", "https://example.com/"),
    ("https://example.com/#/", "https://example.com/"),
    ("https://EXAMPLE.com:443?x=1", "https://example.com/?x=1"),
    ("http://u:p@example.com:8080/a b", "http://example.com:8080/a b"),
])
def test_normalize(spark, url, expected):
    assert values(spark, [(url,)], "u string", U.normalize_url("u")) == [(expected,)]


def test_canonical_and_host(spark):
    rows = [("https://www.example.com/",), ("http://example.com/a/",), ("www.example.com/x",), ("example.com",)]
    got = values(spark, rows, "u string", U.canonical_url("u"), U.hostname_only("u"))
    assert got == [("example.com", "example.com"), ("example.com/a", "example.com"),
                   ("example.com/x", "example.com"), ("example.com", "example.com")]


def test_base_domain(spark):
    rows = [("https://blog.example.co.uk/x",), ("https://example.co.uk",), ("https://co.uk",),
            ("http://www.example.com/",), ("http://a.b.example.com",), ("http://10.0.0.1/x",), ("nope",)]
    got = values(spark, rows, "u string", U.base_domain("u"), U.is_base_domain("u"))
    assert got == [("example.co.uk", False), ("example.co.uk", True), (None, False), ("example.com", True),
                   ("example.com", False), (None, False), (None, False)]


def test_public_suffix_rules(spark):
    rows = [("http://a.b.city.kawasaki.jp/",), ("http://x.y.foo.kawasaki.jp/",), ("http://a.www.ck/",), ("http://a.b.co.ck/",),
            ("http://shop.example.com.ng/",), ("http://x.gov.sg/",), ("http://me.github.io/",), ("http://kawasaki.jp/",),
            ("http://a.unknowntld/",), ("http://x.notco.uk/",)]
    got = [r[0] for r in values(spark, rows, "u string", U.base_domain("u"))]
    assert got == ["city.kawasaki.jp", "y.foo.kawasaki.jp", "www.ck", "b.co.ck", "example.com.ng", "x.gov.sg", "me.github.io",
                   None, "a.unknowntld", "notco.uk"]


def test_capture_files_of_either_form(spark, tmp_path):
    from netloom.sources.readers import read_fetch_capture

    record = '{"time": 1, "options": {"url": "http://a/"}, "result": {"status": 200}}'
    (tmp_path / "lines.json").write_text("\n".join([record] * 5) + "\n")
    (tmp_path / "array.json").write_text("[" + record + ",\n" + record + "]")
    (tmp_path / "pretty.json").write_text('{\n  "time": 1,\n  "options": {"url": "http://a/"},\n  "result": {"status": 200}\n}\n')
    assert read_fetch_capture(spark, str(tmp_path)).where("status = 200").count() == 8
    assert read_fetch_capture(spark, str(tmp_path / "lines.json"), "lines").where("status = 200").count() == 5
    for name, rows in (("array", 2), ("pretty", 1)):
        assert read_fetch_capture(spark, str(tmp_path / f"{name}.json"), "document").where("status = 200").count() == rows


def test_spellings_in_sql_equal_the_column(spark):
    from netloom.extensions import register_sql

    register_sql(spark)
    urls = ["https://example.com:8443/x/", "http://www.example.com:80/", "https://example.com:443/a?b=1#c", "http://h.example/i/index.php"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    column = {(r.u, r.s) for r in df.select("u", F.explode(U.url_permutations("u")).alias("s")).collect()}
    sql = {(r.u, r.s) for r in spark.sql("select u, t.spelling as s from {df}, lateral url_spellings(u) t", df=df).collect()}
    assert column == sql


def test_robots_files_by_name_and_folder(spark, tmp_path):
    from netloom.sources.readers import read_robots

    (tmp_path / "host=a.example").mkdir()
    (tmp_path / "host=a.example" / "part-0.txt").write_text("User-agent: *\n")
    (tmp_path / "B.example.txt").write_text("User-agent: x\n")
    assert {r.host for r in read_robots(spark, f"{tmp_path}/host=*/*.txt").collect()} == {"a.example"}
    assert {r.host for r in read_robots(spark, f"{tmp_path}/*.txt").collect()} == {"b.example"}


def test_suffix_table_takes_the_longest_match(spark):
    hosts = spark.createDataFrame([("a.b.city.kawasaki.jp",), ("x.github.io",), ("one",), ("a.www.ck",), ("a.b.c.ck",)], "host string")
    rules = ("jp", "city.kawasaki.jp", "io", "github.io", "ck", "*.ck", "!www.ck")
    table = spark.createDataFrame([(r,) for r in rules], "suffix string")
    got = {r.host: r.base_domain for r in U.with_base_domain(hosts, table).collect()}
    assert got == {"a.b.city.kawasaki.jp": "b.city.kawasaki.jp", "x.github.io": "x.github.io", "one": None,
                   "a.www.ck": "www.ck", "a.b.c.ck": "b.c.ck"}
    # the column form reads the same rules
    assert got == {r.host: r.d for r in hosts.select("host", U.base_domain_of_host(F.col("host"), rules).alias("d")).collect()}


def test_every_public_suffix(spark):
    """Of ``x.y.<suffix>``, for all rules of the list, what a plain reading of the rules gives."""
    rules = U.public_suffixes()
    plain, wild, never = ({r for r in rules if r[0] not in "*!"}, {r[2:] for r in rules if r[0] == "*"},
                          {r[1:] for r in rules if r[0] == "!"})

    def by_hand(host):
        labels = host.split(".")
        runs = [".".join(labels[-k:]) for k in range(1, len(labels) + 1)]
        size = max([k + (run in wild) for k, run in enumerate(runs, 1) if run in plain or run in wild], default=1)
        size = max([k - 1 for k, run in enumerate(runs, 1) if run in never], default=size)
        return ".".join(labels[-size - 1:]) if len(labels) > size else None

    hosts = [h for r in rules for h in (r.lstrip("*.!"), "x." + r.lstrip("*.!"), "x.y." + r.lstrip("*.!"))]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, h string")
    got = dict(df.select("i", U.base_domain_of_host(F.col("h"))).collect())
    assert [got[i] for i in range(len(hosts))] == [by_hand(h) for h in hosts]


def test_odd_hosts_have_no_domain(spark):
    rows = [("",), (".",), ("example.com.",), (".example.com",), ("a..com",), (None,), ("1.2.3.4",), ("[::1]",), ("com",)]
    df = spark.createDataFrame(rows, "h string")
    assert {r[0] for r in df.select(U.base_domain_of_host(F.col("h"))).collect()} == {None, "example.com"}


def test_permutations_are_closed(spark):
    df = spark.createDataFrame(
        [("https://example.com",), ("http://www.example.com/a/index.php",), ("https://example.com/a/b?q=1#f",),
         ("https://example.com:8443/x/",)], "u string")
    one = df.select("u", F.explode(U.url_permutations("u")).alias("p"))
    sizes = {r.u: r.n for r in one.groupBy("u").agg(F.count("*").alias("n")).collect()}
    assert sizes["https://example.com"] == 12 and sizes["https://example.com/a/b?q=1#f"] == 16
    both = one.select("u", F.array_sort(U.url_permutations("p")).alias("q")).distinct()
    assert both.count() == 4
    keys = one.select("u", U.similar_url_key("p").alias("k")).distinct()
    assert keys.count() == 4


@pytest.mark.parametrize("url,ok,reason", [
    ("example.com", True, None), ("https://example.com/a", True, None), ("file:///tmp/a.pdf", True, None),
    ("http://http://example.com", False, "invalid_protocol"), ("ftp://example.com", False, "unsupported_protocol"),
    ("https://localhost", False, "no_top_level_domain"), ("пример.рф", True, None),
])
def test_validate(spark, url, ok, reason):
    v = U.validate_url("u")
    assert values(spark, [(url,)], "u string", v["ok"], v["reason"]) == [(ok, reason)]


@pytest.mark.parametrize("url,expected", [
    ("https://docs.google.com/document/d/abc-1/edit", "https://docs.google.com/document/d/abc-1/export?format=html"),
    ("https://docs.google.com/document/d/e/abc/pub", None),
    ("https://drive.google.com/file/d/f_1/view", "https://drive.google.com/uc?export=download&id=f_1"),
    ("https://docs.google.com/spreadsheets/d/s1/edit?gid=5#gid=5",
     "https://docs.google.com/spreadsheets/d/s1/gviz/tq?tqx=out:html&gid=5"),
    ("https://example.com", None),
])
def test_export_links(spark, url, expected):
    assert values(spark, [(url,)], "u string", U.rewrite_export_url("u")) == [(expected,)]


def test_content_route(spark):
    rows = [("https://a.com/x.pdf", None, None), ("https://a.com/x.docx", "application/pdf", None),
            ("https://a.com/x", "application/octet-stream", "%PDF-1.7"), ("https://a.com/x.PNG", None, None),
            ("https://a.com/x.png", "text/html", None), ("https://a.com/x", "application/octet-stream", "PK\x03")]
    got = values(spark, rows, "u string, c string, h string", U.content_route("u", "c", "h"))
    assert [g[0] for g in got] == ["pdf", "document", "pdf", "html", "skip", "document"]


def test_countries(spark):
    codes = U.country_table(spark)
    assert codes.count() in (250, 251)
    df = spark.createDataFrame([("us",), ("xx",), (None,), ("US-Generic",)], "country string")
    got = [(r.country_ok, r.country_used) for r in U.locale_ok(df, codes).collect()]
    assert sorted(got, key=str) == sorted(
        [(True, "us"), (False, None), (True, "us-generic"), (True, "us-generic")], key=str)
