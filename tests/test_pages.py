"""Hand-written pages: links, images, metadata, blocks, markdown."""

from pyspark.sql import functions as F

from netloom.operators import blocks as B
from netloom.operators import pages as P

PAGE = """<!DOCTYPE html><html lang="en"><head><title>Hello &amp; bye</title>
<base href="/root/"><meta name="description" content="one"><meta name="description" content="two">
<meta property="og:title" content="OG"><meta name="kw" content="a"><meta name="kw" content="b">
<link rel="shortcut icon" href="/f.ico"></head><body>
<header>top</header><nav><a href="/n">nav</a></nav>
<div class="sidebar"><p id="main">kept</p></div>
<article><h2>Title</h2><p>Some <b>bold</b> and <a href="x y.html">link</a></p>
<script>document.write('<a href="/no">no</a>')</script><!-- <a href="/no2">no</a> -->
<img src="a.png" data-src="b.png" srcset="c.png 1x, d.png 2x"><a href='#top'>t</a><a href=../up>u</a></article>
<div class="ad" data-x="7">advert</div></body></html>"""


def frame(spark, html=PAGE, url="https://www.example.com/dir/page"):
    return spark.createDataFrame([(1, url, html)], "page_id bigint, url string, html string")


def test_links_follow_the_base(spark):
    got = [r.link for r in P.extract_links(frame(spark)).orderBy("pos").collect()]
    assert got == ["https://www.example.com/n", "https://www.example.com/root/x y.html", "https://www.example.com/up"]


def test_regex_links_agree_with_the_tree(spark):
    by_tree = {dict(r.attrs).get("href") for r in B.page_nodes(frame(spark)).where("tag = 'a'").collect()}
    by_regex = set(frame(spark).select(F.explode(P.hrefs(F.col("html")))).toPandas()["col"])
    assert by_tree == by_regex


def test_images(spark):
    got = {r.image for r in P.extract_images(frame(spark)).collect()}
    root = "https://www.example.com/root/"
    assert got == {root + n for n in ("a.png", "b.png", "c.png", "d.png")} | {"https://www.example.com/f.ico"}


def test_metadata(spark):
    m = P.extract_metadata(frame(spark)).first()
    assert m.title == "Hello & bye" and m.description == "one, two" and m.ogTitle == "OG"
    assert m.metadata["kw"] == ["a", "b"] and m.favicon == "/f.ico"


def test_title_is_backfilled(spark):
    html = '<html><head><meta name="twitter:title" content="T"></head></html>'
    assert P.extract_metadata(frame(spark, html)).first().title == "T"


def test_main_content_keeps_marked_regions(spark):
    rows = B.main_content(B.page_trees(frame(spark))).orderBy("pos").collect()
    assert [r.text for r in rows][:3] == ["kept", "Title", "Some bold and link"]
    assert not any("advert" in r.text or "nav" in r.text for r in rows)
    only = B.main_content(B.page_trees(frame(spark)), include=("article",), exclude=("h2",)).collect()
    assert [r.text for r in only][0].startswith("Some")


def test_markdown(spark):
    md = B.page_markdown(B.page_trees(frame(spark))).first().markdown
    assert "## Title" in md and "Some **bold** and [link](x y.html)" in md
    empty = frame(spark, "<html><body><nav>only nav</nav></body></html>")
    row = B.markdown_with_fallback(B.page_trees(empty)).first()
    assert row.fell_back and row.markdown == "only nav"


def test_attributes(spark):
    got = B.extract_attributes(B.page_trees(frame(spark)), [(".ad", "x"), ("#main", "id"), ("a[", "href")])
    assert {r.selector: list(r["values"]) for r in got.collect()} == {".ad": ["7"], "#main": ["main"], "a[": []}


def test_link_cleanup(spark):
    df = spark.createDataFrame([("[a\nb](u)\nc [Skip to content](#x)d",)], "md string")
    assert df.select(B.clean_markdown_links("md")).first()[0] == "[a\\\nb](u)\nc d"


def test_srcset(spark):
    df = spark.createDataFrame([("a 1x, b 3x, c 2x", "s"), ("a 100w, b 300w", "s"), ("a 0.5x", "s"), ("a", None)],
                               "srcset string, src string")
    assert [r[0] for r in df.select(P.biggest_srcset("srcset", "src")).collect()] == ["b", "b", "s", "a"]


def test_frames_of_any_depth(spark):
    from urllib.parse import quote

    from netloom.operators.pages import data_iframe_links

    page = '<a href="/deep6">x</a>'
    for n in range(5, -1, -1):
        page = f'<a href="/deep{n}">x</a><iframe src="data:text/html,{quote(page)}"></iframe>'
    pages = spark.createDataFrame([(1, "https://h.com/", page)], "page_id bigint, url string, html string")
    got = {r.link: r.frame_depth for r in data_iframe_links(pages).collect()}
    assert got == {f"https://h.com/deep{n}": n for n in range(7)}


def test_escaped_breaks_of_long_texts(spark):
    """Against a running depth, on random texts and on one of 100,000 lines."""
    import random

    from netloom.operators.blocks import clean_markdown_links

    rng = random.Random(8)
    texts = ["".join(rng.choice("[]]\nab[é") for _ in range(40)) for _ in range(300)]
    texts += ["[a\n" * 100_000 + "]\n" * 100_000, "[\n]\n]\n[\n", "no brackets\nhere", "", None]

    def by_hand(text):
        depth, out = 0, []
        for c in text:
            depth = depth + 1 if c == "[" else max(depth - 1, 0) if c == "]" else depth
            out.append("\\\n" if c == "\n" and depth > 0 else c)
        return "".join(out)

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(df.select("i", clean_markdown_links("t")).collect())
    assert [got[i] for i in range(len(texts))] == [t if t is None else by_hand(t) for t in texts]
