"""HTML extraction by templates deduced from equivalence classes of tokens.

Tokens are tags under their path of open elements, and whole texts between tags.
A token's occurrence vector says how often each page of its host has it; tokens
of one host with equal vectors form an equivalence class.  A class is valid if
at least three pages, not all alike, have it, and either half of the host's
pages have it, or the class has tags and its pages share no long text (pages
that do are copies of one article).  A class is judged by its own pages, so a
host may have several page templates.  Texts of valid classes are the template's;
what is left between them are the slots.  Slots under menus, headers, footers,
side bars, notices, adverts, forms or comments, known by their elements' names,
are left out; if the page has an article or main element only what is inside it
counts, and nothing there is left out for being frequent.  What remains is put together as blocks.

Another method than the full one: classes are not nested or checked for order,
and slots are not told apart by type; element names decide which count.

Vectors are never gathered: they are compared by a digest, two sums of 31 bits
of one hash for each page and count, which are aggregated before the shuffle,
so a host may have any number of pages and repeated pages do not cancel.

Cases: null or empty html gives an empty text; a null url is a host of its own;
a host with fewer than three different pages has no template and its pages are
judged by their elements' names alone; cut-off tags, comments and scripts end
with the page; a head left open ends with its elements, a title, nav or header left
open at the next article or main element; an SVG, select, object or the like left
open is an element like others; a form counts as one if it has controls and little
text; a class, id or role must as a whole name a part to hide it, and hides nothing
if no text would be left; nesting of any depth takes memory in proportion; repeated
pages keep their rows; input columns named like an output column give way.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.texts import as_bytes, free_name, lower_ascii, others
from netloom.session import cut_lineage

MIN_PAGES, MIN_SHARE, LONG_TEXTS = 3, 0.5, 3
BROADCAST_BYTES = 32 << 20
PAGES_AT_ONCE = 1024  # pages whose tokens are held together

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|iframe|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<title\b[^>]*>.*?(?:</title\s*>|(?=<(?:article|main|body)\b)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD, _SPACE = re.compile(r"[a-z]+"), re.compile(r"\s+")
# Elements left out whole if they are closed, elements without content, elements that end a block, and elements never part of the article.
SKIPPED = {t: re.compile(rf"</{t}\s*>", re.I) for t in "noscript template svg math object select".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split())
OUTSIDE = frozenset("nav footer aside form button menu dialog input label fieldset".split())
# Words of class, id and role that name parts other than the article.
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar "
    "navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget notice notices alert cookie "
    "cookies consent popup modal overlay login signup subscribe newsletter share sharing social related recommended "
    "comment comments disqus reply replies respond pagination pager toolbar search form complementary contentinfo "
    "skip".split())
# Words that make a name the article's own part, that say what a page has, and that add nothing to a part's name.
OWN = frozenset("article entry post story page content main title section news text body".split())
HAS = frozenset("has no with without is not".split())
PLAIN = frozenset(
    "list container wrapper wrap box block bar area section left right top bottom inner outer item items link links "
    "button buttons icon icons unit slot panel column col row text message primary secondary main site global mobile "
    "desktop sticky fixed group holder".split())
# Elements that an article or main element ends if they were left open, and controls of a form.
ENDED_BY_MAIN = frozenset("nav header menu button label".split())
_CONTROL = re.compile(r"<(?:input\b(?![^>]*hidden)|select\b|textarea\b|button\b)", re.I)
_MARKUP = re.compile(r"<(script|style|select|textarea)\b.*?(?:</\1\s*>|\Z)|<[^>]*>", re.S | re.I)
_FORM_END = re.compile(r"</form\s*>", re.I)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
MAIN = frozenset(("article", "main"))


def names_a_part(names: str) -> bool:
    """Whether a class, id or role, as a whole, names a part other than the article.

    ``sidebar``, ``site-header`` and ``comment-list`` do; ``has-sidebar``,
    ``article-header`` and ``social-science-post`` don't.
    """
    for name in names.replace('"', " ").replace("'", " ").split():
        words = _WORD.findall(name)
        if not words or words[0] in HAS:
            continue
        if words[-1] in PARTS and not (len(words) > 1 and words[0] in OWN and words[-1] in ("header", "masthead")):
            return True
        if words[0] in PARTS and all(w in PLAIN or w in PARTS for w in words[1:]):
            return True
    return False


def _is_control_form(page: str, at: int) -> bool:
    """Whether the form that starts here is one to fill in, not the frame of a whole page."""
    end = _FORM_END.search(page, at)
    if not end:
        return False
    inner = page[at:end.start()]
    return len(_SPACE.sub(" ", _MARKUP.sub(" ", inner))) <= 200 + 100 * len(_CONTROL.findall(inner))


NONE, BY_NAME, BY_TAG = range(3)


def walk(page: str, lenient: int = 0) -> Iterator[tuple[str, int, str, int, bool, bool, bool]]:
    """Tokens of a page: (tag or empty for text, digest of the path, text or names, block, outside, in main, in link).

    ``lenient`` 1 lets an article inside a part that is one by its name count, 2
    lets names count for nothing.
    """
    stack: list[tuple[str, int, int, bool, bool]] = []  # tag, path, outside by what, in main, in link
    open_tags: dict[str, int] = {}
    at, block, path, outside, inside, link = 0, 0, 0, NONE, False, False
    unclosed: set[str] = set()

    def drop(i: int) -> None:
        nonlocal path, outside, inside, link
        for gone in stack[i:]:
            open_tags[gone[0]] -= 1
        del stack[i:]
        _, path, outside, inside, link = stack[-1] if stack else ("", 0, NONE, False, False)

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            yield "", path, page[at:m.start()], block, outside > 0, inside, link
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:  # closing
            if tag not in INLINE:
                block += 1
            for i in range(len(stack) - 1, -1, -1) if open_tags.get(tag) else ():
                if stack[i][0] == tag:
                    drop(i)
                    break
                if stack[i][0] in MAIN and tag not in MAIN and tag != "body" and tag != "html":
                    break
            continue
        if tag in SKIPPED and tag not in unclosed and not (tag in ("svg", "math") and (m[4] or "").endswith("/")):
            if end := SKIPPED[tag].search(page, at):
                at = end.end()
                continue
            unclosed.add(tag)
        if tag not in INLINE:
            block += 1
            # a block ends an open paragraph; list items, rows and cells end their like
            ends = CLOSED_BY.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name == "p" or name in ends:
                    drop(i)
                    break
                if name not in INLINE:
                    break
        attributes = m[4] or ""
        names = " ".join(_NAMES.findall(attributes)).lower() if attributes else ""
        main = tag in MAIN and "comment" not in names
        if main and any(open_tags.get(t) for t in ENDED_BY_MAIN):
            drop(next(i for i, x in enumerate(stack) if x[0] in ENDED_BY_MAIN))
        yield tag, path, names, block, outside > 0, inside, link
        # a head may be left open; what is in it is known by its own elements
        if tag in VOID or tag == "head" or attributes.endswith("/"):
            continue
        out = NONE if main and lenient and outside == BY_NAME else outside
        if not out and tag == "form":
            out = BY_NAME if tag not in unclosed and _is_control_form(page, at) else NONE
            if not out and not _FORM_END.search(page, at):
                unclosed.add(tag)
        elif tag in OUTSIDE or (tag == "header" and not inside):
            out = BY_TAG
        if out < BY_TAG and attributes and tag not in ("body", "html"):
            if _HIDDEN.search(attributes):
                out = BY_TAG
            elif not out and lenient < 2 and not main and names_a_part(names):
                out = BY_NAME
        path = xxhash.xxh64_intdigest(b"%d/%s" % (path, tag.encode()))
        outside, inside, link = out, inside or (tag in MAIN and not out), link or tag == "a"
        stack.append((tag, path, outside, inside, link))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(page):
        yield "", path, page[at:], block, outside > 0, inside, link


def _key(tag: str, path: int, text: str) -> int:
    """Digest of a token; the lowest bit is set for tags."""
    return ((xxhash.xxh64_intdigest(f"{tag}\n{path}\n{text}") - (1 << 63)) & ~1) | (tag != "")


def tokens_of(page: str) -> tuple[dict[int, int], int]:
    """Token keys of a page with their counts, and a mask with one bit for each of its longest texts."""
    counts: dict[int, int] = {}
    long: set[str] = set()
    for tag, path, text, _, outside, *_ in walk(page):
        if not tag:
            if not (text := text.strip()):
                continue
            if not outside:
                long.add(text)
        key = _key(tag, path, text)
        counts[key] = counts.get(key, 0) + 1
    mask = 0
    for text in heapq.nlargest(LONG_TEXTS, long, key=lambda t: (len(t), t)):
        mask |= 1 << xxhash.xxh64_intdigest(text) % 63
    return counts, mask


def host_of(url) -> F.Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)), F.lit(""))


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token of a batch: digest of the vector, pages, least and greatest page digest, long texts shared."""
    for batch in (b.slice(k, PAGES_AT_ONCE) for b in batches for k in range(0, max(b.num_rows, 1), PAGES_AT_ONCE)):
        found: dict[tuple[int, int], list[int]] = {}
        for host, raw in zip(batch["host_key"].to_pylist(), as_bytes(batch["html"])):
            page = (raw or b"").decode("utf-8", "replace")
            whole = xxhash.xxh64_intdigest(raw or b"") - (1 << 63)
            counts, mask = tokens_of(page)
            for token, count in [*counts.items(), (0, 1)]:
                mark = xxhash.xxh64_intdigest(b"%d %d" % (whole, count))
                known = found.get((host, token))
                if known is None:
                    found[host, token] = [mark >> 33, mark & 0x7FFFFFFF, 1, whole, whole, mask]
                else:
                    known[0] += mark >> 33
                    known[1] += mark & 0x7FFFFFFF
                    known[2] += 1
                    known[3], known[4] = min(known[3], whole), max(known[4], whole)
                    known[5] &= mask
        rows = [(*k, *v) for k, v in found.items()]
        columns = list(zip(*rows)) if rows else [()] * 8
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns],
            names=["host_key", "token", "high", "low", "n_pages", "least", "greatest", "shared"])


def deduce_templates(pages: DataFrame, url: str = "url", page_html: str = "html") -> DataFrame:
    """Per host: host_key and its template, an array of the texts of valid classes."""
    keyed = pages.select(F.xxhash64(host_of(F.col(url))).alias("host_key"), F.col(page_html).alias("html"))
    tokens = keyed.mapInArrow(_count_tokens, "host_key long, token long, high long, low long, n_pages long, "
                              "least long, greatest long, shared long")
    counted = cut_lineage(tokens.groupBy("host_key", "token").agg(
        F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n_pages").alias("n_pages"),
        F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.bit_and("shared").alias("shared")).where(
        (F.col("token") == 0) | ((F.col("n_pages") >= MIN_PAGES) & (F.col("least") < F.col("greatest")))))
    hosts = counted.where("token = 0").select("host_key", F.col("n_pages").alias("of_pages"))
    # equal vectors are one class: they have their pages, and so n_pages and shared, in common
    is_tag = F.col("token").bitwiseAND(F.lit(1)) == 1
    tagged = counted.where(is_tag & (F.col("shared") == 0)).select(
        "host_key", "high", "low", F.lit(True).alias("tagged")).distinct()
    texts = counted.where(~is_tag & (F.col("token") != 0)).join(hosts, "host_key")
    valid = texts.join(tagged, ["host_key", "high", "low"], "left").where(
        (F.col("n_pages") >= F.col("of_pages") * MIN_SHARE) | F.col("tagged"))
    return valid.groupBy("host_key").agg(F.collect_list("token").alias("template"))


_HAS_MAIN = re.compile(r"<(?:article|main)\b", re.I)


def main_text(page: str, template: set[int] | dict) -> str:
    """Main text of a page; ``template`` has the keys of the host's template texts.

    A page that seems to have none, or whose article seems to lie in a part that
    is no article's, is read again with less trust in names.
    """
    text, found = _main_text(page, template, 0)
    if not found and _HAS_MAIN.search(page):
        again, found = _main_text(page, template, 1)
        text = again if found else text
    return text or _main_text(page, template, 2)[0]


def _main_text(page: str, template: set[int] | dict, lenient: int) -> tuple[str, bool]:
    """The text, and whether it is an article's."""
    blocks: list[list] = []  # block, parts, characters in links, characters, inside
    for tag, path, text, block, outside, inside, link in walk(page, lenient):
        if tag:
            if tag == "br" and blocks and blocks[-1][0] == block:
                blocks[-1][1].append(" ")
            continue
        if outside:
            continue
        bare = text.strip()
        if bare and template and not inside and _key("", path, bare) in template:
            continue
        if not blocks or blocks[-1][0] != block:
            blocks.append([block, [], 0, 0, inside])
        last = blocks[-1]
        last[1].append(text)
        last[3] += len(bare)
        last[2] += len(bare) if link else 0
        last[4] = last[4] or inside
    if found := any(b[4] and b[3] for b in blocks):
        blocks = [b for b in blocks if b[4]]
    else:  # no article: blocks made up of links are menus
        blocks = [b for b in blocks if b[2] * 2 <= b[3]]
    lines = (_SPACE.sub(" ", html.unescape("".join(parts))).strip() for _, parts, *_ in blocks)
    return "\n".join(x for x in lines if x), found


def _extract(pages: pa.Array, templates: pa.Array) -> pa.Array:
    texts, seen = [], {}
    for raw, tokens in zip(as_bytes(pages), templates):
        known = set()
        if tokens.is_valid:
            values = tokens.values
            key = (values.offset, len(values), values[0].as_py() if len(values) else 0)
            known = seen.get(key)
            if known is None:
                known = seen[key] = set(values.to_pylist())
        texts.append(main_text((raw or b"").decode("utf-8", "replace"), known))
    return pa.StructArray.from_arrays(
        [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["text", "n_chars"])


def extract_main_text(pages: DataFrame, url: str = "url", page_html: str = "html") -> DataFrame:
    """Adds text (main text, blocks joined by line breaks) and n_chars to every page."""
    templates = cut_lineage(deduce_templates(pages, url, page_html))
    width = templates.agg(F.sum(F.size("template") * 8 + 48)).first()[0] or 0
    host, tokens = (free_name(pages, n) for n in ("host_key", "template"))
    templates = templates.select(F.col("host_key").alias(host), F.col("template").alias(tokens))
    keyed = pages.withColumn(host, F.xxhash64(host_of(F.col(url))))
    joined = keyed.join(F.broadcast(templates) if width <= BROADCAST_BYTES else templates, host, "left")
    name = free_name(pages, "main_of_page")
    kept = others(pages, "text", "n_chars")
    run = F.arrow_udf(_extract, "text string, n_chars long")
    made = joined.select(*kept, run(F.col(page_html), F.col(tokens)).alias(name))
    return made.select(*kept, F.col(name)["text"].alias("text"), F.col(name)["n_chars"].alias("n_chars"))
