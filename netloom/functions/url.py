"""URL expressions.

Every function takes and returns a Column, so a call stays inside whole-stage
codegen and never needs a Python worker.  URLs are read the way browsers read
them (leading/trailing blanks ignored, scheme and host case-folded, default
port dropped); Spark's own ``parse_url`` follows java.net.URI instead and fails
on inputs such as a blank in the path.  Text is kept raw: nothing is
percent-encoded here.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.tables import (
    ADSERVER_DOMAINS,
    DOCUMENT_CONTENT_TYPES,
    DOCUMENT_EXTENSIONS,
    SKIPPED_FILE_EXTENSIONS,
)

_NAME = r"[A-Za-z][A-Za-z0-9+.\-]*"
_SCHEME = rf"^({_NAME}):"
_HOST = rf"^{_NAME}://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"
_PORT = rf"^{_NAME}://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):([0-9]+)"
_ROOT = rf"^({_NAME}://[^/?#]*)"
_PATH = rf"^(?:{_NAME}:)?(?://[^/?#]*)?([^?#]*)"
_FOLDER = rf"^{_NAME}://[^/?#]*(/(?:[^?#]*/)?)"
_VALID = r"^(?i)(https?|ftp|wss?)://([^/?#@\s]*@)?[^/?#@:\s<>^|%\\]+(:[0-9]*)?([/?#]|$)"


def _col(url) -> Column:
    return F.col(url) if isinstance(url, str) else url


def _clean(url) -> Column:
    return F.trim(_col(url))


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_clean(url), _SCHEME, 1))


def host(url) -> Column:
    """Lower-cased host name, empty when the text has no authority."""
    return F.lower(F.regexp_extract(_clean(url), _HOST, 1))


def port(url) -> Column:
    """Explicit port; NULL when absent or when it is the scheme's default."""
    number = F.regexp_extract(_clean(url), _PORT, 1)
    default = _clean(url).rlike(r"^(?i)(http://[^/?#]*:80|https://[^/?#]*:443)([/?#]|$)")
    return F.when(~default, number.try_cast("int"))


def _slash_if_empty(text: Column) -> Column:
    return F.regexp_replace(text, "^$", "/")


def path(url) -> Column:
    return _slash_if_empty(F.regexp_extract(_clean(url), _PATH, 1))


def query(url) -> Column:
    """Query text without the question mark, empty when absent."""
    return F.regexp_extract(_clean(url), r"^[^?#]*\?([^#]*)", 1)


def fragment(url) -> Column:
    """Fragment text without the hash sign, empty when absent."""
    return F.regexp_extract(_clean(url), r"^[^#]*#(.*)$", 1)


def is_web_url(url) -> Column:
    """True when the text is an absolute URL with a usable host."""
    return F.coalesce(_clean(url).rlike(_VALID), F.lit(False))


def origin(url) -> Column:
    """scheme://host[:port] with user data and the default port dropped."""
    root = F.lower(F.regexp_extract(_clean(url), _ROOT, 1))
    return F.regexp_replace(
        F.regexp_replace(root, r"://[^@]*@", "://"),
        r"^(?:(http://.*):80|(https://.*):443|(.*?):?)$", "$1$2$3")


def url_parts(url) -> Column:
    return F.struct(
        scheme(url).alias("scheme"),
        host(url).alias("host"),
        port(url).alias("port"),
        path(url).alias("path"),
        query(url).alias("query"),
        fragment(url).alias("fragment"),
    )


# --- resolving -------------------------------------------------------------


def _fold_dots(segments: Column) -> Column:
    """Resolve `.` and `..` in an array of path segments."""
    empty = F.array().cast("array<string>")

    def step(acc, seg):
        return (
            F.when(seg.isin(".", "%2e", "%2E"), acc)
            .when(
                seg.isin("..", ".%2e", "%2e.", "%2e%2e"),
                F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc),
            )
            .otherwise(F.concat(acc, F.array(seg)))
        )

    return F.aggregate(segments, empty, step)


def resolve_dots(path_text: Column) -> Column:
    """Path with dot segments folded; untouched (and cheap) when it has none."""
    folded = F.array_join(_fold_dots(F.split(path_text, "/")), "/")
    ends_in_dots = path_text.rlike(r"/\.{1,2}$")
    folded = F.when(ends_in_dots, F.concat(folded, F.lit("/"))).otherwise(folded)
    return F.when(path_text.rlike(r"(^|/)(\.|%2e|%2E)"), folded).otherwise(path_text)


def repair_slashes(href) -> Column:
    """`http:/x` and `https:/x` become `http://x` and `https://x`."""
    return F.regexp_replace(_col(href), r"^(https?):/([^/]|$)", "$1://$2")


def clean_href(href) -> Column:
    return F.trim(repair_slashes(href))


def resolve_clean(h: Column, base: Column) -> Column:
    """:func:`resolve_url` for a link already passed through ``clean_href``."""
    root = origin(base)
    folder = _slash_if_empty(F.regexp_extract(base, _FOLDER, 1))
    rooted = h.startswith("/")
    full_path = F.concat(
        F.when(rooted, "").otherwise(folder), F.regexp_extract(h, r"^([^?#]*)", 1))
    tail = F.regexp_replace(h, r"^[^?#]*", "")
    return (
        F.when(h.rlike(r"^(https?://|mailto:)"), h)
        .when(h.startswith("#"), "")
        .when(h.rlike(_SCHEME), h)
        .when(h.startswith("//"), F.concat(
            scheme(base), F.lit(":"), F.regexp_replace(h, r"^(//[^/?#]+)$", "$1/")))
        .when(h == "", F.regexp_replace(base, r"#.*$", ""))
        .when(h.startswith("?"), F.concat(root, path(base), h))
        .otherwise(F.concat(root, resolve_dots(full_path), tail))
    )


def resolve_url(href, base) -> Column:
    """Absolute form of a link against its base; empty text for in-page anchors.

    Absolute http(s) and mailto links are returned as written.
    """
    return resolve_clean(clean_href(href), _clean(base))


# --- keys ------------------------------------------------------------------


def _search(url, ignore_query: bool) -> Column:
    """Query with its question mark, empty when there is none."""
    return F.lit("") if ignore_query else F.regexp_extract(_clean(url), r"^[^?#]*(\?[^#]+)", 1)


def normalize_url(url, ignore_query: bool = False) -> Column:
    """Crawl key of a URL: fragment dropped unless it is a client-side route."""
    return F.concat(
        origin(url), resolve_dots(path(url)), _search(url, ignore_query), _route(url))


def _route(url) -> Column:
    """Fragment that is a client-side route, with its hash sign; else empty."""
    return F.regexp_extract(_clean(url), r"^[^#]*(#/.+|#!/.*)$", 1)


def canonical_url(url) -> Column:
    bare = F.regexp_replace(F.regexp_replace(_col(url), r"^https?://", ""), r"^www\.", "")
    return F.regexp_replace(bare, r"/$", "")


def strip_www(name: Column) -> Column:
    return F.regexp_replace(name, r"^www\.", "")


def hostname_only(url) -> Column:
    loose = F.regexp_replace(F.regexp_replace(_col(url), r"^https?://", ""), r"^www\.", "")
    return F.when(is_web_url(url), strip_www(host(url))).otherwise(
        F.split(loose, "/", 2).getItem(0)
    )


def path_depth(path_text: Column) -> Column:
    return F.size(F.filter(
        F.split(path_text, "/"), lambda s: ~s.isin("", "index.php", "index.html")))


def url_depth(url) -> Column:
    return path_depth(path(url))


def adjusted_max_depth(seed, extra) -> Column:
    return url_depth(seed) + (F.lit(extra) if isinstance(extra, int) else extra)


@lru_cache(maxsize=1)
def public_suffixes() -> tuple[str, ...]:
    """All rules of the public-suffix list on Spark's class path, with ``*.`` and ``!`` as written."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    jvm = spark._jvm
    stream = jvm.java.lang.Thread.currentThread().getContextClassLoader().getResourceAsStream(
        "mozilla/public-suffix-list.txt")
    text = jvm.java.lang.String(stream.readAllBytes(), "UTF-8")
    lines = (line.split()[0] for line in text.splitlines() if line.strip())
    return tuple(line for line in lines if not line.startswith("//"))


_SUFFIX_SLOTS = 16384


def _suffix_kinds(rules) -> dict[str, str]:
    """Of each run of labels: p for a suffix, w if any label before it makes one, e if it is an exception to that."""
    kinds: dict[str, set] = {}
    for rule in rules:
        kind, name = ("e", rule[1:]) if rule.startswith("!") else ("w", rule[2:]) if rule.startswith("*.") else ("p", rule)
        spellings = {name, ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in name.split("."))}
        for spelling in spellings:
            kinds.setdefault(spelling, set()).add(kind)
    return {name: "".join(sorted(found)) for name, found in kinds.items()}


@lru_cache(maxsize=8)
def _suffix_table(rules: tuple[str, ...]) -> tuple[pa.Table, int]:
    """One row with all runs, by the slots of their hash, and the labels of the longest run."""
    slots, kinds = [""] * _SUFFIX_SLOTS, _suffix_kinds(rules)
    for name, found in kinds.items():
        slots[zlib.crc32(name.encode()) % _SUFFIX_SLOTS] += f"\x02{name}\x03{found}"
    deepest = max((name.count(".") + 1 for name in kinds), default=1)
    return pa.table({"slots": pa.array([slots], pa.list_(pa.string()))}), deepest


def _run_kinds(run: Column, slots: Column) -> Column:
    """What the rules say of one run of labels; NULL if nothing."""
    slot = F.element_at(slots, (F.crc32(run.cast("binary")) % _SUFFIX_SLOTS + 1).cast("int"))
    mark = F.concat(F.lit("\x02"), run, F.lit("\x03"))
    at = F.instr(slot, mark)
    return F.when(at > 0, F.substring_index(F.substring(slot, at + F.length(mark), F.lit(3)), "\x02", 1))


def _suffix_slots(suffixes: tuple[str, ...] | None) -> tuple[Column, int]:
    """The rules as one constant of the query, and the labels of the longest run."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    table, deepest = _suffix_table(suffixes if suffixes is not None else public_suffixes())
    return spark.createDataFrame(table).scalar(), deepest


def _label_count(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1


def _kinds_at(name: Column, labels: Column, k: int, slots: Column) -> Column:
    return F.when(labels >= k, _run_kinds(F.substring_index(name, ".", -k), slots))


def _suffix_size(kinds: list[Column]) -> Column:
    """Labels of the suffix, from what the rules say of the last one, two ... labels."""
    ends, exceptions = [F.lit(1), F.lit(1)], [F.lit(None).cast("int"), F.lit(None).cast("int")]
    for k, kind in enumerate(kinds, 1):
        ends += [F.when(kind.contains("p"), k), F.when(kind.contains("w"), k + 1)]
        exceptions.append(F.when(kind.contains("e"), k - 1))
    return F.coalesce(F.greatest(*exceptions), F.greatest(*ends))


def _checked_domain(name: Column, labels: Column, size: Column, found: Column) -> Column:
    whole = ~(found.startswith(".") | found.endswith(".") | found.contains(".."))
    return F.when((labels > size) & whole & ~name.rlike(r"^[0-9.]+$|:"), found)


def base_domain_of_host(name: Column, suffixes: tuple[str, ...] | None = None) -> Column:
    """Registrable domain of a host; NULL for bare suffixes and IP addresses.

    ``suffixes`` are public-suffix rules; by default all of the list that Spark
    carries on its class path.  The rules are a table of one row that the query
    reads once; of a host only its last few runs of labels are looked up there.
    Several domains, or those of long expressions, are better made by
    :func:`with_domain`, which names each step.
    """
    slots, deepest = _suffix_slots(suffixes)
    labels = _label_count(name)
    size = _suffix_size([_kinds_at(name, labels, k, slots) for k in range(1, deepest + 1)])
    return _checked_domain(name, labels, size, F.call_function("substring_index", name, F.lit("."), -(size + 1)))


def with_domain(df: DataFrame, suffixes: tuple[str, ...] | None = None, **hosts: Column) -> DataFrame:
    """Adds the registrable domain of each host expression, under the argument's name.

    As :func:`base_domain_of_host`, but every step is a column, so that no part
    is written out, or computed, more than once.
    """
    slots, deepest = _suffix_slots(suffixes)
    steps = range(1, deepest + 1)
    out = df.withColumns({f"_{o}_host": h for o, h in hosts.items()})
    out = out.withColumns({f"_{o}_labels": _label_count(F.col(f"_{o}_host")) for o in hosts})
    out = out.withColumns({f"_{o}_{k}": _kinds_at(F.col(f"_{o}_host"), F.col(f"_{o}_labels"), k, slots)
                           for o in hosts for k in steps})
    out = out.withColumns({f"_{o}_size": _suffix_size([F.col(f"_{o}_{k}") for k in steps]) for o in hosts})
    out = out.withColumns({f"_{o}_found": F.expr(f"substring_index(`_{o}_host`, '.', -(`_{o}_size` + 1))") for o in hosts})
    # The test on the partition's number is always true.  Conditions on a column that depends on it are not moved
    # below it, where all steps would be written out again in each of them.
    here = F.spark_partition_id() >= 0
    out = out.withColumns({o: F.when(here, _checked_domain(*[F.col(f"_{o}_{c}") for c in ("host", "labels", "size", "found")]))
                           for o in hosts})
    return out.drop(*[f"_{o}_{c}" for o in hosts for c in ("host", "labels", "size", "found", *steps)])


def base_domain(url, suffixes: tuple[str, ...] | None = None) -> Column:
    return base_domain_of_host(host(url), suffixes)


def with_base_domain(df: DataFrame, suffixes: DataFrame, host_col: str = "host",
                     out: str = "base_domain") -> DataFrame:
    """Longest-match registrable domain against a public-suffix table.

    ``suffixes`` has one column ``suffix`` of rules, ``*.`` and ``!`` as written.
    Distinct hosts are expanded once into their trailing label runs (a host has
    few labels) and matched with an equi join, so the table may be broadcast or
    shuffled as its size demands.
    """
    hosts = df.select(F.col(host_col).alias("_h")).where("_h is not null").distinct()
    labels = F.split("_h", r"\.")
    runs = hosts.select(
        "_h", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("_k"),
    ).withColumn("_run", F.expr("substring_index(_h, '.', -_k)"))
    rules = suffixes.select(
        F.regexp_replace("suffix", r"^(\*\.|!)", "").alias("_run"),
        F.when(F.col("suffix").startswith("!"), "e").when(F.col("suffix").startswith("*."), "w").otherwise("p").alias("_kind"),
    ).distinct()
    best = runs.join(rules, "_run").groupBy("_h").agg(
        F.max(F.expr("case when _kind = 'e' then _k - 1 end")).alias("_exception"),
        F.max(F.expr("case when _kind = 'p' then _k when _kind = 'w' then _k + 1 end")).alias("_longest"))
    resolved = hosts.join(best, "_h", "left").withColumn(
        "_size", F.coalesce("_exception", "_longest", F.lit(1))).select("_h", F.expr(
            "case when size(split(_h, '\\\\.')) > _size then substring_index(_h, '.', -(_size + 1)) end").alias(out))
    return df.join(resolved, df[host_col] == resolved["_h"], "left").drop("_h")


def is_base_domain(url, suffixes: tuple[str, ...] | None = None) -> Column:
    return F.coalesce(
        is_web_url(url)
        & (strip_www(host(url)) == base_domain(url, suffixes))
        & (path(url) == "/"),
        F.lit(False),
    )


def _last_two(name: Column) -> Column:
    return F.substring_index(name, ".", -2)


def same_domain(a, b) -> Column:
    ok = is_web_url(a) & is_web_url(b)
    return ok & (_last_two(strip_www(host(a))) == _last_two(strip_www(host(b))))


def same_subdomain(a, b) -> Column:
    ok = is_web_url(a) & is_web_url(b)
    return ok & (strip_www(host(a)) == strip_www(host(b)))


# --- permutations ----------------------------------------------------------


def _stem(url) -> Column:
    """Path without a trailing slash or index page."""
    return F.regexp_replace(path(url), r"(/index\.(html|php)|/)$", "")


def _tail(url) -> Column:
    return F.concat(
        F.regexp_extract(_clean(url), r"^[^?#]*(\?[^#]+)", 1),
        F.regexp_extract(_clean(url), r"^[^#]*(#.+)$", 1))


def _port_text(url) -> Column:
    return F.coalesce(F.concat(F.lit(":"), port(url).cast("string")), F.lit(""))


def _is_web_scheme(url) -> Column:
    return _clean(url).rlike(r"^(?i)https?://")


def url_permutations(url) -> Column:
    """All spellings treated as one page: www/bare, http/https, index forms."""
    stem, before, after = _stem(url), _port_text(url), _tail(url)
    forms = F.transform(
        F.array(F.concat(stem, F.lit("/index.html")), F.concat(stem, F.lit("/index.php")),
                F.concat(stem, F.lit("/")), _slash_if_empty(stem)),
        lambda p: F.concat(before, p, after))
    name = strip_www(host(url))
    heads = F.when(_is_web_scheme(url), F.array(
        F.concat(F.lit("http://www."), name), F.concat(F.lit("https://www."), name),
        F.concat(F.lit("http://"), name), F.concat(F.lit("https://"), name),
    )).otherwise(F.array(
        F.concat(scheme(url), F.lit("://www."), name), F.concat(scheme(url), F.lit("://"), name)))
    return F.array_distinct(F.flatten(F.transform(
        heads, lambda h: F.transform(forms, lambda p: F.concat(h, p)))))


def similar_url_key(url) -> Column:
    """First permutation, computed directly: one member stands for the class."""
    return F.concat(
        F.when(_is_web_scheme(url), "http").otherwise(scheme(url)), F.lit("://www."),
        strip_www(host(url)), _port_text(url), _stem(url), F.lit("/index.html"), _tail(url))


def normalized_similar_key(url, ignore_query: bool = False) -> Column:
    """``similar_url_key(normalize_url(url))`` from the parts of the raw URL.

    Nesting the two would repeat the whole normalised text in every part.
    """
    stem = F.regexp_replace(resolve_dots(path(url)), r"(/index\.(html|php)|/)$", "")
    return F.concat(
        F.when(_is_web_scheme(url), "http").otherwise(scheme(url)), F.lit("://www."),
        strip_www(host(url)), _port_text(url), stem, F.lit("/index.html"),
        _search(url, ignore_query), _route(url))


# --- validation ------------------------------------------------------------

# Fixed pattern: a dotted label of two or more letters/digits (Latin or
# Cyrillic) or a punycode label, then an optional port, then path or end.
TLD_PATTERN = (
    r"(?i)(\.[a-zA-Z0-9\-Ѐ-ӿԀ-ԯⷠ-ⷿꙀ-ꚟ]{2,}|\.xn--[a-zA-Z0-9\-]{1,})(:\d+)?([/?#]|$)"
)


def has_protocol(url) -> Column:
    return _col(url).rlike(r"^(?i)([^.:]+://)")


def with_protocol(url) -> Column:
    return F.when(has_protocol(url), _col(url)).otherwise(F.concat(F.lit("http://"), _col(url)))


def validate_url(url) -> Column:
    """struct<ok, url, reason>; protocol added when missing."""
    full = with_protocol(url)
    is_file = full.rlike(r"^(?i)file://")
    reason = (
        F.when(_col(url).isNull(), "missing")
        .when(is_file, F.lit(None).cast("string"))
        .when(~full.rlike(r"^(?i)(https?|file)://"), "unsupported_protocol")
        .when(~full.rlike(TLD_PATTERN), "no_top_level_domain")
        .when(F.regexp_count(F.substring_index(full, ".", 1), F.lit(":")) != 1, "invalid_protocol")
        .when(~is_web_url(full), "invalid_url")
    )
    return F.struct(reason.isNull().alias("ok"), full.alias("url"), reason.alias("reason"))


def clean_map_url(url, ignore_query: bool = True) -> Column:
    """URL as listed in a site map; NULL when it is not a web URL."""
    full = F.regexp_replace(with_protocol(url), r"/$", "")
    ok = is_web_url(full) & scheme(full).isin("http", "https")
    shown = F.split(full, r"\?", 2).getItem(0) if ignore_query else full
    return F.when(ok, F.trim(shown))


def rewrite_export_url(url) -> Column:
    """Share links of hosted office documents become export links; else NULL."""
    u = _col(url)

    def doc_id(kind):
        return F.regexp_extract(u, "/" + kind + r"/d/([\w\-]+)", 1)

    def shared(where):
        return u.rlike("^https?://" + where)

    def unless_published(kind, made):
        return F.when(~u.contains(f"/{kind}/d/e/") & (doc_id(kind) != ""), made)

    gid = F.regexp_extract(u, r"[?&#]gid=(\d+)", 1)
    gid = F.when(gid == "", "").otherwise(F.concat(F.lit("&gid="), gid))
    docs = "https://docs.google.com/"
    return (
        F.when(shared(r"docs\.google\.com/document/d/"), unless_published("document", F.concat(
            F.lit(docs + "document/d/"), doc_id("document"), F.lit("/export?format=html"))))
        .when(shared(r"docs\.google\.com/presentation/d/"), unless_published("presentation", F.concat(
            F.lit(docs + "presentation/d/"), doc_id("presentation"), F.lit("/export?format=html"))))
        .when(shared(r"drive\.google\.com/file/d/"), F.when(doc_id("file") != "", F.concat(
            F.lit("https://drive.google.com/uc?export=download&id="), doc_id("file"))))
        .when(shared(r"docs\.google\.com/spreadsheets/d/"), unless_published("spreadsheets", F.concat(
            F.lit(docs + "spreadsheets/d/"), doc_id("spreadsheets"),
            F.lit("/gviz/tq?tqx=out:html"), gid)))
    )


# --- routing ---------------------------------------------------------------


def is_skipped_file(path_text: Column) -> Column:
    """True when the path ends in a file type that is never crawled."""
    ext = F.regexp_extract(path_text, r"(\.[^.]*)$", 1)
    return ext.isin(list(SKIPPED_FILE_EXTENSIONS))


def content_route(url, content_type=None, head=None) -> Column:
    """`document`, `pdf`, `skip` or `html`, from path, content type and first bytes."""
    p = F.lower(path(url))
    doc_ext = "|".join(DOCUMENT_EXTENSIONS)
    by_doc_path = p.rlike(rf"\.({doc_ext})(/|$)")
    by_pdf_path = p.rlike(r"\.pdf(/|$)")
    route = F.when(by_doc_path, "document").when(by_pdf_path, "pdf")
    if content_type is not None:
        ct = F.coalesce(_col(content_type), F.lit(""))
        bytes_head = F.coalesce(_col(head), F.lit("")) if head is not None else F.lit("")
        is_doc = F.lit(False)
        for t in DOCUMENT_CONTENT_TYPES:
            is_doc = is_doc | ct.startswith(t)
        octets = ct == "application/octet-stream"
        route = (
            route.when(is_doc, "document")
            .when(octets & bytes_head.rlike("^(PK|UEsD|0M8R4K|\\xD0\\xCF\\x11\\xE0)"), "document")
            .when((ct == "application/pdf") | ct.startswith("application/pdf;"), "pdf")
            .when(octets & bytes_head.rlike("^(%PDF-|JVBERi0)"), "pdf")
        )
    return route.when(is_skipped_file(path(url)), "skip").otherwise("html")


def repo_ref(url) -> Column:
    """struct<owner, repo> of a code-host page, NULL for anything else."""
    parts = F.filter(F.split(path(url), "/"), lambda s: s != "")
    ok = is_web_url(url) & (host(url) == "github.com") & (F.size(parts) >= 2)
    return F.when(ok, F.struct(
        F.get(parts, 0).alias("owner"),
        F.regexp_replace(F.get(parts, 1), r"\.git$", "").alias("repo"),
    ))


def country_table(spark: SparkSession) -> DataFrame:
    """ISO 3166 alpha-2 codes, from the JVM's own list plus Kosovo and the
    former Netherlands Antilles (both accepted)."""
    codes = set(spark._jvm.java.util.Locale.getISOCountries()) | {"XK", "AN"}
    return spark.createDataFrame([(c,) for c in sorted(codes)], "code string")


def locale_ok(df: DataFrame, countries: DataFrame, country_col: str = "country") -> DataFrame:
    """Adds ``country_ok`` and the effective lower-cased ``country_used``."""
    value = F.col(country_col)
    known = countries.select(F.col("code").alias("_code"))
    joined = df.join(F.broadcast(known), F.upper(value) == F.col("_code"), "left")
    blank = F.coalesce(value, F.lit("")) == ""
    special = F.lower(value).isin("us-generic", "us-whitelist")
    ok = blank | F.col("_code").isNotNull() | F.coalesce(special, F.lit(False))
    return joined.select(
        *[df[c] for c in df.columns], ok.alias("country_ok"),
        F.when(blank, "us-generic").when(ok, F.lower(value)).alias("country_used"),
    )


def is_ad_host(url, ad_domains=ADSERVER_DOMAINS) -> Column:
    name, hit = host(url), F.lit(False)
    for d in ad_domains:
        hit = hit | name.contains(d)
    return hit
