"""URL expressions for the checking SQL, as text."""

from __future__ import annotations

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def scheme(u):
    return f"lower(regexp_extract(trim({u}), '{_SCHEME}', 1))"


def hostport(u):
    return (f"regexp_replace(regexp_extract(trim({u}), "
            r"'^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', '')")


def host(u):
    return f"lower(regexp_replace({hostport(u)}, ':[0-9]*$', ''))"


def bare_host(u):
    return f"regexp_replace({host(u)}, '^www\\.', '')"


def rest(u):
    return rf"regexp_replace(trim({u}), '^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/?#]*)?', '')"


def path(u):
    raw = f"regexp_extract({rest(u)}, '^([^?#]*)', 1)"
    return f"(case when {raw} = '' then '/' else {raw} end)"


def query(u):
    return rf"regexp_extract({rest(u)}, '^[^?#]*\?([^#]*)', 1)"


def fragment(u):
    return f"regexp_extract({rest(u)}, '^[^#]*#(.*)$', 1)"


def origin(u):
    return f"({scheme(u)} || '://' || {host(u)})"


def resolve(href, base):
    """Absolute and root-relative links, the forms the given tables hold."""
    return (f"(case when regexp_matches({href}, '^https?://') then {href} "
            f"when {href} like '#%' then '' else {origin(base)} || {href} end)")


def normalize(u, ignore_query=False):
    q = "''" if ignore_query else f"(case when {query(u)} = '' then '' else '?' || {query(u)} end)"
    f = f"('#' || {fragment(u)})"
    return (f"({origin(u)} || {path(u)} || {q} || "
            f"case when length({f}) > 2 and regexp_matches({f}, '^#!?/') then {f} else '' end)")


def depth(u):
    return (f"len(list_filter(string_split({path(u)}, '/'), "
            "lambda s: s not in ('', 'index.php', 'index.html')))::bigint")


def last_two(h):
    return f"array_to_string(string_split({h}, '.')[-2:], '.')"


def base_domain(u):
    return last_two(host(u))


def stem(u):
    p = path(u)
    return (f"(case when {p} like '%/' then regexp_replace({p}, '/$', '') "
            rf"else regexp_replace({p}, '/index\.(html|php)$', '') end)")


def tail(u):
    return (f"(case when {query(u)} = '' then '' else '?' || {query(u)} end || "
            f"case when {fragment(u)} = '' then '' else '#' || {fragment(u)} end)")


def similar_key(u):
    return f"('http://www.' || {bare_host(u)} || {stem(u)} || '/index.html' || {tail(u)})"


def canonical(u):
    return (f"regexp_replace(regexp_replace(regexp_replace({u}, '^https?://', ''), "
            r"'^www\.', ''), '/$', '')")
