"""One registered query per operator, over its whole table, with checking SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from netloom.llm import bpe, decontaminate, exact_dedup, html_main, language_id, licenses, minhash, prefix_trie, simhash
from netloom.llm import suffix_dedup, toxicity, turn_repair, url_filter
from netloom.llm.texts import conversations, documents, pages

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CATEGORIES = ["quality", "toxic"]


def tokenizer(spark) -> bpe.Tokenizer:
    return bpe.Tokenizer(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.cut_repeats(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_html_extraction(spark, sf_dir):
    return html_main.extract_main_text(pages(spark, sf_dir)).select("page_id", "url", "text", "n_chars")


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    return language_id.predict_language(docs, model).select(
        "doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(list(url_filter.CONTRACT_RULES), "verdict string, host string, path string")
    return url_filter.judge_urls(pages(spark, sf_dir).select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict")


def op6_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    chain = toxicity.fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), CATEGORIES)
    return toxicity.predict_toxicity(docs, chain).select("doc_id", "toxic", "p_toxic", "p_quality")


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_license_scans(spark, sf_dir):
    return licenses.scan_licenses(documents(spark, sf_dir).select("doc_id", "text"), licenses.known_table(spark))


def op9_byte_bpe(spark, sf_dir):
    return bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), tokenizer(spark)).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_decontamination(spark, sf_dir):
    found = decontaminate.find_overlaps(documents(spark, sf_dir).select("doc_id", "text"),
                                        spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.judged(found).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_turn_repair(spark, sf_dir):
    turns = conversations(spark, sf_dir)
    return turn_repair.repair(turns, turn_repair.damage(turns))


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(conversations(spark, sf_dir))


def op13_minhash(spark, sf_dir):
    return minhash.near_duplicates(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_html_extraction, op3_exact_dedup, op4_language_id, op5_url_filters, op6_toxicity,
    op7_simhash, op8_license_scans, op9_byte_bpe, op10_decontamination, op11_turn_repair, op12_prefix_trie, op13_minhash)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
_WORDS = lambda t: f"regexp_extract_all({_LOWER(t)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.CONTRACT_RULES)


def _canonical(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for old, new in licenses.SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    out = f"replace({out}, chr(13), chr(10))"
    out = f"regexp_replace({out}, '(^|\\n)[^\\pL\\pN\\n©]*(copyright\\b|©|\\(c\\))[^\\n]*', chr(10), 'g')"
    return f"regexp_replace({out}, '[^\\pL\\pN\\n]+', '', 'g')"


_KNOWN = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in licenses.KNOWN)

# Unsigned CRC-32 of an ASCII string, by the usual table of 256 entries in column ``t``.
_CRC_TABLE = """select list(v order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i))"""
_CRC = """xor(list_reduce([4294967295] || list_transform(string_split({}, ''), lambda x: cast(ord(x) as bigint)),
  lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)""".format
_ROLE = "case when {} % 2 = 0 then 'user' else 'assistant' end".format


def _more(state: str, cost: str, letter: str) -> str:
    """A state of the repair's table, cost and audit as one string, one edit further."""
    return f"lpad(cast(cast({state}[1:8] as bigint) + {cost} as varchar), 8, '0') || {state}[9:] || '{letter}'"


def _takes(role: str, *states: str) -> str:
    """Keeping a row of this role, or giving it the role."""
    initial = f"w.initial = '{role}'"
    kept = [f"case when not gone and {initial} then {_more(s, 'late', 'K')} end" for s in states]
    given = [f"case when not gone then {_more(s, '2 + late', 'R')} end" for s in states if role != "s"]
    return ", ".join(kept + given)


CHECKS = {
    "op12_prefix_trie": rf"""
with crc as ({_CRC_TABLE}),
o as (select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x,
        row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as p from conversations),
convs as (select c, count(*) as n, c - c % 5 as s from o group by c),
heads as (select c, n, s, {_CRC("cast(c as varchar)")} % 9 as h from convs, crc),
plan as (select a.c, a.h, a.s, least(a.h, coalesce(b.n, 0)) as taken from heads a left join convs b on b.c = a.s),
seq as (select plan.c, p + 1 as d, r, x from plan join o on o.c = s and p < h
        union all select plan.c, taken + p - h + 1, r, x from plan join o on o.c = plan.c and p >= h),
lists as (select plan.c, coalesce(list({{'r': r, 'x': x}} order by d) filter (where d is not null), []) as l
          from plan left join seq using (c) group by plan.c),
members as (select c, d, list_slice(l, 1, d) as k, len(l) = d as ends from (select c, l, unnest(range(0, len(l) + 1)) as d from lists)),
nodes as (select d, k, min(c) as node, count(*) as n, coalesce(strlen(k[d].x), 0) as b,
            sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where ends), '')) as e from members group by d, k),
kids as (select d - 1 as d, list_slice(k, 1, d - 1) as k, count(*) as n from nodes where d > 0 group by 1, 2),
own as (select nodes.*, coalesce(kids.n, 0) as kids from nodes left join kids on nodes.d = kids.d and nodes.k = kids.k),
sums as (select u as d, list_slice(k, 1, u) as k, count(*) filter (where kids = 0) as leaves, sum((n - 1) * b) as saved
         from (select *, unnest(range(0, d + 1)) as u from own) group by 1, 2)
select own.node as conv_id, own.d as depth, up.node as parent_conv_id, own.n as n_convs, own.kids as n_children,
  leaves as n_leaves, cast(saved as bigint) as saved_tokens, own.e as ends_sha256
from own join sums on own.d = sums.d and own.k = sums.k left join nodes up on up.d = own.d - 1 and up.k = list_slice(own.k, 1, own.d - 1)""",
    "op11_turn_repair": rf"""
with recursive crc as ({_CRC_TABLE}),
d as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        {_CRC("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as k
      from conversations, crc),
e as (select conv_id, turn, case when k = 4 then 'user' else role end as role,
        case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case when k = 3 then [0, 1] else [0] end) as copy
      from d where k <> 0),
f as (select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body, left(role, 1) as initial,
        row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from e),
g as (select *, body = '' as blank, lag(initial) over (partition by conv_id order by i) || initial as two,
        row_number() over (partition by conv_id, role, text order by i) > 1 as again from f),
w as (select *, blank or again as gone, not (blank or again) and right(body, 1) not in ('.', '!', '?') as cut,
        cast(not (blank or again) and right(body, 1) not in ('.', '!', '?') as bigint) as late from g),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
             count(*) filter (where blank) as blank, count(*) filter (where again and not blank) as duplicate,
             count(*) filter (where cut) as truncated, max(i) as n,
             count(*) filter (where two is not null and two not in ('su', 'ua', 'au')) as illegal from w group by conv_id),
raw as (select conv_id, cast(0 as bigint) as i, '00000000' as s0, cast(null as varchar) as s1,
          {_more("'00000000'", "2", "I")} as s2, {_more("'00000000'", "4", "II")} as s3 from counts
        union all
        select conv_id, i, n0, n1, least(n2, {_more("n0", "2", "I")}, {_more("n1", "2", "I")}, {_more("n3", "2", "I")}),
          least(n3, {_more("n2", "2", "I")}, {_more("n0", "4", "II")}, {_more("n1", "4", "II")}) from (
          select raw.conv_id, w.i, {_more("s0", "3", "D")} as n0, least({_more("s1", "3", "D")}, {_takes("s", "s0")}) as n1,
            least({_more("s2", "3", "D")}, {_takes("u", "s0", "s1", "s3")}) as n2,
            least({_more("s3", "3", "D")}, {_takes("a", "s2")}) as n3
          from raw join w on raw.conv_id is not distinct from w.conv_id and w.i = raw.i + 1)),
best as (select conv_id, least(s0, s3) as s from raw join counts using (conv_id) where raw.i = counts.n),
letters as (select conv_id, s[9:] as audit, unnest(range(9, length(s) + 1)) as z, s[z] as edit from best),
placed as (select *, sum(cast(edit <> 'I' as int)) over (partition by conv_id order by z) as i,
             sum(cast(edit <> 'D' as int)) over (partition by conv_id order by z) - 1 as place,
             sum(cast(edit <> 'D' as int)) over (partition by conv_id) as n from letters),
hashed as (select p.conv_id, sha256(string_agg(case edit when 'K' then role else {_ROLE("(place + n)")} end || ':' ||
             case edit when 'I' then '' else text end, chr(10) order by z)) as h
           from placed p join w on p.conv_id = w.conv_id and greatest(p.i, 1) = w.i where edit <> 'D' group by p.conv_id),
ids as (select distinct conv_id from conversations)
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cast(s[1:8] as bigint), 0) as cost,
  coalesce(s[9:], '') as audit, coalesce(h, sha256('')) as repaired_sha256
from ids left join counts using (conv_id) left join best using (conv_id) left join hashed using (conv_id)""",
    "op3_exact_dedup": r"""
with d as (select doc_id, length(coalesce(text, '')) as n,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as t from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size,
  doc_id = first_value(doc_id) over w as kept, sha256(t) as text_sha256
from d window w as (partition by t order by n desc, doc_id)""",
    "op5_url_filters": rf"""
with u as (select page_id, coalesce({_LOWER("regexp_extract(url, '^(?s).*?://([^/?#]*)', 1)")}, '') as host,
             coalesce(regexp_extract(url, '^(?s).*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
rules(verdict, h, p) as (values {_RULES}),
best as (select page_id, host, path, verdict, h || p as rule,
           row_number() over (partition by page_id order by length(h || p) desc nulls last) as k
         from u left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from best where k = 1""",
    "op8_license_scans": rf"""
with known as (select sha256(replace({_canonical("t")}, chr(10), '')) as digest, min(id) as license
               from (values {_KNOWN}) as k(id, t) group by 1),
d as (select row_number() over () as r, doc_id, {_canonical("text")} as c from documents),
units as (select r, true as whole, replace(c, chr(10), '') as u from d
          union all select r, false, unnest(string_split(c, chr(10))) from d),
found as (select r, whole, license from units join known on sha256(u) = digest and u <> '')
select doc_id, max(license) filter (where whole) as license_id,
  coalesce(string_agg(distinct license, ',' order by license) filter (where not whole), '') as notices,
  count(license) filter (where not whole) as n_notices
from d left join found using (r) group by r, doc_id""",
    "op10_decontamination": rf"""
with b as (select cast(item_id as varchar) as item, {_WORDS("text")} as w from benchmark where text is not null),
win as (select distinct item, least(10, len(w)) as size, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') as s
        from (select item, w, unnest(range(1, cast(len(w) as bigint) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
d as (select doc_id, row_number() over () as r, coalesce({_WORDS("text")}, []) as w from documents),
sizes as (select distinct size from win),
g as (select r, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') as s
      from (select r, w, size, unnest(range(1, cast(len(w) as bigint) - size + 2)) as i from d, sizes where len(w) >= size)),
hit as (select r, i, g.size, item from g join win on g.s = win.s and g.size = win.size),
words as (select r, count(distinct p) as n from (select r, unnest(range(i, i + size)) as p from (select distinct r, i, size from hit)) group by r),
items as (select r, count(*) as n, string_agg(item, ',' order by item) as s from (select distinct r, item from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(words.n, 0) as n_hit, coalesce(items.n, 0) as n_items,
  sha256(coalesce(items.s, '')) as items_sha256, words.n is not null as contaminated
from d left join words using (r) left join items using (r)""",
}
