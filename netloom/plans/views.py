"""Input views over the given tables.

Each view is SQL over base tables or other views, named in braces.  The same
text serves Spark and the checking engine; where their dialects differ a view
holds one text for each.  Registered queries read these views whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Tables whose rows are costly to work on.
TEXT_TABLES = ("pages", "documents", "conversations")

_A_HREF = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"
_NOISE = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"


def _spark_raw(pattern: str) -> str:
    # Spark string literal: backslashes and single quotes escaped.
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _duck_raw(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _braces(text: str) -> str:
    return text.replace("{", "{{").replace("}", "}}")


def _both(template: str, **patterns: str) -> tuple[str, str]:
    """Fills regex slots ``<<name>>`` for each dialect."""
    spark, duck = template, template
    for name, pattern in patterns.items():
        spark = spark.replace(f"<<{name}>>", _braces(_spark_raw(pattern)))
        duck = duck.replace(f"<<{name}>>", _braces(_duck_raw(pattern)))
    return spark, duck


VIEWS: dict[str, tuple[tuple[str, ...], str, str]] = {}


def _add(name: str, deps: tuple[str, ...], spark: str, duck: str | None = None) -> None:
    VIEWS[name] = (deps, spark, duck if duck is not None else spark)


_add("jobs", ("orders", "customer"), """
select o_orderkey as id, o_custkey as group_id, cast(c_nationkey as bigint) as owner_id,
  cast(substr(o_orderpriority, 1, 1) as bigint) as priority,
  case when o_orderstatus = 'O' then 'queued' when o_orderstatus = 'P' then 'active'
       when o_orderkey % 10 = 0 then 'failed' else 'completed' end as status,
  o_orderdate as created_at,
  case when o_orderstatus = 'F' then o_orderdate + (o_orderkey % 90) * interval '1' minute end
    as finished_at,
  case when o_orderstatus = 'P' then o_orderdate + (o_orderkey % 5) * interval '1' minute end
    as locked_at,
  o_orderkey % 12 as stalls,
  case when o_orderkey % 25 = 0 then 'kickoff' else 'single_urls' end as mode,
  cast(floor(o_totalprice) as bigint) as bytes,
  case when o_orderstatus = 'F' and o_orderkey % 10 = 0 then
    case o_orderkey % 4 when 0 then 'SCRAPE_TIMEOUT|{{"message":"took ' || cast(o_custkey as varchar(20)) || ' ms"}}'
      when 2 then case when o_orderkey % 3 = 0
        then 'SCRAPE_RACED_REDIRECT_ERROR|{{"message":"raced"}}' else 'socket hang up' end
      else 'CRAWL_DENIAL|{{"message":"denied"}}' end end as failedreason
from {orders} join {customer} on o_custkey = c_custkey
""")

_add("job_payloads", ("jobs",), """
select id, group_id, status,
  '{{"mode":"' || mode || '","url":"https://site' || cast(group_id as varchar(20)) || '.example.com/'
    || cast(id as varchar(20)) || '"}}' as data
from {jobs}
""")

_add("backlog", ("jobs",), """
select id + 1000000000 as id, group_id, owner_id, mode, priority, created_at,
  case when id % 3 <> 0 then created_at + (id % 48) * interval '1' hour end as times_out_at
from {jobs} where id % 7 = 0
""")

_add("groups", ("customer",), """
select c_custkey as id, cast(c_nationkey as bigint) as owner_id,
  case when c_custkey % 4 = 0 then 'completed' else 'active' end as status,
  cast(86400000 as bigint) as ttl,
  case when c_custkey % 4 = 0
    then timestamp '1999-01-01 00:00:00' + (c_custkey % 100) * interval '1' day end as expires_at
from {customer}
""".replace("timestamp '", "TIMESTAMP_NTZ '"), """
select c_custkey as id, cast(c_nationkey as bigint) as owner_id,
  case when c_custkey % 4 = 0 then 'completed' else 'active' end as status,
  cast(86400000 as bigint) as ttl,
  case when c_custkey % 4 = 0
    then timestamp '1999-01-01 00:00:00' + (c_custkey % 100) * interval '1' day end as expires_at
from {customer}
""")

_add("links", ("pages",), *_both("""
select page_id, url, cast(pos as bigint) as pos, regexp_replace(raw, <<quotes>>, '') as href
from (select page_id, url, posexplode(regexp_extract_all(
        regexp_replace(html, <<noise>>, ''), <<a>>, 1)) as (pos, raw) from {pages})
""", a=_A_HREF, noise=_NOISE, quotes="^[\"']|[\"']$")[:1], _both("""
select page_id, url, cast(i - 1 as bigint) as pos, regexp_replace(raw, <<quotes>>, '', 'g') as href
from (select page_id, url, unnest(m) as raw, generate_subscripts(m, 1) as i
      from (select page_id, url, regexp_extract_all(
              regexp_replace(html, <<noise>>, '', 'g'), <<a>>, 1) as m from {pages}))
""", a=_A_HREF, noise=_NOISE, quotes="^[\"']|[\"']$")[1])

_add("page_links", ("pages",), """
select e.page_id, e.url, e.k as pos, t.url as href
from (select p.page_id, p.url, k,
        (p.page_id * 7 + 13 * k) % (select count(*) from {pages}) as target
      from {pages} p lateral view explode(array(1L, 2L, 3L)) x as k) e
join {pages} t on t.page_id = e.target
""", """
select e.page_id, e.url, e.k as pos, t.url as href
from (select p.page_id, p.url, k, (p.page_id * 7 + 13 * k) % (select count(*) from {pages}) as target
      from {pages} p, (select cast(unnest([1, 2, 3]) as bigint) as k)) e
join {pages} t on t.page_id = e.target
""")

_add("all_links", ("links", "page_links"), """
select page_id, url, pos, href from {links}
union all
select page_id, url, pos + 1000 as pos, href from {page_links}
""")

_add("exchanges", ("conversations",), """
select q.conv_id * 4294967296 + q.turn as id, q.conv_id as session_id,
  row_number() over (partition by q.conv_id order by q.turn) as sequence,
  q.text as user_message, a.text as assistant_message
from {conversations} q join {conversations} a
  on a.conv_id = q.conv_id and a.turn = q.turn + 1
where q.role = 'user' and a.role = 'assistant'
""".replace("row_number() over (partition by q.conv_id order by q.turn)",
            "cast(row_number() over (partition by q.conv_id order by q.turn) as bigint)"))

_add("sessions", ("conversations",), """
select conv_id as id,
  case conv_id % 3 when 0 then 'cli' when 1 then 'mcp' else 'api' end as source,
  case when conv_id % 2 = 0 then 'client' || cast(conv_id % 5 as varchar(4)) end as client_name,
  1700000000 + min(conv_id) * 61 as started_at,
  case when conv_id % 4 = 0 then 1700000000 + min(conv_id) * 61 + count(*) * 30 end as ended_at
from {conversations} group by conv_id
""")

_add("doc_lines", ("documents",), """
select doc_id, cast(pos as bigint) as line_no, line as text,
  cast(pos div 5 + 1 as bigint) as page, cast(800 - 12 * (pos % 5) as double) as y
from (select doc_id, posexplode(split(text, '\\n')) as (pos, line) from {documents})
""", """
select doc_id, cast(i - 1 as bigint) as line_no, line as text,
  cast((i - 1) // 5 + 1 as bigint) as page, cast(800 - 12 * ((i - 1) % 5) as double) as y
from (select doc_id, unnest(m) as line, generate_subscripts(m, 1) as i
      from (select doc_id, string_split(text, chr(10)) as m from {documents}))
""")

_add("memory_entries", ("doc_lines",), """
select doc_id * 100000 + line_no as id, doc_id as owner_id,
  case when line_no % 3 = 0 then 'user' else 'memory' end as target,
  case when line_no % 7 = 0 then 'Style: ' when line_no % 5 = 0 then 'Tools & setup: ' else '' end
    || text as content
from {doc_lines} where text <> ''
""")

_add("text_items", ("doc_lines",), """
select doc_id, page, line_no, cast(pos as bigint) as word_no, word as text,
  cast(40 * pos as double) as x, y, cast(5.0 * length(word) as double) as width,
  cast(case when line_no = 0 then 18 when line_no % 4 = 0 then 14 else 10 end as double)
    as font_size
from (select doc_id, page, line_no, y, posexplode(split(text, ' ')) as (pos, word)
      from {doc_lines})
where word <> ''
""", """
select doc_id, page, line_no, cast(i - 1 as bigint) as word_no, word as text,
  cast(40 * (i - 1) as double) as x, y, cast(5.0 * length(word) as double) as width,
  cast(case when line_no = 0 then 18 when line_no % 4 = 0 then 14 else 10 end as double)
    as font_size
from (select doc_id, page, line_no, y, unnest(m) as word, generate_subscripts(m, 1) as i
      from (select doc_id, page, line_no, y, string_split(text, ' ') as m from {doc_lines}))
where word <> ''
""")

_add("page_stats", ("doc_lines",), """
select doc_id, page, (doc_id + page) % 4 <> 0 as has_text, page % 3 = 0 as has_images,
  doc_id % 50 = 0 as is_template,
  cast(sum(length(text) - length(replace(text, ' ', '')) + 1) as bigint) as n_ops
from {doc_lines} group by doc_id, page
""")

_add("queries", ("pages",), *_both("""
select page_id as query_id, regexp_extract(html, <<title>>, 1) ||
  case page_id % 10 when 0 then ' how to fix error' when 1 then ' latest news'
    when 2 then ' 是什么' when 3 then ' vs other' when 4 then ' this week guide'
    when 5 then ' 论文 研究 学术 的 如何 可以 最近 报告 内容' when 6 then ' RAG paper this year'
    when 7 then ' かな' when 8 then ' best breaking' else '' end as query
from {pages}
""", title="(?s)<title>(.*?)</title>"))

# Fixed search terms run against every page.
SEARCH_TERMS = ((0, "the of and"), (1, "que les RAG"), (2, "der die und"), (3, "xylophone zebra"),
                (4, "如何"))
_TERM_STRUCTS_SPARK = ", ".join(
    f"named_struct('query_id', {i}L, 'query', '{q}')" for i, q in SEARCH_TERMS)
_TERM_STRUCTS_DUCK = ", ".join(
    f"{{{{'query_id': {i}::bigint, 'query': '{q}'}}}}" for i, q in SEARCH_TERMS)

_SERP_COLUMNS = """
  p.page_id as position, p.url, regexp_extract(p.html, <<title>>, 1) as title,
  trim(regexp_extract(p.html, <<para>>, 1)) as description,
  cast((p.page_id * 37 + q.query_id * 11) % 100 as double) / 10.0 - 1 as score
"""
_SERP_PATTERNS = {"title": "(?s)<title>(.*?)</title>", "para": "(?s)<p>(.*?)</p>"}

_add("serp", ("pages",),
     _both("select q.query_id, q.query," + _SERP_COLUMNS
           + "from {pages} p lateral view explode(array(" + _TERM_STRUCTS_SPARK + ")) t as q",
           **_SERP_PATTERNS)[0],
     _both("select q.query_id, q.query," + _SERP_COLUMNS
           + "from (select *, unnest([" + _TERM_STRUCTS_DUCK + "]) as q from {pages}) p",
           **_SERP_PATTERNS)[1])

_add("attempts", ("pages", "doc_lines"), *_both("""
select page_id, line_no, url || '/p' || cast(line_no as varchar(10)) as url, url as site_url,
  text as rendered,
  case when (page_id + line_no) % 5 = 0 then substr(text, 1, cast(length(text) as int) / 2)
       when (page_id + line_no) % 11 = 0 then '' else text end as plain,
  case (page_id + line_no) % 10 when 3 then 404 when 4 then 403 when 6 then 304 else 200 end as status
from (select page_id, line_no, url, regexp_replace(text, <<wide>>, '?') as text
      from {pages} join {doc_lines} on page_id = doc_id)
""".replace("cast(length(text) as int) / 2", "length(text) div 2"), wide=r"[^\x00-\x7F]")[:1],
    _both("""
select page_id, line_no, url || '/p' || cast(line_no as varchar(10)) as url, url as site_url,
  text as rendered,
  case when (page_id + line_no) % 5 = 0 then substr(text, 1, length(text) // 2)
       when (page_id + line_no) % 11 = 0 then '' else text end as plain,
  case (page_id + line_no) % 10 when 3 then 404 when 4 then 403 when 6 then 304 else 200 end as status
from (select page_id, line_no, url, regexp_replace(text, <<wide>>, '?', 'g') as text
      from {pages} join {doc_lines} on page_id = doc_id)
""", wide=r"[^\x00-\x7F]")[1])

_add("suggestions_raw", ("exchanges",), """
select id as batch_id, session_id,
  case when id % 2 = 0 then 'Here you go:\\n```json\\n' else '' end ||
  '[{{"content":"prefers answer ' || cast(session_id as varchar(20)) || '","target":"' ||
    case when id % 3 = 0 then 'user' else 'memory' end || '","confidence":' ||
    case id % 4 when 0 then '0.95' when 1 then '0.7' when 2 then '0.4' else '1.5' end ||
    ',"sourceExchangeId":' || cast(case when id % 5 = 0 then -1 else id end as varchar(20)) ||
  '}},{{"content":"","target":"memory","confidence":0.9}},' ||
  '{{"content":"uses item ' || cast(id % 7 as varchar(4)) || '","target":"memory","confidence":0.8}}]' ||
  case when id % 2 = 0 then '\\n```' else '' end as raw
from {exchanges}
""", """
select id as batch_id, session_id,
  case when id % 2 = 0 then 'Here you go:' || chr(10) || '```json' || chr(10) else '' end ||
  '[{{"content":"prefers answer ' || cast(session_id as varchar(20)) || '","target":"' ||
    case when id % 3 = 0 then 'user' else 'memory' end || '","confidence":' ||
    case id % 4 when 0 then '0.95' when 1 then '0.7' when 2 then '0.4' else '1.5' end ||
    ',"sourceExchangeId":' || cast(case when id % 5 = 0 then -1 else id end as varchar(20)) ||
  '}},{{"content":"","target":"memory","confidence":0.9}},' ||
  '{{"content":"uses item ' || cast(id % 7 as varchar(4)) || '","target":"memory","confidence":0.8}}]' ||
  case when id % 2 = 0 then chr(10) || '```' else '' end as raw
from {exchanges}
""")

_add("job_events", ("events",), """
select event_id, event_id // 4 as job_id, user_id as owner_id,
  case event_type when 'signup' then 'queued' when 'click' then 'active'
    when 'view' then 'heartbeat' when 'purchase' then 'completed' else 'failed' end as action, ts
from {events}
""".replace("event_id // 4", "event_id div 4"), """
select event_id, event_id // 4 as job_id, user_id as owner_id,
  case event_type when 'signup' then 'queued' when 'click' then 'active'
    when 'view' then 'heartbeat' when 'purchase' then 'completed' else 'failed' end as action, ts
from {events}
""")

_add("request_log", ("events",), """
select event_id, upper(event_type) as method,
  '/crawl/' || lpad(lower(hex(event_id)), 8, '0') || '-0000-4000-8000-' ||
    lpad(lower(hex(user_id)), 12, '0') || '/status' as path,
  case event_type when 'error' then 500 else 200 end as status, value as seconds, user_id, ts
from {events}
""", """
select event_id, upper(event_type) as method,
  '/crawl/' || lpad(printf('%x', event_id), 8, '0') || '-0000-4000-8000-' ||
    lpad(printf('%x', user_id), 12, '0') || '/status' as path,
  case event_type when 'error' then 500 else 200 end as status, value as seconds, user_id, ts
from {events}
""")


def _one_file(table: DataFrame) -> bool:
    return len(table.inputFiles()) == 1


def view(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """DataFrame of a base table or view.

    ``by`` is a column that the view keeps of its base table, whose rows are then dealt by
    it: what a view makes of a row, many times its bytes, need not be shuffled to meet by
    that column.  The number of tasks is named, as adaptive execution would join the few
    bytes of many rows that grow later.
    """
    if name in BASE_TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if by is not None:
            return table.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), by)
        # The given tables are single files, often one split; real tables are not re-dealt.
        return table.repartition(spark.sparkContext.defaultParallelism) if name in TEXT_TABLES and _one_file(table) else table
    deps, text, _ = VIEWS[name]
    if name == "exchanges":
        from netloom.operators.sessions import build_exchanges

        return build_exchanges(view(spark, sf_dir, "conversations"))
    return spark.sql(text, **{d: view(spark, sf_dir, d, by) for d in deps})


def _closure(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for n in names:
        if n not in BASE_TABLES and n not in seen:
            _closure(VIEWS[n][0], seen)
            seen.append(n)
    return seen


def check_sql(final: str, *names: str, recursive: bool = False, extra: str = "") -> str:
    """Full SQL for the checking engine: the named views, then ``final``."""
    parts = []
    for n in _closure(names, []):
        deps, _, text = VIEWS[n]
        parts.append(f"{n} as ({text.format(**{d: d for d in deps})})")
    if extra:
        parts.append(extra)
    body = final.strip()
    if body.startswith("with "):
        body = body.removeprefix("with ").removeprefix("recursive ")
        own, joiner = True, ",\n"
    else:
        own, joiner = False, "\n"
    if not parts:
        return final
    return ("with " + ("recursive " if recursive else "") + ",\n".join(parts)
            + (joiner if own else "\n") + body)
