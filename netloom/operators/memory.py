"""A size-limited memory store: admission, edits, usage, search, rendering.

Entries have ``id, owner_id, target, content``; every rule works per
``(owner_id, target)``.  An edit or admission batch is judged against one
table version; :mod:`netloom.sources.tables` writes the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.plans.ranking import running_rank

# Characters each target may hold.
CHAR_LIMITS = {"memory": 2200, "user": 1375}

# Fixed patterns that make a text unsafe, in order.
INJECTION_PATTERNS = (
    r"ignore\s+(all\s+)?previous\s+instructions?",
    r"disregard\s+(all\s+)?prior",
    r"you\s+are\s+now\s+",
    r"system\s*:\s*you\s+are",
    r"forget\s+everything\s+(above|before)",
)
INVISIBLE = r"[\u200B\u200C\u200D\uFEFF\u2060]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def char_limit(target="target") -> Column:
    return F.when(_c(target) == "user", CHAR_LIMITS["user"]).otherwise(CHAR_LIMITS["memory"])


def security_scan(text) -> Column:
    """struct<safe, reason, pattern>: invisible characters, then known phrases."""
    t = _c(text)
    pattern = None
    for p in INJECTION_PATTERNS:
        test = t.rlike("(?i)" + p)
        pattern = F.when(test, p) if pattern is None else pattern.when(test, p)
    hidden = t.rlike(INVISIBLE)
    pattern = F.when(~hidden, pattern)
    reason = F.when(hidden, "invisible-unicode").when(pattern.isNotNull(), "prompt-injection")
    return F.struct(reason.isNull().alias("safe"), reason.alias("reason"), pattern.alias("pattern"))


def memory_usage(entries: DataFrame) -> DataFrame:
    """Characters used per owner and target, with limit and percent."""
    used = entries.groupBy("owner_id", "target").agg(F.sum(F.length("content")).alias("used"))
    limit = char_limit().cast("bigint")
    return used.select(
        "owner_id", "target", "used", limit.alias("limit"),
        F.least(F.lit(100.0), F.round(F.col("used") / limit * 100, 1)).alias("pct"))


def admit_memories(entries: DataFrame, incoming: DataFrame) -> DataFrame:
    """Verdict on each incoming text, in arrival order.

    ``incoming`` has ``owner_id, target, pos, content``.  ``verdict`` is
    `unsafe`, `duplicate`, `over_capacity` or `accepted`; rejected texts use no
    budget, so a smaller one may still fit later.

    The order-dependent fold is exact but runs on a bounded set.  The free
    budget R only shrinks, so among texts of one length the accepted ones are
    the first, and at most R / length of them: everything behind that is over
    capacity without being looked at.  What is left per owner and target is
    fewer than R * ln(R) short structs, whatever the input size.
    """
    keys = ["owner_id", "target"]
    scanned = incoming.withColumns({
        "_safe": security_scan("content")["safe"], "_hash": F.sha2("content", 256),
        "_len": F.length("content")})
    stored = entries.groupBy(*keys).agg(F.sum(F.length("content")).alias("_used"))
    known = entries.select(*keys, F.sha2("content", 256).alias("_hash")).distinct()
    firsts = scanned.where("_safe").groupBy(*keys, "_hash").agg(
        F.min("pos").alias("_first"), F.min("_len").alias("_len"))
    marked = firsts.join(known.withColumn("_known", F.lit(True)), [*keys, "_hash"], "left").join(
        stored, keys, "left").withColumn(
        "_room", char_limit() - F.coalesce("_used", F.lit(0)))
    fresh = marked.where("_known is null and _len <= _room")
    ranked = running_rank(fresh, [*keys, "_len"], F.floor(F.col("_first") / 4096),
                          [F.col("_first")], "_nth")
    possible = ranked.where(F.col("_nth") * F.greatest("_len", F.lit(1)) <= F.col("_room"))
    item = F.struct(F.col("_first").alias("pos"), F.col("_len").cast("bigint").alias("len"))
    folded = possible.groupBy(*keys).agg(
        F.array_sort(F.collect_list(item)).alias("_items"),
        F.first("_room").cast("bigint").alias("_room"))
    start = F.struct(F.col("_room").alias("room"),
                     F.array().cast("array<bigint>").alias("taken"))

    def step(acc, x):
        return F.when(x["len"] <= acc["room"], F.struct(
            (acc["room"] - x["len"]).alias("room"),
            F.concat(acc["taken"], F.array(x["pos"])).alias("taken"))).otherwise(acc)

    taken = folded.select(*keys, F.explode(
        F.aggregate("_items", start, step, lambda a: a["taken"])).alias("_first")).withColumn(
        "_accepted", F.lit(True))
    judged = marked.join(taken, [*keys, "_first"], "left").select(
        *keys, "_hash", "_first", "_known", "_accepted")
    joined = scanned.join(judged, [*keys, "_hash"], "left")
    verdict = (
        F.when(~F.col("_safe"), "unsafe").when(F.col("_known"), "duplicate")
        .when(F.col("_accepted") & (F.col("pos") == F.col("_first")), "accepted")
        .when(F.col("_accepted"), "duplicate").otherwise("over_capacity"))
    return joined.select(*[joined[c] for c in incoming.columns], verdict.alias("verdict"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def like_contains(text, part) -> Column:
    """``text LIKE '%' || part || '%'`` with ASCII letter case ignored.

    ``%`` and ``_`` in ``part`` keep their wildcard meaning.  The pieces between
    percent signs are found left to right, so the cost stays linear; the
    regular expression behind ``ILIKE`` backtracks without end on a text with
    many percent signs.
    """
    folded = F.translate(_c(part), _UPPER, _LOWER)
    pieces = F.filter(F.split(folded, "%"), lambda s: s != "")

    def step(rest, piece):
        pattern = F.concat(F.lit("(?s)"), F.replace(F.regexp_replace(
            piece, r"([^\w\s])", r"\\$1"), F.lit("_"), F.lit(".")))
        at = F.when(piece.contains("_"), F.regexp_instr(rest, pattern)).otherwise(
            F.instr(rest, piece))
        return F.when(at > 0, F.substr(rest, at + F.length(piece)))

    return F.aggregate(pieces, F.translate(_c(text), _UPPER, _LOWER), step).isNotNull()


def _matches(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """How many entries each edit names, and which if exactly one."""
    hits = edits.select("edit_id", "owner_id", "target", "old_text").join(
        entries.select("owner_id", "target", F.col("id").alias("_id"), F.col("content").alias("_c")),
        ["owner_id", "target"]).where(like_contains("_c", "old_text"))
    found = hits.groupBy("edit_id").agg(
        F.count("*").alias("matches"), F.min("_id").alias("_id"),
        F.min(F.length("_c")).alias("_old_len"))
    return edits.join(found, "edit_id", "left").withColumn(
        "matches", F.coalesce("matches", F.lit(0)))


def replace_memory(entries: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replaces the one entry containing ``old_text`` (case ignored).

    ``edits`` has ``edit_id, owner_id, target, old_text, content``.  Returns
    the verdict per edit and the new entries.  Each edit is judged on the given
    version; if two hit one entry the later ``edit_id`` stands.
    """
    usage = entries.groupBy("owner_id", "target").agg(F.sum(F.length("content")).alias("_used"))
    judged = _matches(entries, edits).join(usage, ["owner_id", "target"], "left").withColumn(
        "_after", F.col("_used") - F.col("_old_len") + F.length("content"))
    verdict = (
        F.when(~security_scan("content")["safe"], "unsafe")
        .when(F.col("matches") == 0, "no_match").when(F.col("matches") > 1, "ambiguous")
        .when(F.col("_after") > char_limit(), "over_capacity").otherwise("replaced"))
    judged = judged.withColumn("verdict", verdict)
    new = judged.where("verdict = 'replaced'").groupBy(F.col("_id").alias("id")).agg(
        F.max_by("content", "edit_id").alias("_new"))
    joined = entries.join(new, "id", "left")
    changed = joined.withColumn("content", F.coalesce("_new", "content")).select(*entries.columns)
    return judged.select("edit_id", "matches", "verdict", F.when(
        F.col("verdict") == "replaced", F.col("_id")).alias("id")), changed


def remove_memory(entries: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deletes the one entry containing ``old_text``; else no_match / ambiguous."""
    judged = _matches(entries, edits).withColumn("verdict", F.when(
        F.col("matches") == 0, "no_match").when(F.col("matches") > 1, "ambiguous").otherwise("removed"))
    gone = judged.where("verdict = 'removed'").select(F.col("_id").alias("id"))
    return judged.select("edit_id", "matches", "verdict", F.when(
        F.col("verdict") == "removed", F.col("_id")).alias("id")), entries.join(
        gone.distinct(), "id", "left_anti")


def list_memory(entries: DataFrame, owner, target: str) -> DataFrame:
    return entries.where((F.col("owner_id") == owner) & (F.col("target") == target)).orderBy("id")


def get_memory(entries: DataFrame, entry_id) -> DataFrame:
    return entries.where(F.col("id") == entry_id)


def search_memory(entries: DataFrame, query: str, target: str | None = None,
                  limit: int = 20) -> DataFrame:
    """Entries containing the text, most occurrences first."""
    if not query:
        raise ValueError("query must not be empty")
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    lowered, q = F.lower("content"), query.lower()
    rows = entries if target is None else entries.where(F.col("target") == target)
    score = (F.length(lowered) - F.length(F.replace(lowered, F.lit(q), F.lit("")))) / len(q)
    return rows.where(lowered.contains(q)).withColumn("score", score.cast("bigint")).orderBy(
        F.desc("score"), "id").limit(limit)


def replace_profile(entries: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deletes an owner's profile, then admits the new text.

    A refused text leaves the profile empty.  ``updates`` has ``owner_id,
    id, content``.  Returns the verdicts and the new entries.
    """
    cleared = entries.join(
        updates.select("owner_id", F.lit("user").alias("target")).distinct(),
        ["owner_id", "target"], "left_anti")
    incoming = updates.select("owner_id", F.lit("user").alias("target"),
                              F.col("id").cast("bigint").alias("pos"), "content")
    verdicts = admit_memories(cleared, incoming)
    added = verdicts.where("verdict = 'accepted'").select(
        F.col("pos").alias("id"), "owner_id", "target", "content")
    return verdicts, cleared.select("id", "owner_id", "target", "content").unionByName(added)


# --- rendering -------------------------------------------------------------

# Fixed format: a section prefix of an entry.
SECTION = r"^([A-Z][A-Za-z0-9 &/'\-]{0,40}):\s"
_EMPTY = "_Empty — no entries yet._"


def _percent(pct: Column) -> Column:
    """One decimal, dropped when zero."""
    return F.regexp_replace(F.format_string("%.1f", pct), r"\.0$", "")


def capacity_bar(used: Column, limit: Column, pct: Column) -> Column:
    return F.concat(F.lit("["), _percent(pct), F.lit("% — "), F.format_number(used, 0), F.lit("/"),
                    F.format_number(limit, 0), F.lit(" chars]"))


def _document(title: str, bar: Column, body: Column, taken_at: str) -> Column:
    return F.concat(F.lit(f"# {title}\n\n"), bar, F.lit("\n\n---\n\n"), body,
                    F.lit(f"\n\n---\n\n*Snapshot taken at session start: {taken_at}*"))


def section_of(content) -> Column:
    name = F.regexp_extract(_c(content), SECTION, 1)
    return F.when(name == "", "General").otherwise(name)


def _owners(entries: DataFrame, usage: DataFrame, target: str) -> DataFrame:
    limit = F.lit(CHAR_LIMITS[target]).cast("bigint")
    own = usage.where(F.col("target") == target).select("owner_id", "used", "pct")
    return own.withColumn("limit", limit)


def render_notes(entries: DataFrame, usage: DataFrame, taken_at: str) -> DataFrame:
    """Notes document per owner: sections by name, entries by id.

    Bounded by the capacity of one owner.
    """
    rows = entries.where("target = 'memory'").select(
        "owner_id", "id", section_of("content").alias("section"),
        F.regexp_replace("content", SECTION, "").alias("body"))
    sections = rows.groupBy("owner_id", "section").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("id", "body"))), lambda s: s["body"]), "\n\n").alias("text"))
    bodies = sections.groupBy("owner_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("section", "text"))),
        lambda s: F.concat(F.lit("## "), s["section"], F.lit("\n"), s["text"])), "\n\n").alias("body"))
    joined = _owners(entries, usage, "memory").join(bodies, "owner_id", "left")
    return joined.select("owner_id", _document(
        "Agent's Personal Notes", capacity_bar(F.col("used"), F.col("limit"), F.col("pct")),
        F.coalesce("body", F.lit(_EMPTY)), taken_at).alias("markdown"))


def render_profile(entries: DataFrame, usage: DataFrame, taken_at: str) -> DataFrame:
    """Profile document per owner: entries by id between rules."""
    bodies = entries.where("target = 'user'").groupBy("owner_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("id", "content"))), lambda s: s["content"]),
        "\n\n---\n\n").alias("body"))
    joined = _owners(entries, usage, "user").join(bodies, "owner_id", "left")
    return joined.select("owner_id", _document(
        "User Profile", capacity_bar(F.col("used"), F.col("limit"), F.col("pct")),
        F.coalesce("body", F.lit(_EMPTY)), taken_at).alias("markdown"))


# --- suggestions -----------------------------------------------------------


def suggestion_json(raw) -> Column:
    """Variant of the JSON array inside a model answer; NULL if there is none.

    A fenced block wins over bare text; the array runs from the first opening
    to the last closing bracket.
    """
    text = F.trim(_c(raw))
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.+?)\s*```", 1)
    candidate = F.when(fenced != "", fenced).otherwise(text)
    return F.try_parse_json(F.regexp_extract(candidate, r"(?s)(\[.*\])", 1))


def parse_failures(answers: DataFrame) -> DataFrame:
    return answers.where(suggestion_json("raw").isNull()).select("batch_id", "raw")


def parse_suggestions(answers: DataFrame, members: DataFrame) -> DataFrame:
    """Usable suggestions of model answers.

    ``answers`` has ``batch_id, raw``; ``members`` has ``batch_id,
    exchange_id``.  Items need text, a known target and a confidence in 0..1;
    an unknown source becomes the first exchange of the batch.
    """
    items = answers.select("batch_id", F.posexplode_outer(F.try_variant_get(
        suggestion_json("raw"), "$", "array<variant>")).alias("item_no", "item"))

    def kind(name):
        return F.schema_of_variant(F.try_variant_get("item", f"$.{name}", "variant"))

    number = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
    typed = items.select(
        "batch_id", "item_no",
        F.when(kind("content") == "STRING", F.try_variant_get("item", "$.content", "string")).alias("content"),
        F.when(kind("target") == "STRING", F.try_variant_get("item", "$.target", "string")).alias("target"),
        F.when(kind("confidence").rlike(number), F.try_variant_get("item", "$.confidence", "double"))
        .alias("confidence"),
        F.when(kind("sourceExchangeId").rlike(number), F.try_variant_get("item", "$.sourceExchangeId", "bigint"))
        .alias("_source"))
    good = typed.where(
        "content <> '' and target in ('memory', 'user') and confidence between 0 and 1")
    first = members.groupBy("batch_id").agg(F.min("exchange_id").alias("_fallback"))
    valid = members.select("batch_id", F.col("exchange_id").alias("_source"),
                           F.lit(True).alias("_valid")).distinct()
    joined = good.join(valid, ["batch_id", "_source"], "left").join(first, "batch_id", "left")
    return joined.select(
        "batch_id", "item_no", "content", "target", "confidence",
        F.when(F.col("_valid"), F.col("_source")).otherwise(
            F.coalesce("_fallback", F.lit(0))).alias("source_exchange_id"))


def queue_suggestions(suggestions: DataFrame, exchanges: DataFrame, members: DataFrame,
                      now: Column, min_confidence: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Pending rows of good enough suggestions; the whole batch counts as examined."""
    pending = suggestions.where(F.col("confidence") >= min_confidence).select(
        "batch_id", "item_no", "source_exchange_id", "content", "target", "confidence",
        now.alias("created_at"), F.lit("pending").alias("status"))
    seen = members.select(F.col("exchange_id").alias("id")).distinct().withColumn("_seen", F.lit(True))
    marked = exchanges.join(seen, "id", "left")
    stamped = marked.withColumn("extracted_at", F.when(F.col("_seen"), now).otherwise(
        F.col("extracted_at"))).select(*exchanges.columns)
    return pending, stamped


def review(pending: DataFrame, decisions: DataFrame, entries: DataFrame) -> DataFrame:
    """Applies approve / reject decisions to pending rows.

    ``pending`` has ``id, owner_id, target, content, status``; ``decisions``
    has ``id, decision``.  ``outcome`` is `approved`, `rejected`,
    `not_pending`, `not_found`, or the refusal of the store; a duplicate still
    counts as approved.
    """
    asked = decisions.join(pending, "id", "left")
    approved = asked.where("decision = 'approve' and status = 'pending'").select(
        "owner_id", "target", F.col("id").alias("pos"), "content")
    verdicts = admit_memories(entries, approved).select(F.col("pos").alias("id"), "verdict")
    joined = asked.join(verdicts, "id", "left")
    outcome = (
        F.when(F.col("status").isNull(), "not_found")
        .when(F.col("status") != "pending", "not_pending")
        .when(F.col("decision") == "reject", "rejected")
        .when(F.col("verdict").isin("accepted", "duplicate"), "approved")
        .otherwise(F.col("verdict")))
    return joined.select("id", "decision", outcome.alias("outcome"), F.coalesce(
        F.when(outcome.isin("approved", "rejected"), outcome), F.col("status")).alias("status"))


def list_pending(pending: DataFrame, limit: int = 50) -> DataFrame:
    return pending.where("status = 'pending'").orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
