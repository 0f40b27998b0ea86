"""URL filters as a temporal list join (DataFrame operations only).

Dated list entries (kind, pattern, action, since) become validity intervals: an entry holds until the next one of
the same kind and pattern. Kinds: prefix (host and path up to a slash), host, domain (it and all below it); actions:
block, allow, remove (the pattern is on no list from then on). Of entries of one pattern and one instant, block goes
before allow before remove. Every capture is then evaluated against the entries active at its fetch time: it is
joined by each of its own prefixes, its host and its domains, as of that time, and the most specific active entry
decides (the longest prefix, else the host, else the longest domain). Without one it is kept.

Intervals of one pattern don't overlap, so a capture meets at most one for each of its own patterns: the join grows
with the captures, whatever the list's length. The list is broadcast only if its files are small; else the join
shuffles and AQE splits a hot host. Intervals are made by pattern and hour, then by pattern over its hours, so that a hot pattern isn't one task.

A null or host-less url, or a null time, meets no entry and is kept. Entries with a null in any column are ignored.
Repeated captures are decided alike. Other columns of captures pass through, but for those of the result's names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.llm.common import small, written


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """kind, pattern, action, since, until (null: still active), without those of removed patterns."""
    entries = entries.select("kind", "pattern", "action", "since").dropna()
    rank = F.expr("CASE action WHEN 'block' THEN 3 WHEN 'allow' THEN 2 ELSE 1 END")
    one = entries.groupBy("kind", "pattern", "since").agg(F.max(rank).alias("r")).withColumn("hour", F.date_trunc("hour", "since"))
    hours = one.groupBy("kind", "pattern", "hour").agg(F.min("since").alias("first"))
    hours = hours.select("kind", "pattern", "hour", F.lead("first").over(Window.partitionBy("kind", "pattern").orderBy("hour")).alias("later"))
    within = F.lead("since").over(Window.partitionBy("kind", "pattern", "hour").orderBy("since"))
    spans = one.withColumn("next", within).join(hours, ["kind", "pattern", "hour"]).withColumn("until", F.coalesce("next", "later"))
    return spans.where("r > 1").select("kind", "pattern", F.expr("if(r = 3, 'block', 'allow') AS action"), "since", "until")


def own_patterns(host: str = "host", path: str = "path") -> Column:
    """(kind, pattern, rank) of a capture: rank orders them by how specific they are."""
    steps = f"filter(sequence(1, length({path})), i -> substring({path}, i, 1) = '/')"
    prefixes = f"transform({steps}, i -> struct('prefix' AS kind, concat({host}, substring({path}, 1, i)) AS pattern, 2000000 + i AS rank))"
    labels = f"split({host}, '[.]')"
    domains = f"transform(sequence(1, size({labels})), i -> struct('domain' AS kind, array_join(slice({labels}, i, size({labels})), '.') AS pattern, 1000 - i AS rank))"
    return F.expr(f"CASE WHEN {host} = '' THEN array() ELSE concat(if(length({path}) > 0, {prefixes}, array()), array(struct('host' AS kind, {host} AS pattern, 1000000 AS rank)), {domains}) END")


def decide(captures: DataFrame, entries: DataFrame, url: str = "url", time: str = "fetch_time") -> DataFrame:
    """captures with host, kind, pattern, action, since of the entry that decides (null: none) and kept."""
    made = ("host", "kind", "pattern", "action", "since", "kept")
    captures = captures.select(*[c for c in captures.columns if c not in made])
    spans = small(written(intervals(entries), "intervals"))
    seen = captures.select(F.col(url).alias("_url"), F.col(time).alias("_time")).dropna().distinct()
    keys = seen.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    keys = keys.select("_url", "_time", F.inline(own_patterns()))
    met = keys.join(spans, ["kind", "pattern"]).where("since <= _time AND (until IS NULL OR _time < until)")
    best = met.groupBy("_url", "_time").agg(F.max(F.struct("rank", "kind", "pattern", "action", "since")).alias("e"))
    best = best.select("_url", "_time", "e.kind", "e.pattern", "e.action", "e.since")
    out = captures.join(best, (captures[url] == best["_url"]) & (captures[time] == best["_time"]), "left")
    return out.select(*[captures[c] for c in captures.columns], host_of(captures[url]).alias("host"), "kind", "pattern", "action", "since", F.coalesce(F.col("action") != "block", F.lit(True)).alias("kept"))


def listed_by_events(pages: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures and list entries from the tables: a page's fetch time follows from its id; an event is an entry on the
    page of its id. Events whose id is no page's are no entries: listed_by_all_events takes them all."""
    return _listed(pages, events, F.col("event_id"))


def listed_by_all_events(pages: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As listed_by_events, but every event is an entry: its id modulo the number of page ids names the page, so that a
    host has dated entries over the whole range of the events. Page ids are 0, 1, 2, ... as in the tables."""
    count = F.broadcast(pages.agg((F.max("page_id") + 1).alias("_pages")))
    return _listed(pages, events.crossJoin(count), F.expr("pmod(event_id, _pages)"))


def _listed(pages: DataFrame, events: DataFrame, page: Column) -> tuple[DataFrame, DataFrame]:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    captures = pages.select("page_id", "url", (start + F.make_dt_interval(mins=F.pmod(F.col("page_id") * 7919, F.lit(43200)).cast("int"))).alias("fetch_time"))
    on = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    entries = events.select(page.alias("page_id"), "event_type", F.col("ts").alias("since")).join(on, "page_id")
    kind = F.expr("CASE event_type WHEN 'click' THEN 'domain' WHEN 'error' THEN 'prefix' ELSE 'host' END")
    pattern = F.expr(r"CASE event_type WHEN 'click' THEN regexp_replace(host, '^(m|www|blog)[.]', '') WHEN 'error' THEN concat(host, regexp_extract(path, '^(/[^/]*/)', 1)) ELSE host END")
    action = F.expr("CASE event_type WHEN 'signup' THEN 'allow' WHEN 'purchase' THEN 'remove' ELSE 'block' END")
    return captures, entries.select(kind.alias("kind"), pattern.alias("pattern"), action.alias("action"), "since")


#: DuckDB SQL for the decisions over listed_by_events.
ORACLE_SQL = r"""
WITH c AS (
    SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes((page_id * 7919) % 43200) AS fetch_time,
        lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1)) AS host,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), entries AS (
    SELECT CASE event_type WHEN 'click' THEN 'domain' WHEN 'error' THEN 'prefix' ELSE 'host' END AS kind,
        CASE event_type WHEN 'click' THEN regexp_replace(host, '^(m|www|blog)[.]', '')
            WHEN 'error' THEN host || regexp_extract(path, '^(/[^/]*/)', 1) ELSE host END AS pattern,
        CASE event_type WHEN 'signup' THEN 2 WHEN 'purchase' THEN 1 ELSE 3 END AS r, ts AS since
    FROM events JOIN c ON event_id = page_id WHERE host <> ''
), one AS (
    SELECT kind, pattern, since, max(r) AS r FROM entries GROUP BY ALL
), spans AS (
    SELECT *, lead(since) OVER (PARTITION BY kind, pattern ORDER BY since) AS until FROM one
), own AS (
    SELECT DISTINCT url, fetch_time, host, path FROM c
), met AS (
    SELECT own.url, own.fetch_time, s.*,
        CASE s.kind WHEN 'prefix' THEN 2000000 + length(pattern) WHEN 'host' THEN 1000000 ELSE length(pattern) END AS rank
    FROM own JOIN spans s ON s.r > 1 AND since <= fetch_time AND (until IS NULL OR fetch_time < until)
        AND CASE s.kind WHEN 'host' THEN own.host = pattern WHEN 'domain' THEN own.host = pattern OR ends_with(own.host, '.' || pattern)
            ELSE starts_with(own.host || own.path, pattern) AND ends_with(pattern, '/') END
), best AS (
    SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY url, fetch_time ORDER BY rank DESC) = 1
)
SELECT page_id, c.url, c.fetch_time, c.host, kind, pattern, CASE r WHEN 3 THEN 'block' WHEN 2 THEN 'allow' END AS action, since,
    coalesce(r <> 3, TRUE) AS kept
FROM c LEFT JOIN best ON c.url = best.url AND c.fetch_time = best.fetch_time
"""

#: The same over listed_by_all_events.
ALL_EVENTS_SQL = ORACLE_SQL.replace("ON event_id = page_id", "ON event_id % (SELECT max(page_id) + 1 FROM pages) = page_id")
