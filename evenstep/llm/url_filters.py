"""URL filters in time: a dated list of domains, asked as it stood on the day of each capture.

Everything is DataFrame functions. A list entry holds from its day to the day before the next entry of the same
domain. What a capture is told depends on its host and day alone, so pairs of host and day are judged, each once,
and captures are joined to their pair; a host with many captures costs no more than its days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"
#: Of several entries of a domain on one day the first of these counts.
ACTIONS = ("block", "allow", "lift")


def host_of(url: Column) -> Column:
    """Host in lower case without user, port, trailing dot and leading ``www.``; null where there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"^www\.|\.$", "")
    return F.when(host != "", host)


def _domains(host: Column) -> Column:
    """The host and its parent domains of two labels or more, the host first."""
    labels = F.split(host, r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def daily_entries(entries: DataFrame) -> DataFrame:
    """One entry per domain and day of ``domain, listed_on, action``; rows that lack any of these tell nothing."""
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.lower("action"))
    ranked = entries.select(F.lower("domain").alias("domain"), F.col("listed_on").alias("day"), rank.alias("rank"))
    known = ranked.where(F.col("domain").isNotNull() & F.col("day").isNotNull() & (F.col("rank") > 0))
    return known.groupBy("domain", "day").agg(F.element_at(F.array(*map(F.lit, ACTIONS)), F.min("rank").cast("int")).alias("action"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``domain, action, valid_from, valid_to``: ``valid_to`` is the day of the next entry, null for the last."""
    by_day = Window.partitionBy("domain").orderBy("day")
    return daily_entries(entries).select("domain", "action", F.col("day").alias("valid_from"), F.lead("day").over(by_day).alias("valid_to"))


def _active(asked: DataFrame, intervals: DataFrame) -> DataFrame:
    """As-of join: for each ``domain, day`` of ``asked`` the interval that holds the day, if any.

    Both sides have at most a row per domain and day, which bounds a window of a domain by the days that occur.
    """
    interval = F.struct("action", "valid_from", "valid_to")
    line = intervals.select("domain", F.col("valid_from").alias("day"), interval.alias("entry"), F.lit(False).alias("asked"))
    line = line.unionByName(asked.select("domain", "day", F.lit(None).cast(line.schema["entry"].dataType).alias("entry"), F.lit(True).alias("asked")))
    until = Window.partitionBy("domain").orderBy("day", "asked").rowsBetween(Window.unboundedPreceding, 0)
    return line.select("domain", "day", F.last("entry", ignorenulls=True).over(until).alias("entry"), "asked").where("asked").drop("asked")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every row of ``captures`` (``url``, ``fetched_on`` and others) with the verdict of the list on its day.

    Added columns: ``host``, ``verdict`` (blocked, allowed or unlisted), and of the entry that decided,
    ``domain``, ``valid_from`` and ``valid_to``. The entry of the longest domain that covers the host counts; one
    that was lifted counts as absent. Captures without a host or a day, like all captures under an empty list,
    are unlisted; repeated captures are answered one by one. Columns of ``captures`` that bear the name of an
    added one are replaced.
    """
    added = ("host", "verdict", "domain", "valid_from", "valid_to")
    captures = captures.drop(*added).withColumn("host", host_of(F.col("url")))
    pairs = captures.where("host is not null and fetched_on is not null").select("host", F.col("fetched_on").alias("day")).distinct()
    asked = pairs.select("host", "day", F.posexplode(_domains(F.col("host"))).alias("depth", "domain"))
    active = _active(asked.select("domain", "day").distinct(), validity_intervals(entries))
    listed = asked.join(active.where("entry.action != 'lift'"), ["domain", "day"])
    decided = listed.groupBy("host", "day").agg(F.min_by(F.struct("domain", "entry"), "depth").alias("_by"))
    verdict = F.when(F.col("_by.entry.action") == "block", "blocked").when(F.col("_by.entry.action") == "allow", "allowed").otherwise("unlisted")
    named = decided.select(F.col("host").alias("_host"), F.col("day").alias("_day"), "_by")
    return captures.join(named, (F.col("host") == F.col("_host")) & (F.col("fetched_on") == F.col("_day")), "left").select(
        *[F.col(f"`{c}`") for c in captures.columns],
        verdict.alias("verdict"),
        F.col("_by.domain").alias("domain"),
        F.col("_by.entry.valid_from").alias("valid_from"),
        F.col("_by.entry.valid_to").alias("valid_to"),
    )


# The given tables have neither fetch days nor a list, so both are worked out from `pages`: every page is a capture,
# and a page of a suspect host, or one page in four, stands for a list entry of its host or the host's parent.
SUSPECT = "casino|spam|bets|free-|pills|loan"
START = "2024-01-01"
DAYS = 366


def captures_of(pages: DataFrame) -> DataFrame:
    day = F.expr(f"date_add(date'{START}', cast((page_id * 37 + length(url)) % {DAYS} as int))")
    return pages.select("page_id", "url", day.alias("fetched_on"))


def entries_of(pages: DataFrame) -> DataFrame:
    host = host_of(F.col("url"))
    turn = F.expr("(page_id + length(html)) % 8")
    action = F.when(host.rlike(SUSPECT) & (turn < 6), "block").when(turn == 0, "block").when(turn == 1, "allow").when(turn == 2, "lift")
    domains = _domains(host)
    domain = F.when(turn % 2 == 1, F.element_at(domains, -1)).otherwise(F.element_at(domains, 1))
    day = F.expr(f"date_add(date'{START}', cast((page_id + 7 * length(html)) % {DAYS} as int))")
    return pages.select(domain.alias("domain"), day.alias("listed_on"), action.alias("action"))


def judged_pages(pages: DataFrame) -> DataFrame:
    judged = judge(captures_of(pages), entries_of(pages))
    return judged.select("page_id", "host", "verdict", "domain", *[F.col(c).cast("string") for c in ("fetched_on", "valid_from", "valid_to")])


JUDGED_PAGES_SQL = rf"""
WITH hosts AS (
  SELECT *, nullif(regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '^www\.|\.$', '', 'g'), '') AS host FROM pages),
named AS (
  SELECT page_id, url, host, string_split(host, '.') AS labels, (page_id + length(html)) % 8 AS turn,
         DATE '{START}' + CAST((page_id * 37 + length(url)) % {DAYS} AS INTEGER) AS fetched_on,
         DATE '{START}' + CAST((page_id + 7 * length(html)) % {DAYS} AS INTEGER) AS listed_on
  FROM hosts),
entries AS (
  SELECT CASE WHEN turn % 2 = 1 AND len(labels) > 1 THEN array_to_string(labels[-2:], '.') ELSE host END AS domain, listed_on,
         CASE WHEN regexp_matches(host, '{SUSPECT}') AND turn < 6 OR turn = 0 THEN 1 WHEN turn = 1 THEN 2 WHEN turn = 2 THEN 3 END AS action
  FROM named),
daily AS (SELECT domain, listed_on, min(action) AS action FROM entries WHERE action IS NOT NULL AND domain IS NOT NULL GROUP BY ALL),
intervals AS (
  SELECT domain, action, listed_on AS valid_from, lead(listed_on) OVER (PARTITION BY domain ORDER BY listed_on) AS valid_to FROM daily),
asked AS (
  SELECT page_id, fetched_on, i, array_to_string(labels[i:], '.') AS domain
  FROM named, unnest(range(1, greatest(len(labels), 2))) AS t(i)),
matched AS (
  SELECT a.page_id, a.i, a.domain, n.action, n.valid_from, n.valid_to
  FROM asked a ASOF JOIN intervals n ON a.domain = n.domain AND a.fetched_on >= n.valid_from),
decided AS (SELECT * FROM matched WHERE action < 3 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) = 1)
SELECT n.page_id, n.host, CASE d.action WHEN 1 THEN 'blocked' WHEN 2 THEN 'allowed' ELSE 'unlisted' END AS verdict, d.domain,
       CAST(n.fetched_on AS VARCHAR) AS fetched_on, CAST(d.valid_from AS VARCHAR) AS valid_from, CAST(d.valid_to AS VARCHAR) AS valid_to
FROM named n LEFT JOIN decided d USING (page_id)"""
