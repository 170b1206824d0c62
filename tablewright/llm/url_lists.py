"""Temporal URL lists: each capture is judged by the entries that were active when it was fetched.

Dated entries (add or remove of a domain on a list) become validity intervals, found by the next dated entry of the same
list and domain; an interval holds from its day up to, not including, the next. Captures are keyed by their host and each of
its parent domains. What is asked of the lists is only (domain, day), however many captures share it: these are put in order
with the intervals of their domain and look back to the last one begun, an as-of join whose groups hold no more
than the days of a calendar and a domain's own changes. The answers go back to captures by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.plans.scratch import Scratch

FOREVER = 2_147_483_647
#: Parent domains looked at, from the top: a.b.c.d.e is keyed by itself and by its last 2, 3, ... labels.
LEAST_LABELS = 2
HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"
ADDRESS = r"^(\[.*|[0-9]+(\.[0-9]+){3})$"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot, an IPv6 address in its brackets; null for what has none."""
    host = F.regexp_extract(F.lower(url), HOST, 1)
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def domains_of(host: Column) -> Column:
    """The host and its parent domains of at least ``LEAST_LABELS`` labels; a host of one label or an address is its own."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    ends = F.sequence(F.lit(0), F.greatest(n - LEAST_LABELS, F.lit(0)))
    return F.when(host.rlike(ADDRESS), F.array(host)).otherwise(F.transform(ends, lambda k: F.array_join(F.slice(labels, k + 1, n - k), ".")))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list_name, domain, from_day, to_day) from dated entries (list_name, domain, day, action).

    On one day the last action by name (remove after add) holds. An add that follows an add changes nothing but starts
    a new interval. Entries with a null in any of the four are no entries.
    """
    clean = entries.dropna(subset=["list_name", "domain", "day", "action"]).groupBy("list_name", "domain", "day").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list_name", "domain").orderBy("day")
    return clean.withColumn("to_day", F.coalesce(F.lead("day").over(w), F.lit(FOREVER))).filter("action = 'add'").select("list_name", "domain", F.col("day").alias("from_day"), "to_day")


def active_entries(visits: DataFrame, intervals: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, fetch_day) with n_active and the sorted lists, for those that meet an active entry."""
    keys = visits.withColumn("domain", F.explode(domains_of(F.col("host"))))
    asked = keys.select("domain", F.col("fetch_day").alias("day")).distinct().join(intervals.select("list_name", "domain").distinct(), "domain")
    begun = intervals.select("list_name", "domain", F.col("from_day").alias("day"), "to_day", F.lit(False).alias("asks"))
    both = begun.unionByName(asked.select("list_name", "domain", "day", F.lit(None).cast("int").alias("to_day"), F.lit(True).alias("asks")))
    # On one day the interval that begins then comes first.
    back = Window.partitionBy("list_name", "domain").orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = both.withColumn("until", F.last("to_day", ignorenulls=True).over(back))
    active = scratch.table(last.filter("asks AND day < until").select("list_name", "domain", F.col("day").alias("fetch_day")), "active")
    hits = keys.join(active, ["domain", "fetch_day"])
    return hits.groupBy("host", "fetch_day").agg(F.count("*").alias("n_active"), F.array_sort(F.collect_set("list_name")).alias("lists"))


def filter_captures(captures: DataFrame, entries: DataFrame, scratch: Scratch) -> DataFrame:
    """Captures (page_id, url, fetch_day) with host, n_active, lists and blocked.

    Captures of one host and day share their verdict, so the join runs over (host, day), not over captures. A null url,
    host or day meets no entry and stays unblocked. Repeated captures keep their rows. Extra columns are ignored, whatever
    their names. Very long urls are read whole. Without captures there are no rows; without entries nothing is blocked.
    """
    keyed = captures.select("page_id", "url", "fetch_day").withColumn("host", host_of(F.col("url")))
    intervals = scratch.table(validity_intervals(entries), "intervals")
    visits = scratch.table(keyed.select("host", "fetch_day").dropna().distinct(), "visits")
    verdicts = scratch.table(active_entries(visits, intervals, scratch), "verdicts")
    # A capture without a host would meet all its like in one task if it were joined.
    with_host = keyed.filter("host IS NOT NULL AND fetch_day IS NOT NULL").join(verdicts, ["host", "fetch_day"], "left")
    without = keyed.filter("host IS NULL OR fetch_day IS NULL").withColumns({"n_active": F.lit(None).cast("long"), "lists": F.lit(None).cast("array<string>")})
    out = with_host.unionByName(without)
    return out.select("page_id", "host", "fetch_day", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.array_join(F.coalesce("lists", F.array().cast("array<string>")), ",").alias("lists"), F.coalesce(F.col("n_active") > 0, F.lit(False)).alias("blocked"))


def _digit(name: Column, salt: str, modulus: int) -> Column:
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), name)), 1, 8), 16, 10).cast("long") % modulus).cast("int")


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the domains of ``pages``: two lists, on each up to three dated changes of a third of the domains."""
    domains = pages.select(F.explode(domains_of(host_of(F.col("url")))).alias("domain")).distinct()
    change = lambda k: F.struct(F.lit(k).alias("k"), (_digit(F.col("domain"), f"day{k}", 300) + 20 * k).alias("day"), F.when(F.lit(k) == 1, "remove").otherwise("add").alias("action"))
    rows = domains.withColumn("list_name", F.explode(F.array(F.lit("adult"), F.lit("spam")))).filter(_digit(F.concat("list_name", F.lit("/"), "domain"), "on", 3) == 0)
    return rows.withColumn("c", F.explode(F.array(change(0), change(1), change(2)))).select("list_name", "domain", F.col("c.day").alias("day"), F.col("c.action").alias("action"))


def op10_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every row of ``pages``; its fetch day, which the table lacks, is derived from its id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetch_day", F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int"))
    return filter_captures(captures, derived_entries(pages), Scratch(spark, "urls"))


OP10_SQL = r"""
WITH c AS (SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)', 1), '\.$', ''), '') AS host,
       CAST((page_id * 37) % 365 AS INTEGER) AS fetch_day FROM pages),
x AS (SELECT *, CASE WHEN regexp_matches(host, '^(\[.*|[0-9]+(\.[0-9]+){3})$') THEN [host] ELSE string_split(host, '.') END AS labels FROM c),
k AS (SELECT page_id, fetch_day, unnest(list_transform(range(0, greatest(len(labels) - 2, 0) + 1), lambda i: array_to_string(labels[i + 1:], '.'))) AS domain FROM x WHERE host IS NOT NULL),
d AS (SELECT DISTINCT domain FROM k),
e AS (SELECT l.list_name, domain, n.k, CAST(CAST('0x' || substr(md5('day' || n.k || ':' || domain), 1, 8) AS BIGINT) % 300 + 20 * n.k AS INTEGER) AS day,
        CASE WHEN n.k = 1 THEN 'remove' ELSE 'add' END AS action
      FROM d, (VALUES ('adult'), ('spam')) l(list_name), (VALUES (0), (1), (2)) n(k)
      WHERE CAST('0x' || substr(md5('on:' || l.list_name || '/' || domain), 1, 8) AS BIGINT) % 3 = 0),
u AS (SELECT list_name, domain, day, max(action) AS action FROM e GROUP BY ALL),
v AS (SELECT *, coalesce(lead(day) OVER (PARTITION BY list_name, domain ORDER BY day), 2147483647) AS to_day FROM u),
h AS (SELECT page_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT list_name)), ',') AS lists FROM k JOIN v USING (domain)
      WHERE action = 'add' AND fetch_day >= day AND fetch_day < to_day GROUP BY 1)
SELECT c.page_id, host, fetch_day, CAST(coalesce(n, 0) AS BIGINT) AS n_active, coalesce(lists, '') AS lists, coalesce(n, 0) > 0 AS blocked
FROM c LEFT JOIN h USING (page_id)
"""
