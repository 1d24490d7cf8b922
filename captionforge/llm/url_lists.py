"""URL filters: dated block lists become validity intervals, and an as-of join judges every capture at its fetch time.

A change adds a pattern (a host, or a domain that covers its subdomains) to a list or removes it. Between an addition
and the pattern's next change the entry is active, from the first moment on and without the last. A capture is blocked
if an entry for its host or for one of its parent domains is active when it is fetched; of several the longest
pattern is named. Changes of one pattern at one moment count in the order removals, additions, so it is active after.

Captures are judged once for each distinct host and moment, so a host with a third of all captures isn't joined as
often. A null or hostless URL, or a null fetch time, is never blocked. Changes with a null pattern or moment are void;
repeated ones change nothing. Repeated captures each get a row. Empty tables give empty results or nothing blocked. Other
columns of the captures are kept; ``host``, ``blocked``, ``pattern`` and ``since`` replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionforge.llm.common import table


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[]+)"


def host_of(url: Column) -> Column:
    """The lower-case host, without a dot at its end, an address in brackets whole; null where there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")
    return F.when(host != "", host)


def suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def intervals(changes: DataFrame) -> DataFrame:
    """pattern, since and until (null: still active) from changes (pattern, action ``add`` or ``remove``, at)."""
    order = Window.partitionBy("pattern").orderBy("at", F.desc("action"))
    dated = changes.select("pattern", "action", "at").filter("pattern is not null and at is not null").distinct()
    dated = dated.withColumn("until", F.lead("at").over(order)).filter("action = 'add' and (until is null or at < until)")
    return dated.select("pattern", F.col("at").alias("since"), "until")


def judged(captures: DataFrame, changes: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with host, blocked, pattern and since."""
    host = host_of(F.col(url))
    moments = captures.select(host.alias("h"), F.col(fetched).alias("t")).filter("h is not null and t is not null").distinct()
    tried = moments.select("h", "t", F.explode(suffixes(F.col("h"))).alias("pattern"))
    active = tried.join(intervals(changes), "pattern").filter((F.col("since") <= F.col("t")) & (F.col("until").isNull() | (F.col("t") < F.col("until"))))
    verdict = active.groupBy(F.col("h").alias("__u_h"), F.col("t").alias("__u_t")).agg(F.max(F.struct(F.length("pattern"), "pattern", "since")).alias("__u_v"))
    rows = captures.withColumn("__u_host", host)
    out = rows.join(verdict, (F.col("__u_host") == F.col("__u_h")) & (F.col(fetched) == F.col("__u_t")), "left")
    names = [c for c in captures.columns if c not in ("host", "blocked", "pattern", "since")]
    return out.select(*names, F.col("__u_host").alias("host"), F.col("__u_v").isNotNull().alias("blocked"), F.col("__u_v.pattern").alias("pattern"), F.col("__u_v.since").alias("since"))


def _number(name: str, salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.col(name), F.lit(salt))), 1, 7), 16, 10).cast("long")


def derived_changes(pages: DataFrame) -> DataFrame:
    """Dated changes for hosts and domains that occur in the pages: additions, removals and renewed additions."""
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).filter("pattern is not null").distinct()
    domains = hosts.select(F.regexp_replace("pattern", r"^[^.]+\.", "").alias("pattern")).distinct()
    some = hosts.filter(_number("pattern", "host") % 5 == 0).union(domains.filter(_number("pattern", "domain") % 9 == 0)).distinct()
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400).cast("timestamp_ntz")
    first, gap = _number("pattern", "first") % 15, 1 + _number("pattern", "gap") % 10
    add = some.select("pattern", F.lit("add").alias("action"), day(first).alias("at"))
    out = some.filter(_number("pattern", "out") % 3 > 0).select("pattern", F.lit("remove").alias("action"), day(first + gap).alias("at"))
    again = some.filter(_number("pattern", "again") % 3 == 0).select("pattern", F.lit("add").alias("action"), day(first + gap + 3).alias("at"))
    return add.union(out).union(again)


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of ``pages``; its fetch time follows from page_id, as the table has none."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.timestamp_seconds(F.lit(1704067200) + (F.col("page_id") * 7919) % 43200 * 60).cast("timestamp_ntz")
    return judged(pages.withColumn("fetched", fetched), derived_changes(pages)).select("page_id", "host", "fetched", "blocked", "pattern", "since")


def _sql_number(salt: str) -> str:
    return f"('0x' || substr(md5(pattern || '{salt}'), 1, 7))::BIGINT"


_SQL_DAY = "(TIMESTAMP '2024-01-01' + to_days(({})::INTEGER))"
_FIRST, _GAP = f"{_sql_number('first')} % 15", f"(1 + {_sql_number('gap')} % 10)"
ORACLE = f"""
WITH captures AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '\\.$', ''), '') AS host,
         TIMESTAMP '2024-01-01' + to_minutes(((page_id * 7919) % 43200)::INTEGER) AS fetched FROM pages),
hosts AS (SELECT DISTINCT host AS pattern FROM captures WHERE host IS NOT NULL),
domains AS (SELECT DISTINCT regexp_replace(pattern, '^[^.]+\\.', '') AS pattern FROM hosts),
picked AS (SELECT pattern FROM hosts WHERE {_sql_number('host')} % 5 = 0 UNION SELECT pattern FROM domains WHERE {_sql_number('domain')} % 9 = 0),
changes AS (
  SELECT pattern, 'add' AS action, {_SQL_DAY.format(_FIRST)} AS moment FROM picked
  UNION SELECT pattern, 'remove', {_SQL_DAY.format(f'{_FIRST} + {_GAP}')} FROM picked WHERE {_sql_number('out')} % 3 > 0
  UNION SELECT pattern, 'add', {_SQL_DAY.format(f'{_FIRST} + {_GAP} + 3')} FROM picked WHERE {_sql_number('again')} % 3 = 0),
dated AS (SELECT *, lead(moment) OVER (PARTITION BY pattern ORDER BY moment, action DESC) AS until FROM changes),
active AS (SELECT pattern, moment AS since, until FROM dated WHERE action = 'add'),
hits AS (
  SELECT c.page_id, a.pattern, a.since, row_number() OVER (PARTITION BY c.page_id ORDER BY length(a.pattern) DESC, a.pattern DESC, a.since DESC) AS k
  FROM captures c JOIN active a ON (c.host = a.pattern OR ends_with(c.host, '.' || a.pattern)) AND a.since <= c.fetched AND (a.until IS NULL OR c.fetched < a.until))
SELECT c.page_id, c.host, c.fetched, h.pattern IS NOT NULL AS blocked, h.pattern, h.since
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.k = 1
"""

QUERIES = {"op2_url_lists": op2_url_lists}
ORACLES = {"op2_url_lists": ORACLE}
