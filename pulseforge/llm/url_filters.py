"""URL filters by dated lists.

An entry of a list sets the action for a key from its date on, until the next entry of the same key: entries become
intervals of validity. A capture is evaluated against the entries that were active when it was fetched: by an as-of join on
its keys, which are its host, each parent domain, and each prefix of its path under the host. Of the active entries the one
with the longest key decides (an action of `remove` ends an entry, so it never decides); without any, the capture is allowed.

Hosts compare in lower case, without port and user. Null or malformed URLs (no scheme and host) have no keys and decision
`invalid`. A null fetch date is before all entries. Entries without key or date are none; of entries of one key on one date,
the last by action in code point order (block, then allow before remove) is in force. Rows that repeat a page_id are captures
of their own; further columns are ignored; empty tables give empty results or no decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stored


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def keys_of(url: Column, depth: int) -> Column:
    """The keys of a URL, e.g. a.example.com/x/y.html: a.example.com, example.com, com, a.example.com/x/. Those of more than
    depth directories are left out."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)
    steps = F.slice(F.split(path, "/"), 2, depth + 1)  # without what stands before the first slash
    whole = F.size(F.split(path, "/")) - 2
    count = F.least(F.greatest(whole, F.lit(0)), F.lit(depth))
    prefixes = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/"), F.lit("/"))))
    return F.when(host != "", F.array_distinct(F.concat(domains, F.coalesce(prefixes, F.array().cast("array<string>")))))


def validity(entries: DataFrame) -> DataFrame:
    """(key, action, valid_from, valid_to) of entries (key, action, day); valid_to is the next entry's day, or null."""
    single = entries.filter("key is not null and day is not null and action is not null").groupBy("key", "day").agg(F.max("action").alias("action"))
    following = F.lead("day").over(Window.partitionBy("key").orderBy("day"))
    return single.select("key", "action", F.col("day").alias("valid_from"), following.alias("valid_to")).filter("action <> 'remove'")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched) with host, decision, decided_by, active_from and kept.

    A broadcast join where the list is small, else one by key: rows are narrow, and AQE splits what a hot host brings.
    Captures get keys of as many directories as the list's deepest key has: a longer one could not meet any.
    """
    lists = stored(validity(entries), "url-lists")
    seen = lists.agg(F.count("*").alias("n"), F.max(F.size(F.split("key", "/")) - 2).alias("depth")).first()
    lists = F.broadcast(lists) if seen["n"] <= BROADCAST_ROWS else lists
    rows = captures.select(F.monotonically_increasing_id().alias("_row"), "page_id", "url", "fetched").withColumn("host", host_of(F.col("url")))
    rows = rows.withColumn("_key", F.explode_outer(keys_of(F.col("url"), max(0, seen["depth"] or 0))))
    active = (F.col("_key") == F.col("key")) & (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    met = rows.join(lists, active, "left")
    # One row per capture again; a capture has few keys, so groups are small however hot its host.
    best = F.max(F.when(F.col("key").isNotNull(), F.struct(F.length("key").alias("n"), "key", "action", "valid_from"))).alias("best")
    one = met.groupBy("_row", "page_id", "fetched", "host").agg(best)
    decision = F.when(F.coalesce("host", F.lit("")) == "", "invalid").otherwise(F.coalesce("best.action", F.lit("allow")))
    return one.select(
        "page_id",
        F.nullif("host", F.lit("")).alias("host"),
        "fetched",
        decision.alias("decision"),
        F.col("best.key").alias("decided_by"),
        F.col("best.valid_from").alias("active_from"),
        (decision == "allow").alias("kept"),
    )


def dated(pages: DataFrame) -> DataFrame:
    """Captures of pages, which have no dates: page_id and 2024 give one."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int")).alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list made of the pages' own hosts and first directories, as no list is given: entries of a key begin at a day
    that the key's length and smallest page_id give, and turn to another action twice."""
    host = host_of(F.col("url"))
    named = pages.select("page_id", host.alias("host"), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)/", 1).alias("dir")).filter("host <> ''")
    keys = named.select("page_id", F.explode(F.array("host", F.when(F.col("dir") != "", F.concat_ws("", "host", F.lit("/"), "dir", F.lit("/"))))).alias("key")).filter("key is not null")
    first = keys.groupBy("key").agg(F.min("page_id").alias("p")).withColumn("s", F.col("p") + F.length("key"))
    turn = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("turn")
    action = F.element_at(F.array(F.lit("block"), F.lit("remove"), F.lit("allow")), (F.pmod(F.col("s") + F.col("turn"), F.lit(3)) + 1).cast("int"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.pmod(F.col("s") * 37, F.lit(120)) + F.col("turn") * 90).cast("int"))
    return first.select("key", "s", turn).select("key", action.alias("action"), day.alias("day"))


def filtered_pages(pages: DataFrame) -> DataFrame:
    return evaluate(dated(pages), derived_entries(pages))


ORACLE = r"""
WITH c AS (SELECT row_number() OVER () AS r, page_id, DATE '2024-01-01' + ((page_id * 7919) % 366)::INTEGER AS fetched, url,
           lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
           regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1) AS path FROM pages),
q AS (SELECT page_id, host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)/', 1) AS dir FROM c WHERE host <> ''),
k AS (SELECT page_id, host AS key FROM q UNION ALL SELECT page_id, host || '/' || dir || '/' FROM q WHERE dir <> ''),
f AS (SELECT key, min(page_id) + length(key) AS s FROM k GROUP BY key),
e AS (SELECT key, ['block', 'remove', 'allow'][((s + t) % 3)::INTEGER + 1] AS action, DATE '2024-01-01' + ((s * 37) % 120 + t * 90)::INTEGER AS day FROM f, (SELECT unnest([0, 1, 2]) AS t)),
v AS (SELECT * FROM (SELECT key, action, day AS valid_from, lead(day) OVER (PARTITION BY key ORDER BY day) AS valid_to FROM e) WHERE action <> 'remove'),
l AS (SELECT r, host, path, string_split(host, '.') AS d, string_split(path, '/') AS p FROM c WHERE host <> ''),
ck AS (SELECT r, array_to_string(d[i:], '.') AS key FROM l, unnest(range(1, len(d) + 1)) AS s(i)
       UNION SELECT r, host || '/' || array_to_string(p[2:i + 1], '/') || '/' FROM l, unnest(range(1, greatest(len(p) - 2, 0) + 1)) AS s(i)),
m AS (SELECT ck.r, v.*, row_number() OVER (PARTITION BY ck.r ORDER BY length(v.key) DESC, v.key DESC) AS k
      FROM ck JOIN c USING (r) JOIN v ON v.key = ck.key AND c.fetched >= valid_from AND (valid_to IS NULL OR c.fetched < valid_to))
SELECT page_id, nullif(host, '') AS host, c.fetched, CASE WHEN coalesce(host, '') = '' THEN 'invalid' ELSE coalesce(action, 'allow') END AS decision,
       key AS decided_by, valid_from AS active_from, CASE WHEN coalesce(host, '') = '' THEN 'invalid' ELSE coalesce(action, 'allow') END = 'allow' AS kept
FROM c LEFT JOIN m ON m.r = c.r AND m.k = 1
"""
