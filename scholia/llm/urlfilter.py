"""URL filters by a temporal list join.

Dated list entries (add, remove) of a list and key become validity intervals, and every capture is evaluated against the entries that were active when it
was fetched. A key's intervals are one row, an array in time order, so the as-of join is an equi-join on keys followed by a look into that array: a
capture makes one row for each key it can match (its host, its parent domains, its path prefixes), whatever the length of a key's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut


def host(url: Column) -> Column:
    """Lower-cased host of a URL without user and port, in brackets where it is a numeric address; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))


def match_keys(url: Column) -> Column:
    """Keys under which a URL can be listed: its host and every parent domain, and its host with each leading part of its path.

    Scheme, user, port, query and fragment don't count; a URL without a host has no keys.
    """
    name, labels = host(url), F.split(host(url), r"\.")
    path = F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1), F.lit(""))
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.concat(name, F.lit("/"), F.concat_ws("/", F.slice(steps, F.lit(1), i))))
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, F.filter(prefixes, lambda p: ~p.endswith("/")))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, key, history): for each list and key the intervals [since, until) in which it was listed, in time order.

    ``entries`` has list, key, listed (true: added, false: removed) and at. Of entries of one time the removal wins. Entries that repeat the state change nothing;
    case counts in the path of a key but not in its host; null list, key, listed or at are ignored; until is null while the entry is still active.
    """
    dated = entries.select("list", F.expr("concat(lower(substring_index(key, '/', 1)), substring(key, length(substring_index(key, '/', 1)) + 1))").alias("key"), "listed", "at").dropna().groupBy("list", "key", "at").agg(F.min("listed").alias("listed"))
    order = Window.partitionBy("list", "key").orderBy("at")
    changes = dated.withColumn("before", F.lag("listed", 1, False).over(order)).where("listed != before")
    spans = changes.withColumn("until", F.lead("at").over(order)).where("listed")
    return spans.groupBy("list", "key").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("since"), "until"))).alias("history"))


def filter_urls(captures: DataFrame, entries: DataFrame, id_column: str = "page_id") -> DataFrame:
    """Evaluate every row of ``captures`` (id, url, fetched_at) against the list entries active at its fetch time.

    Returns one row per input row: id, url, fetched_at, lists (sorted names of the lists that hold it), matched_key (longest matching key, ties to the
    first in order; null if none), kept (no list holds it).

    Null urls or fetch times match nothing and are kept. Repeated rows are kept apart; extra columns are ignored. The list side is broadcast up to a
    measured size and joined by shuffle beyond it.
    """
    rows = captures.select(F.col(id_column), "url", "fetched_at")
    intervals = cut(validity_intervals(entries))
    size = intervals.agg(F.sum(F.octet_length("list") + F.octet_length("key") + 24 * F.size("history") + 48)).first()[0] or 0
    # distinct captures are matched once; copies of a capture share the result
    asked = rows.where("url is not null and fetched_at is not null").select("url", "fetched_at").distinct()
    keyed = asked.select("url", "fetched_at", F.explode(match_keys(F.col("url"))).alias("key"))
    active = F.exists("history", lambda s: (s["since"] <= F.col("fetched_at")) & (s["until"].isNull() | (F.col("fetched_at") < s["until"])))
    hits = keyed.join(F.broadcast(intervals) if size <= BROADCAST_BYTES else intervals, "key").where(active)
    held = hits.groupBy("url", "fetched_at").agg(F.sort_array(F.collect_set("list")).alias("lists"), F.min(F.struct(-F.length("key"), F.col("key").alias("key")))["key"].alias("matched_key"))
    out = rows.join(held, ["url", "fetched_at"], "left")
    return out.select(id_column, "url", "fetched_at", F.coalesce("lists", F.array().cast("array<string>")).alias("lists"), "matched_key", F.col("lists").isNull().alias("kept"))
