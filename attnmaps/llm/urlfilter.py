"""URL filters as a temporal list join.

A list is a table of dated events: on a date an entry is added to or removed from a list.
Each entry's events become validity intervals, and a capture is blocked if, at its fetch
time, an interval holds for its host or for a domain above it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def url_host(url):
    """Host of a URL in lower case, without user, port and final dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def intervals(events: DataFrame) -> DataFrame:
    """(entry, list, valid_from, valid_to) from events (entry, list, action, at).

    An entry is valid from an "add" to the next "remove" of the same list, or for good
    (``valid_to`` null). Repeated events of a kind change nothing; of events at one time
    the removal counts last. Events without an entry, list or time are no events.
    """
    known = events.where("entry is not null and list is not null and at is not null and action in ('add', 'remove')")
    own = Window.partitionBy("list", "entry").orderBy("at", "action")
    turns = known.withColumn("before", F.lag("action").over(own)).where("before is null or before <> action")
    closed = turns.withColumn("valid_to", F.lead("at").over(own)).where("action = 'add'")
    return closed.select("entry", "list", F.col("at").alias("valid_from"), "valid_to").where("valid_to is null or valid_to > valid_from")


def host_keys(host):
    """The host and every domain above it that has a dot; an IP number has none above it."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    deep = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), n - 2)),
        lambda k: F.array_join(F.slice(labels, k + 1, n), "."),
    )
    return F.when(host.isNotNull(), F.when(host.rlike(r"^[0-9.]+$|^\["), F.array(host)).otherwise(deep))


def block(captures: DataFrame, events: DataFrame, id_col: str, url_col: str, time_col: str) -> DataFrame:
    """(id, host, fetched_at, blocked, entry, list, n_lists) of every capture.

    The as-of join finds, for each capture and each of its domains, the intervals that
    hold at the fetch time (from included, to excluded). ``entry`` and ``list`` are of the
    longest such domain, ties to the first list by name. Captures with no host or no
    time aren't blocked. Rows that repeat an id with the same host and time are one
    capture; those that differ are judged each.
    """
    rows = captures.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), F.col(time_col).alias("fetched_at"))
    # the hosts of a capture's keys are few, so matches are looked up by (host, time) and
    # not by capture: a host with a third of all captures is one row for each time
    seen = rows.where("host is not null and fetched_at is not null").select("host", "fetched_at").distinct()
    keys = seen.select("host", "fetched_at", F.explode(host_keys(F.col("host"))).alias("entry"))
    valid = intervals(events)
    held = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    hits = keys.join(valid, "entry").where(held)
    best = F.min(F.struct((-F.length("entry")).alias("size"), "list", "entry")).alias("best")
    verdicts = hits.groupBy("host", "fetched_at").agg(best, F.count(F.lit(1)).alias("n_lists"))
    joined = rows.join(verdicts.withColumnsRenamed({"host": "_host", "fetched_at": "_at"}), (F.col("host") == F.col("_host")) & (F.col("fetched_at") == F.col("_at")), "left")
    return joined.select(
        "id", "host", "fetched_at", F.col("best").isNotNull().alias("blocked"),
        F.col("best.entry").alias("entry"), F.col("best.list").alias("list"), F.coalesce("n_lists", F.lit(0)).cast("long").alias("n_lists"),
    )
