"""URL filters by a temporal list join, in DataFrame functions alone.

Dated list entries (an action on a host, a parent domain or a first path step) become validity
intervals; each capture is joined as of its fetch time with the entries active then, and the most
specific one decides.  Intervals are dealt out over the periods that they cover, so that the join
has equal keys (pattern and period) and a pattern with many entries or captures is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds in a period; intervals are cut at period ends.
PERIOD = 30 * 86_400


def host_of(url: Column) -> Column:
    """The lower-case host without user, port and a leading ``www.``; empty if the URL has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def first_step(url: Column) -> Column:
    """The first step of the path, with its slash; empty without one."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]+)", 1)


def patterns_of(url: Column) -> Column:
    """The patterns that a URL falls under, most specific first: host with first step, host, parent
    domains down to two labels."""
    host, step = host_of(url), first_step(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    parents = F.when(n >= 3, parents).otherwise(F.array().cast("array<string>"))
    own = F.when(step != "", F.array(F.concat(host, step), host)).otherwise(F.array(host))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(own, parents))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to) from dated entries (pattern, action, listed_at): an entry
    holds until the pattern's next one, the last for ever (null).  Of entries of one pattern and
    time the greatest action holds; an action "remove" ends the listing; nulls are no entries."""
    e = entries.filter(F.col("pattern").isNotNull() & F.col("action").isNotNull() & F.col("listed_at").isNotNull())
    e = e.groupBy("pattern", "listed_at").agg(F.max("action").alias("action"))
    following = F.lead("listed_at").over(Window.partitionBy("pattern").orderBy("listed_at"))
    out = e.select("pattern", "action", F.col("listed_at").alias("valid_from"), following.alias("valid_to"))
    return out.filter(F.col("action") != "remove")


def filter_urls(captures: DataFrame, entries: DataFrame, period: int = PERIOD, horizon: Column | None = None) -> DataFrame:
    """(page_id, url, fetched_at, pattern, action, listed_at, kept): a row per row of ``captures``
    (page_id, url, fetched_at), with the entry that decides, if any; kept unless its action is block.

    No entry decides on a null or hostless URL or a null time.  Entries of one pattern never overlap;
    of several patterns the most specific decides.  Repeated rows are each returned, with the same
    result.  Other columns of ``captures`` are left out; join them by page_id and fetched_at.  ``horizon`` ends open intervals for the cut into
    periods; by default the last fetch time.
    """
    iv = intervals(entries)
    if horizon is None:
        end = captures.agg(F.max("fetched_at").alias("_end"))
        iv = iv.join(F.broadcast(end), F.col("valid_from") <= F.col("_end"))
    else:
        iv = iv.withColumn("_end", horizon)
    number = lambda c: F.floor(F.unix_seconds(c) / period)
    stop = F.least(F.coalesce("valid_to", "_end"), F.col("_end"))
    cut = iv.select("pattern", "action", "valid_from", "valid_to", F.explode(F.sequence(number(F.col("valid_from")), F.greatest(number(stop), number(F.col("valid_from"))))).alias("period"))

    keyed = captures.select("page_id", "url", "fetched_at").withColumn("_row", F.struct("page_id", "url", "fetched_at"))
    asked = keyed.select("_row", "fetched_at", F.posexplode(patterns_of(F.col("url"))).alias("rank", "pattern")).withColumn("period", number(F.col("fetched_at")))
    hit = asked.join(cut, ["pattern", "period"]).filter((F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
    best = hit.groupBy("_row").agg(F.min(F.struct("rank", "pattern", "action", F.col("valid_from").alias("listed_at"))).alias("best"))
    b = best.select(F.col("_row").alias("_b"), "best")
    out = keyed.join(b, keyed["_row"].eqNullSafe(b["_b"]), "left")
    kept = F.coalesce(F.col("best.action") != "block", F.lit(True)).alias("kept")
    return out.select("page_id", "url", "fetched_at", "best.pattern", "best.action", "best.listed_at", kept)
