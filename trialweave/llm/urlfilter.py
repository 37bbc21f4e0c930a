"""URL filters by dated lists.

A list is a history of dated entries that add or remove a key: a domain
("example.org" covers its subdomains) or a URL prefix ("example.org/de/").
Entries become validity intervals, and every capture is judged by the intervals
of its URL's keys that are open at its fetch time: an as-of join. The most
specific key decides, and on the same key an allowing entry goes before a
blocking one. The join is by key and month, so that a key with a long history is spread over its months.
Keys that no list has are dropped before it, where lists have at most ``LISTED`` keys. A key and month with more than one
in ``HOT`` of all captures' keys (one host with most captures of a crawl) is dealt to ``SALTS`` tasks. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.common import let
from trialweave.session import staged

#: Up to so many listed keys are broadcast; which keys are hot (at most so many), and to how many tasks each goes.
LISTED, HOT, SALTS = 1_000_000, 1000, 64
#: Years and months as one number.
_MONTH = "year({0}) * 12 + month({0})"


def host_of(url: Column) -> Column:
    """The lower-cased host of an absolute URL, without user, port and final dot; null if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:@]+)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def url_keys(url: Column) -> Column:
    """All keys that cover a URL: its host and parent domains, and its host with each leading part of the path."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)

    def domains(labels: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

    def prefixes(parts: Column, host: Column) -> Column:
        # "/a/b" has the parts "", "a", "b": the folders "/" and "/a/", and the path as it stands.
        folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
        return F.array_append(folders, F.concat(host, F.array_join(parts, "/")))

    keys = let(host_of(url), lambda h: F.when(h.isNotNull(), F.concat(domains(F.split(h, r"\.")), prefixes(F.split(path, "/"), h))))
    return F.array_distinct(F.coalesce(keys, F.array().cast("array<string>")))


def intervals(entries: DataFrame) -> DataFrame:
    """list, action, key, valid_from and valid_to (null: still open) of a history of entries.

    ``entries`` has list, action (allow or block), key, op (add or remove) and
    dated. Adding what is listed and removing what isn't change nothing; of
    entries at the same time, removals come first. Entries without a key or
    time are void. Repeated entries count once.
    """
    history = Window.partitionBy("list", "action", "key").orderBy("dated", "adds")
    known = entries.where("key is not null and dated is not null and op in ('add', 'remove') and action in ('allow', 'block')")
    once = known.select("list", "action", F.lower("key").alias("key"), (F.col("op") == "add").cast("int").alias("adds"), "dated").distinct()
    turns = once.withColumn("was", F.coalesce(F.lag("adds").over(history), F.lit(0))).where("adds <> was")
    closed = turns.withColumn("valid_to", F.lead("dated").over(history)).where("adds = 1")
    return closed.select("list", "action", "key", F.col("dated").alias("valid_from"), "valid_to").where("valid_to is null or valid_to > valid_from")


def _maybe_broadcast(keys: DataFrame) -> DataFrame:
    """``keys`` for a join by broadcast, if there are few enough."""
    return F.broadcast(keys) if keys.limit(LISTED + 1).count() <= LISTED else keys


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Verdict for every row of ``captures`` (page_id, url, fetched_at).

    Returns page_id, url, fetched_at, verdict, key, list, valid_from, valid_to.
    The verdict is ``block``, ``allow`` (an allowing entry decides), ``keep``
    (no entry is open) or ``invalid`` (no absolute URL). Null fetch time: no
    entry is open. Repeated captures get the same verdict; a null page_id is an
    id like any other; of lists that tie, the first by name decides. Path keys
    compare without regard to case. Empty captures give no rows, and without entries all valid ones are kept.
    """
    rows = captures.select("page_id", "url", "fetched_at")
    keyed = rows.where("fetched_at is not null").distinct().withColumn("key", F.explode(F.transform(url_keys(F.col("url")), F.lower))).withColumn("month", F.expr(_MONTH.format("fetched_at")))
    newest = F.timestamp_micros(F.lit(rows.agg(F.max(F.unix_micros("fetched_at"))).first()[0]).cast("long"))
    spans = intervals(entries).withColumn("until", F.coalesce(F.least("valid_to", newest), newest)).where("valid_from <= until")
    spans = spans.withColumn("month", F.explode(F.sequence(F.expr(_MONTH.format("valid_from")), F.expr(_MONTH.format("until"))))).drop("until")
    spans = staged(spans, "url-spans")
    keyed = keyed.join(_maybe_broadcast(spans.select("key").distinct()), "key", "left_semi")
    places = keyed.groupBy("key", "month").agg(F.count(F.lit(1)).alias("n"))
    hot = staged(places.where(F.col("n") * HOT > keyed.count()).drop("n").withColumn("hot", F.lit(True)), "url-hot")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0)))
    keyed, spans = (x.join(F.broadcast(hot), ["key", "month"], "left").withColumn("salt", by).drop("hot") for x, by in ((keyed, salt), (spans, salts)))
    open_then = (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    active = keyed.join(spans, ["key", "month", "salt"]).where(open_then)
    # A path key has more characters than the host it begins with, and a host more than its parents.
    rank = F.struct(F.length("key").alias("n"), (F.col("action") == "allow").alias("allows"))
    best = active.groupBy("page_id", "url", "fetched_at").agg(F.max(F.struct(rank.alias("rank"), "action", "key")).alias("top"), F.collect_set(F.struct(rank.alias("rank"), "list", "valid_from", "valid_to")).alias("all"))
    chosen = F.array_min(F.transform(F.filter("all", lambda x: x["rank"] == F.col("top.rank")), lambda x: F.struct(x["list"].alias("list"), x["valid_from"].alias("valid_from"), x["valid_to"].alias("valid_to"))))
    best = best.select(F.col("page_id").alias("_p"), F.col("url").alias("_u"), F.col("fetched_at").alias("_f"), "top.action", "top.key", chosen.alias("by"))
    same = rows["page_id"].eqNullSafe(best["_p"]) & rows["url"].eqNullSafe(best["_u"]) & rows["fetched_at"].eqNullSafe(best["_f"])
    verdict = F.when(host_of(F.col("url")).isNull(), "invalid").otherwise(F.coalesce("action", F.lit("keep")))
    return rows.join(best, same, "left").select("page_id", "url", "fetched_at", verdict.alias("verdict"), "key", "by.list", "by.valid_from", "by.valid_to")
