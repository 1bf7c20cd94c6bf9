"""URL filters with dated lists: every capture is judged by the entries active when it was fetched.

A list is a log of entries that come and go on dates. Each becomes validity
intervals; a capture meets those of its keys that hold its fetch date. Keys are
the host, the domains above it, the directories of the path and the URL itself.
The most specific entry decides, then the latest, then a block.

Only built-in functions are used. The key with the most captures may be joined
by many tasks, since the join needs no more than equal keys and a date between
two others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

# Kinds of entries, from general to specific.
KINDS = ("domain", "host", "prefix", "url")
_FOREVER = "9999-12-31"


def parsed(captures: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (lower case, without port and user) and ``path`` (up to query and fragment, at least '/').

    A URL without a scheme and a host has null for both.
    """
    pattern = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)"
    host = F.lower(F.regexp_extract(url, pattern, 1))
    path = F.regexp_extract(url, pattern, 2)
    return captures.withColumns({
        "host": F.when(host != "", host),
        "path": F.when(host != "", F.when(path == "", "/").otherwise(path)),
    })


def keys_of(captures: DataFrame) -> DataFrame:
    """A row (id, url, fetched, kind, key) for each key of (id, url, fetched, host, path)."""
    labels = F.split("host", r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    folders = F.split("path", "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(folders) - 1, F.lit(1))),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat("host", F.array_join(F.slice(folders, 1, i), "/"), F.lit("/")).alias("key")))
    single = F.array(
        F.struct(F.lit("host").alias("kind"), F.col("host").alias("key")),
        F.struct(F.lit("url").alias("kind"), F.concat("host", "path").alias("key")))
    known = captures.filter("host IS NOT NULL AND fetched IS NOT NULL")
    return known.select("id", "url", "fetched", F.explode(F.concat(domains, prefixes, single)).alias("k")).select("id", "url", "fetched", "k.*")


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, key, action, since, until): when an entry was active, of the log (kind, key, action, day, added).

    An entry holds from the day it is added up to the day before its next row, which adds it anew or takes it away;
    of rows of one day the one that takes away comes last. Rows without key, kind, action or day are void.
    """
    valid = entries.filter("kind IS NOT NULL AND key IS NOT NULL AND action IS NOT NULL AND day IS NOT NULL").select(
        "kind", "key", "action", "day", F.coalesce("added", F.lit(True)).alias("added")).distinct()
    history = Window.partitionBy("kind", "key", "action").orderBy("day", F.col("added").desc())
    until = F.coalesce(F.lead("day").over(history), F.lit(_FOREVER).cast("date"))
    return valid.withColumn("until", until).filter(F.col("added") & (F.col("day") < F.col("until"))).select(
        "kind", "key", "action", F.col("day").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, n_entries, kind, key, action, blocked) of (id, url, fetched) under the log of entries.

    ``n_entries`` counts active entries that match. A capture without any, without
    a readable URL or without a fetch date is not blocked and has null for the
    entry. Rows with one id are judged on their own; repeated rows stay repeated.
    """
    captures = captures.select("id", "url", "fetched")
    # Stored, so that both sides of the join are plain shuffles, which Spark can split where one key has many captures.
    active = keys_of(parsed(captures.distinct())).join(stored(intervals(entries), "intervals"), ["kind", "key"]).filter("since <= fetched AND fetched < until")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    # One row per capture and task before the shuffle.
    best = active.groupBy("id", "url", "fetched").agg(
        F.count("key").alias("n_entries"),
        F.max(F.struct(order.alias("rank"), F.length("key").alias("length"), "since", "action", "kind", "key")).alias("e"))
    decided = best.select("id", "url", "fetched", "n_entries", "e.kind", "e.key", "e.action").alias("d")
    same = F.lit(True)
    for column in ("id", "url", "fetched"):
        same = same & F.col(f"c.{column}").eqNullSafe(F.col(f"d.{column}"))
    return captures.alias("c").join(decided, same, "left").select(
        "c.id", F.coalesce("n_entries", F.lit(0)).cast("bigint").alias("n_entries"), "kind", "key", "action",
        F.coalesce(F.col("action") == "block", F.lit(False)).alias("blocked"))


def _number(text: Column) -> Column:
    """A number from a text that any engine can compute."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def listed_from(pages: DataFrame) -> DataFrame:
    """A list log made of the hosts, domains, sections and addresses of the pages themselves, dated by their hashes."""
    read = parsed(pages.select("url")).filter("host IS NOT NULL")
    section = F.concat("host", F.lit("/"), F.split("path", "/")[1], F.lit("/"))
    named = read.select(F.explode(F.array(
        F.struct(F.lit("domain").alias("kind"), F.regexp_replace("host", r"^(www|m|blog)\.", "").alias("key")),
        F.struct(F.lit("host").alias("kind"), F.col("host").alias("key")),
        F.struct(F.lit("prefix").alias("kind"), section.alias("key")),
        F.struct(F.lit("url").alias("kind"), F.concat("host", "path").alias("key")))).alias("k")).select("k.*").distinct()
    h = _number(F.concat("kind", F.lit(" "), "key"))
    action = F.when(h % 5 == 0, "allow").otherwise("block")
    first, second = (h % 600).cast("int"), (h % 600 + 40 + h % 97).cast("int")
    dated = named.withColumn("h", h).filter("h % 3 = 0").select("kind", "key", action.alias("action"), F.explode(F.array(
        F.struct(first.alias("d"), F.lit(True).alias("added")),
        F.struct(second.alias("d"), F.lit(False).alias("added")),
        F.struct((second + 60).alias("d"), F.lit(True).alias("added")))).alias("e"))
    return dated.select("kind", "key", "action", F.date_add(F.lit("2023-01-01").cast("date"), F.col("e.d")).alias("day"), "e.added")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, fetched on days given by their ids, under a list log made from the pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2023-01-01").cast("date"), (_number(F.col("page_id").cast("string")) % 730).cast("int"))
    captures = pages.select(F.col("page_id").alias("id"), "url", fetched.alias("fetched"))
    return judge(captures, listed_from(pages)).select(F.col("id").alias("page_id"), "n_entries", "kind", "key", "action", "blocked")
