"""URL filters as a sort-merge range join, with DataFrame operations only.

A host reversed label by label ("net/example/a/"; no host holds a slash) turns "this host and its subdomains" into an
interval of keys that begin with the rule's key. Rules and urls are merged into one sorted sweep; for
each depth (number of host labels) the sweep holds the last rule host met. Such a slot is on the stack
of active nested rules as long as the current key begins with its key; a key that doesn't has left the
interval, and the slot is popped by that test. Of the active rules whose path the url's path begins
with, the longest wins.

The sweep is parted by the first host label (a rule never reaches beyond it). A label with a large
share of all urls is dealt over as many salts as its share asks for, and its rules go to every salt.

Defined results: a null url or one without `://` has an empty host and path and no rule; an empty
table gives an empty table; repeated urls are judged one by one; of two rules with the same host and
path, block wins; of two of the same length, the longer host, then the smaller text. Null rules are
left out. Other columns never clash: the operator returns its key column and its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The rules of the query op9_url_rules: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path. Positions are found by plain text search, so any character may follow."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    no_query = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(no_query, "/", 1)
    path = F.substring(no_query, F.length(host) + 1, F.length(no_query))
    return F.translate(host, _UPPER, _LOWER), path


def host_key(host: F.Column) -> F.Column:
    """"a.example.net" becomes "net/example/a/"; the empty host stays empty."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/")))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def apply_rules(urls: DataFrame, rules: DataFrame, *, key_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule (or null) and verdict of each url."""
    host, path = url_parts(F.col(url_col))
    found = urls.select(F.col(key_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    # One node for each rule host, with all its rules; the text is what is reported.
    nodes = (
        rules.where("host is not null and path is not null and verdict is not null and host <> ''")
        .select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumn("one", F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("h"), F.concat("host", "path").alias("rule"), F.col("path").alias("path"), F.col("verdict").alias("verdict")))
        .groupBy("host").agg(F.collect_list("one").alias("own"))
        .withColumn("key", host_key(F.col("host"))).withColumn("depth", F.size(F.split("host", r"\.")))
    )
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    label = lambda c: F.substring_index(c, "/", 1)

    # A label with more than half of an even partition's rows gets salts by its share.
    even = 0.5 / max(1, int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = found.groupBy(label("key").alias("label")).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = [(r.label, r.salts) for r in counts.withColumn("salts", F.ceil(F.col("count") / F.lit(even * max(1, total))).cast("int")).where("salts > 1").collect()]
    salts = reduce(lambda w, x: w.when(label(F.col("key")) == x[0], F.lit(x[1])), hot, F.when(F.lit(False), F.lit(1))).otherwise(1)

    none = F.lit(None)
    left = found.select(label("key").alias("label"), F.pmod(F.xxhash64("id", "host", "path"), salts).cast("int").alias("salt"), "key", F.lit(1).alias("kind"), "id", "host", "path", none.cast("int").alias("depth"), none.cast(nodes.schema["own"].dataType).alias("own"))
    right = nodes.select(label("key").alias("label"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "key", F.lit(0).alias("kind"), none.cast(found.schema["id"].dataType).alias("id"), none.cast("string").alias("host"), none.cast("string").alias("path"), "depth", "own")
    sweep = Window.partitionBy("label", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = left.unionByName(right)
    for d in range(1, deepest + 1):
        merged = merged.withColumn(f"slot{d}", F.last(F.when((F.col("kind") == 0) & (F.col("depth") == d), F.struct("key", "own")), ignorenulls=True).over(sweep))
    empty = F.lit(None).cast(nodes.schema["own"].dataType)
    stack = [F.when(F.startswith(F.col("key"), F.col(f"slot{d}.key")), F.col(f"slot{d}.own")) for d in range(1, deepest + 1)]
    active = F.concat(*[F.coalesce(x, F.array().cast(nodes.schema["own"].dataType)) for x in stack]) if stack else empty
    fits = F.filter(active, lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.element_at(F.array_sort(fits, lambda x, y: F.when(x["n"] != y["n"], y["n"] - x["n"]).when(x["h"] != y["h"], y["h"] - x["h"]).when(x["rule"] < y["rule"], -1).when(x["rule"] > y["rule"], 1).otherwise(0)), 1)
    best = F.when(F.size(fits) > 0, best)
    return merged.where("kind = 1").select(F.col("id").alias(key_col), "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))


ORACLE = r"""
with u as (select row_number() over () as r, page_id, case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end as rest from pages),
c as (select r, page_id, split_part(split_part(rest, '#', 1), '?', 1) as rest from u),
h as (select r, page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, substr(rest, length(split_part(rest, '/', 1)) + 1) as path from c),
q(rhost, rpath, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
j as (select page_id, host, path, rhost || rpath as rule, v,
             row_number() over (partition by h.r order by length(rhost || rpath) desc nulls last) as n
      from h left join q on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from j where n = 1
"""
