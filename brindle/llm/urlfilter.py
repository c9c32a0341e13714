"""URL rules by hash-prefix lookup, in DataFrame functions only.

Each URL's host is expanded into its suffixes at dots, no more labels than some
rule has. Suffixes meet the hosts of the rules in an equi-join on the first bytes
of their SHA-256, confirmed by the full digest; a host says which path lengths
its rules have. Only these prefixes of the path are joined to the suffix, and
the expressions meet the rules in a second equi-join of that kind. The longest
confirmed rule decides. So a URL yields few expressions, however many rules
there are for other hosts.

Rows are gathered again by (id, host, path) and the partition they were read in:
expressions are aggregated in the task that made them before they move, and of
a row that repeats, a task gets at most the copies that one partition held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8
BROADCAST_BYTES = 8 << 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty for null or no ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _by_prefix(rows: DataFrame, expression: str, value: Column, prefix_hex: int) -> DataFrame:
    """``(prefix, held)``: for each hash prefix the digests of ``expression`` with it and what belongs to them."""
    rows = rows.select(F.sha2(expression, 256).alias("digest"), value.alias("value"))
    return rows.groupBy(F.substring("digest", 1, prefix_hex).alias("prefix")).agg(F.collect_list(F.struct("digest", "value")).alias("held"))


def _met(u: DataFrame, held: DataFrame, expression: str, prefix_hex: int, name: str) -> DataFrame:
    """``u`` with what the table of prefixes holds for its column ``expression``, null where the full digest isn't there."""
    u = u.withColumn("digest", F.sha2(expression, 256)).withColumn("prefix", F.substring("digest", 1, prefix_hex)).join(held, "prefix", "left")
    value = F.transform(F.filter("held", lambda x: x["digest"] == F.col("digest")), lambda x: x["value"])
    return u.withColumn(name, F.when(F.size(value) > 0, F.element_at(value, 1))).drop("held", "prefix", "digest")


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", prefix_hex: int = PREFIX_HEX, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows ``(id, host, path, rule, verdict)``, one for each row of ``urls``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``allow`` or ``block``).
    A rule fits its host and all subdomains if the URL's path starts with the
    rule's path; of fitting rules the longest (host and path together, then the
    longer host) decides. Rules with a null or empty host or a null verdict are
    ignored, a null path is empty; of equal rules with different verdicts
    ``block`` holds. Without a fitting rule ``rule`` is null and ``verdict`` is
    ``default``. Null URLs and those without ``://`` have empty host and path
    and fit no rule. Null ids and repeated rows are kept as they come. Other
    columns of either table are not read.

    Rules are broadcast while their measured size is within
    ``broadcast_bytes``, else shuffled by hash prefix, where adaptive execution
    splits the prefixes of common hosts. An empty table gives no rows.
    """
    r = rules.select(F.translate("host", UPPER, LOWER).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict").where((F.col("h") != "") & F.col("verdict").isNotNull())
    r = r.groupBy("h", "p").agg(F.max("verdict").alias("verdict")).withColumn("rule", F.concat("h", "p"))
    labels = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."), F.lit(""))) + 1
    most, size = r.agg(F.max(labels(F.col("h"))), F.sum(F.length("rule") + 120)).first()
    hit = F.struct(F.length("rule").alias("size"), F.length("h").alias("host_size"), "rule", "verdict")
    by_rule = _by_prefix(r, "rule", hit, prefix_hex)
    hosts = r.groupBy("h").agg(F.sort_array(F.collect_set(F.length("p"))).alias("lengths"))
    by_host = _by_prefix(hosts, "h", F.col("lengths"), prefix_hex)
    if (size or 0) <= broadcast_bytes:
        by_rule, by_host = F.broadcast(by_rule), F.broadcast(by_host)

    u = urls.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.spark_partition_id().alias("part"))
    u = u.select("id", "part", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    suffixes = F.when(F.col("host") != "", F.transform(F.sequence(F.lit(1), F.least(labels(F.col("host")), F.lit(most or 1))), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k)))
    u = u.select("id", "part", "host", "path", F.posexplode_outer(suffixes).alias("at", "suffix"))
    u = _met(u, by_host, "suffix", prefix_hex, "lengths")
    paths = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.concat(F.col("suffix"), F.substring(F.col("path"), F.lit(1), n)))
    u = u.select("id", "part", "host", "path", "at", F.posexplode_outer(paths).alias("of", "expression"))
    # Prefixes come as one row each, so each expression is still one row here.
    best = _met(u, by_rule, "expression", prefix_hex, "hit")
    first = (F.coalesce("at", F.lit(0)) == 0) & (F.coalesce("of", F.lit(0)) == 0)
    best = best.groupBy("id", "host", "path", "part").agg(F.max("hit").alias("hit"), F.sum(F.when(first, 1)).alias("copies"))
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
