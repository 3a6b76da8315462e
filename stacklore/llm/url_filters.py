"""URL filters by a sort-merge range join of canonical keys with prefix rules.

A rule (host, path, verdict) fits its host and all subdomains where the path starts with
its path; the longest rule that fits decides. With its labels reversed, ``www.example.com``
becomes ``com.example.www.``, so a rule's host is a prefix and covers an interval of the
sort order, and so does a path. Both are found by the same ``sweep``: starts and ends of the
intervals and the points lie in one sorted sequence. Intervals of prefixes are nested or
apart, so the starts less the ends so far are the height of the stack, and its level k holds
the last start that reached height k. The height is a running sum and every level a running
last value, so a window over buckets of the sorted rows does it, and each bucket takes over
the sums and the stack that the buckets before it leave. The first sweep gives every distinct
host the rule hosts that it lies in; the second gives every url, under each of those, the
innermost path. Equal keys are told apart by their row and may lie in several buckets, so
no host or url is too frequent.

Cases: a null url, and one without ``://``, has an empty host and path. Host letters A-Z are
lower-cased, in rules too; nothing else is decoded. A rule with a null host is ignored, a
null path is empty. Of two equal rules that disagree, block counts. Where two rules that fit
are equally long, the one with the longer host wins. Urls that no rule fits get the default
verdict and a null rule. Repeated rows and null ids stay rows of their own; other columns of
``pages`` are ignored. An empty table gives an empty result, no rules give the default.
"""

import string

from pyspark.sql import DataFrame, Window, functions as F

from stacklore.llm.common import dealt, join_hot
from stacklore.session import cut_lineage

ALLOW, BLOCK = "allow", "block"
RULES = [  # verdict, host, path
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
]
RULE_SCHEMA = "verdict string, host string, path string"
# No UTF-8 text holds this byte, and it sorts behind all that do.
LAST = b"\xff"


def _lower(host):
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url):
    """Columns host and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host.alias("host"), path.alias("path")


def host_key(host):
    """Reversed labels, each with its dot: subdomains of a host start with its key."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit(".")).cast("binary")


def sweep(points, rules, label, innermost=False) -> DataFrame:
    """``points`` with ``stack``: the values of the rules whose key starts the point's key.

    Points hold a binary ``key`` and a ``tie`` that tells equal keys apart; rules hold
    distinct binary keys and a ``value``. The stack runs from the shortest rule to the
    longest; ``innermost`` keeps its top only, as ``top``.
    """
    rules = cut_lineage(rules.select("key", "value"), f"{label}-rules")
    none = F.lit(None).cast(rules.schema["value"].dataType)
    starts = rules.select("key", F.lit(0).alias("kind"), "value", F.lit(1).alias("step"))
    ends = rules.select(F.concat("key", F.lit(LAST)).alias("key"), F.lit(0).alias("kind"),
                        none.alias("value"), F.lit(-1).alias("step"))
    events = points.withColumns({"kind": F.lit(1), "value": none, "step": F.lit(0)}).unionByName(
        starts.unionByName(ends), allowMissingColumns=True)
    order = ["key", "kind", "tie"]
    rows = dealt(events, order, label)
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    base = rows.groupBy("_bucket").agg(F.sum("step").alias("_sum")).select(
        "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    rows = cut_lineage(rows.join(base, "_bucket").withColumn(
        "height", F.col("_base") + F.sum("step").over(so_far)).drop("_base"), f"{label}-heights")
    highest = rows.agg(F.max("height")).first()[0] or 0
    if not highest:
        stack = F.array().cast(f"array<{rules.schema['value'].dataType.simpleString()}>")
        found = rows.filter("kind = 1").withColumn("stack", stack)
    else:
        at = {k: F.when((F.col("step") == 1) & (F.col("height") == k), F.struct(*order, "value"))
              for k in range(1, highest + 1)}
        left = rows.groupBy("_bucket").agg(*[F.max(at[k]).alias(f"_l{k}") for k in at]).select(
            "_bucket", *[F.last(f"_l{k}", True).over(earlier).alias(f"_l{k}") for k in at])
        levels = [F.coalesce(F.last(at[k], True).over(so_far), F.col(f"_l{k}"))["value"]
                  for k in at]
        found = rows.join(left, "_bucket").withColumn("_levels", F.array(*levels)).filter(
            "kind = 1").withColumn("stack", F.slice("_levels", 1, F.col("height").cast("int")))
    found = found.select(*points.columns, "stack")
    if innermost:
        return found.withColumn("top", F.try_element_at("stack", F.lit(-1))).drop("stack")
    return found


def judge(pages, rules=None, default=ALLOW) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages`` (page_id, url)."""
    if rules is None:
        rules = pages.sparkSession.createDataFrame(RULES, RULE_SCHEMA)
    rules = cut_lineage(rules.filter("host IS NOT NULL").select(
        _lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
        "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "url-rules")
    urls = cut_lineage(pages.select("page_id", *host_and_path(F.col("url"))).withColumn(
        "row", F.monotonically_increasing_id()), "urls")

    hosts = urls.groupBy("host").agg(F.count("*").alias("n")).withColumns(
        {"key": host_key(F.col("host")), "tie": F.lit(0).cast("long")})
    of_hosts = rules.select("host").distinct().select(
        host_key(F.col("host")).alias("key"), F.col("host").alias("value"))
    inside = cut_lineage(sweep(hosts, of_hosts, "url-hosts").filter(F.size("stack") > 0).select(
        "host", "stack", "n"), "url-inside")

    paths = join_hot(urls.drop("page_id"), inside, "host").select(
        F.col("row").alias("tie"), F.explode("stack").alias("within"), "path").select(
        "tie", F.concat(host_key(F.col("within")), F.lit(LAST), F.col("path").cast("binary")).alias("key"))
    of_paths = rules.select(
        F.concat(host_key(F.col("host")), F.lit(LAST), F.col("path").cast("binary")).alias("key"),
        F.struct((F.length("host") + F.length("path")).alias("chars"),
                 F.length("host").alias("host_chars"),
                 F.concat("host", "path").alias("rule"), "verdict").alias("value"))
    best = sweep(paths, of_paths, "url-paths", innermost=True).filter("top IS NOT NULL").groupBy(
        F.col("tie").alias("row")).agg(F.max("top").alias("top"))
    return urls.join(best, "row", "left").select(
        "page_id", "host", "path", F.col("top.rule").alias("rule"),
        F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
