"""URL filters by a sort-merge range join, in DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch, partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER = chr(ord(".") + 1)  # the character that follows the separator: a key's interval ends at the key with this last


def host_key(labels: Column) -> Column:
    """Labels from the last to the first, each with a dot after it: hosts below a host begin with its key."""
    return F.concat(F.array_join(labels, "."), F.lit("."))


def reversed_labels(host: str) -> Column:
    return F.reverse(F.split(host, "\\."))


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lowered; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({{0}}, instr({{0}}, '://') + 3)".replace("{0}", "__url"))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    return F.regexp_extract(rest, "(?s)^[^/?#]*(/[^?#]*)?", 1)


def host_marks(rules: DataFrame) -> DataFrame:
    """(__key, __value): where the stack of active rule hosts changes along the keys, and the stack from there on.

    A host is active from its key to the end of its interval. Intervals nest or lie apart, so the stack at a start is
    the host below those of its own upper hosts that have rules, of which there are at most as many as it has labels.
    """
    hosts = rules.select("__hk", "labels").distinct()
    upper = hosts.select("__hk", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("n"), "labels")
    upper = upper.select("__hk", host_key(F.slice("labels", F.lit(1), F.col("n"))).alias("up"), "n")
    real = upper.join(hosts.select(F.col("__hk").alias("up")), "up")
    stacks = real.groupBy("__hk").agg(F.array_sort(F.collect_list(F.struct("n", "up"))).getField("up").alias("stack"))
    end = F.concat(F.expr("substring(__hk, 1, char_length(__hk) - 1)"), F.lit(AFTER))
    points = F.array(F.struct(F.col("__hk").alias("k"), F.col("stack").alias("v")), F.struct(end.alias("k"), F.expr("slice(stack, 1, size(stack) - 1)").alias("v")))
    return stacks.select(F.explode(points).alias("p")).select(F.col("p.k").alias("__key"), F.col("p.v").alias("__value"))


def path_marks(rules: DataFrame) -> DataFrame:
    """(__hk, __at, __value): where the longest fitting rule of a host changes along its paths, and that rule.

    A rule is active from its path to that path with a byte after it that UTF-8 does not have; from there on the rule
    around it is, the longest of the host whose path starts its own. Lengths of a host's paths bound how many are asked.
    """
    one = rules.groupBy("__hk", "path").agg(F.min(F.struct("text", "verdict")).alias("r"), F.first("host").alias("host"))
    size = F.char_length("host")
    rule = F.struct("__hk", (-size - F.char_length("path")).alias("less"), (-size).alias("shorter"), F.col("r.text").alias("text"), F.col("r.verdict").alias("verdict"))
    one = one.select("__hk", "path", rule.alias("rule"))
    lengths = one.groupBy("__hk").agg(F.collect_set(F.char_length("path")).alias("lengths"))
    asked = one.select("__hk", "path").join(lengths, "__hk").select("__hk", "path", F.explode(F.expr("filter(lengths, l -> l < char_length(path))")).alias("l"))
    asked = asked.select("__hk", F.col("path").alias("own"), F.expr("substring(path, 1, l)").alias("path"), "l")
    around = asked.join(one, ["__hk", "path"]).groupBy("__hk", F.col("own").alias("path")).agg(F.max_by("rule", "l").alias("around"))
    none = F.struct("__hk", *(F.lit(None).cast(kind).alias(name) for name, kind in (("less", "int"), ("shorter", "int"), ("text", "string"), ("verdict", "string"))))
    at = F.col("path").cast("binary")
    points = F.array(
        F.struct(at.alias("k"), F.col("rule").alias("v")), F.struct(F.concat(at, F.lit(b"\xff")).alias("k"), F.coalesce("around", none).alias("v"))
    )
    return one.join(around, ["__hk", "path"], "left").select("__hk", F.explode(points).alias("p")).select("__hk", F.col("p.k").alias("__at"), F.col("p.v").alias("__value"))


def swept(scratch: Scratch, name: str, rows: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (with a __uid) with __found, the value of the last mark at or before their keys; null if there is none.

    Rows and marks are sorted together and dealt into ranges; a range begins with the last mark of those before it. Rows
    of equal keys are dealt over many ranges by their numbers.
    """
    order = [*(F.asc(k) for k in keys), F.desc("__mark"), F.asc("__salt")]
    both = rows.withColumn("__mark", F.lit(False)).withColumn("__salt", F.xxhash64("__uid")).unionByName(marks.withColumn("__mark", F.lit(True)), allowMissingColumns=True)
    dealt = scratch.freeze(both.repartitionByRange(partitions(scratch.spark), *order).withColumn("__part", F.spark_partition_id()), name)
    # the last mark of each range, for the ranges after it: one row a range
    ends = dealt.groupBy("__part").agg(F.max_by("__value", F.when(F.col("__mark"), F.struct(*keys))).alias("__last"))
    before = F.last("__last", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("__part", before.alias("__carried"))
    inside = F.last("__value", ignorenulls=True).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = dealt.withColumn("__inside", inside).where("NOT __mark").join(F.broadcast(carried), "__part")
    return found.withColumn("__found", F.coalesce("__inside", "__carried")).drop("__mark", "__salt", "__part", "__value", "__inside", "__carried")


def url_filters(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, default: str = "allow", url_col: str = "url", prefix: str = "") -> DataFrame:
    """Judge urls by allow and block rules on hosts and paths.

    Rules are pairs of a verdict and a text such as example.net/en/, or a table of both (the first two columns), of any
    size; those with a null are passed over. A rule fits its host (A-Z lowered) and all hosts below it, for paths that
    start with its own. Two sorted sweeps find them. Hosts are keyed by their reversed labels, so that a rule host is an
    interval of keys, and each url takes the stack of rule hosts that are active at its key. For each of those, a second
    sweep along paths takes the longest of the host's rules whose path starts the url's. Of these the longest decides (by
    host and path; then the longer host; then the text that sorts first; of rules for one host and path that differ in
    their case or verdict, the first in order). Urls that no rule fits get the default.

    Returns pages with {prefix}host, path, rule (as written, null if none) and verdict added. Null urls and urls without
    :// have an empty host and path and get the default. Ports and user names count as part of the host. Repeated rows
    and urls are judged alike; equal hosts are dealt over many ranges. An empty table or list of rules is fine. Other
    columns pass through, as long as they do not start with two underscores; added columns replace those of their names.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    given = rules.toDF("verdict", "text", *rules.columns[2:]).select("verdict", "text") if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "verdict string, text string")
    host, path = F.translate(F.substring_index("text", "/", 1), UPPER, LOWER), F.when(F.instr("text", "/") > 0, F.expr("substring(text, instr(text, '/'))")).otherwise("")
    given = given.where("verdict IS NOT NULL AND text IS NOT NULL").withColumn("host", host).withColumn("path", path).withColumn("labels", reversed_labels("host"))
    given = scratch.freeze(given.withColumn("__hk", host_key(F.col("labels"))), "rules")

    urls = pages.withColumn("__url", F.coalesce(F.col(url_col), F.lit(""))).withColumn("__host", host_of(F.col("__url"))).withColumn("__path", path_of(F.col("__url"))).drop("__url")
    key = F.when(F.col("__host") == "", "").otherwise(host_key(reversed_labels("__host")))
    urls = urls.withColumn("__key", key).withColumn("__uid", F.monotonically_increasing_id())
    hosted = swept(scratch, "hosts", urls, host_marks(given), ["__key"])
    each = hosted.select("__uid", F.explode("__found").alias("__hk"), F.col("__path").cast("binary").alias("__at"))
    fitting = swept(scratch, "paths", each, path_marks(given), ["__hk", "__at"]).where("__found.__hk = __hk AND __found.text IS NOT NULL")
    best = fitting.groupBy("__uid").agg(F.min(F.struct("__found.less", "__found.shorter", "__found.text", "__found.verdict")).alias("__best"))
    found = hosted.join(best, "__uid", "left")
    out = {"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__best.text"), "verdict": F.coalesce("__best.verdict", F.lit(default))}
    own = [c for c in pages.columns if c.removeprefix(prefix) not in out or not c.startswith(prefix)]
    return found.select(*(found[f"`{c}`"] for c in own), *(c.alias(prefix + k) for k, c in out.items()))


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filters(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}')"


OP10_SQL = f"""
WITH split AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path
  FROM split
), ruled AS (
  SELECT *, CASE WHEN {_fits("example.net", "/en/")} THEN 'example.net/en/' WHEN {_fits("example.com", "/de/")} THEN 'example.com/de/'
    WHEN {_fits("org", "/fr/")} THEN 'org/fr/' WHEN {_fits("net", "/")} THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
