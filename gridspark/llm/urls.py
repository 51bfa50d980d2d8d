"""URL filters: prefix rules, and a character language-model ratio for what no rule decides.

Two smoothed variable-order Markov models are counted from the URLs, one from those that a rule allows and one from those that a
rule blocks. A character's probability after its longest context is interpolated with that after each shorter one down to the
uniform distribution (Witten-Bell: a context with n characters of t kinds gives t / (n + t) to the shorter context). A URL's
score is the mean over its characters of the log ratio, accepted over rejected; the cut is calibrated on the URLs with a rule:
the point as many standard deviations below the accepted mean as above the rejected one.

Everything is DataFrame operations. Counts and look-ups are keyed by n-gram, and are pre-aggregated per n-gram before the
shuffle; log ratios are computed once per distinct n-gram of the table, and summed in whole units, so that the cut and the
verdicts don't depend on the order of rows. Windows that stand in most URLs make hot keys of the look-up only, an equi-join that
Spark splits.

Null URLs, and URLs without `://`, have an empty host and path and no rule; an empty or null URL has score 0. The method's
verdict is allow where the score is at least the cut. Without URLs of either kind to learn from, the score is 0 and the cut is
0, so everything is allowed. Repeated rows each count and each get their row. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import written

#: Production rules: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Characters of context in the longest order; size of the alphabet of the uniform distribution (code points fold into it).
ORDER, ALPHABET = 4, 128
#: Units of log ratios and scores; a score is under 40 of natural logarithm, so its square keeps to 25 digits.
UNIT = 1 << 36


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Between the first :// and the next / ? # or the end (A-Z lower-cased); from there up to ? or #."""
    url = F.col(url) if isinstance(url, str) else url
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for how, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(how)).otherwise(verdict)
    return rule, verdict


def windows(urls: DataFrame, *carry: str) -> DataFrame:
    """(carry..., g): each URL's windows of ORDER + 1 characters, one for each character; the start is padded."""
    padded = F.concat(F.lit("\x02" * ORDER), F.col("url"))
    every = F.transform(F.sequence(F.lit(1), F.length("url")), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))
    return urls.select(*carry, F.explode(every).alias("g"))


def _model(tally: DataFrame) -> DataFrame:
    """(k, s, good, bad, good_n, bad_n, good_kinds, bad_kinds) for k characters of context and the one after, s: how often s was
    accepted and rejected, how often its context was, and with how many kinds of characters after it."""
    parts = F.array(*(F.struct(F.lit(k).alias("k"), F.substring("g", ORDER + 1 - k, k + 1).alias("s")) for k in range(ORDER + 1)))
    sums = tally.select("good", "bad", F.explode(parts).alias("o")).groupBy("o.k", "o.s").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    # A context has as many rows as characters follow it: the alphabet at most.
    of = W.Window.partitionBy("k", F.substring(F.col("s"), F.lit(1), F.col("k")))
    kinds = lambda c: F.sum((F.col(c) > 0).cast("long")).over(of).alias(f"{c}_kinds")
    return sums.select("k", "s", "good", "bad", F.sum("good").over(of).alias("good_n"), F.sum("bad").over(of).alias("bad_n"), kinds("good"), kinds("bad"))


def _log_ratio(model: DataFrame) -> DataFrame:
    """(g, llr): for each distinct window, the log ratio of its last character under the two models, in units of 1 / UNIT.

    Whole units make sums of them exact, whatever their order.
    """
    def mixed(kind: str, below: Column) -> Column:
        n, total, kinds = F.col(kind), F.col(f"{kind}_n"), F.col(f"{kind}_kinds")
        return F.when(total > 0, (n + kinds * below) / (total + kinds)).otherwise(below)

    at = model.filter("k = 0").select("s", mixed("good", F.lit(1.0 / ALPHABET)).alias("p"), mixed("bad", F.lit(1.0 / ALPHABET)).alias("q"))
    for k in range(1, ORDER + 1):
        shorter = at.select(F.col("s").alias("tail"), "p", "q")
        at = model.filter(F.col("k") == k).withColumn("tail", F.substring("s", 2, k)).join(shorter, "tail").select("s", mixed("good", F.col("p")).alias("p"), mixed("bad", F.col("q")).alias("q"))
    return at.select(F.col("s").alias("g"), F.round((F.log("p") - F.log("q")) * UNIT).cast("long").alias("llr"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row; score is null where a rule decides."""
    spark = pages.sparkSession
    url = F.col("url")
    host, path = host_and_path(url)
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    every = pages.select("page_id", url, host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("how"))
    # Equal URLs are counted and scored once. They are dealt out anew, as their windows are many times more than they are.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = written(every.filter(F.length("url") > 0).groupBy("url", "how").agg(F.count("*").alias("copies")).repartition(tasks, "url").withColumn("id", F.monotonically_increasing_id()))
    seen = lambda kind: F.sum(F.when(F.col("how") == kind, F.col("copies")).otherwise(0))
    tally = windows(urls, "how", "copies").groupBy("g").agg(seen("allow").alias("good"), seen("block").alias("bad"))
    ratio = _log_ratio(written(_model(tally)))
    sums = windows(urls, "id").join(ratio, "g").groupBy("id").agg(F.sum("llr").alias("llr"), F.count("*").alias("n"))
    scored = written(urls.join(sums, "id").select("url", "how", "copies", F.round(F.col("llr") / F.col("n")).cast("long").alias("units")))
    moments = []
    for kind in ("allow", "block"):
        of = F.when(F.col("how") == kind, F.col("copies")).cast("decimal(18,0)")
        x = F.col("units").cast("decimal(18,0)")
        total = F.sum(of).cast("double")
        mean = F.sum((of * x).cast("decimal(38,0)")).cast("double") / total
        square = F.sum((of * (x * x).cast("decimal(25,0)")).cast("decimal(38,0)")).cast("double") / total
        moments += [mean.alias(f"m_{kind}"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias(f"s_{kind}")]
    both = F.col("s_allow") + F.col("s_block")
    cut = F.when(both > 0, (F.col("m_allow") * F.col("s_block") + F.col("m_block") * F.col("s_allow")) / both).otherwise((F.col("m_allow") + F.col("m_block")) / 2)
    learned = F.coalesce(scored.agg(*moments).select(F.coalesce(cut, F.lit(0.0)).alias("cut")).scalar(), F.lit(0.0))
    units = F.coalesce("units", F.lit(0))
    open_ = scored.filter(F.col("how").isNull()).select("url", "units")
    return every.join(open_, "url", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("how", F.when(units >= learned, "allow").otherwise("block")).alias("verdict"), F.when(F.col("how").isNull(), units / UNIT).alias("score"))
