"""Benchmark decontamination: finds windows of documents that repeat a benchmark item, with DataFrame operations only.

Words are lower-cased runs of letters and digits. An item of w words has max(1, w - 4) five-word shingles (an item of fewer
words is one shingle of all of them); a window has as many shingles as its item, or the whole document where that is shorter.
Two bags of shingles are as similar as the sum of the smaller counts over the sum of the larger, and a window leaks an item at
LEAST % or more.

1. A leak shares shingles with its item, so shingles of documents meet those of the items first. Sliding a window to the right
   until its first shingle is one of the item's never lowers its similarity, so windows that begin at such a place suffice, and
   of these only those that hold as many of the item's shingles as the threshold asks for.
2. Each such item-sized window has a SimHash of BITS bits, and so has each item. A bag's votes are those of its pairs (shingle, its running
   number among equal ones), one vote a pair: the plain Jaccard similarity of two sets of pairs is the weighted one of the bags, and no
   repeated shingle owns a bit. Fingerprints are cut into RADIUS + 1 blocks; two within RADIUS bits agree in one of them at least, so a join
   on block and value finds all within the radius, whose distance is then counted.
3. The exact similarity of each window within the radius decides. Each (document, item) is reported once, with its best and then first
   window.

At the threshold a bit differs with a chance of about 0.19, so a distance over RADIUS is 6 standard deviations off (of the order of one
window in 10^8). A radius this wide selects little by itself; step 1 does that, and blocks are compared for its windows only.

Null texts, texts without words and items without words have no leaks. A null id is never reported. Rows that repeat an id are
reported once. Ties between windows go to the earliest. Extra columns aren't read. Work for an item that many documents hold is
keyed by document, so no task gathers an item's documents; the joins with the item table are plain equi-joins whose strategy
Spark picks by size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SHINGLE, LEAST = 5, 75
#: Bits of a fingerprint, and how many of them may differ.
BITS, RADIUS = 63, 30


def fingerprints(bags: DataFrame, key: str, s: str, n: str) -> DataFrame:
    """(key, fp) of bags (key, shingle hash, its count): bit i is set where most of the bag's pairs vote for it.

    Counts of bits i and i + 32 share a long, so there are 32 sums; a bag may have 2^31 pairs.
    """
    votes = bags.select(key, F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col(n)), lambda j: F.xxhash64(F.col(s), j))).alias("v"))
    sums = votes.groupBy(key).agg(F.count("*").alias("pairs"), *(F.sum(F.shiftrightunsigned("v", j).bitwiseAND(F.lit((1 << 32) | 1))).alias(f"c{j}") for j in range(32)))
    ones = lambda i: F.shiftrightunsigned(f"c{i % 32}", 32 * (i // 32)).bitwiseAND(F.lit((1 << 32) - 1))
    bits = [F.when(2 * ones(i) > F.col("pairs"), F.lit(1 << i)).otherwise(F.lit(0).cast("long")) for i in range(BITS)]
    return sums.select(key, reduce(lambda x, y: x.bitwiseOR(y), bits).alias("fp"))


def blocks(fp: str) -> Column:
    """(number, value) of the RADIUS + 1 blocks of a fingerprint."""
    edges = [BITS * b // (RADIUS + 1) for b in range(RADIUS + 2)]
    return F.array(*(F.struct(F.lit(b).alias("b"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("v")) for b, (lo, hi) in enumerate(zip(edges, edges[1:]))))


def within_radius(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(item, which): the windows' contents whose fingerprint is within RADIUS of their item's. A content is fingerprinted once, however many
    documents have it. windows are (item, which, win), counts (item, s, ni)."""
    contents = windows.select("which", "win").dropDuplicates(["which"])
    bags = contents.select("which", F.explode("win").alias("s")).groupBy("which", "s").agg(F.count("*").alias("n"))
    pairs = windows.select("item", "which").distinct().join(fingerprints(bags, "which", "s", "n"), "which")
    own = fingerprints(counts, "item", "s", "ni").withColumnRenamed("fp", "item_fp")
    mine = pairs.select("item", "which", "fp", F.inline(blocks("fp")))
    met = mine.join(own.select("item", "item_fp", F.inline(blocks("item_fp"))), ["item", "b", "v"])
    return met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("item", "which").distinct()


def words(text: str = "text") -> Column:
    parts = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def hashed(w: str, k: int) -> Column:
    """Hashes of the k-word shingles of an array of words, in order."""
    at = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), at)).otherwise(F.array().cast("array<bigint>"))


def items_of(benchmark: DataFrame, key: str = "item_id") -> DataFrame:
    """(item, w, k, m, h): words, shingle length, number of shingles and their hashes, for items with words."""
    split = benchmark.filter(F.col(key).isNotNull()).select(F.col(key).alias("item"), words().alias("ws")).filter(F.size("ws") > 0).dropDuplicates(["item"])
    hashes = reduce(lambda rest, k: F.when(F.size("ws") == k, hashed("ws", k)).otherwise(rest), range(1, SHINGLE), hashed("ws", SHINGLE))
    return split.select("item", F.size("ws").alias("w"), F.least(F.size("ws"), F.lit(SHINGLE)).alias("k"), hashes.alias("h")).withColumn("m", F.size("h"))


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity), one row for each document and item that it leaks."""
    items = items_of(benchmark)
    lengths = sorted(r[0] for r in items.select("k").distinct().collect())  # five values at most
    base = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    grams = items.select("item", "k", F.explode(F.array_distinct("h")).alias("s"))

    # With n the window's and m the item's shingles, similarity >= least % means overlap >= least * (m + n) / (100 + least).
    enough = F.ceil(F.lit(least) * (F.col("m") + F.least("m", "size")) / F.lit(100 + least)).cast("int")
    found = []
    for k in lengths:
        split = base.select("doc_id", words().alias("ws")).select("doc_id", hashed("ws", k).alias("h"))
        rows = split.select("doc_id", F.size("h").alias("size"), F.posexplode_outer("h").alias("pos", "s"))
        found.append(rows.join(grams.filter(F.col("k") == k).select("s", "item"), "s").select("doc_id", "item", "size", "pos"))
    if not found:
        return base.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity")).limit(0)
    hits = reduce(DataFrame.unionByName, found).groupBy("doc_id", "item", "size").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    hits = hits.join(items.select("item", "k", "m"), "item")
    # The window [pos, pos + m) has enough hits if the hit `need` - 1 places on is still in it.
    reach = lambda p, i: F.coalesce(F.get("at", i + F.col("need") - 1) - p < F.col("m"), F.lit(False))
    full = hits.withColumn("need", enough).filter(F.size("at") >= F.col("need")).select("*", F.explode(F.filter("at", reach)).alias("pos"))
    starts = full.select("doc_id", "item", "k", "m", "size", F.greatest(F.lit(0), F.least("pos", F.col("size") - F.col("m"))).alias("start")).distinct()

    wanted = starts.groupBy("doc_id").agg(F.collect_set(F.struct("item", "k", "m", "size", "start")).alias("cands"))
    parts = []
    for k in lengths:
        of = wanted.select("doc_id", F.filter("cands", lambda c: c["k"] == k).alias("cands")).filter(F.size("cands") > 0)  # noqa: B023
        split = base.join(of, "doc_id").select("doc_id", "cands", words().alias("ws")).select("doc_id", "cands", hashed("ws", k).alias("h"))
        one = split.select("doc_id", "h", F.explode_outer("cands").alias("c")).filter(F.col("c.size") == F.size("h"))
        parts.append(one.select("doc_id", F.col("c.item").alias("item"), F.col("c.m").alias("m"), F.col("c.k").alias("k"), F.col("c.start").alias("start"), F.slice("h", F.col("c.start") + 1, F.col("c.m")).alias("win")))
    # Written, as fingerprints and similarities both read them, and texts are to be read no more.
    windows = written(reduce(DataFrame.unionByName, parts).distinct().withColumn("which", F.xxhash64("win")))

    counts = items.select("item", F.explode("h").alias("s")).groupBy("item", "s").agg(F.count("*").alias("ni"))
    size = F.size("win").alias("n")
    near = windows.join(within_radius(windows, counts), ["item", "which"], "left_semi")
    mine = near.select("doc_id", "item", "m", "k", "start", size, "which", F.explode("win").alias("s"))
    mine = mine.groupBy("doc_id", "item", "m", "k", "start", "n", "which", "s").agg(F.count("*").alias("nd")).join(counts, ["item", "s"])
    scored = mine.groupBy("doc_id", "item", "m", "k", "start", "n", "which").agg(F.sum(F.least("nd", "ni")).alias("o"))
    scored = scored.filter((100 + least) * F.col("o") >= least * (F.col("m") + F.col("n"))).withColumn("similarity", F.col("o") / (F.col("m") + F.col("n") - F.col("o")))
    best = scored.groupBy("doc_id", "item").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", (F.col("n") + F.col("k") - 1).alias("w"))).alias("b"))
    return best.select("doc_id", F.col("item").alias("item_id"), F.col("b.start").alias("start_word"), F.col("b.w").alias("n_words"), (-F.col("b.s")).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """docs without the rows that leak an item. Each row with an id is judged by its own text, whatever rows repeat its id."""
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.md5("text"))
    rows = docs.filter(F.col("doc_id").isNotNull()).select(key.alias("doc_id"), "text")
    found = leaks(rows, benchmark, least).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, docs["doc_id"].isNotNull() & (key == F.col("_leak")), "left_anti").select(*docs.columns)
