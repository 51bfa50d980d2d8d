"""Sharding by sampled splitters.

Records are ordered by (hash of the text, doc_id), so copies lie side by side. A size-weighted sample of the text hashes gives
quantile boundaries, which cut the order into many small ranges; their exact sizes are then counted. Where one text holds more
than a range should, it becomes a range of its own, and it is subdivided by a running number of its rows: always for numbering,
and into several shards only if it alone outweighs a whole shard. Ranges go to shards heaviest first, each to the lightest shard so far, so
`bytes` is the law that holds: sizes are near equal, and equal texts share a shard unless that can't be.

The driver sees the sample and one row per range; there are `cells` ranges a shard, or as many as keep a range to about RANGE_ROWS
rows. Slots number the records of a shard from 0 without gaps: the offset of the range plus the place in it.

Null texts have size 1 (nothing plus 1) and the checksum of no bytes. An empty table gives no rows. Null and repeated ids are rows
like any other: sampling and subdividing go by the running number, which the written table holds. Extra columns aren't read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import written

#: Ranges for each shard at least; sample keys drawn for each range; rows of a range from where on there are more ranges.
CELLS, DRAWN, RANGE_ROWS = 128, 8, 1 << 20


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, h): what sharding needs of a document; the text itself isn't shuffled."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select("doc_id", (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("h"))


def splitters(rows: DataFrame, cells: int, total: int) -> list[int]:
    """Boundaries at the quantiles of a sample that takes each record with a chance in proportion to its size.

    The chance is read off a hash of the row's number, so it is the same whenever it is read; about cells * DRAWN keys are drawn.
    """
    chance = F.col("size") * F.lit(cells * DRAWN / max(total, 1))
    draw = F.pmod(F.xxhash64("uid", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    keys = sorted(r[0] for r in rows.filter(draw < chance).select("h").collect())
    return sorted({keys[i * len(keys) // cells] for i in range(1, cells)}) if keys else []


def shard(docs: DataFrame, shards: int = 8, cells: int = CELLS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row; `cells` is the number of ranges per shard."""
    spark = docs.sparkSession
    # A few dozen bytes a document, written once, so that texts are read once.
    rows = written(sizes(docs).withColumn("uid", F.monotonically_increasing_id()))
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).collect()[0]
    cells = max(cells, -(-n_rows // (shards * RANGE_ROWS)))
    cuts = np.array(splitters(rows, shards * cells, total), np.int64)

    @F.pandas_udf("int")
    def cell_of(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, h.to_numpy(), side="right").astype(np.int32))

    rows = rows.withColumn("cell", cell_of("h"))
    # Texts that alone outweigh a range; there are at most shards * cells of them, as their sizes add up to the total.
    ideal = total / max(1, shards * cells)
    heavy = {r[0]: r[1] for r in rows.groupBy("h").agg(F.sum("size").alias("b")).filter(F.col("b") > F.lit(2 * ideal)).collect()}
    if heavy:
        order = sorted(heavy)
        parts = np.array([max(1, int(heavy[h] // ideal)) for h in order], np.int64)
        known = np.array(order, np.int64)

        @F.pandas_udf("long")
        def part_of(h: pd.Series, uid: pd.Series) -> pd.Series:
            """-1 for ordinary rows, else heavy text's place << 32 | part by the row's number."""
            hh = h.to_numpy()
            i = np.minimum(np.searchsorted(known, hh), len(known) - 1)
            mixed = (uid.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            return pd.Series(np.where(known[i] == hh, (i << 32) | (mixed.astype(np.int64) % parts[i]), -1))

        rows = rows.withColumn("part", part_of("h", "uid"))
    else:
        order = []
        rows = rows.withColumn("part", F.lit(-1).cast("long"))
    rows = rows.withColumn("cell", F.when(F.col("part") >= 0, F.lit(-1)).otherwise(F.col("cell")))

    counted = [tuple(r) for r in rows.groupBy("cell", "part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()]
    # What stays together: a range, a heavy text that fits into a shard, or a part of one that doesn't.
    units: dict[tuple, list[tuple]] = {}
    for cell, part, b, n in sorted(counted):
        whole = part >= 0 and heavy[order[part >> 32]] <= total / shards
        units.setdefault(("text", part >> 32) if whole else (cell, part), []).append((cell, part, b, n))
    heap, given, offset = [(0, s) for s in range(shards)], [], [0] * shards
    for unit in sorted(units.values(), key=lambda u: (-sum(x[2] for x in u), u[0][:2])):
        load, s = heapq.heappop(heap)
        for cell, part, b, n in unit:
            given.append((cell, part, s, offset[s]))
            offset[s] += n
            load += b
        heapq.heappush(heap, (load, s))

    at = spark.createDataFrame(given or [(0, 0, 0, 0)], "cell int, part long, shard int, offset long")
    place = F.row_number().over(W.Window.partitionBy("cell", "part").orderBy("h", "doc_id", "uid")) - 1
    # One row per range: shards * cells and the parts of heavy texts, at most three times as many, so it is small whatever the documents.
    return rows.withColumn("place", place).join(F.broadcast(at), ["cell", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
