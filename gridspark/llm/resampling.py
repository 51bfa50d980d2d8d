"""Importance resampling towards a target corpus, on bucket-partitioned inverted postings.

A feature is a run of 1 to GRAMS consecutive words; features fall into BUCKETS buckets by checksum. Blocks of documents write postings
(bucket, document in the block, count), delta coded and sorted by bucket, once into a table; the sums of each corpus by bucket go
along. Postings are shuffled by bucket range, where they meet the gains of their buckets, which come from both corpora's sums grouped
by bucket. What a document gains in a range of buckets is one number; these contributions are shuffled by block and added. A weight
plus noise from the document's id is its score, and the highest scores are drawn (Gumbel top-k, which draws without replacement in
proportion to exp(weight)).

A bucket that all documents share is not a group: postings of a bucket range are salted by blocks, so a task meets a bounded number
of them, and gains are copied to the salts. Ranks come from a distributed sort. The driver sees two totals, a count, and a row per range of
the sort.

Words are lower-cased A-Z and runs of characters that aren't ASCII punctuation, space or control. A null or empty text has no features:
weight 0. Long texts are read whole, in pieces. A null id counts as the empty text in the noise and comes first among equal scores;
rows that repeat an id are rows like any other, equal ones in any order. Without documents there are no rows; without target texts all counts of
the target are 0. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.ordered import numbered
from .common import SLICE_BYTES, forget, slices, trim, written

BUCKETS = 10_000
#: Ranges of buckets; postings of a range are dealt out by this many blocks.
PARTS, BLOCKS_PER_SALT = 50, 64
WIDTH = BUCKETS // PARTS
#: Most documents of a block (their number takes two bytes), and bytes of a long text that are cut into words at once.
BLOCK_ROWS, PIECE = 1 << 16, 1 << 20
#: Lower-cases A-Z and makes every byte that isn't of a word a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "block long, part int, blob binary, doc_ids array<long>, words array<long>, features array<long>, sums array<long>"
ROSTER, SUMS = -1, -2


def pieces(raw: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, a bounded number at once."""
    at = 0
    while at < len(raw):
        end = at + size
        while end < len(raw) and FOLD[raw[end]] != 32:  # not within a word
            end += 1
        yield raw[at:end].translate(FOLD).split()
        at = end


def checksums(raw: bytes) -> tuple[int, np.ndarray]:
    """The number of words, and the checksum of every feature."""
    n, found, last = 0, [], []
    for words in pieces(raw):
        n += len(words)
        old, words = len(last), last + words
        spaced = [b" " + w for w in words]
        one = list(map(crc32, words))
        two = list(map(crc32, spaced[1:], one))
        # Features that end before this piece are counted already.
        for sums, begin in ((one, old), (two, max(0, old - 1)), (list(map(crc32, spaced[2:], two)), 0)):
            found.append(np.array(sums[begin:], np.uint32))
        last = words[-2:]
    return n, np.concatenate(found) if found else np.zeros(0, np.uint32)


def pack(bucket: np.ndarray, doc: np.ndarray, count: np.ndarray) -> bytes:
    """Postings sorted by bucket and document: sizes of the lists, gaps between documents, counts; byte planes, compressed."""
    size = np.bincount(bucket, minlength=WIDTH).astype("<u4")
    gap = doc.copy()
    same = np.flatnonzero(bucket[1:] == bucket[:-1]) + 1
    gap[same] -= doc[same - 1]
    planes = [size.tobytes(), *((gap >> s & 255).astype(np.uint8).tobytes() for s in (0, 8)), *((count >> s & 255).astype(np.uint8).tobytes() for s in (0, 8, 16, 24))]
    raw = b"".join(planes)
    return len(raw).to_bytes(6, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document, count) of postings."""
    raw = np.frombuffer(pa.decompress(blob[6:], int.from_bytes(blob[:6], "little"), codec="zstd", asbytes=True), np.uint8)
    size = raw[: 4 * WIDTH].view("<u4").astype(np.int64)
    n = int(size.sum())
    plane = raw[4 * WIDTH :].reshape(6, n).astype(np.int64)
    run = np.cumsum(plane[0] | plane[1] << 8)
    begin = np.cumsum(size) - size
    before = np.where(begin > 0, run[np.maximum(begin, 1) - 1] if n else 0, 0)
    return np.repeat(np.arange(WIDTH), size), run - np.repeat(before, size), plane[2] | plane[3] << 8 | plane[4] << 16 | plane[5] << 24


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(ddl))


def _rows(schema: pa.Schema, height: int, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(height, f.type) for f in schema], schema=schema)


def index(docs: DataFrame, id_column: str | None) -> DataFrame:
    """Postings and roster of each block of documents, and each task's sums by bucket; without an id column the sums only."""
    schema = _schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, SLICE_BYTES):
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                words, features, keys = [], [], []
                for i, raw in enumerate(part.column("text").to_pylist()):
                    n, found = checksums(raw or b"")
                    words.append(n)
                    features.append(len(found))
                    keys.append((found % BUCKETS).astype(np.int64) * BLOCK_ROWS + i)
                key, count = np.unique(np.concatenate(keys), return_counts=True)
                bucket, doc = key // BLOCK_ROWS, key % BLOCK_ROWS
                sums += np.bincount(bucket, count, BUCKETS).astype(np.int64)
                if id_column is None:
                    continue
                cut = np.searchsorted(bucket, np.arange(0, BUCKETS + 1, WIDTH))
                blobs = [(p, pack(bucket[a:b] - p * WIDTH, doc[a:b], count[a:b])) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if a < b]
                if blobs:
                    yield _rows(schema, len(blobs), block=[block] * len(blobs), part=[p for p, _ in blobs], blob=[b for _, b in blobs])
                yield _rows(schema, 1, block=[block], part=[ROSTER], doc_ids=[part.column("doc_id").to_pylist()], words=[words], features=[features])
                block += 1
        yield _rows(schema, 1, part=[SUMS], sums=[sums])
        trim()

    key = [F.col(id_column).cast("long").alias("doc_id")] if id_column else []
    return docs.select(*key, F.col("text").cast("binary").alias("text")).mapInArrow(run, INDEX)


def bucket_sums(indexed: DataFrame, name: str) -> DataFrame:
    return indexed.filter(F.col("part") == SUMS).select(F.posexplode("sums").alias("bucket", "x")).groupBy("bucket").agg(F.sum("x").alias(name))


def gains(source: DataFrame, target: DataFrame) -> DataFrame:
    """(part, gains): floor(1000 ln of the odds of target and source) of each bucket, smoothed by one, in arrays by bucket range."""
    spark = source.sparkSession
    both = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(bucket_sums(source, "s"), "bucket", "left").join(bucket_sums(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    both = written(both)
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).collect()[0]
    odds = (F.col("t") + 1).cast("double") * F.lit(float(all_s + BUCKETS)) / ((F.col("s") + 1).cast("double") * F.lit(float(all_t + BUCKETS)))
    gain = both.select((F.col("bucket") / WIDTH).cast("int").alias("part"), F.struct("bucket", F.floor(1000 * F.log(odds)).cast("long").alias("gain")).alias("g"))
    return gain.groupBy("part").agg(F.sort_array(F.collect_list("g")).getField("gain").alias("gains"))


def weights(indexed: DataFrame, gain: DataFrame) -> DataFrame:
    """(uid, doc_id, n_words, n_features, weight) of each row of the indexed documents."""
    n_blocks = indexed.filter(F.col("part") == ROSTER).count()
    salts = max(1, -(-n_blocks // BLOCKS_PER_SALT))
    salt = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt")
    posted = indexed.filter(F.col("part") >= 0).select("part", salt, "block", "blob")
    spread = gain.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("shuffle_hash")
    added, result = _schema("block long, part int, blob binary"), _schema("uid long, doc_id long, n_words long, n_features long, weight long")

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for blob, own in zip(batch.column("blob").to_pylist(), batch.column("gains").to_pylist()):
                bucket, doc, count = unpack(blob)
                total = np.zeros(int(doc.max()) + 1, np.int64)
                np.add.at(total, doc, count * np.array(own, np.int64)[bucket])
                out.append(pa.compress(total.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True) + len(total).to_bytes(4, "little"))
            yield _rows(added, batch.num_rows, block=batch.column("block"), part=batch.column("part"), blob=out)

    def add(table: pa.Table) -> pa.Table:
        total, roster = np.zeros(BLOCK_ROWS, np.int64), None
        for row in table.to_pylist():
            if row["part"] == ROSTER:
                roster = row
                continue
            n = int.from_bytes(row["blob"][-4:], "little")
            plane = np.frombuffer(pa.decompress(row["blob"][:-4], 8 * n, codec="zstd", asbytes=True), np.uint8)
            total[:n] += np.ascontiguousarray(plane.reshape(8, n).T).view(np.int64).ravel()
        n = len(roster["doc_ids"])
        return pa.Table.from_batches([_rows(result, n, uid=roster["block"] * BLOCK_ROWS + np.arange(n), doc_id=roster["doc_ids"], n_words=roster["words"], n_features=roster["features"], weight=total[:n])])

    parts = posted.join(spread, ["part", "salt"]).select("block", "part", "blob", "gains").mapInArrow(contribute, "block long, part int, blob binary")
    roster = indexed.filter(F.col("part") == ROSTER).select("block", "part", "blob", "doc_ids", "words", "features")
    return parts.unionByName(roster, allowMissingColumns=True).groupBy("block").applyInArrow(add, "uid long, doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it isn't drawn."""
    indexed = written(index(docs, "doc_id"))
    weighed = weights(indexed, gains(indexed, index(target, None)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weighed.select("uid", "doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("eligible"))
    placed = numbered(scored, [F.desc("eligible"), F.desc("score"), F.asc("doc_id"), "uid"])
    drawn = indexed.filter(F.col("part") == ROSTER).select(F.sum(F.size(F.filter("words", lambda w: w >= least_words))).alias("n")).collect()[0].n or 0
    forget(indexed)
    rank = F.when(F.col("eligible") & (F.col("place") <= percent * drawn // 100), F.col("place"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
