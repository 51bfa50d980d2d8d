"""N-gram Jaccard join: groups of documents whose word-shingle sets are linked, by vertical partitioning.

A document's set holds its distinct five-word shingles (words are runs without ASCII white space, A-Z lower-cased); with fewer
words, the whole sequence is its one shingle; without words the set is empty and linked with nothing. Two documents link when
100 * intersection >= LEAST * union.

1. Documents with equal sets form a class; from here on a class is one set, however many copies it has. Class frequencies of all
   shingles are counted by a distributed sort (exchange.py). They give the global order, rarest first. A class of n shingles, less
   than LEAST % of which any other class has, can have no link and is finished.
2. The global order is cut into fragments at fixed pivots. Two linked sets share a shingle of their prefixes in the global order
   (n - ceil(LEAST % of n) + 1 shingles long), so sets that share one are proposed, unless their sizes, the shingles that they share
   with anyone, or the parities of their sets show that they can't be linked.
3. Every fragment counts the overlap of a proposed pair in its part of the order, and the counts are summed per pair.
4. Where many sets share a shingle, not all their pairs are listed: each set first meets a fixed number of leaders of the group;
   links make components. Pairs of the group that are still in different components then meet exhaustively, in pairs of blocks
   that are dealt out, so no link between components is lost and no task lists the pairs of a whole group.

Null texts are empty. A row without an id is nobody's partner and has no component. Rows that repeat an id are separate documents
with one id. Extra columns are not read. Hashes of 64 bits stand for shingles (59 bits of them in overlaps), 128 bits for whole
sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import written
from .exchange import MESSAGE, Layout, Message, back, dealt, first_round, merged, message_table, next_round, pack, ranges, total_bytes, unpack
from .graph import components

WORDS, LEAST = 5, 75
#: Parts that the global order is cut into; leaders of a group of sets that share a shingle; sets in a block of a group.
FRAGMENTS, LEADERS, BLOCK = 8, 16, 512
#: Places of the parities of a set, a power of two.
BITS = 256
_PLACE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_EMPTY = np.zeros(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return _EMPTY
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    k = min(WORDS, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out += h[i : i + len(out)] * _PLACE[i]
        out ^= out >> np.uint64(31)
    out *= _PLACE[1]
    out ^= out >> np.uint64(32)
    return np.unique(out + np.uint64(k))


def fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [shingles(t) for t in table.column("text").to_pylist()]


def _distinct(sets: list[np.ndarray], layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(layout.short(np.concatenate(sets)) if sets else _EMPTY, return_counts=True)


def needed(n: int | np.ndarray):
    """Least overlap with any partner of a set of n: ceil(LEAST % of n)."""
    return (LEAST * n + 99) // 100


CLASS, SIG, KEYS = range(3)
_SIG = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("id", "<i8")])


def _classes(table: pa.Table, sets: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
    """The distinct sets of a bucket's rows with an id, as fingerprints with the least id, and a row that has both."""
    ids = table.column("doc_id").to_pylist()
    seen: dict[bytes, int] = {}
    for i, s in enumerate(sets):
        if len(s) and ids[i] is not None:
            sig = fingerprint(s)
            if sig not in seen or ids[i] < ids[seen[sig]]:
                seen[sig] = i
    out = np.zeros(len(seen), _SIG)
    out["hi"] = [int.from_bytes(k[:8], "big") for k in seen]
    out["lo"] = [int.from_bytes(k[8:], "big") for k in seen]
    out["id"] = [ids[i] for i in seen.values()]
    order = np.lexsort((out["lo"], out["hi"]))
    rows = list(seen.values())
    return out[order], [rows[i] for i in order]


def profiles(docs: DataFrame, carry: tuple[str, ...] = (), bucket_bytes: int | None = None) -> DataFrame:
    """(doc_id, n, sig, least, toks, bits, carry...): set size, fingerprint of the set and the least id of its class. One row of each
    class that may have links also has those of its shingles that other classes have, as numbers in the global order, and their
    parities in BITS places."""
    layout = Layout(total_bytes(docs), bucket_bytes)
    placed = dealt(docs, layout, carry=carry)

    def send_classes(b, table) -> list[Message]:
        of, _ = _classes(table, _sets(table))
        cut = layout.cut(of["hi"])
        return [(r, b, SIG, of[x:y].tobytes()) for r, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]

    def rank_classes(r, got: list[Message]) -> list[Message]:
        """To each bucket, the least id of each class that it has, and whether it is to speak for the class."""
        of = np.concatenate([np.frombuffer(m[3], _SIG) for m in got])
        order = np.lexsort((np.arange(len(of)), of["id"], of["lo"], of["hi"]))
        ranked = of[order]
        new = np.concatenate([[True], (ranked["hi"][1:] != ranked["hi"][:-1]) | (ranked["lo"][1:] != ranked["lo"][:-1])])
        least, speaks = np.empty(len(of), np.int64), np.zeros(len(of), bool)
        least[order] = ranked["id"][np.flatnonzero(new)][np.cumsum(new) - 1]
        speaks[order[new]] = True
        out, at = [], 0
        for m in got:
            k = len(m[3]) // _SIG.itemsize
            out.append((m[1], r, CLASS, k.to_bytes(8, "little") + least[at : at + k].tobytes() + np.packbits(speaks[at : at + k]).tobytes()))
            at += k
        return out

    def read_classes(answers: list[Message]) -> tuple[np.ndarray, np.ndarray]:
        least, speaks = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for m in answers:
            if m[2] == CLASS:
                k = int.from_bytes(m[3][:8], "little")
                least.append(np.frombuffer(m[3], np.int64, k, 8))
                speaks.append(np.unpackbits(np.frombuffer(m[3], np.uint8, -1, 8 + 8 * k), count=k).astype(bool))
        return np.concatenate(least), np.concatenate(speaks)

    def send_keys(b, table, answers) -> pa.Table:
        sets = _sets(table)
        _, rows = _classes(table, sets)
        speaks = read_classes(answers)[1]
        keys, n = _distinct([sets[i] for i, yes in zip(rows, speaks) if yes], layout)
        n = np.minimum(n, 255).astype(np.uint8)
        cut = layout.cut(keys)
        own = [(-1 - b, m[1], CLASS, m[3]) for m in answers]
        return message_table(own + [(r, b, KEYS, pack(keys[x:y], layout.key_bits) + n[x:y].tobytes()) for r, (x, y) in enumerate(zip(cut, cut[1:])) if y > x])

    def rank_keys(r, got: list[Message]) -> list[Message]:
        sent = [unpack(m[3]) for m in got]
        n = np.concatenate([np.frombuffer(rest, np.uint8) for _, rest in sent]).astype(np.int64)
        order, begin, counts = merged([k for k, _ in sent])
        df = np.add.reduceat(n[order], begin)
        level = np.where(df == 1, 0, np.minimum(15, np.ceil(np.log2(np.maximum(df, 2))))).astype(np.uint8)
        out = []
        for m, v in zip(got, back(order, counts, level, [len(k) for k, _ in sent])):
            even = np.append(v, np.zeros(len(v) % 2, np.uint8))
            out.append((m[1], r, KEYS, len(v).to_bytes(8, "little") + (even[::2] << 4 | even[1::2]).tobytes()))
        return out

    from pyspark.sql.pandas.types import to_arrow_schema

    types = dict(docs.dtypes)
    schema = ", ".join(["doc_id long, n long, sig binary, least long, toks array<long>, bits array<long>", *(f"`{c}` {types[c]}" for c in carry)])
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def finish(b, table, answers) -> pa.Table:
        levels = [_EMPTY.astype(np.uint8)]
        for m in answers:
            if m[2] == KEYS:
                raw = np.frombuffer(m[3], np.uint8, offset=8)
                levels.append(np.stack([raw >> 4, raw & 15], axis=1).ravel()[: int.from_bytes(m[3][:8], "little")])
        level = np.concatenate(levels)
        sets = _sets(table)
        of, rows = _classes(table, sets)
        least, speaks = read_classes(answers)
        speakers = [i for i, yes in zip(rows, speaks) if yes]
        keys, _ = _distinct([sets[i] for i in speakers], layout)
        ids, by = table.column("doc_id").to_pylist(), {(int(x["hi"]), int(x["lo"])): int(d) for x, d in zip(of, least)}
        sig = [fingerprint(s) if len(s) else None for s in sets]
        own = [None if s is None or d is None else by[int.from_bytes(s[:8], "big"), int.from_bytes(s[8:], "big")] for s, d in zip(sig, ids)]
        toks, bits = [None] * len(sets), [None] * len(sets)
        for i in speakers:
            s = sets[i]
            of_others = level[np.searchsorted(keys, layout.short(s))]
            shared = of_others > 0
            if np.count_nonzero(shared) >= needed(len(s)):
                t = np.sort(of_others[shared].astype(np.int64) << 59 | (s[shared] >> np.uint64(5)).astype(np.int64))
                toks[i] = t
                bits[i] = np.packbits(np.bincount(t & (BITS - 1), minlength=BITS).astype(np.uint8) & 1).view(np.int64)
        cols = [table.column("doc_id"), [len(s) for s in sets], sig, own, toks, bits, *(table.column(c) for c in carry)]
        return pa.table([c.cast(f.type) if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    classes = ranges(first_round(placed, send_classes), rank_classes)
    return next_round(placed, ranges(next_round(placed, classes, send_keys, MESSAGE), rank_keys), finish, schema)


def _may_link(x: str, y: str) -> Column:
    """Of two sides with n, s and bits: their sizes can reach the threshold, and so can the most that they can have in common.

    Two sets of which s shingles are also in others have at most the smaller s in common. Where the parities of two sets differ in
    d places, they differ in d shingles at least.
    """
    n, m, s, t = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.s"), F.col(f"{y}.s")
    differ = sum((F.bit_count(F.col(f"{x}.b{i}").bitwiseXOR(F.col(f"{y}.b{i}"))) for i in range(BITS // 64)), F.lit(0))
    most = F.least(F.least(s, t), F.shiftright(s + t - differ, 1))
    return (100 * F.least(n, m) >= LEAST * F.greatest(n, m)) & ((100 + LEAST) * most >= LEAST * (n + m))


def _fragments(classes: DataFrame) -> DataFrame:
    """(c, f, part): each class's shingles cut where the global order is, at quantiles of the classes' shingles."""
    at = F.transform(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)), lambda i: F.get("toks", (F.size("toks") * i / FRAGMENTS).cast("int")))
    got = classes.select(F.explode(at).alias("t")).agg(F.percentile_approx("t", [i / FRAGMENTS for i in range(1, FRAGMENTS)], 1000)).collect()[0][0] or []
    pivots = np.array(sorted(set(got)), np.int64)  # FRAGMENTS - 1 numbers at most

    def cut(batches):
        for batch in batches:
            c, f, part = [], [], []
            for sig, toks in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = toks.values.to_numpy()
                edges = [0, *np.searchsorted(t, pivots, side="right").tolist(), len(t)]
                for i, (x, y) in enumerate(zip(edges, edges[1:])):
                    if y > x:
                        c.append(sig)
                        f.append(i)
                        part.append(t[x:y])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array(f, pa.int32()), pa.array(part, pa.list_(pa.int64()))], ["c", "f", "part"])

    return classes.select("c", "toks").mapInArrow(cut, "c binary, f int, part array<long>")


def _verified(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, both: sum of their sizes, ...) that are links: overlaps are counted fragment by fragment and summed."""
    left = fragments.select(F.col("c").alias("a"), "f", F.col("part").alias("pa"))
    right = fragments.select(F.col("c").alias("b"), "f", F.col("part").alias("pb"))
    keys = pairs.columns
    partial = pairs.join(left, "a").join(right, ["b", "f"]).select(*keys, F.size(F.array_intersect("pa", "pb")).alias("o"))
    return partial.groupBy(*keys).agg(F.sum("o").alias("o")).filter((100 + LEAST) * F.col("o") >= LEAST * F.col("both")).drop("o")


def linked_classes(classes: DataFrame) -> DataFrame:
    """(c, comp) for the classes (c, n, toks, bits) that have links to others; comp is the least class reached."""
    fragments = written(_fragments(classes))
    need = F.floor((LEAST * F.col("n") + 99) / 100)
    prefix = (F.col("n") - need + 1 - (F.col("n") - F.size("toks"))).cast("int")
    keyed = classes.filter(prefix > 0).select("c", "n", F.size("toks").alias("s"), *(F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(BITS // 64)), F.explode(F.slice("toks", F.lit(1), prefix)).alias("t"))

    def pairs_of(x: str, y: str, *more: Column) -> list[Column]:
        swap = F.col(f"{x}.c") > F.col(f"{y}.c")
        a, b = F.col(f"{x}.c"), F.col(f"{y}.c")
        return [F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"), (F.col(f"{x}.n") + F.col(f"{y}.n")).alias("both"), *more]

    # Every class meets the first LEADERS of those that share a prefix shingle: all pairs of a small group, a linear number in a large one.
    first = F.row_number().over(W.Window.partitionBy("t").orderBy("c"))
    leaders = keyed.withColumn("k", first).filter(F.col("k") <= LEADERS)
    met = leaders.alias("x").join(keyed.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.c") < F.col("y.c")) & _may_link("x", "y"))
    links = written(_verified(met.select(*pairs_of("x", "y")).distinct(), fragments))
    comps = components(links)

    # What is left: pairs of a large group that are in different components. A group is cut into blocks, and its pairs of blocks are
    # dealt out, so no task lists the pairs of a whole group.
    labelled = keyed.join(comps.withColumnRenamed("v", "c"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    large = labelled.groupBy("t").agg(F.count("*").alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter((F.col("k") > LEADERS) & (F.col("lo") < F.col("hi")))
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    rows = labelled.join(large.select("t", blocks.alias("blocks")), "t").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
    one, two = rows.filter(F.col("own") == F.col("p")).alias("x"), rows.filter(F.col("own") == F.col("q")).alias("y")
    same = (F.col("x.t") == F.col("y.t")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.q") == F.col("y.q"))
    apart = (F.col("x.comp") != F.col("y.comp")) & ((F.col("x.p") < F.col("x.q")) | (F.col("x.c") < F.col("y.c")))
    rest = one.join(two, same & apart & _may_link("x", "y"))
    late = written(_verified(rest.select(*pairs_of("x", "y", F.least("x.comp", "y.comp").alias("ca"), F.greatest("x.comp", "y.comp").alias("cb"))).distinct(), fragments))
    if late.isEmpty():
        return comps.withColumnRenamed("v", "c")
    joined = components(late.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    alone = joined.select(F.col("v"), F.col("v").alias("comp")).join(comps, "v", "left_anti")
    return comps.unionByName(alone).join(joined.select(F.col("v").alias("comp"), F.col("comp").alias("least")), "comp", "left").select(F.col("v").alias("c"), F.coalesce("least", "comp").alias("comp"))


def join(docs: DataFrame, carry: tuple[str, ...] = (), bucket_bytes: int | None = None, group: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, carry...) for each row; component_id is null where doc_id is.

    If asked for, `group` tells groups apart whose least ids are equal; it is null for rows without shingles or without an id.
    """
    rows = written(profiles(docs, carry, bucket_bytes))
    classes = rows.filter(F.col("toks").isNotNull()).select(F.col("sig").alias("c"), "n", "toks", "bits", F.col("least").alias("d"))
    found = linked_classes(classes.drop("d"))
    label = classes.select("c", "d").join(found, "c")
    label = label.join(label.groupBy("comp").agg(F.min("d").alias("least_id")), "comp").select(F.col("c").alias("sig"), "least_id", "comp")
    named = F.col("doc_id").isNotNull()
    out = rows.join(label, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(named, F.coalesce("least_id", "least", "doc_id")).alias("component_id"), *([F.when(named, F.coalesce("comp", "sig")).alias("group")] if group else []), *carry)
    return out
