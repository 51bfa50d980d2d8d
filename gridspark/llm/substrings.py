"""Suffix-array dedup: removes what already stands in an earlier document, to the byte.

A byte goes if it is covered by a string of LENGTH bytes that also starts in a document with a smaller doc_id. Strings are judged
on the input; matches never cross documents.

The method is prefix doubling. A position's name for 8 bytes is the bytes themselves; names for 16, 32 and finally 50 bytes come
from the pair of names at the position and at a growing offset. Ranking is by distributed sort of the names (see exchange.py), and
a name that is unique to a document drops out before the next, longer one is ranked:

1. Each string of 50 bytes is represented by the least 24-byte name in it, a function of its content alone, so neighbours share
   one; of these about one in fourteen positions is ranked. Strings whose name no other document has drop out.
2. Of the rest, whole runs of neighbouring strings with one name are ranked. A run whose pair of outer names also stands in a
   smaller document is removed as a whole. A name with one kind of run is finished.
3. For the others, the smallest document of each run ranks its 50-byte strings one by one, up to the threshold, and removes
   those that a smaller document has.

Names beyond 8 bytes are 64-bit mixes of the pair. What removes bytes, a run or a string of 50, is also compared by an independent
mix of 32 bits, so unequal ones meet by a chance of 2**-96 a pair.

A null text counts as empty: nothing of it is removed. A document without an id, or whose text is under LENGTH bytes, stays whole,
and the former is nobody's source. Rows that repeat an id are each judged against smaller ids only. Extra columns may be carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import Layout, Message, back, dealt, first_round, merged, next_round, pack, planes, ranges, total_bytes, unpack, unplanes

LENGTH, SEED_BYTES = 50, 24
SPAN = LENGTH - SEED_BYTES + 1
#: Bytes worked on at once, so that arrays stay in the processor's cache; strings of a run at most.
CHUNK, LONGEST_RUN = 1 << 16, 40
A, B, C, D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93))


def stir(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(29)
    x *= C
    x ^= x >> np.uint64(32)
    return x


class Chunk:
    """Some documents of a bucket, side by side; numbers of documents count within the bucket."""

    def __init__(self, first: int, texts: list[bytes]):
        self.first, sizes = first, np.array([len(t) for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.end = self.start + sizes
        self.raw = b"".join(texts)

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Names of 8 and of 16 bytes at each position (and a little past the end)."""
        n = len(self.raw) + 56
        padded = self.raw + b"\0" * 64
        eight = np.empty(n, np.uint64)
        for o in range(8):
            part = eight[o::8]
            part[:] = np.frombuffer(padded, "<u8", len(part), o)
        sixteen = eight[:-8] * A
        sixteen += eight[8:]
        return eight, sixteen

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first string, last string, name) of each run of strings with one least name."""
        n = len(self.raw)
        eight, sixteen = self.names()
        seed = sixteen[:-8] * B
        seed += eight[16 : 16 + len(seed)]
        least, have = stir(seed), 1
        while have * 2 <= SPAN:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < SPAN:
            least = np.minimum(least[: -(SPAN - have)], least[SPAN - have :])
        least = least[:n]
        new = np.empty(n, bool)
        new[:1] = True
        np.not_equal(least[1:], least[:-1], out=new[1:])
        new[self.start[self.end > self.start]] = True
        at = np.flatnonzero(new)
        doc = np.searchsorted(self.start, at, side="right") - 1
        last = np.minimum(np.concatenate([at[1:] - 1, [n - 1]]), self.end[doc] - LENGTH)
        ok = last >= at
        at, doc, last = at[ok], doc[ok], last[ok]
        parts = (last - at) // LONGEST_RUN + 1
        if len(parts) and parts.max() > 1:
            k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            at, doc, last = np.repeat(at, parts) + LONGEST_RUN * k, np.repeat(doc, parts), np.repeat(last, parts)
            last = np.minimum(last, at + LONGEST_RUN - 1)
        return doc + self.first, at, last, least[at]

    def strings(self) -> tuple[np.ndarray, np.ndarray]:
        """Names of LENGTH bytes, and their checks."""
        eight, sixteen = self.names()
        gap = LENGTH - 32

        def longer(sixteen: np.ndarray, x: np.uint64, y: np.uint64) -> np.ndarray:
            long = sixteen[:-16] * x
            long += sixteen[16:]
            pair = long[:-gap] * y
            pair += long[gap:]
            return stir(pair)

        other = stir(eight)
        return longer(sixteen, C, B), (longer(other[:-8] * D + other[8:], A, D) >> np.uint64(32)).astype(np.uint32)


class Bucket:
    """The documents of a bucket with an id and LENGTH bytes or more, in the order of (id, text)."""

    def __init__(self, table: pa.Table):
        self.table = table
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        self.raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.row = sorted((i for i, t in enumerate(self.raw) if ids[i] is not None and len(t) >= LENGTH), key=lambda i: (ids[i], self.raw[i]))
        self.ids = np.array([ids[i] for i in self.row], np.int64)

    def chunks(self):
        batch, size, first = [], 0, 0
        for k, i in enumerate(self.row):
            if batch and size + len(self.raw[i]) > CHUNK:
                yield Chunk(first, batch)
                batch, size, first = [], 0, k
            batch.append(self.raw[i])
            size += len(self.raw[i])
        if batch:
            yield Chunk(first, batch)


def _least_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, and the least and largest value of each."""
    order = np.argsort(keys, kind="stable")
    ranked, values = keys[order], values[order]
    begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(keys):
        return ranked, values, values
    return ranked[begin], np.minimum.reduceat(values, begin), np.maximum.reduceat(values, begin)


def _groups(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (key, check), where each distinct pair begins in it, and the number of each entry's pair."""
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    new = np.ones(len(keys), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


NAME, RUN, STRING, SHARED, REMOVED = range(5)


def _send(layout: Layout, kind: int, src: int, keys: np.ndarray, payload) -> list[Message]:
    """Sorted keys by range; payload(a, b) gives the bytes that go with keys[a:b]."""
    cut, bits = layout.cut(keys), layout.key_bits if kind == NAME else 64
    return [(r, src, kind, pack(keys[a:b], bits) + payload(a, b)) for r, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]


def _bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(8, "little") + np.packbits(flags).tobytes()


def _unbits(blob: bytes) -> tuple[np.ndarray, bytes]:
    n = int.from_bytes(blob[:8], "little")
    end = 8 + (n + 7) // 8
    return np.unpackbits(np.frombuffer(blob, np.uint8, end - 8, 8), count=n).astype(bool), blob[end:]


def _joined_bits(messages: list[Message], kind: int) -> np.ndarray:
    got = [_unbits(m[3])[0] for m in messages if m[2] == kind]
    return np.concatenate(got) if got else np.zeros(0, bool)


def _send_least(layout: Layout, kind: int, src: int, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> list[Message]:
    """Each distinct (key, check) with the least document that has it."""
    if not len(keys):
        return []
    order, begin, _ = _groups(keys, checks)
    first, least = order[begin], np.minimum.reduceat(ids[order], begin)
    checks = checks[first]
    return _send(layout, kind, src, keys[first], lambda x, y: checks[x:y].tobytes() + planes(least[x:y]))


def _answer_least(kind: int, got: list[Message]) -> list[Message]:
    """To every entry, the least document of its key and check: a bit says whether it is the entry's own, else the number follows."""
    sent = [unpack(m[3]) for m in got]
    checks = np.concatenate([np.frombuffer(rest, np.uint32, len(k)) for k, rest in sent])
    own = np.concatenate([unplanes(rest[4 * len(k) :]) for k, rest in sent])
    order, begin, number = _groups(np.concatenate([k for k, _ in sent]), checks)
    least = np.minimum.reduceat(own[order], begin)[number]
    out, at = [], 0
    for m, (k, _) in zip(got, sent):
        mine, other = least[at : at + len(k)], least[at : at + len(k)] != own[at : at + len(k)]
        at += len(k)
        # The source of an answer is the range that gave it, so that a bucket can put ranges in order.
        out.append((m[1], m[0], kind, _bits(other) + planes(mine[other])))
    return out


def _read_least(messages: list[Message], kind: int, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each entry that `_send_least` was given, the least document of all buckets."""
    if not len(keys):
        return ids
    order, begin, number = _groups(keys, checks)
    out, at = np.minimum.reduceat(ids[order], begin), 0
    for m in messages:
        if m[2] == kind:
            other, rest = _unbits(m[3])
            part = out[at : at + len(other)]
            part[other] = unplanes(rest)
            at += len(other)
    return out[number]


def _rounds(docs: DataFrame, layout: Layout, carry: tuple[str, ...], emit, schema: str) -> DataFrame:
    placed = dealt(docs, layout, carry=carry)

    def all_runs(bucket: Bucket):
        found = [(c, *c.runs()) for c in bucket.chunks()]
        names = np.concatenate([f[4] for f in found]) if found else np.zeros(0, np.uint64)
        return found, layout.short(names)

    def send_names(b, table):
        bucket = Bucket(table)
        found, names = all_runs(bucket)
        doc = np.concatenate([bucket.ids[f[1]] for f in found]) if found else np.zeros(0, np.int64)
        keys, low, high = _least_by(names, doc)
        return _send(layout, NAME, b, keys, lambda x, y: _bits(low[x:y] != high[x:y]))

    def rank_names(r, got):
        sent = [unpack(m[3]) for m in got]
        several = np.concatenate([_unbits(rest)[0] for _, rest in sent])
        order, begin, counts = merged([k for k, _ in sent])
        shared = (counts > 1) | np.logical_or.reduceat(several[order], begin)
        return [(m[1], r, SHARED, _bits(s)) for m, s in zip(got, back(order, counts, shared, [len(k) for k, _ in sent]))]

    def shared_runs(bucket: Bucket, shared: np.ndarray):
        """Of each run whose name others have: chunk, strings, document, first, last string, its name, and key and check of the whole run."""
        found, names = all_runs(bucket)
        keep = shared[np.searchsorted(np.unique(names), names)]
        at, parts = 0, []
        for c, doc, first, last, name in found:
            ok = keep[at : at + len(doc)]
            at += len(doc)
            if not ok.any():
                continue
            string, check = c.strings()
            doc, first, last, name = doc[ok], first[ok], last[ok], name[ok]
            whole = stir((string[first] * A + string[last]) * B + name + (last - first).astype(np.uint64))
            checks = stir(check[first] * A + check[last] * B + (last - first).astype(np.uint64)) >> np.uint64(32)
            parts.append((c, (string, check), doc, first, last, name, whole, checks.astype(np.uint32)))
        return parts

    def send_runs(b, table, answers):
        shared = _joined_bits(answers, SHARED)
        parts = shared_runs(bucket := Bucket(table), shared)
        out = [(-1 - b, b, SHARED, _bits(shared))]
        if parts:
            names, whole = np.concatenate([layout.short(p[5]) for p in parts]), np.concatenate([p[6] for p in parts])
            keys, low, high = _least_by(names, whole)
            one = np.where(low == high, low, np.uint64(0))
            out += _send(layout, NAME, b, keys, lambda x, y: one[x:y].tobytes())
            out += _send_least(layout, RUN, b, whole, np.concatenate([p[7] for p in parts]), bucket.ids[np.concatenate([p[2] for p in parts])])
        return message(out)

    def rank_runs(r, got):
        out = []
        if of_names := [m for m in got if m[2] == NAME]:
            sent = [unpack(m[3]) for m in of_names]
            one = np.concatenate([np.frombuffer(rest, np.uint64) for _, rest in sent])
            order, begin, counts = merged([k for k, _ in sent])
            low, high = np.minimum.reduceat(one[order], begin), np.maximum.reduceat(one[order], begin)
            mixed = (low != high) | (low == 0)
            out += [(m[1], r, NAME, _bits(x)) for m, x in zip(of_names, back(order, counts, mixed, [len(k) for k, _ in sent]))]
        if of_runs := [m for m in got if m[2] == RUN]:
            out += _answer_least(RUN, of_runs)
        return out

    def judged(bucket: Bucket, answers):
        """Intervals of runs to remove, and the runs whose strings need a rank of their own."""
        parts = shared_runs(bucket, _joined_bits(answers, SHARED))
        gone, single = [], []
        if parts:
            names, whole, doc = np.concatenate([layout.short(p[5]) for p in parts]), np.concatenate([p[6] for p in parts]), np.concatenate([p[2] for p in parts])
            mixed = _joined_bits(answers, NAME)[np.searchsorted(np.unique(names), names)]
            least = _read_least(answers, RUN, whole, np.concatenate([p[7] for p in parts]), bucket.ids[doc])
            drop, rank = bucket.ids[doc] > least, mixed & (bucket.ids[doc] == least)
            at = 0
            for c, (string, check), d, first, last, *_ in parts:
                part = slice(at, at := at + len(d))
                base = c.start[d - c.first]
                x = drop[part]
                gone.append(np.stack([d[x], first[x] - base[x], last[x] - base[x] + LENGTH]))
                x = rank[part]
                n = last[x] - first[x] + 1
                at_string = spread(first[x], n)
                single.append((np.stack([d[x], first[x] - base[x], n]), string[at_string], check[at_string]))
        return gone, single

    def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """first, first + 1, ... n times for each run."""
        return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def send_strings(b, table, answers):
        bucket = Bucket(table)
        gone, single = judged(bucket, answers)
        none = np.zeros((3, 0), np.int64)
        run, cover = (np.concatenate([none, *x], axis=1) for x in ([s[0] for s in single], gone))
        string, check = np.concatenate([np.zeros(0, np.uint64), *[s[1] for s in single]]), np.concatenate([np.zeros(0, np.uint32), *[s[2] for s in single]])
        # Strings are looked up again by their place: the runs are kept, the names are computed anew.
        out = [(-1 - b, b, REMOVED, cover.astype(np.int32).tobytes()), (-1 - b, b, SHARED, run.astype(np.int32).tobytes())]
        out += _send_least(layout, STRING, b, string, check, bucket.ids[np.repeat(run[0], run[2])])
        return message(out)

    def rank_strings(r, got):
        return _answer_least(STRING, got)

    def finish(b, table, answers):
        bucket = Bucket(table)
        cover = [np.frombuffer(m[3], np.int32).reshape(3, -1).astype(np.int64) for m in answers if m[2] == REMOVED]
        where = [np.frombuffer(m[3], np.int32).reshape(3, -1).astype(np.int64) for m in answers if m[2] == SHARED]
        if where and where[0].shape[1]:
            doc, pos = np.repeat(where[0][0], where[0][2]), spread(where[0][1], where[0][2])
            string, check, at = np.empty(len(doc), np.uint64), np.empty(len(doc), np.uint32), 0
            for c in bucket.chunks():
                end = int(np.searchsorted(doc, c.first + len(c.start)))
                if end > at:
                    here = pos[at:end] + c.start[doc[at:end] - c.first]
                    names = c.strings()
                    string[at:end], check[at:end] = names[0][here], names[1][here]
                at = end
            drop = bucket.ids[doc] > _read_least(answers, STRING, string, check, bucket.ids[doc])
            cover.append(np.stack([doc[drop], pos[drop], pos[drop] + LENGTH]))
        spans: dict[int, np.ndarray] = {}
        if cover:
            doc, lo, hi = np.concatenate(cover, axis=1)
            order = np.lexsort((lo, doc))
            doc, lo, hi = doc[order], lo[order], hi[order]
            edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
            for x, y in zip(edge, [*edge[1:], len(doc)]):
                top = np.maximum.accumulate(hi[x:y])
                new = np.concatenate([[True], lo[x + 1 : y] > top[:-1]])
                begin = np.flatnonzero(new)
                spans[bucket.row[doc[x]]] = np.stack([lo[x:y][begin], top[np.concatenate([begin[1:] - 1, [y - x - 1]])]])
        return emit(bucket, spans)

    from .exchange import MESSAGE, message_table

    message = message_table
    names = ranges(first_round(placed, send_names), rank_names)
    runs = ranges(next_round(placed, names, send_runs, MESSAGE), rank_runs)
    strings = ranges(next_round(placed, runs, send_strings, MESSAGE), rank_strings)
    return next_round(placed, strings, finish, schema)


def dedup(docs: DataFrame, keep_text: bool = False, carry: tuple[str, ...] = (), bucket_bytes: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row, with `kept` (a string) if asked for, and carried columns.

    Where a cut splits a character, `kept` keeps the whole character; the checksum is of the exact bytes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    types = dict(docs.dtypes)
    schema = ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(["kept string"] if keep_text else []), *(f"`{c}` {types[c]}" for c in carry)])
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def whole(raw: bytes, cuts: np.ndarray) -> bytes:
        """What is left where removed spans shrink to whole characters."""
        out, at = [], 0
        for x, y in cuts.T.tolist():
            while x < y and raw[x] & 0xC0 == 0x80:
                x += 1
            while x < y < len(raw) and raw[y] & 0xC0 == 0x80:
                y -= 1
            out.append(raw[at:x])
            at = y
        return b"".join([*out, raw[at:]])

    def emit(bucket: Bucket, spans: dict[int, np.ndarray]) -> pa.Table:
        n_bytes, removed, n_spans, sha, kept = [], [], [], [], []
        for i, raw in enumerate(bucket.raw):
            cuts = spans.get(i)
            left = raw
            if cuts is not None:
                edges = [0, *cuts.T.ravel().tolist(), len(raw)]
                left = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
            n_bytes.append(len(raw))
            removed.append(len(raw) - len(left))
            n_spans.append(0 if cuts is None else cuts.shape[1])
            sha.append(hashlib.sha256(left).hexdigest())
            if keep_text:
                kept.append((left if cuts is None else whole(raw, cuts)).decode("utf-8", "surrogatepass"))
        cols = [bucket.table.column("doc_id"), n_bytes, removed, n_spans, sha, *([kept] if keep_text else []), *(bucket.table.column(c) for c in carry)]
        return pa.table([c.cast(f.type) if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return _rounds(docs, Layout(total_bytes(docs), bucket_bytes), carry, emit, schema)
