"""The training-data operators against brute force, libraries and round trips; nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers_path = pytest.importorskip("public_tokenizers").path

from gridspark.llm import bpe, decontamination, exchange, graph, jaccard, language, licenses, media, sharding, substrings, tokencount, urls  # noqa: E402

DOC = "doc_id long, text string"
ODD = [(901, None), (902, ""), (903, "  \n"), (904, "x"), (905, "a" * 30_000), (906, "日本語 😀 é" * 50), (907, "same text here"), (908, "same text here"), (908, "same text here")]


def docs_of(spark, rows):
    """With extra columns whose names clash with those that operators use inside."""
    return spark.createDataFrame(rows, DOC).withColumns({c: F.lit("clash") for c in ("b", "c", "n", "s", "h", "comp", "sig", "toks", "dest", "shard", "score", "item", "path")})


# --- 1 decontamination

def bag(words, k):
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def leaks_by_hand(docs, items):
    out = {}
    for d, t in docs:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for i, x in items:
            iw = re.findall(r"[^\W_]+", (x or "").lower())
            if d is None or not iw:
                continue
            k = min(5, len(iw))
            a, b = bag(iw, k), bag(w, k)
            n = min(len(a), len(b))
            for s in range(len(b) - n + 1 if b else 0):
                o = sum((Counter(a) & Counter(b[s : s + n])).values())
                if 175 * o >= 75 * (len(a) + n):
                    sim = o / (len(a) + n - o)
                    if sim > out.get((d, i), 0) + 1e-12:
                        out[d, i] = sim
    return out


def test_decontamination(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["é"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(2, 40)))) for i in range(12)] + [(50, "a b " * 8), (51, None), (52, "...")]
    rows = []
    for d in range(120):
        w = rng.choices(vocabulary, k=rng.randint(0, 100))
        if rng.random() < 0.7:
            leak = rng.choice(items[:13])[1].split()
            for _ in range(rng.randint(0, 2)):
                leak.insert(rng.randrange(len(leak) + 1), "Q")
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + "," for x in leak]
        rows.append((d, " ".join(w)))
    rows += [*ODD, (None, items[5][1]), (3, rows[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.leaks(docs_of(spark, rows), bench).collect()}
    want = leaks_by_hand(rows, items)
    assert want and got == pytest.approx(want)
    kept = decontamination.clean(docs_of(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontamination.leaks(docs_of(spark, rows).limit(0), bench).count() == 0
    assert decontamination.leaks(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_of_repeated_shingles(spark):
    """Windows over the threshold that replace or lack an item's repeated shingle, or repeat one that the item has once."""
    rest = [f"w{i}" for i in range(176)]
    once = [f"u{i}" for i in range(204)]
    items = [(1, " ".join(["x"] * 28 + rest)), (2, " ".join(once))]
    rows = [(1, " ".join(["y"] * 28 + rest)), (2, " ".join([f"z{i}" for i in range(28)] + rest)), (3, " ".join(rest)), (4, " ".join(["y"] * 28 + once[28:]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.leaks(docs_of(spark, rows), bench).collect()}
    want = leaks_by_hand(rows, items)
    assert set(want) == {(1, 1), (2, 1), (3, 1), (4, 2)} and got == pytest.approx(want)


def test_fingerprints_at_the_threshold(spark):
    """Windows that replace or lack as much as the threshold allows are within the radius, whatever is repeated; equal bags have equal bits."""
    rng = random.Random(17)
    bags = []
    for i in range(400):
        m = rng.choice([4, 5, 7, 12, 28, 100, 200])
        item = ["x"] * (m // 7) + [f"i{i}w{j}" for j in range(m - m // 7)]
        out = m - math.ceil(150 * m / 175)
        bags += [(4 * i, Counter(item)), (4 * i + 1, Counter([f"n{i}w{j}" for j in range(out)] + item[out:])), (4 * i + 2, Counter(item[: math.ceil(0.75 * m)])), (4 * i + 3, Counter(reversed(item)))]
    rows = [(k, zlib.crc32(s.encode()), n) for k, b in bags for s, n in b.items()]
    got = {r.k: r.fp for r in decontamination.fingerprints(spark.createDataFrame(rows, "k long, s long, n long"), "k", "s", "n").collect()}
    far = [(got[4 * i] ^ got[4 * i + j]).bit_count() for i in range(400) for j in (1, 2)]
    assert max(far) <= decontamination.RADIUS and 8 < sum(far) / len(far) < 15
    assert all(got[4 * i] == got[4 * i + 3] and 0 <= got[4 * i] < 1 << decontamination.BITS for i in range(400))
    strange = [(got[4 * i] ^ got[4 * i + 4]).bit_count() for i in range(0, 300)]
    assert 25 < sum(strange) / len(strange) < 38


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(18)
    pairs = []
    for i in range(500):
        a = rng.getrandbits(decontamination.BITS)
        b = a
        for bit in rng.sample(range(decontamination.BITS), decontamination.RADIUS):
            b ^= 1 << bit
        pairs.append((i, a, b))
    df = spark.createDataFrame(pairs, "i int, a long, b long").select("i", F.arrays_overlap(decontamination.blocks("a"), decontamination.blocks("b")).alias("met"), F.size(decontamination.blocks("a")).alias("n"))
    assert {(r.met, r.n) for r in df.collect()} == {(True, decontamination.RADIUS + 1)}


# --- 2 substrings

def cut_by_hand(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            if d is not None:
                first[b[p : p + 50]] = min(first.get(b[p : p + 50], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if d is not None and first[b[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return sorted(out, key=str)


def test_substrings(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "été", "x", "ing", "the", "of", "lorem"]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(20)]
    rows = []
    for i in range(150):
        t = rng.choice(base)
        r = rng.random()
        if 0.2 < r < 0.6:
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            t = " ".join(w)
        elif r < 0.8:
            at = rng.randrange(len(t))
            t = f"q{i} " + t[at : at + rng.randint(40, 120)] + f" z{i}"
        elif r < 0.9:
            t = rng.choice(["ab", "a"]) * rng.randint(20, 200)
        rows.append((i if r < 0.98 else None, t))
    rows += ODD + [(2000, "a" * 29_000)]
    out = substrings.dedup(docs_of(spark, rows), keep_text=True, carry=("h",))
    got = sorted([tuple(r)[:5] for r in out.collect()], key=str)
    assert got == cut_by_hand(rows)
    assert all(r.h == "clash" for r in out.collect())
    whole = {(d, hashlib.sha256((t or "").encode()).hexdigest()): t or "" for d, t in rows}
    for r in out.collect():  # what is cut inside a character keeps the character, else `kept` has the bytes of the checksum
        at_most = r.n_removed and (r.doc_id, r.kept_sha256) not in whole
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 or at_most and not r.kept.isascii() and 0 < len(r.kept.encode()) - (r.n_bytes - r.n_removed) <= 6 * r.n_spans
    assert substrings.dedup(docs_of(spark, rows).limit(0)).count() == 0


# --- 3 BPE

def test_equal_keys_are_told_apart_by_their_checks():
    layout, rng = exchange.Layout(1 << 20), np.random.default_rng(6)
    buckets = [(rng.integers(0, 8, 40).astype(np.uint64) << np.uint64(61), rng.integers(0, 3, 40).astype(np.uint32), rng.integers(-5, 1 << 40, 40)) for _ in range(3)]
    messages = [m for b, entries in enumerate(buckets) for m in substrings._send_least(layout, substrings.STRING, b, *entries)]
    answers = [a for r in {m[0] for m in messages} for a in substrings._answer_least(substrings.STRING, sorted(m for m in messages if m[0] == r))]
    least = {}
    for entries in buckets:
        for k, c, d in zip(*entries):
            least[k, c] = min(d, least.get((k, c), d))
    for b, (keys, checks, ids) in enumerate(buckets):
        got = substrings._read_least(sorted(a for a in answers if a[0] == b), substrings.STRING, keys, checks, ids)
        assert got.tolist() == [least[k, c] for k, c in zip(keys, checks)]


def test_bpe_like_the_library(spark):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizers_path("word_bpe_49k.json"))
    rng = random.Random(1)
    alphabet = list("abcdeiou'ÀÉéßΣςİⅣ½٣日😀\t\n\x1c\x85\xa0  .,!?$0129") + ["e\u0301", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<|", "A\u030a", "ΑΣ", "the", "ing"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(1500)] + ["abcab" * 2000, "é" * 300, "a" * 65, "a" * 64]
    rows = [*enumerate(texts), *ODD]
    path = tokenizers_path("word_bpe_49k.json")
    got = {(r.doc_id, r.text): r for r in bpe.decode(bpe.encode(docs_of(spark, rows), path), path).collect()}
    digests = bpe.digest(docs_of(spark, rows), path).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[d, t].ids == ids
        assert got[d, t].decoded == library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r) for r in digests) == sorted(want)
    assert bpe.digest(docs_of(spark, rows).limit(0), path).count() == 0


# --- 4 media

def test_tiff_round_trips():
    rng = np.random.default_rng(1)
    for compression in (media.NONE, media.PACKBITS, media.LZW, media.DEFLATE, media.OLD_DEFLATE):
        for predictor in (1, 2):
            for tile in (None, (16, 32)):
                for high in (2, 4, 256):
                    images = [rng.integers(0, high, (rng.integers(1, 70), rng.integers(1, 70), s), dtype=np.uint8) for s in (1, 3, 1)]
                    read = list(media.pages(media.write_tiff(images, compression, predictor, 20, tile)))
                    assert [p.pixels for p in read] == [i.tobytes() for i in images]
    noise = rng.integers(0, 256, (300, 300), dtype=np.uint8)  # fills the LZW table more than once
    assert next(media.pages(media.write_tiff([noise], media.LZW, 1))).pixels == noise.tobytes()
    for n in (9, 10, 11, 12):  # code widths change around full tables
        for d in range(-3, 4):
            data = bytes(rng.integers(0, 256, (1 << n) - 258 + d if n > 9 else 254 + d, dtype=np.uint8))
            assert media.lzw_decode(media.lzw_encode(data), len(data)) == data


def test_tiff_operator(spark):
    good = media.write_tiff([np.zeros((3, 4), np.uint8), np.ones((2, 2), np.uint8)])
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"no")), (3, None), (4, bytearray(good[:30]))], "doc_id long, media binary")
    got = sorted((r.doc_id, r.page, r.width, bool(r.error)) for r in media.tiff_pages(df).collect())
    assert got == [(1, 0, 4, False), (1, 1, 2, False), (2, -1, None, True), (4, -1, None, True)]
    for r, (d, t) in zip(sorted(media.digest(docs_of(spark, ODD)).collect(), key=lambda r: r.doc_id), sorted(ODD, key=lambda x: x[0])):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


# --- 5 licences

def test_tiff_digest_by_hand(spark):
    """Every stored form, and what is said of it, recomputed from the file that `store` makes; files of several pages among them."""
    rows = ODD + [(i, f"text {i} " * (i % 7 * 40)) for i in range(60)] + [(70, "long " * 40_000), (None, "no id"), (None, None)]
    forms = set()
    got = sorted(((r.doc_id is None, r.doc_id, r.n_bytes), r.media_bytes, r.media_sha256, r.feature) for r in media.digest(docs_of(spark, rows)).collect())
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        data = media.store(payload)
        read = list(media.pages(data))
        assert b"".join(p.pixels for p in read) == payload
        forms.add((read[0].compression, media.TILES in next(media.directories(data))[1]))
        level = list(payload)
        cut = [(len(level) // 17 + 1) * i if i <= len(level) % 17 else len(level) // 17 * i + len(level) % 17 for i in range(18)]
        bands = [sum(level[x:y]) * 4096 // max(y - x, 1) for x, y in zip(cut, cut[1:])]
        sign = sum(1 << i for i in range(16) if bands[i] > bands[i + 1])
        want.append(((d is None, d, len(raw)), len(data), hashlib.sha256(data).hexdigest(), f"pages={-(-len(payload) // 65536)};rows={len(payload) // 64};mean={sum(level) * 100 // len(level)};bands={sign:04x}"))
    assert got == sorted(want) and forms == {(media.LZW, False), (media.PACKBITS, False), (media.DEFLATE, True), (media.DEFLATE, False)}
    assert media.digest(docs_of(spark, rows).limit(0)).count() == 0


def test_tiff_damage_is_an_error_row(spark):
    """Any damaged tag: zero or absent sizes, empty lists, sizes beyond the file; no other file is touched by it."""
    rows, n = [], 0
    for tile in (None, (16, 16)):
        good = media.write_tiff([np.full((20, 20), 7, np.uint8)], media.DEFLATE, 2, 8, tile)
        at = struct.unpack_from("<I", good, 4)[0]
        for k in range(struct.unpack_from("<H", good, at)[0]):
            for field, kind, value in ((4, "<I", 0), (8, "<I", 0), (8, "<I", 0xFFFFFFFF), (0, "<H", 9999), (4, "<I", 0xFFFFFFFF), (8, "<I", 3)):
                bad = bytearray(good)
                struct.pack_into(kind, bad, at + 2 + 12 * k + field, value)
                rows.append((n := n + 1, bad))
        rows.append((0, bytearray(good)))
    got = media.tiff_pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert {r.doc_id for r in got} == {d for d, _ in rows} and all((r.pixels is None) == bool(r.error) for r in got)
    assert [r.pixels for r in got if r.doc_id == 0] == [bytes([7] * 400)] * 2


def test_tiff_pages_after_one_that_cannot_be_read(spark):
    data = bytearray(media.write_tiff([np.full((4, 8), i, np.uint8) for i in range(3)], media.DEFLATE, 2))
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", data, 4)[0]
    at = struct.unpack_from(order + "I", data, at + 2 + 12 * struct.unpack_from(order + "H", data, at)[0])[0]
    here = next(h for h in range(at + 2, len(data), 12) if struct.unpack_from(order + "H", data, h)[0] == media.BITS)
    struct.pack_into(order + "H", data, here + 8, 16)
    rows = spark.createDataFrame([(1, bytes(data))], "doc_id long, media binary")
    got = {r.page: (r.pixels and r.pixels[0], r.error is None) for r in media.tiff_pages(rows).collect()}
    assert got == {0: (0, True), 1: (None, False), 2: (2, True)}


@pytest.mark.parametrize("line, licence", [
    ("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("# SPDX-License-Identifier: GPL-2.0", "GPL-2.0"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("GNU General Public License version 2", "GPL-2.0"), ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"), ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"),
    ("Licensed under the EUPL License.", None), ("Licensed under the Frobnicate License.", None), ("GNU Lesser General Public License version 3", "LGPL-3.0"), ("SPDX-License-Identifier: LGPL-2.1", "LGPL-2.1"), ("GNU Affero General Public License version 3", "AGPL-3.0"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", "CC-BY-NC-SA-4.0"), ("Licensed under the European Union Public Licence, version 1.2.", "EUPL-1.2"),
    ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"), ("SPDX-License-Identifier: Unlicense", "Unlicense"), ("SPDX-License-Identifier: ISC", "ISC"), ("GNU General Public License", None), ("the license of poets", None), ("mit der Lizenz 2.0 und mehr", None), ("", None)])
@pytest.mark.parametrize("files", [0, 5, 1_000_000])
def test_licence_lines(line, licence, files):
    """Whatever the corpus weighs: nothing, a handful of files, or a million in which the words are common or rare."""
    for df in ({}, {t: files // 3 for t in ("the", "license", "licensed", "under", "version", "2.0", "public")}, {t: files // 200 for t in ("gpl", "mit", "bsd", "license", "2.0", "3")}):
        m = licenses.Matcher(licenses.LICENCES, df, files, licenses.LEAST)
        assert m.best(line)[0] == licence and m.scan(f"code\n{line}\nmore code", False)[0] == licence, (line, m.best(line))


def test_every_template_is_its_licences(spark):
    m = licenses.Matcher(licenses.LICENCES, {}, 0, licenses.LEAST)
    for name, x in licenses.LICENCES.items():
        for t in x.templates:
            # Wordings without a version or name of their own may be anyone's; they are never another's.
            assert m.best(t)[0] in (name, None), (t, m.best(t))
        assert any(m.best(t)[0] == name for t in x.templates), name
    gpl2 = "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n" + licenses.LICENCES["GPL-2.0"].templates[-1]
    assert m.scan(gpl2, True)[0] == "GPL-2.0" and m.scan("MIT License\n\nCopyright (c) 2020 A\n\n" + licenses._MIT[1], True)[0] == "MIT"


def licences_by_hand(rows):
    """Cosines over all terms of all lines, rules and inheritance, without shortcuts."""
    count = lambda text: Counter(re.findall(r"cc0|0bsd|[a-z]+|[0-9]+(?:\.[0-9]+)*", text.lower()))
    lines = [(n, count(t)) for n, x in licenses.LICENCES.items() for t in x.templates]
    held, df = Counter(t for _, c in lines for t in c), Counter(t for *_, text in rows for t in count(text or ""))
    idf = lambda t: math.log((1 + len(rows) + 1000) / (1 + df[t] + 1000 * held[t] / len(lines))) + 1 if t in held else math.log(1 + len(rows) + 1000) + 1
    length = lambda c: math.sqrt(sum((n * idf(t)) ** 2 for t, n in c.items()))

    def best(text):
        c, top = count(text), {}
        for n, v in lines:
            x = licenses.LICENCES[n]
            if c and all(set(g) & set(c) for g in x.needs) and not set(x.bars) & set(c):
                top[n] = max(top.get(n, 0), round(min(1.0, sum(c[t] * v[t] * idf(t) ** 2 for t in c) / length(c) / length(v)), 9))
        order = sorted(top.items(), key=lambda x: (-x[1], x[0]))
        return order[0] if order and order[0][1] >= 0.75 and (len(order) < 2 or order[1][1] <= order[0][1] - 0.02) else None

    own, out = {}, []
    for i, (_, path, text) in enumerate(rows):
        is_file = (path or "").rsplit("/", 1)[-1].split(".")[0].upper() in licenses.LICENCE_FILES
        got = best(text or "") if is_file else None
        got = got or max((b for x in (text or "").split("\n") if (b := best(x))), key=lambda b: (b[1], [-ord(c) for c in b[0]]), default=None)
        own[i] = (got, is_file)
    for i, (doc, path, _) in enumerate(rows):
        got, is_file = own[i]
        if got:
            out.append((doc, got[0], "file" if is_file else "header", None))
            continue
        folder = path.rsplit("/", 1)[0] if path and "/" in path else "" if path is not None else None
        up = None
        while folder is not None and up is None:
            there = [(-own[j][0][1], p, own[j][0][0]) for j, (_, p, _) in enumerate(rows) if own[j][1] and own[j][0] and (p.rsplit("/", 1)[0] if "/" in p else "") == folder]
            up = min(there, default=None)
            folder = folder.rsplit("/", 1)[0] if "/" in folder else "" if folder else None
        out.append((doc, up and up[2], up and "inherited", up and up[1]))
    return out


def test_licenses(spark):
    rows = [(1, "r/LICENSE", "Released under the MIT License."), (2, "r/a/b/x.py", "code\nno header"), (3, "r/a/LICENSE.txt", "intro\nLicensed under the Apache License, Version 2.0.\n"), (4, "r/a/b/y.py", "# This work is licensed under the GNU General Public License, version 3.\nz"),
            (5, "q/x", "the license of poets"), (6, None, None), (7, "r/a", "plain"), (8, "LICENSE", "nothing"), (9, "top.txt", "x"), (9, "top.txt", "x"), (10, "r/ab/z", "x")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({"own": F.lit(1), "at": F.lit(2), "folder": F.lit(3)})
    got = {r.doc_id: (r.licence, r.via, r.licence_path) for r in licenses.scan(df).collect()}
    assert got == {1: ("MIT", "file", None), 2: ("Apache-2.0", "inherited", "r/a/LICENSE.txt"), 3: ("Apache-2.0", "file", None), 4: ("GPL-3.0", "header", None), 5: (None, None, None), 6: (None, None, None), 7: ("MIT", "inherited", "r/LICENSE"), 8: (None, None, None), 9: (None, None, None), 10: ("MIT", "inherited", "r/LICENSE")}
    assert licenses.scan(df).count() == len(rows) and licenses.scan(df.limit(0)).count() == 0
    rng = random.Random(33)
    lines = [t for x in licenses.LICENCES.values() for t in x.templates] + ["plain words", "Licensed under", "version 2.0 of the code", "mit 3", "GNU GPL 2 and 3"]
    names = ["LICENSE", "COPYING.md", "a.py", "b.txt", "licence.rst"]
    many = [(i, "/".join([*rng.choices(["p", "q", "s"], k=rng.randint(0, 3)), rng.choice(names)]), "\n".join(" ".join(rng.sample(w := rng.choice(lines).split(), rng.randint(max(1, len(w) - 2), len(w)))) for _ in range(rng.randint(0, 3)))) for i in range(150)]
    found = licenses.scan(spark.createDataFrame(many, "doc_id long, path string, text string"))
    assert sorted(((r.doc_id, r.licence, r.via, r.licence_path) for r in found.collect()), key=str) == sorted(licences_by_hand(many), key=str)


# --- 6 language

def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)


def profile_by_hand(text):
    """Bound, permuted and bundled, letter by letter."""
    import unicodedata

    folded = "".join(c.lower()[0] if unicodedata.category(c)[0] == "L" else " " for c in text)
    padded = re.sub(" +", " ", f" {folded} ")
    vec = lambda c, place: np.roll(np.array([1 if b == "1" else -1 for byte in hashlib.sha512(f"7:{0 if c == ' ' else ord(c)}".encode()).digest() for b in f"{byte:08b}"]), place)
    return sum((vec(a, 0) * vec(b, 1) * vec(c, 2) for a, b, c in zip(padded, padded[1:], padded[2:])), np.zeros(512, np.int64))


def test_language_vectors_by_hand(spark, monkeypatch):
    texts = ["Ab, cd", "ÄÖ über", "Привет мир", "γειά σου κόσμε", "日本語のテキスト", "x", "straße İstanbul"]
    for _ in range(2):
        v = language.Vectors()
        for t in texts * 2:
            assert np.array_equal(v.document(t), profile_by_hand(t)), t
        assert v.document(" .,1") is None and len(language.trigrams("Ab, cd")) == 5
        monkeypatch.setattr(language, "KEPT_VECTORS", 8)  # a small memory changes nothing
        monkeypatch.setattr(language, "KEPT_LETTERS", 6)
        monkeypatch.setattr(language, "BOUND", 3)
    df = docs_of(spark, ODD).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(df).collect()} == {"und"}
    out = language.predict(docs_of(spark, ODD), {"xx": v.document("aaa")})
    assert out.count() == len(ODD) and {r.doc_id: r.lang_pred for r in out.collect()}[901] == "und" and "shard" in out.columns


def test_language_prototypes_by_hand(spark, monkeypatch):
    monkeypatch.setattr(language, "HELD_COUNTS", 40)
    rng = random.Random(3)
    alphabets = {"ru": "абвгдежз", "el": "αβγδεζηθ", "en": "abcdefgh", "ru2": "ийклмноп"}
    rows = [(i, "".join(rng.choices(alphabets[lang] + " ", k=rng.randint(1, 60))), lang) for i, lang in enumerate(rng.choices(list(alphabets), k=160))]
    rows += [(1000, None, "en"), (1001, "abc", None), (1002, "", "en"), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = language.train(df)
    want = {lang: sum((profile_by_hand(t) for _, t, x in rows if x == lang and t), np.zeros(512)) for lang in alphabets}
    assert list(got) == sorted(want) and all(np.array_equal(got[k], v) for k, v in want.items())
    unit = {k: v / np.linalg.norm(v) for k, v in sorted(want.items())}
    for r in language.predict(df, got).collect():
        p = profile_by_hand(r.text or "")
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cos = {k: float(v @ p / np.linalg.norm(p)) for k, v in unit.items()}
        assert cos[r.lang_pred] == pytest.approx(max(cos.values())) and r.score == pytest.approx(min(1, max(0, cos[r.lang_pred])))
    monkeypatch.setattr(language, "LABELS", 2)
    most = sorted(alphabets, key=lambda k: (-sum(x == k for *_, x in rows), k))[:2]
    assert sorted(language.train(df)) == sorted(most)
    assert language.train(df.limit(0)) == {} and language.identify(df.limit(0)).count() == 0


# --- 7 token counts

def best_by_hand(word, scores):
    best = {0: (0.0, 0)}
    for end in range(1, len(word) + 1):
        options = [(-(best[s][0] + scores[word[s:end]]), best[s][1] + 1) for s in range(max(0, end - 64), end) if word[s:end] in scores]
        raw = len(word[end - 1].encode())
        options.append((-(best[end - 1][0] + tokencount.BYTE_SCORE * raw), best[end - 1][1] + raw))
        top = min(options)
        best[end] = (-top[0], top[1])
    return best[len(word)][1]


def test_token_counts(spark):
    path = tokenizers_path("piece_bpe_32k.model")
    scores = tokencount.zipf_scores(tokencount.read_pieces(path))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40)
    rows = [tuple(r) for r in docs.collect()] + ODD
    got = sorted((r.doc_id, r.n_pretokens, r.n_tokens) for r in tokencount.count_tokens(docs_of(spark, rows), path).collect())
    words = {w for _, t in rows for w in (t or "").split()}
    by_hand = {w: best_by_hand(tokencount.MARK + w, scores) for w in words}
    assert got == sorted((d, len((t or "").split()), sum(by_hand[w] for w in (t or "").split())) for d, t in rows)
    assert tokencount.count_tokens(docs_of(spark, rows).limit(0), path).count() == 0


def test_a_shared_prefix_is_scored_once(monkeypatch):
    scores = tokencount.zipf_scores(tokencount.read_pieces(tokenizers_path("piece_bpe_32k.model")))
    rng = random.Random(2)
    words = ["▁" + "".join(rng.choices("abcde", k=rng.randint(1, 9))) for _ in range(3000)] + ["▁", "", "▁日本語", "▁a" * 40]
    trie = tokencount.Trie(scores)
    got = trie.count(words)
    assert got == {w: best_by_hand(w, scores) for w in words}
    assert trie.made == len({w[:i] for w in words for i in range(1, len(w) + 1)})
    assert trie.count(words) == got and trie.made == len(trie.best) - 1
    monkeypatch.setattr(tokencount, "NODES", 50)  # a small trie changes nothing
    assert tokencount.Trie(scores).count(words) == got


# --- 8 sharding

def test_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    heavy = docs.limit(1).select("doc_id", "text").crossJoin(spark.range(900)).select((F.col("id") + 5000).alias("doc_id"), "text")
    for table in (docs.select("doc_id", "text"), docs.select("doc_id", "text").unionByName(heavy), docs_of(spark, ODD)):
        want = {r.doc_id: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in table.collect()}
        got = sharding.shard(table).collect()
        assert len(got) == table.count() and all(want[r.doc_id] == (r.size, r.text_crc32) and r.law == "bytes" and 0 <= r.shard < 8 and r.grown_shard is None for r in got)
        loads, slots = Counter(), {}
        for r in got:
            loads[r.shard] += r.size
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        total, largest = sum(loads.values()), max(r.size for r in got)
        assert max(loads.values()) - min(loads.get(s, 0) for s in range(8)) <= max(0.05 * total / 8, largest)
    assert sharding.shard(docs.limit(0)).count() == 0


def test_shards_keep_copies_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    at = sharding.shard(docs).join(docs.select("doc_id", "text"), "doc_id")
    assert at.groupBy("text").agg(F.count_distinct("shard").alias("n")).filter("n > 1").count() == 0


# --- 9 URLs

@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: (1 << 60) + i % 3])
def test_shards_keep_their_law_on_equal_rows(spark, ids):
    """One heavy text under null, one or few ids, so that only the rows' numbers can subdivide it."""
    rows = [(ids(i), "x" * 999) for i in range(800)] + [(i, f"small {i}") for i in range(50)]
    got = sharding.shard(docs_of(spark, rows)).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 0.05 * sum(sizes.values()) / 8
    assert all(sorted(r.slot for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got))) for k in range(8))
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((d is None, d) for d, _ in rows)


def test_url_rules(spark):
    rows = [(1, "http://A.Example.org/en/7?x"), (2, "https://example.org/en/123"), (3, "http://x.example.org/es/a"), (4, "ftp://b.com/fr/1#t"), (5, "http://b.com/de/"), (6, "http://b.com/de"), (7, "no scheme.org/"), (8, None), (9, ""), (10, "http://org"), (11, "http://myexample.org/es/"), (12, "x://user@host?y"), (12, "x://user@host?y"), (13, "http://cheap-pills.com/q")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"g": F.lit(1), "host": F.lit(2), "path": F.lit(3), "html": F.lit(None).cast("string")})
    got = urls.judge(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.host, r.path, r.rule) for r in got}
    assert by[1] == ("a.example.org", "/en/7", "org/") and by[2][2] == "example.org/en/1" and by[3][2] == "example.org/es/" and by[4] == ("b.com", "/fr/1", "com/fr/") and by[5][2] == "com/de/" and by[6][2] is None
    assert by[7] == by[8] == by[9] == ("", "", None) and by[10] == ("org", "", None) and by[11][2] == "org/" and by[12] == ("user@host", "", None)
    assert all(r.verdict == ("block" if r.rule in ("example.org/es/", "example.org/en/1", "com/de/") else "allow") for r in got if r.rule)
    assert urls.judge(df.limit(0)).count() == 0 and {r.verdict for r in urls.judge(df.filter("page_id = 13")).collect()} == {"allow"}


def test_url_scores_by_hand(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    got = {r.page_id: r for r in urls.judge(table).collect()}
    rows = [(p, u) for p, u in table.collect()]
    counts = {k: [Counter() for _ in range(urls.ORDER + 1)] for k in ("allow", "block")}
    for p, u in rows:
        if got[p].rule:
            padded = "\x02" * urls.ORDER + u
            for i in range(urls.ORDER, len(padded)):
                for k in range(urls.ORDER + 1):
                    counts[got[p].verdict][k][padded[i - k : i + 1]] += 1
    heads = {m: [Counter() for _ in c] for m, c in counts.items()}
    kinds = {m: [Counter() for _ in c] for m, c in counts.items()}
    for m, c in counts.items():
        for k, grams in enumerate(c):
            for g, n in grams.items():
                heads[m][k][g[:k]] += n
                kinds[m][k][g[:k]] += 1

    def chance(m, window):
        p = 1 / urls.ALPHABET
        for k in range(urls.ORDER + 1):
            g = window[urls.ORDER - k :]
            n, t = heads[m][k][g[:k]], kinds[m][k][g[:k]]
            p = (counts[m][k][g] + t * p) / (n + t) if n else p
        return p

    for p, u in rows:
        if not got[p].rule:
            padded = "\x02" * urls.ORDER + u
            ws = [padded[i : i + urls.ORDER + 1] for i in range(len(u))]
            assert got[p].score == pytest.approx(sum(math.log(chance("allow", w) / chance("block", w)) for w in ws) / len(u), abs=1e-9)


# --- 10 Jaccard

def groups_by_hand(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, top = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if a and sets[j] and 100 * o >= 75 * (len(a) + len(sets[j]) - o):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_jaccard(spark):
    rng = random.Random(5)
    vocabulary = [f"W{i}" for i in range(60)]
    base = [rng.choices(vocabulary, k=rng.randint(3, 100)) for _ in range(15)]
    passage = rng.choices(vocabulary, k=40)
    rows = []
    for i in range(220):
        w = list(base[0] if i < 60 else rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.15:
            w[10:10] = passage
        rows.append((i, " ".join(w) if rng.random() < 0.8 else "\n".join(w).lower()))
    rows += ODD
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs_of(spark, rows)).collect())
    assert got == groups_by_hand(rows)
    assert jaccard.join(docs_of(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("leaders, block", [(16, 512), (1, 4), (0, 4)])
def test_jaccard_blocks_lose_no_link(spark, monkeypatch, leaders, block):
    """With few leaders or none, the pairs of blocks must find everything; with them, nothing may be lost."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):  # a chain: neighbours are similar, ends are not
        rows.append((i, " ".join(base[:-1] + [f"x{i}"])))
        base[rng.randrange(55)] = f"n{i}"
    rows += [(100 + i, " ".join([*(f"p{k}" for k in range(30)), *(f"own{i}_{k}" for k in range(6))])) for i in range(30)]  # a passage of unlinked texts
    monkeypatch.setattr(jaccard, "LEADERS", leaders)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs_of(spark, rows)).collect()) == groups_by_hand(rows)


def test_jaccard_parities_bound_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x, y = (rng.choice(600, rng.integers(1, 300), replace=False) for _ in range(2))
        bits = [np.bincount(t & (jaccard.BITS - 1), minlength=jaccard.BITS) & 1 for t in (x, y)]
        assert np.count_nonzero(bits[0] != bits[1]) <= len(set(x) ^ set(y))


def test_packed_keys_come_back():
    rng = np.random.default_rng(4)
    for bits in (20, 38, 64):
        for n in (0, 1, 2, 1000):
            shift = np.uint64(64 - bits)
            keys = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1) >> shift << shift)
            got, rest = exchange.unpack(exchange.pack(keys, bits) + b"rest")
            assert got.tolist() == keys.tolist() and rest == b"rest"


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (60, 60), (51, 50)], "a long, b long")
    got = {r.v: r.comp for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 51: 50}


def test_cuts_keep_whole_characters(spark):
    passage = "".join(f"{i:03d}" for i in range(30))
    rows = [(1, f"{passage}é"), (2, f"{passage}è and more"), (3, f"ḩ{passage[:60]}"), (4, f"new ᨩ{passage[:60]}")]
    got = {r.doc_id: r.kept for r in substrings.dedup(docs_of(spark, rows), keep_text=True).collect()}
    assert got[1] == rows[0][1] and got[2] == "è and more" and got[4] == "new ᨩ"


# --- pipeline

def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    near, cut, clean, last = None, None, None, None
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, sf)
        docs = spark.createDataFrame(out.collect(), out.schema)
        if name == "language ID":
            gone = {d for d, _ in before} - {r.doc_id for r in docs.collect()}
            assert {d for d, t in before if not re.search(r"[^\W\d_]", t or "")} <= gone and len(gone) <= 0.02 * len(before)
        elif name == "n-gram Jaccard join":
            near = sorted(r.doc_id for r in docs.collect())
            assert near == sorted(d for d, _, c in groups_by_hand(before) if d == c)
        elif name == "suffix-array dedup":
            cut = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect())
            by_hand = {(d, s) for d, n, gone, _, s in cut_by_hand(before) if gone < n}
            assert len(cut) == len(by_hand) and sum(x in by_hand for x in cut) >= 0.95 * len(cut)  # cuts inside a character lose its rest
        elif name == "benchmark decontamination":
            clean = {r.doc_id for r in docs.collect()}
            assert clean == {d for d, _ in before} - {d for d, _ in leaks_by_hand(before, items)}
        else:
            last = {r.doc_id for r in docs.collect()}
            assert last == clean
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == last


def test_pipeline_judges_rows_without_an_id(spark, tmp_path):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (None, a), (None, b), (None, c)], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'web' AS source", "0L AS n_chars")
    texts = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    assert texts(corpus_pipeline.drop_near_copies(spark, docs, "")) == Counter([(1, a), (None, b), (None, c)])
    assert texts(corpus_pipeline.drop_repeated_passages(spark, docs, "")) == Counter([(1, a), (None, b), (None, c)])
    spark.createDataFrame([(1, b)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert texts(corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path))) == Counter([(1, a), (None, a), (None, c)])


def test_pipeline_judges_rows_that_repeat_an_id(spark, tmp_path):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c), (3, c + " more"), (3, d), (4, d + " more"), (5, ""), (5, ""), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'web' AS source", "0L AS n_chars")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    c = min(c, c + " more", key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert Counter(got) == Counter([(1, a), (2, b), (3, c), (3, d), (5, ""), (5, ""), (6, None)])
    spark.createDataFrame([(1, b)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path)).collect()]
    assert Counter(got) == Counter(x for x in rows if x != (2, b))
