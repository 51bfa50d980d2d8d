"""Importance resampling against a version by hand; nulls, empty and long texts, equal rows, no documents, no target."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridspark.llm import resampling

DOC = "doc_id long, text string, block string, part int, words string, score double"


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def by_hand(docs, target):
    own = [features(t) for _, t in docs]
    s, t = sum((f for _, f in own), Counter()), sum((features(x)[1] for x in target), Counter())
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for (i, _), (n, f) in zip(docs, own):
        weight = sum(c * math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b, c in f.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7, "clash", 0.5) for i, t in rows], DOC)


def target(spark, texts):
    return spark.createDataFrame([(t, "clash") for t in texts], "text string, sums string")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["ÉTÉ", "日本", "A_b", "x-Y", "İ", "ſ"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 3, 19, 20, 25, 80, 400]))) for _ in range(400)]
    docs = list(enumerate(texts)) + [(1000 + i, texts[3]) for i in range(60)]
    docs += [(2000, None), (2001, ""), (2002, " ,.\n"), (2003, "word " * 90_000), (2004, "z" * 100_000), (7, texts[9]), (7, texts[9]), (None, texts[5]), (None, None), (2005, "😀 éİ ß" * 40)]
    return docs, [" ".join(rng.choices(words[:40], k=30)) for _ in range(12)] + [None, "", "one"]


def test_by_hand(spark, corpus):
    docs, bench = corpus
    got = resampling.resample(table(spark, docs).repartition(5), target(spark, bench))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    want = by_hand(docs, bench)
    assert rows_of(got) == sorted(want, key=str) and sum(r[4] is not None for r in want) > 10


def test_small_blocks_and_pieces_change_nothing(spark, corpus, monkeypatch):
    docs, bench = corpus
    docs = docs[:120] + docs[-10:]
    monkeypatch.setattr(resampling, "PIECE", 7)
    assert resampling.checksums(b"one two,three  four five")[0] == 5
    a, b = resampling.checksums("Ab cd é fg hi".encode()), [zlib.crc32(g.encode()) for g in ("ab", "cd", "é", "fg", "hi", "ab cd", "cd é", "é fg", "fg hi", "ab cd é", "cd é fg", "é fg hi")]
    assert sorted(a[1].tolist()) == sorted(b)
    monkeypatch.setattr(resampling, "BLOCKS_PER_SALT", 1)
    assert rows_of(resampling.resample(table(spark, docs).repartition(9), target(spark, bench))) == sorted(by_hand(docs, bench), key=str)


def test_nothing(spark, corpus):
    docs, bench = corpus
    assert rows_of(resampling.resample(table(spark, docs[:1]).limit(0), target(spark, bench))) == []
    assert rows_of(resampling.resample(table(spark, docs[:50]), target(spark, []))) == sorted(by_hand(docs[:50], []), key=str)
    blank = [(1, None), (2, "")]
    assert rows_of(resampling.resample(table(spark, blank), target(spark, [None]))) == sorted(by_hand(blank, [None]), key=str)


def test_postings_come_back():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5000):
        key = np.unique(rng.integers(0, resampling.WIDTH << 16, n))
        bucket, doc, count = key >> 16, key & 0xFFFF, rng.integers(1, 1 << 30, len(key))
        for a, b in zip(resampling.unpack(resampling.pack(bucket, doc, count)), (bucket, doc, count)):
            assert (a == b).all()
