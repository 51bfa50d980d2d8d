"""Pruned retrieval against scoring every pair, with boosts, ties and few documents; and that it prunes."""

import math
import random
from collections import Counter

import pytest

from gridspark.operators import retrieval


def by_hand(docs, queries, k, boosts=None):
    tf = {d: Counter(t.split()) for d, t in docs}
    df = Counter(t for c in tf.values() for t in c)
    out = []
    for q, text in queries:
        want = Counter(text.split())
        scores = []
        for d, c in tf.items():
            if shared := want.keys() & c.keys():
                s = sum(min(want[t], c[t]) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in shared) / sum(want.values())
                scores.append((-round(s + (boosts or {}).get((q, d), 0.0), 6), d))
        out += [(q, d, -s, r) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    common, rare = [f"c{i}" for i in range(8)], [f"r{i}" for i in range(900)]
    docs = [(i, " ".join([*rng.choices(common, k=25), *rng.choices(rare, k=rng.randint(0, 6))])) for i in range(700)]
    docs += [(1000 + i, docs[i % 9][1]) for i in range(60)]
    queries = [(q, " ".join([*rng.choices(common, k=rng.randint(0, 10)), *rng.choices(rare, k=rng.randint(0, 8))])) for q in range(40)] + [(90, "nothing shared"), (91, ""), (92, " ".join(common)), (93, "r1")]
    return docs, queries


@pytest.mark.parametrize("boosted", [False, True])
def test_like_scoring_all(spark, texts, boosted):
    docs, queries = texts
    rng = random.Random(5)
    boosts = {(q, d): rng.choice([0.3, 1.0, 2.5]) for q, _ in queries for d, _ in rng.sample(docs, 20)} if boosted else None
    d, q = spark.createDataFrame(docs, "doc long, t string"), spark.createDataFrame(queries, "query long, t string")
    given = spark.createDataFrame([(*k, v) for k, v in boosts.items()], "query long, doc long, boost double") if boosted else None
    got = retrieval.search(retrieval.postings(d, "doc", "t"), len(docs), q, "doc", "query", "t", 5, boosts=given)
    assert sorted((r["query"], r.doc, r.score, r["rank"]) for r in got.collect()) == sorted(by_hand(docs, queries, 5, boosts))


def test_common_words_are_left_out(spark, texts):
    docs, queries = texts
    d, q = spark.createDataFrame(docs, "doc long, t string"), spark.createDataFrame(queries, "query long, t string")
    mine = retrieval.postings(d, "doc", "t")
    terms = retrieval._terms(mine, retrieval.postings(q, "query", "t"), len(docs), "query")
    kept, judged = retrieval.candidates(mine, terms, "doc", "query", 5)
    pairs = mine.join(terms, "token").select("query", "doc").distinct().count()
    assert kept.count() < pairs / 2 and not judged.filter("NOT needed").isEmpty()


def test_few_documents(spark):
    docs, queries = [(1, "a b"), (2, "b")], [(1, "a b c"), (2, "z")]
    d, q = spark.createDataFrame(docs, "doc long, t string"), spark.createDataFrame(queries, "query long, t string")
    got = retrieval.search(retrieval.postings(d, "doc", "t"), 2, q, "doc", "query", "t", 5)
    assert sorted((r["query"], r.doc, r.score, r["rank"]) for r in got.collect()) == sorted(by_hand(docs, queries, 5))
    assert retrieval.search(retrieval.postings(d.limit(0), "doc", "t"), 0, q, "doc", "query", "t", 5).count() == 0


def test_only_pairs_near_the_best_are_completed(spark):
    """Bounds come from whole sums: of documents that share common words with a query, few are left."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(30)]
    docs = [(i, " ".join([*rng.choices(common, k=20), f"r{i % 40}"])) for i in range(600)] + [(1000 + i, " ".join([*common, f"r{i % 40}"])) for i in range(200)]
    queries = [(q, " ".join([*common, f"r{q}"])) for q in range(10)]
    d, q = spark.createDataFrame(docs, "doc long, t string"), spark.createDataFrame(queries, "query long, t string")
    mine = retrieval.postings(d, "doc", "t")
    terms = retrieval._terms(mine, retrieval.postings(q, "query", "t"), len(docs), "query")
    assert retrieval.candidates(mine, terms, "doc", "query", 5)[0].count() < 200
    got = retrieval.search(mine, len(docs), q, "doc", "query", "t", 5)
    assert sorted((r["query"], r.doc, r.score, r["rank"]) for r in got.collect()) == sorted(by_hand(docs, queries, 5))
