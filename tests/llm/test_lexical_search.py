import math
import random
import re
from collections import Counter

import pytest

from reviewlake.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(UPPER))


def _plain(docs, items, k):
    """Every item against every document."""
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(_terms(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, c in counts:
            n = sum(c.values())
            m = 10 + (90 * n * n_docs) // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms if c[t]
            )
            if score > 0:
                scored.append((-score, -math.inf if doc is None else doc, doc))
        out += [(item, at + 1, doc, -s) for at, (s, _, doc) in enumerate(sorted(scored, key=lambda x: x[:2])[:k])]
    return sorted(out, key=repr)


def _found(spark, docs, items, **options):
    rows = lexical_search.rank_documents(
        spark.createDataFrame([(i, t, 1.0, "x") for i, t in docs], "doc_id long, text string, norm double, terms string"),
        spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int"), **options)
    return sorted(map(tuple, rows.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    dice = random.Random(3)
    words = [f"w{int(dice.paretovariate(0.6)) % 900}" for _ in range(3000)]
    docs = [(i, " ".join(dice.choices(words, k=dice.choice([1, 3, 20, 60, 400])))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(150)]  # a large group of copies
    items = [(i, " ".join(dice.choices(words, k=dice.choice([1, 5, 30])))) for i in range(25)]
    items += [(90, docs[7][1][:200]), (91, docs[11][1]), (92, "W1 w1, w1! w2")]
    return docs, items


@pytest.mark.parametrize("options", [
    {}, {"bucket_size": 16, "first": 40}, {"bucket_size": 5, "first": 1, "k": 3}, {"block_bytes": 600, "first": 64, "bucket_size": 64},
])
def test_equals_every_item_against_every_document(spark, corpus, options):
    assert _found(spark, *corpus, **options) == _plain(*corpus, options.get("k", 10))


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "!? -"), (4, "Ünï Über x_y"), (4, "Ünï Über x_y"), (None, "ünï x"), (None, "Ünï"),
            (5, "a" * 3_000_000 + " x " + "ünï " * 300_000), (6, "Straße ELANİ")]
    items = [(1, "Ünï x"), (1, "y"), (2, None), (3, "..."), (None, "straße elanİ"), (7, "nowhere"), (8, "a" * 3_000_000)]
    for options in ({}, {"bucket_size": 2, "first": 1}):
        assert _found(spark, docs, items, **options) == _plain(docs, items, 10)
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert lexical_search.rank_documents(none, one).count() == 0
    assert lexical_search.rank_documents(one.withColumnRenamed("item_id", "doc_id"), one.where("false")).count() == 0


def test_bounds_drop_most_documents(spark, corpus):
    """The work is less than every item against every document: survivors are few once thresholds are known."""
    import numpy as np
    import pyarrow as pa

    docs, _ = corpus
    counted = [Counter(int(w[1:]) for w in t.split()) for _, t in docs]
    rows = pa.table({
        "doc_id": pa.array([i for i, _ in docs], pa.int64()), "n": pa.array([sum(c.values()) for c in counted], pa.int64()),
        "terms": pa.array([sorted(c) for c in counted], pa.list_(pa.int32())),
        "tf": pa.array([[c[t] for t in sorted(c)] for c in counted], pa.list_(pa.int32())),
    })
    df = Counter(t for c in counted for t in c)
    weights = np.array([lexical_search.weight(len(docs), df[t]) for t in range(900)], np.int64)
    shared = {"weights": weights, "docs": len(docs), "terms": sum(sum(c.values()) for c in counted)}
    bucket = lexical_search.Bucket(lexical_search.Vectors(rows, shared))
    terms = sorted(counted[11])[:40]
    every, scores = bucket.search(terms, 1)
    least = int(np.sort(scores)[-10])
    few, exact = bucket.search(terms, least)
    assert set(every[scores >= least]) <= set(few) and len(few) < len(every) / 3
    assert dict(zip(few.tolist(), exact.tolist())).items() <= dict(zip(every.tolist(), scores.tolist())).items()
    assert len(bucket.search(terms, int(scores.max()) * 1000)[0]) == 0
