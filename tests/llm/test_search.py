"""Ball-tree search against scores of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quantloom.llm import search

SCHEMA = "doc_id long, text string, n long, qid long, score long, t string, item_id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, top):
    words = [(d, Counter(terms(t))) for d, t in docs]
    words = [(d, c, sum(c.values())) for d, c in words if c]
    n_docs, total = len(words), sum(n for *_, n in words)
    df = Counter(t for _, c, _ in words for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in words:
            m = 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        scored.sort(key=lambda x: x[:3])
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(scored[:top])]
    return sorted(out, key=str)


def texts(n, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)] + ["Élan", "ſK", "中文", "CAPS", "a1"]
    out = []
    for i in range(n):
        base = vocab[:100] if i % 2 else vocab[100:]
        out.append(" ".join(rng.choices(base, weights=[1 / (j + 1) for j in range(len(base))], k=rng.randint(1, 60))))
    return out


@pytest.mark.parametrize(("block_docs", "leaf_docs", "item_bytes", "parts"), [(4096, 32, 1 << 24, 3), (40, 3, 400, 2), (7, 1, 1 << 24, 1)])
def test_search_against_all_pairs(spark, block_docs, leaf_docs, item_bytes, parts):
    own = texts(150)
    docs = [(i if i % 20 else None, t) for i, t in enumerate(own)] + [(500, None), (501, ""), (502, "?! --"), (503, "w1-W2,w3 " * 9_000), *[(600 + i, own[4]) for i in range(90)], (600, own[4])]
    items = [("a", own[4]), ("b", own[9].upper()), ("c", None), ("d", "..."), ("e", "unknown"), ("f", "w1 w1 w2"), ("g", "élan Élan"), ("a", own[31]), *[(f"x{i}", t) for i, t in enumerate(texts(12, 9))]]
    d = spark.createDataFrame([(i, t, 1, 2, 3, "z", "clash") for i, t in docs], SCHEMA).repartition(parts)
    q = spark.createDataFrame([(t, i, 7) for i, t in items], "text string, item_id string, doc_id long")
    got = search.search(d, q, 20, block_docs=block_docs, leaf_docs=leaf_docs, item_bytes=item_bytes)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(docs, items, 20)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([("i", "a")], "item_id string, text string")
    for docs, items in ((d.limit(0), q), (d, q.limit(0)), (d.limit(0), q.limit(0)), (d, q.selectExpr("item_id", "cast(null as string) as text"))):
        out = search.search(docs, items)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0
    assert search.digest(d, q).dtypes == [("item_id", "string"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_bounds_hold_and_prune():
    """Two groups of near copies over disjoint terms: no score over a bound, and most leaves stay shut."""
    rng = np.random.default_rng(1)
    lengths, columns, impacts = [], [], []
    for i in range(512):
        base = (np.arange(30) + 40 * (i % 8)).astype(np.int64)
        own = np.sort(rng.choice(base, 28, replace=False))
        lengths.append(len(own))
        columns.append(own)
        impacts.append(rng.integers(400_000, 410_000, len(own)))
    weights = rng.integers(1, 7_000, 400)
    tree = search.BallTree(np.array(lengths), np.concatenate(columns), np.concatenate(impacts), weights, 8)
    assert sorted(tree.order.tolist()) == list(range(512))
    terms = np.arange(5, 17)
    table = np.zeros(400, np.int64)
    table[terms] = weights[terms]
    exact = np.array([int((i * table[c]).sum()) for c, i in zip(columns, impacts, strict=True)])
    found = np.searchsorted(tree.vocabulary, terms)
    for node, (s, e, *_) in enumerate(tree.nodes):
        assert exact[tree.order[s:e]].max() <= tree.bound(node, found, np.sqrt(weights[terms]))
    docs, scores, opened = tree.search(terms, weights[terms], 1, np.arange(512), 10)
    want = np.lexsort((np.arange(512), -exact))[:10]
    assert sorted(docs.tolist()) == sorted(want.tolist()) and sorted(scores.tolist()) == sorted(exact[want].tolist())
    assert opened <= 24  # of 64 leaves; the documents of one group in eight score
