"""Mixing: quotas, the splitting tree and the draws against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quantloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, shard string, `key` string, n long, size string"


def rows_of(n):
    out = []
    for i in range(n):
        text = [None, "", " \n\t", "one", "word " * (i % 40), "x y z　w " * 9, "w " * (3_000 if i == 6 else 11)][i % 7]
        out.append((i if i % 13 else None, text, [None, "", "a", "b", "B", "é", "hot", "hot", "hot"][i % 9], "clash", "k", 5, "s"))
    return out + out[4:7] + out[6:7]


def plain(rows, weights=(5, 2, 1), share=1.5, repeats=2):
    """(doc_id, size, source_size, target, taken) by source axes in hash order."""
    by = defaultdict(list)
    for r in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        key = hashlib.md5(f"{'-' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()
        by[r[2]].append((key, r[0], size))
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(x[2] for x in by[s]) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = share * sum(size.values()), list(names), {}
    while free:
        price = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * price >= repeats * size[s]]
        if not over:
            target |= {s: weight[s] * price for s in free}
            break
        for s in over:
            target[s] = float(repeats * size[s])
            left -= target[s]
            free.remove(s)
    out = []
    for s in names:
        at = 0
        for _, i, n in sorted(by[s], key=lambda x: x[0]):
            out.append((i, n, size[s], round(target[s], 6), sum(n for e in range(repeats) if n and e * size[s] + at + n / 2 < target[s])))
            at += n
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 40, 400])
def test_digest_against_plain(spark, n):
    rows = rows_of(n)
    got = mixing.digest(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want = plain(rows)
    assert sorted([(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in got.collect()], key=str) == want
    taken = defaultdict(int)
    for _, size, source_size, target, t in want:
        assert t <= 2 * size
        taken[source_size, target] += t
    assert len(want) == len(rows)


def test_draws_are_disjoint_blocks_of_exact_quotas(spark):
    rows = [(i, "w " * (i % 30 + 1), f"s{i % 5}" if i % 3 else "hot", "", "", 0, "") for i in range(2_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    a, b = (mixing.draw(docs, block_words=50, shard_blocks=7, run_rows=16) for _ in range(2))
    got = a.draws.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, b.draws.collect()))
    assert len({(r["sidx"], r["key"], r["copy"], r["epoch"]) for r in got}) == len(got)
    places = defaultdict(list)
    for r in got:
        places[r["shard"]].append(r["place"])
    assert len(places) > 50 and all(sorted(p) == list(range(len(p))) for p in places.values())
    sources = {r["sidx"]: r for r in a.sources.collect()}
    assert {s: sum(r["size"] for r in got if r["sidx"] == s) for s in sources} == pytest.approx({s: r["target"] for s, r in sources.items()}, abs=15)
    blocks = mixing.blocks(a.sources, 7).collect()
    assert len(set((r["sidx"], r["block"]) for r in blocks)) == len(blocks)
    assert Counter(r["sidx"] for r in blocks) == {s: r["quota"] for s, r in sources.items()}
    assert all(0 <= r["block"] < sources[r["sidx"]]["quota"] for r in blocks)
    size = Counter(r["shard"] for r in blocks)
    assert set(size.values()) <= {6, 7}  # shards have the same number of blocks, to one


def test_hypergeometric_frequencies(spark):
    from math import comb

    cases = [(20, 7, 9), (10, 10, 4), (10, 0, 4), (50, 3, 50), (1000, 500, 500), (5, 4, 3)]
    for n, c, d in cases:
        draw = mixing.hypergeometric(str(n), str(c), str(d), "u")
        got = Counter(r[0] for r in spark.range(20_000, numPartitions=2).select(((F.col("id") + 0.5) / 20_000).alias("u")).selectExpr(f"{draw} as k").collect())
        for k in range(max(0, c + d - n), min(c, d) + 1):
            assert abs(got.pop(k, 0) / 20_000 - comb(c, k) * comb(n - c, d - k) / comb(n, d)) < 1e-3
        assert not got


def test_tree_is_multivariate_hypergeometric(spark):
    """Counts of a shard over many seeds: mean and variance of draws without replacement."""
    root = spark.createDataFrame([([240, 120, 40],)], "counts array<long>")
    seen = [r["counts"] for seed in range(12) for r in mixing.leaves(root, 40, seed).collect()]
    assert all(sum(c) == 10 for c in seen) and len(seen) == 480
    for i, k in enumerate((240, 120, 40)):
        mean = sum(c[i] for c in seen) / 480
        var = sum((c[i] - mean) ** 2 for c in seen) / 480
        assert mean == k / 40
        assert var == pytest.approx(10 * k / 400 * (1 - k / 400) * 390 / 399, rel=0.3)


def test_mixed_rows_keep_their_columns(spark):
    rows = rows_of(200)
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("key", "place")
    out = mixing.mix(docs, block_words=64, shard_blocks=8)
    assert out.columns == ["doc_id", "text", "source", "n", "size", "shard", "place"]
    taken = Counter()
    for r in out.collect():
        taken[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    want = Counter()
    for doc_id, *_, t in plain(rows):
        want[doc_id] += t
    assert +taken == +want


def test_empty_tables(spark):
    for rows in ([], [(1, None, "a", "", "", 0, ""), (None, "", None, "", "", 0, "")]):
        docs = spark.createDataFrame(rows, SCHEMA)
        assert [tuple(r) for r in mixing.digest(docs).orderBy("doc_id").collect()] == sorted([(r[0], 0, 0, 0.0, 0) for r in rows], key=lambda x: (x[0] is not None, x[0]))
        assert mixing.mix(docs).count() == 0
    with pytest.raises(ValueError, match="share"):
        mixing.draw(docs, share=3)
