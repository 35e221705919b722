"""The Merkle manifest against hashlib."""

import hashlib
import zlib

import numpy as np
import pytest

from quantloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, tree long, leaf string, `by` string, digest string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, plus=0):
    n = None if r[4] is None else r[4] + plus
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], n, r[1])])


def grow(nodes, k, paths):
    """Root of nodes [(digest, members)]; paths: member -> list of (slot, run)."""
    while len(nodes) > 1:
        up = []
        for i in range(0, len(nodes), k):
            run = nodes[i : i + k]
            for slot, (_, members) in enumerate(run):
                for m in members:
                    paths[m].append((slot, [d for d, _ in run]))
            up.append((sha(*[d for d, _ in run]), [m for _, ms in run for m in ms]))
        nodes = up
    return nodes[0][0]


def brute(rows, k):
    paths = {i: [] for i in range(len(rows))}
    leaves = [leaf(r) for r in rows]
    first = lambda x: (x is not None, x if x is not None else 0)
    tops, sub = [], {}
    for lang in sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted((i for i in range(len(rows)) if rows[i][2] == lang), key=lambda i: (first(rows[i][0]), leaves[i]))
        root = grow([(leaves[i], [i]) for i in own], k, paths)
        sub |= dict.fromkeys(own, root)
        tops.append((root, own))
    root = grow(tops, k, paths)
    out = []
    for i, r in enumerate(rows):
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        now = leaf(r, int(hit))
        for slot, run in paths[i]:
            now = sha(*run[:slot], now, *run[slot + 1 :])
        proof = "".join(d for slot, run in paths[i] for j, d in enumerate(run) if j != slot)
        out.append((r[0], leaves[i], sub[i], root, sha(proof), now, now == root))
    return sorted(out, key=str)


def rows_of(n, langs):
    out = []
    for i in range(n):
        text = [None, "", "é🙂 " * (i % 5), "x" * 200_000 if i == 7 else f"text {i}"][i % 4]
        out.append((i * 3 % 101 if i % 9 else None, text, langs[i * i % len(langs)], None if i % 6 == 0 else f"s{i % 3}", None if i % 5 == 0 else i, "a", 1, "b", "c", "d"))
    return out + out[:3]


@pytest.mark.parametrize(("n", "langs", "fanout", "levels"), [(150, [None, "de", "en", "en", "en", "", "é"], 2, 2), (40, ["en"], 3, 1), (1, ["en"], 2, 11), (90, ["de", "en"], 2, 11)])
def test_manifest_against_hashlib(spark, monkeypatch, n, langs, fanout, levels):
    rows = rows_of(n, langs)
    monkeypatch.setattr(merkle.build, "__defaults__", (*merkle.build.__defaults__[:-2], fanout, levels))
    got = merkle.digest(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, fanout)


def test_empty_table(spark):
    out = merkle.digest(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.count() == 0


def test_compression_is_sha256():
    text = np.arange(24, dtype=np.uint32).reshape(3, 8) * np.uint32(0x9E3779B1)
    one = merkle.finish(merkle.compress(np.tile(merkle.INITIAL, (3, 1)), merkle.hex_block(text)), np.ones(3, int))
    assert [merkle.raw(d).hex() for d in one] == [hashlib.sha256(merkle.raw(d).hex().encode()).hexdigest() for d in text]


def test_folding_reads_no_left_sibling():
    leaves = np.arange(40, dtype=np.uint32).reshape(5, 8)
    nodes, states = merkle.subtree(leaves, 1, 5)
    new = leaves[3:4] + np.uint32(1)
    run = leaves[None].copy()
    run[0, :4] = 12345  # what lies left, and the old child, play no part
    got = merkle.fold(new, np.array([3]), states[0][[0], [3]], np.array([5]), run)
    want = hashlib.sha256("".join(merkle.raw(d).hex() for d in [*leaves[:3], new[0], leaves[4]]).encode()).hexdigest()
    assert merkle.raw(got[0]).hex() == want and len(nodes[1]) == 1
