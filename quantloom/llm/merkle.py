"""Merkle manifest of a table, with SHA-256 midstates retained in every parent.

Leaves hash whole rows; leaves of a partition (by default lang) stand in the order of
their ids and form a tree, the trees' roots form one more. Digests enter a parent as hex
text of 64 bytes, which is exactly one block of SHA-256: the state of the hash before each
child slot is the chaining value after the blocks before it. Parents keep a copy of all
these states, so a replaced child is folded upwards by resuming the state before its slot
with the new digest and the siblings to its right only; nothing to the left is hashed again.

hashlib can copy a state but not store it, so the compression function is here in numpy,
over all nodes of a level at once, and states are bytes in the manifest.

A tree is built by tiers: ``LEVELS`` levels of a run of FANOUT ** LEVELS consecutive nodes
are one chunk, a row of the manifest, and the chunks' roots are the nodes of the next tier.
A task holds one chunk at a time, whatever a partition's share of the rows. Downwards, every
chunk gets the path from its root to the root of all, a few KB, and folds all its leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm._common import discard, global_rank, materialize, small_side

FANOUT = 2
#: Levels of a chunk: it holds FANOUT ** LEVELS nodes at most.
LEVELS = 11
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 7


def _primes(n: int) -> list[int]:
    out: list[int] = []
    x = 2
    while len(out) < n:
        if all(x % p for p in out):
            out.append(x)
        x += 1
    return out


def _cube_root(n: int) -> int:
    x = 1 << (n.bit_length() // 3 + 1)
    while (y := (2 * x + n // (x * x)) // 3) < x:
        x = y
    return x


#: The 32 bits after the point of the square roots of 8 primes and of the cube roots of 64 (FIPS 180-4).
INITIAL = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _primes(64)]
#: 16 bits as four hex digits, read as one big-endian number.
HEX16 = np.frombuffer("".join(f"{i:04x}" for i in range(1 << 16)).encode(), ">u4").astype(np.uint32)


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (n, 8) after one block (n, 16) each, all uint32."""
    w = [block[:, i] for i in range(16)]
    a, b, c, d, e, f, g, h = (state[:, i] for i in range(8))
    for t in range(64):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            w.append(w[t - 16] + (_rotated(x, 7) ^ _rotated(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_rotated(y, 17) ^ _rotated(y, 19) ^ (y >> np.uint32(10))))
        one = h + (_rotated(e, 6) ^ _rotated(e, 11) ^ _rotated(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + w[t]
        two = (_rotated(a, 2) ^ _rotated(a, 13) ^ _rotated(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack((a, b, c, d, e, f, g, h), axis=1)


def hex_block(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 8) as the blocks (n, 16) of their hex text."""
    out = np.empty((len(digests), 16), np.uint32)
    out[:, 0::2], out[:, 1::2] = HEX16[digests >> np.uint32(16)], HEX16[digests & np.uint32(0xFFFF)]
    return out


def finish(state: np.ndarray, kids: np.ndarray) -> np.ndarray:
    """Digests of messages of kids[i] whole blocks that led to state[i]."""
    last = np.zeros((len(state), 16), np.uint32)
    last[:, 0], last[:, 15] = 1 << 31, kids * 512
    return compress(state, last)


def words(raw: bytes) -> np.ndarray:
    """Digests or states as uint32 (n, 8) from their bytes."""
    return np.frombuffer(raw, ">u4").astype(np.uint32).reshape(-1, 8)


def raw(digests: np.ndarray) -> bytes:
    return digests.astype(">u4").tobytes()


def parents(digests: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """The parents of consecutive nodes, and (n, fanout, 8): the state of each before each child slot that it has."""
    n = -(-len(digests) // fanout)
    kids = np.full(n, fanout)
    kids[-1] = len(digests) - (n - 1) * fanout
    states, now, blocks = np.zeros((n, fanout, 8), np.uint32), np.tile(INITIAL, (n, 1)), hex_block(digests)
    for slot in range(fanout):
        own = n if kids[-1] > slot else n - 1
        states[:own, slot] = now[:own]
        now[:own] = compress(now[:own], blocks[slot::fanout])
    return finish(now, kids), states


def subtree(leaves: np.ndarray, levels: int, fanout: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Nodes by level, the leaves first, and the parents' states by level from the first on."""
    nodes, states = [leaves], []
    for _ in range(levels):
        up, kept = parents(nodes[-1], fanout)
        nodes.append(up)
        states.append(kept)
    return nodes, states


def depth(n: int, most: int, fanout: int) -> int:
    """Levels that a chunk of a tier of n nodes has: until one node is left, `most` at most."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // fanout), levels + 1
    return levels


def fold(digests: np.ndarray, slots: np.ndarray, states: np.ndarray, kids: np.ndarray, siblings: np.ndarray) -> np.ndarray:
    """Parents of replaced children: the state before each slot goes on with the new digest and what lies to its right.

    states (n, 8) belongs to the slots; siblings (n, fanout, 8) holds the run, of which only what is right of the slot is read.
    """
    now = compress(states, hex_block(digests))
    for slot in range(1, siblings.shape[1]):
        right = np.flatnonzero((slots < slot) & (slot < kids))
        if len(right):
            now[right] = compress(now[right], hex_block(siblings[right, slot]))
    return finish(now, kids)


def _runs(nodes: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes by run (n, fanout, 8), with zeros after the end, and how many each run has."""
    n = -(-len(nodes) // fanout)
    out = np.zeros((n * fanout, 8), np.uint32)
    out[: len(nodes)] = nodes
    kids = np.full(n, fanout)
    kids[-1] = len(nodes) - (n - 1) * fanout
    return out.reshape(n, fanout, 8), kids


def _path(nodes: Sequence[np.ndarray], states: Sequence[np.ndarray], i: int, fanout: int) -> bytes:
    """The path of node i to the root of its chunk: for each level slot, children, the state before the slot, and the siblings."""
    out = []
    for level, kept in zip(nodes, states, strict=False):
        parent, slot = divmod(i, fanout)
        run = level[parent * fanout : (parent + 1) * fanout]
        out += [bytes((slot, len(run))), raw(kept[parent, slot]), raw(np.delete(run, slot, axis=0))]
        i = parent
    return b"".join(out)


def _steps(path: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(slot, children, state, siblings) of each level of a path."""
    at = 0
    while at < len(path):
        slot, kids = path[at], path[at + 1]
        end = at + 34 + 32 * (kids - 1)
        yield slot, kids, words(path[at + 2 : at + 34])[0], words(path[at + 34 : end])
        at = end


def field(value: Column) -> Column:
    """A value in a leaf: '-' for null, else its UTF-8 byte count, ':' and itself."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    """The leaf of a row, as hex text."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


@dataclass(frozen=True)
class Manifest:
    """tiers of the partitions' trees and of the tree of their roots, from the leaves up; subroots by tree; the root.

    A tier has a row for each chunk: tree, chunk, n (nodes in its whole tier), root, digests
    (all levels), states (all parents' slots), and in the first one ids, leaves and what replaces them.
    """

    tiers: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: str | None
    fanout: int
    levels: int


def _chunk(keep: tuple[str, ...], fanout: int, levels: int) -> Callable[[pa.Table], pa.Table]:
    """The function that makes a chunk's row of the manifest from its nodes."""

    def made(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        n = group.column("n")[0].as_py()
        nodes, states = subtree(words(b"".join(group.column("digest").to_pylist())), depth(n, levels, fanout), fanout)
        numbers = {"tree": group.column("tree")[0].as_py(), "chunk": group.column("idx")[0].as_py() // fanout**levels, "n": n}
        blobs = {"root": raw(nodes[-1]), "digests": b"".join(map(raw, nodes)), "states": b"".join(map(raw, states))}
        arrays = [*[pa.array([v], pa.int64()) for v in numbers.values()], *[pa.array([v], pa.binary()) for v in blobs.values()]]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(group)], pa.int32()), group.column(c).combine_chunks()) for c in keep]
        return pa.Table.from_arrays(arrays + lists, [*numbers, *blobs, *keep])

    return made


def _build(nodes: DataFrame, fanout: int, levels: int, label: str, keep: Sequence[str] = ()) -> list[DataFrame]:
    """Tiers over nodes (tree, idx, digest, n); columns in keep stay as lists in the first."""
    size, out = fanout**levels, []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most:
        kinds = {f.name: f.dataType for f in nodes.schema.fields}
        schema = T.StructType([T.StructField("tree", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("n", T.LongType()), *[T.StructField(x, T.BinaryType()) for x in ("root", "digests", "states")], *[T.StructField(c, T.ArrayType(kinds[c])) for c in keep]])
        tier = nodes.withColumn("chunk", F.floor(F.col("idx") / size)).groupBy("tree", "chunk").applyInArrow(_chunk(tuple(keep), fanout, levels), schema)
        out.append(materialize(tier, f"{label}{len(out)}"))
        if most <= size:
            break
        most, keep = -(-most // size), ()
        nodes = out[-1].where(F.col("n") > size).select("tree", F.col("chunk").alias("idx"), F.col("root").alias("digest"), F.ceil(F.col("n") / size).cast("long").alias("n"))
    return out


def build(docs: DataFrame, columns: Sequence[str] = COLUMNS, by: str = "lang", order: str = "doc_id", replaced: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> Manifest:
    """The manifest of docs: a leaf for each row over `columns`, a tree for each value of `by`.

    Leaves of a tree ascend by `order` (null first), then by digest, so repeated rows are
    leaves of their own and the roots don't depend on how rows come. `replaced` has other
    values of columns: the leaves that they give are kept beside, for audits(). Trees stand by
    their value, null first. Null, empty and very long values are hashed as field() says;
    other columns play no part, whatever their names. An empty table has no root.
    """
    if not 2 <= fanout <= 255:
        raise ValueError("fanout must lie in [2, 255]")
    own = {c: F.col(f"`{c}`") for c in columns}
    rows = docs.select(F.col(f"`{by}`").alias("by"), F.col(f"`{order}`").alias("id"), leaf_digest(list(own.values())).alias("leaf"), *own.values())
    changed = F.col("leaf") if replaced is None else F.lit(False)
    if replaced is not None:
        differs = [~own[c].eqNullSafe(v) for c, v in replaced.items()]
        changed = F.when(F.greatest(*differs, F.lit(False)), leaf_digest(list((own | replaced).values()))).otherwise(F.col("leaf"))
    leaves = materialize(rows.select("by", "id", F.unhex("leaf").alias("digest"), F.unhex(changed).alias("forged")), "leaves")
    ranked = global_rank(leaves, [F.col("by").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest")], "ordered")
    discard(leaves)
    # One row for each value of `by`.
    trees = ranked.groupBy("by").agg(F.min("_rank").alias("first"), F.count("*").alias("n")).withColumn("tree", F.row_number().over(Window.orderBy(F.col("by").asc_nulls_first())).cast("long") - 1)
    trees = materialize(trees, "trees")
    placed = ranked.withColumnRenamed("by", "_by").join(small_side(trees), F.col("_by").eqNullSafe(F.col("by")))
    nodes = placed.select("tree", (F.col("_rank") - F.col("first")).alias("idx"), "digest", "n", "id", "forged")
    tiers = _build(nodes, fanout, levels, "tier", ["id", "forged"])
    discard(ranked)
    size = fanout**levels
    done = [t.where(F.col("n") <= size).select("tree", F.col("root").alias("digest")) for t in tiers]
    if not done:
        return Manifest([], [], leaves.sparkSession.createDataFrame([], "tree long, subroot binary"), None, fanout, levels)
    subroots = done[0]
    for more in done[1:]:
        subroots = subroots.unionByName(more)
    n = trees.count()
    top = _build(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest", F.lit(n).cast("long").alias("n")), fanout, levels, "top")
    root = top[-1].select(F.lower(F.hex("root"))).first()[0]
    return Manifest(tiers, top, subroots.select("tree", F.col("digest").alias("subroot")), root, fanout, levels)


def _levels_of(digests: bytes, states: bytes, n: int, fanout: int, levels: int, size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The levels of a chunk from its row."""
    every, kept, nodes, out = words(digests), words(states), [], []
    m, at, before = size, 0, 0
    for level in range(levels + 1):
        nodes.append(every[at : at + m])
        at += m
        if level < levels:
            up = -(-m // fanout)
            out.append(kept[before : before + up * fanout].reshape(up, fanout, 8))
            before += up * fanout
            m = up
    return nodes, out


def _length(digests: bytes, levels: int, fanout: int, most: int) -> int:
    """How many nodes the lowest of the levels has: their numbers add up to the digests that there are."""
    total = len(digests) // 32
    lo, hi = 1, most
    while lo < hi:
        mid, m, s = (lo + hi) // 2, (lo + hi) // 2, (lo + hi) // 2
        for _ in range(levels):
            m = -(-m // fanout)
            s += m
        lo, hi = (mid + 1, hi) if s < total else (lo, mid)
    return lo


def _opened(row: dict, fanout: int, levels: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    own = depth(row["n"], levels, fanout)
    return _levels_of(row["digests"], row["states"], row["n"], fanout, own, _length(row["digests"], own, fanout, fanout**levels))


def _descend(tier: DataFrame, above: DataFrame | None, fanout: int, levels: int) -> DataFrame:
    """(tree, chunk, path) for the nodes of a tier: their paths in their chunk, then what lies above it (tree, chunk, path)."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes, states = _opened(row, fanout, levels)
                first, rest, m = row["chunk"] * fanout**levels, row["path"], len(nodes[0])
                columns = [[row["tree"]] * m, list(range(first, first + m)), [_path(nodes, states, i, fanout) + rest for i in range(m)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["tree", "chunk", "path"])

    rows = tier.select("tree", "chunk", "n", "digests", "states")
    rows = rows.withColumn("path", F.lit(b"")) if above is None else rows.join(above, ["tree", "chunk"])
    return rows.mapInArrow(paths, "tree long, chunk long, path binary")


def _above(manifest: Manifest) -> DataFrame:
    """(tree, chunk, path, subroot) of every chunk of leaves: its path up to the root of all."""
    fanout, levels = manifest.fanout, manifest.levels
    size, over = fanout**levels, None
    for tier in reversed(manifest.top):
        over = materialize(_descend(tier, over, fanout, levels).select(F.lit(0).cast("long").alias("tree"), "chunk", "path"), "paths")
    ends = over.select(F.col("chunk").alias("tree"), "path").join(manifest.subroots, "tree")
    below = None
    for tier in reversed(manifest.tiers):
        # Trees that end in this tier hang on the tree of roots.
        here = tier.where(F.col("n") <= size).select("tree", "chunk").join(ends.select("tree", "path"), "tree").select("tree", "chunk", "path")
        here = here if below is None else here.unionByName(below)
        if tier is not manifest.tiers[0]:
            below = materialize(_descend(tier, here, fanout, levels), "paths")
    return here.join(manifest.subroots, "tree")


def audits(manifest: Manifest, order: str = "doc_id") -> DataFrame:
    """(order, leaf, subroot, root, proof, proof_sha256, folded_root, verified), a row for each leaf.

    proof: the siblings' hex digests from the leaf to the root, left to right in each run.
    folded_root: what the replaced leaf (else the leaf) gives with the states and right
    siblings kept in the parents on its path; verified: it is the root.
    """
    fanout, levels, root = manifest.fanout, manifest.levels, manifest.root

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for i, row in enumerate(batch.drop_columns(["id"]).to_pylist()):
                nodes, states = _opened(row, fanout, levels)
                m = len(nodes[0])
                at, now, proofs = np.arange(m), words(b"".join(row["forged"])), [[] for _ in range(m)]
                for level, kept in zip(nodes, states, strict=False):
                    runs, kids = _runs(level, fanout)
                    up, slots = at // fanout, at % fanout
                    text = [raw(d).hex() for d in level]
                    for out, parent, own in zip(proofs, up.tolist(), at.tolist(), strict=True):
                        out += [text[x] for x in range(parent * fanout, min((parent + 1) * fanout, len(level))) if x != own]
                    now = fold(now, slots, kept[up, slots], kids[up], runs[up])
                    at = up
                rest = []
                for slot, n, state, siblings in _steps(row["path"]):
                    rest += [raw(d).hex() for d in siblings]
                    run = np.insert(siblings, slot, 0, axis=0)
                    now = fold(now, np.full(m, slot), np.tile(state, (m, 1)), np.full(m, n), np.broadcast_to(run, (m, *run.shape)))
                shared, folded = "".join(rest), [raw(d).hex() for d in now]
                proofs = ["".join(out) + shared for out in proofs]
                columns = [[raw(d).hex() for d in nodes[0]], [row["subroot"].hex()] * m, [root] * m, proofs, [hashlib.sha256(p.encode()).hexdigest() for p in proofs], folded]
                arrays = [ids.slice(i, 1).flatten(), *[pa.array(c, pa.string()) for c in columns], pa.array([f == root for f in folded])]
                yield pa.RecordBatch.from_arrays(arrays, [order, "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"])

    texts = "leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string, verified boolean"
    if not manifest.tiers:
        return manifest.subroots.sparkSession.createDataFrame([], f"`{order}` long, {texts}")
    kind = manifest.tiers[0].schema["id"].dataType.elementType
    rows = manifest.tiers[0].join(_above(manifest), ["tree", "chunk"]).select("n", "digests", "states", "id", "forged", "path", "subroot")
    return rows.mapInArrow(check, f"`{order}` {kind.simpleString()}, {texts}")


def digest(docs: DataFrame) -> DataFrame:
    """Every row audited after one has been added to n_chars where TAMPERED divides the CRC-32 of the id."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    forged = F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    return audits(build(docs, replaced={"n_chars": forged})).drop("proof")


#: The same as digest() for DuckDB; CRC-32 goes by bits, as DuckDB has no function for it.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, n_chars,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
         coalesce(strlen(text) || ':' || text, '-') AS z,
         list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda x, y: list_reduce(list_prepend(xor(x, y), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda u, v: xor(u >> 1, (u & 1) * 3988292384))) AS crc
  FROM documents
), e AS (
  SELECT rid, doc_id, lang, sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || z) AS leaf,
         sha256(a || coalesce(strlen(CAST(n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR)) || ':' || (n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END), '-') || z) AS forged
  FROM d
), l AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM e
), t AS (
  SELECT tree, 0 AS level, idx, leaf AS digest, n FROM l
  UNION ALL
  SELECT tree, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY tree, level, idx // 2, n
), s AS (SELECT tree, level AS height, digest AS subroot FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, tree AS idx, subroot AS digest, (SELECT count(*) FROM s) AS n FROM s
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, idx // 2, n
), r AS (SELECT level AS height, digest AS root FROM u WHERE n = 1),
p AS (
  SELECT rid, q.level, l.idx >> q.level AS at, t.digest AS sibling FROM l JOIN s USING (tree) JOIN (SELECT DISTINCT level FROM t) q ON q.level < s.height LEFT JOIN t ON t.tree = l.tree AND t.level = q.level AND t.idx = xor(l.idx >> q.level, 1)
  UNION ALL
  SELECT rid, s.height + q.level, l.tree >> q.level, u.digest FROM l JOIN s USING (tree) JOIN (SELECT DISTINCT level FROM u) q ON q.level < (SELECT height FROM r) LEFT JOIN u ON u.level = q.level AND u.idx = xor(l.tree >> q.level, 1)
), f AS (
  SELECT rid, 0 AS level, forged AS digest FROM l
  UNION ALL
  SELECT f.rid, f.level + 1, sha256(CASE WHEN p.at % 2 = 0 THEN f.digest || coalesce(sibling, '') ELSE coalesce(sibling, '') || f.digest END) FROM f JOIN p ON p.rid = f.rid AND p.level = f.level
), g AS (SELECT rid, arg_max(digest, level) AS folded_root FROM f GROUP BY rid),
k AS (SELECT rid, string_agg(sibling, '' ORDER BY level) AS proof FROM p GROUP BY rid)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN s USING (tree) CROSS JOIN r LEFT JOIN k USING (rid) JOIN g USING (rid)
"""
