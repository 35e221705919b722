"""SimHash near-duplicates with pivot distance tables.

Fingerprints of 64 bits come from word 3-shingles. Only distinct fingerprints are
compared, so exact copies cost nothing. Every distinct fingerprint gets its row of the
pivot table once: the Hamming distances to REFERENCES random reference fingerprints, 16
bytes. By the triangle inequality two fingerprints within RADIUS bits differ by RADIUS at
most in every coordinate, so a larger coordinate difference discards a pair before its
bits are compared; survivors are verified bit by bit.

The pivot table discards pairs, but it can't propose them at this scale: one coordinate
test keeps about half of all pairs, and a grid over k coordinates needs about 2.5^k copies
of a row for 2k bits of key. So which pairs meet at all is decided by bit blocks, a method of its own: the 64 bits
are cut into six blocks, of which three at least agree when three bits differ, and a cell
holds the fingerprints that are equal in three given blocks (20 cells for each).

Inside a cell links are found as a search tree: from each fingerprint to those not reached
yet, so a cell emits fewer links than it has members. A cell over ``CHUNK`` members is
dealt again on the bits that it leaves open, 20 finer cells for each member; after
three such steps nine bits at most are open, so a cell has 512 members at most.
Nothing is capped, no task holds a hot cell and a hot group costs a fixed number of copies
of each member. Links become components by alternating large-star and small-star steps on
tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm._common import discard, materialize, numbered, restored

RADIUS = 3
SHINGLE = 3
SEED = 42
REFERENCES, POSITIONS = 16, 64
#: Members that are searched as one group; a larger cell is dealt again.
CHUNK = 4096
#: Blocks that bits are cut into, how many of them a cell fixes, and how often cells can be dealt again.
BLOCKS, FIXED, LEVELS = 6, 3, 3


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text, as a signed integer; zero without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    last = ends[SHINGLE - 1 :] or ends[-1:]
    ones, total = np.zeros(64, np.int64), len(last)
    for at in range(0, total, 1 << 16):  # bounded memory for texts of any length
        h = np.array([xxh64_intdigest(joined[s : e - 1], SEED) for s, e in zip(starts[at : at + (1 << 16)], last[at : at + (1 << 16)], strict=False)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", column: str = "fp") -> DataFrame:
    """docs with a long column of fingerprints; rows and other columns stay as they are."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return docs.withColumn(column, simhash(F.col(f"`{text}`")))


def references() -> np.ndarray:
    """The reference fingerprints: random ones, of which each coordinate is independent of the others."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, REFERENCES, dtype=np.uint64)


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference, one row for a fingerprint."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :])


def with_pivots(fps: DataFrame) -> DataFrame:
    """fps with its row of the pivot table as binary `pivots`, a byte for each reference."""

    @F.pandas_udf("binary")
    def distances(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        refs = references()
        for fp in batches:
            table = np.ascontiguousarray(pivot_table(fp.to_numpy().view(np.uint64), refs))
            yield pd.Series([row.tobytes() for row in table], dtype=object)

    return fps.withColumn("pivots", distances("fp"))


def linked(fps: np.ndarray, table: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links that join all fingerprints within `radius` of each other, n - 1 at most.

    From each fingerprint reached, those not reached yet are tested: first by coordinate
    difference in the pivot table, one pivot after the other, then bit by bit.
    """
    left = np.arange(1, len(fps))
    frontier, a, b = [0], [], []
    while True:
        if not frontier:
            if not len(left):
                break
            frontier, left = [int(left[0])], left[1:]
            continue
        x = frontier.pop()
        near = np.arange(len(left))
        for k in range(table.shape[1]):
            if not len(near):
                break
            near = near[np.abs(table[left[near], k] - table[x, k]) <= radius]
        near = near[np.bitwise_count(fps[left[near]] ^ fps[x]) <= radius]
        if len(near):
            found = left[near]
            a.append(np.full(len(found), x))
            b.append(found)
            frontier.extend(found.tolist())
            left = np.delete(left, near)
    none = np.empty(0, np.int64)
    return (np.concatenate(a) if a else none), (np.concatenate(b) if b else none)


@cache
def _ways(way: int, level: int) -> list[tuple[int, ...]]:
    """The bits that the cells of a level fix, one tuple for each way of choosing blocks; `way` chose those of the level before."""
    fixed: tuple[int, ...] = ()
    choices = list(combinations(range(BLOCKS), FIXED))
    path = []
    for _ in range(level - 1):
        way, choice = divmod(way, len(choices))
        path.append(choice)

    def chosen(fixed: tuple[int, ...], choice: int) -> tuple[int, ...]:
        blocks = np.array_split([x for x in range(POSITIONS) if x not in fixed], BLOCKS)
        return tuple(sorted({*fixed, *(int(x) for k in choices[choice] for x in blocks[k])}))

    for choice in reversed(path):
        fixed = chosen(fixed, choice)
    return [chosen(fixed, choice) for choice in range(len(choices))]


def cells(rows: DataFrame, level: int) -> DataFrame:
    """(way, cell, fp, pivots): the cells of rows (way, fp, pivots) of the level before, by the bits that each way fixes."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Fixed odd multipliers: the cell is a hash of the fixed bits, and of the way they were chosen.
        odd = np.random.default_rng(SEED + 1).integers(0, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            fp, before = batch.column("fp").to_numpy(), batch.column("way").to_numpy()
            for way in np.unique(before).tolist():
                own = np.flatnonzero(before == way)
                chosen = _ways(way, level)
                names = np.arange(len(chosen)) + way * len(chosen)
                masks = np.array([sum(1 << x for x in fixed) for fixed in chosen], np.uint64)
                keys = (fp[own].view(np.uint64)[None, :] & masks[:, None]) * odd[0] + names.astype(np.uint64)[:, None] * odd[1]
                at = pa.array(np.tile(own, len(chosen)))
                columns = [pa.array(np.repeat(names.astype(np.int32), len(own))), pa.array(keys.ravel().view(np.int64)), batch.column("fp").take(at), batch.column("pivots").take(at)]
                yield pa.RecordBatch.from_arrays(columns, ["way", "cell", "fp", "pivots"])

    return rows.select("way", "fp", "pivots").mapInArrow(deal, "way int, cell long, fp long, pivots binary")


def _search(radius: int):
    """Links of whole cells in rows (cell, fp, pivots), sorted by cell."""

    def emit(frame: pd.DataFrame) -> pd.DataFrame:
        # Most cells have two members: those are compared at once, the others one by one.
        cell, signed = frame["cell"].to_numpy(), frame["fp"].to_numpy()
        fp = signed.view(np.uint64)
        table = np.frombuffer(b"".join(frame["pivots"]), np.uint8).reshape(len(fp), REFERENCES).astype(np.int16)
        cut = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        ends = np.append(cut[1:], len(fp))
        two = cut[ends - cut == 2]
        two = two[np.abs(table[two] - table[two + 1]).max(axis=1) <= radius]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        us, vs = [two], [two + 1]
        for s, e in zip(cut[ends - cut > 2], ends[ends - cut > 2], strict=True):
            a, b = linked(fp[s:e], table[s:e], radius)
            us.append(a + s)
            vs.append(b + s)
        u, v = signed[np.concatenate(us)], signed[np.concatenate(vs)]
        return pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = np.flatnonzero((frame["cell"] != frame["cell"].iloc[-1]).to_numpy()) if len(frame) else []
            whole = int(last[-1]) + 1 if len(last) else 0
            rest = frame.iloc[whole:].reset_index(drop=True)
            if whole:
                yield emit(frame.iloc[:whole])
        if rest is not None and len(rest):
            yield emit(rest)

    return search


def links(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(u, v) with u > v: links that join exactly the distinct fingerprints (fp, pivots) within `radius` bits."""
    if radius > BLOCKS - FIXED:
        raise ValueError("three of six blocks agree up to a radius of 3")
    rows = fps.select(F.lit(0).alias("way"), "fp", "pivots")
    found = None
    for level in range(1, LEVELS + 1):
        dealt = materialize(cells(rows, level), "cells")
        sizes = dealt.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
        shared = materialize(dealt.join(sizes, "cell"), "shared")
        discard(dealt)
        small = shared if level == LEVELS else shared.where(F.col("n") <= chunk)
        one = small.select("cell", "fp", "pivots").repartition("cell").sortWithinPartitions("cell", "fp").mapInPandas(_search(radius), "u long, v long")
        found = one if found is None else found.unionByName(one)
        hot = shared.where(F.col("n") > chunk)
        if level == LEVELS or hot.isEmpty():
            return found.distinct()
        rows = hot.select("way", "fp", "pivots")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every node of edges (u, v), u > v.

    Large-star and small-star steps in turn until nothing changes. Every step is one
    aggregation with a partial minimum and one join that can be split on hot nodes.
    """
    edges = materialize(edges.select("u", "v"), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node's smaller neighbours and itself move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        after = materialize(small, "edges")
        discard(edges)
        edges = after
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _rooted(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, low, root) of distinct fingerprints (fp, low, pivots): root is the smallest fingerprint of the component."""
    roots = components(links(fps, radius))
    return fps.join(roots, fps.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id that chains of links reach, the row's own
    included. Null and empty texts have the fingerprint zero and are linked by it like
    any other; repeated rows get the same answer each; null ids are never the smallest.
    """
    own = with_fingerprint(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_t")), "_t").select("doc_id", "fp")
    own = materialize(own, "fingerprints")
    fps = materialize(with_pivots(own.groupBy("fp").agg(F.min("doc_id").alias("low"))), "distinct")
    rooted = _rooted(fps, radius)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = rooted.join(lowest, "root").select("fp", "component_id")
    return own.join(labels, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest doc_id, nulls last, once.

    Ids may be null or repeated, so rows are told apart by 96 bits of hashes of id and
    text; of one component's rows with the same smallest id, that of the smallest hash stays.
    Copies go inside each task before rows are dealt by these hashes. Null and empty texts
    are near-duplicates of each other. Columns keep their names and values, whatever they are.
    """
    renamed, names = numbered(docs)
    doc_id, text, key = names["doc_id"], names["text"], ["key64", "key32"]
    marked = renamed.withColumns({"key64": F.xxhash64(doc_id, text), "key32": F.hash(doc_id, text)})
    own = with_fingerprint(marked.select(doc_id, text, *key), text).drop(text)
    fps = materialize(own.groupBy("fp").agg(F.min(F.struct(F.col(doc_id).isNull().alias("last"), doc_id, *key)).alias("low")).transform(with_pivots), "distinct")
    kept = _rooted(fps).groupBy("root").agg(F.min("low").alias("low")).select("low.key64", "low.key32").distinct()
    return restored(marked.dropDuplicates(key).join(kept, key), names)
