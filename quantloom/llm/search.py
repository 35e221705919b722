"""Ranked lexical search with an exact sparse ball tree.

A document is a sparse vector of term impacts, an item one of term weights, and the score
their inner product in whole numbers. Documents are read as vectors over the items' terms
and indexed by blocks of ``BLOCK_DOCS``: a block is split into two halves again and again,
along the line between two documents far apart, and every subtree keeps its centroid c and
its radius r. For an item q, no document under a node scores more than

    sum of q over the terms that c has, times c   +   r * the norm of q over those terms

since a document there has no other terms. Bounds are floating point with a margin over all
rounding; subtrees are opened best bound first, until the best one left is under the score
of the last rank so far. Leaves are scored exactly, in whole numbers. Coordinates are scaled
by the root of the term's weight, which leaves inner products as they are.

A task goes through its documents block by block and keeps its best for each item: the
documents are dealt once, by how they were read, and only ranks are shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm._common import materialize

TOP = 50
#: Documents of a tree, and of a leaf.
BLOCK_DOCS, LEAF_DOCS = 4096, 32
#: Bytes of items that are searched at once, about: the bound of what is broadcast.
ITEM_BYTES = 1 << 24
#: Bytes between terms become blanks, A-Z lower case; all of other characters belongs to terms.
BETWEEN = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
FOLD = bytes(0x20 if b in BETWEEN else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Relative margin of a bound: sums of up to 2**22 products round by less.
MARGIN = 1e-9


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class BallTree:
    """A block of documents: rows (starts, columns, impacts) in tree order, and nodes with sparse centroids and radii."""

    def __init__(self, lengths: np.ndarray, columns: np.ndarray, impacts: np.ndarray, weights: np.ndarray, leaf_docs: int = LEAF_DOCS):
        """lengths: terms of each document, none without; columns and impacts: theirs; weights by column."""
        self.vocabulary, local = np.unique(columns, return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        x = impacts * np.sqrt(weights[columns])
        norm = np.add.reduceat(x * x, starts)
        self.order = np.arange(len(lengths))
        #: start, end, left child (right is next; -1 in leaves), radius, terms and centroid of each node.
        self.nodes: list[tuple[int, int, int, float, np.ndarray, np.ndarray]] = []

        def inner(at: np.ndarray, cut: np.ndarray, other: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x[at] * other[local[at]], cut)

        def dense(doc: int) -> np.ndarray:
            out = np.zeros(len(self.vocabulary))
            own = slice(starts[doc], starts[doc] + lengths[doc])
            out[local[own]] = x[own]
            return out

        waiting = [(0, len(lengths))]
        children: list[int] = []
        while waiting:
            after = []
            for s, e in waiting:
                docs = self.order[s:e]
                n = lengths[docs]
                cut = np.concatenate(([0], np.cumsum(n)[:-1]))
                at = np.repeat(starts[docs] - cut, n) + np.arange(n.sum())
                center = np.bincount(local[at], weights=x[at], minlength=len(self.vocabulary)) / (e - s)
                size = float(center @ center)
                # The margin covers what cancels in the difference.
                far = np.maximum(norm[docs] + size - 2 * inner(at, cut, center), 0) + 1e-11 * (norm[docs] + size)
                support = np.flatnonzero(center)
                radius, left = float(np.sqrt(far.max())), -1
                if e - s > leaf_docs and radius > 1e-5 * math.sqrt(size):
                    a = dense(docs[int(far.argmax())])
                    b = dense(docs[int((norm[docs] - 2 * inner(at, cut, a)).argmax())])
                    self.order[s:e] = docs[np.argsort(inner(at, cut, b - a), kind="stable")]
                    mid = (s + e) // 2
                    after += [(s, mid), (mid, e)]
                    left = 0  # set below, once the level is whole
                children.append(left)
                self.nodes.append((s, e, left, radius, support, center[support]))
            waiting = after
        at = 1
        for i, (s, e, left, *rest) in enumerate(self.nodes):
            if left >= 0:
                self.nodes[i] = (s, e, at, *rest)
                at += 2
        n = lengths[self.order]
        self.starts = np.concatenate(([0], np.cumsum(n)))
        move = np.repeat(starts[self.order] - self.starts[:-1], n) + np.arange(n.sum())
        self.columns, self.impacts = local[move], impacts[move]

    def bound(self, node: int, terms: np.ndarray, roots: np.ndarray) -> float:
        """What no document under the node can score more than; terms: local columns of the item, roots: of their weights."""
        _, _, _, radius, support, center = self.nodes[node]
        at = np.searchsorted(support, terms)
        at[at == len(support)] = 0
        hit = support[at] == terms
        q = roots[hit]
        return (float(q @ center[at[hit]]) + radius * math.sqrt(float(q @ q))) * (1 + MARGIN) + 1

    def search(self, terms: np.ndarray, weights: np.ndarray, least: int, ranks: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, leaves opened): the best `top` of the block for an item, those under `least` left out.

        terms: columns of the item, ascending; ranks: by which equal scores are ordered, for each document.
        """
        found = np.searchsorted(self.vocabulary, terms)
        found[found == len(self.vocabulary)] = 0
        own = self.vocabulary[found] == terms
        docs, scores, opened = np.empty(0, np.int64), np.empty(0, np.int64), 0
        local, w = found[own], weights[own]
        if not len(local):
            return docs, scores, opened
        roots, table = np.sqrt(w), np.zeros(len(self.vocabulary), np.int64)
        table[local] = w
        heap = [(-self.bound(0, local, roots), 0)]
        while heap and -heap[0][0] >= least:
            node = heapq.heappop(heap)[1]
            s, e, left, *_ = self.nodes[node]
            if left >= 0:
                for child in (left, left + 1):
                    most = self.bound(child, local, roots)
                    if most >= least:
                        heapq.heappush(heap, (-most, child))
                continue
            opened += 1
            here = slice(self.starts[s], self.starts[e])
            exact = np.add.reduceat(self.impacts[here] * table[self.columns[here]], self.starts[s:e] - self.starts[s])
            good = np.flatnonzero(exact >= max(least, 1))
            if len(good):
                docs, scores = np.concatenate((docs, self.order[s + good])), np.concatenate((scores, exact[good]))
                if len(docs) > top:
                    best = np.lexsort((ranks[docs], -scores))[:top]
                    docs, scores = docs[best], scores[best]
                if len(docs) == top:
                    least = max(least, int(scores.min()))
        return docs, scores, opened


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n, ids, tfs) for every row: its number of terms, and those of the vocabulary with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, ids, tfs = [], [], []
            for t in batch.column("t"):
                own = terms(t.as_py())
                held = [(known[k], c) for k, c in Counter(own).items() if k in known]
                n.append(len(own))
                ids.append([i for i, _ in held])
                tfs.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "ids", "tfs"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"))
    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, ids array<int>, tfs array<long>")


def _ranked(vecs: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, total: int, top: int, block_docs: int, leaf_docs: int) -> DataFrame:
    """(qid, doc_id, score): the best of each task for every item (qid, term ids, weights)."""
    shared = vecs.sparkSession.sparkContext.broadcast((queries, weights))
    kind = vecs.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        best: list[list[tuple[int, tuple, object]]] = [[] for _ in asked]
        held: list[pa.RecordBatch] = []
        id_type = None

        def block(rows: pa.Table) -> None:
            ids = rows.column("doc_id").to_pylist()
            keys = [(i is None, 0 if i is None else i) for i in ids]
            ranks = np.empty(len(ids), np.int64)
            ranks[sorted(range(len(ids)), key=keys.__getitem__)] = np.arange(len(ids))
            lists, tfs = rows.column("ids").combine_chunks(), rows.column("tfs").combine_chunks()
            lengths, columns, tf = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), tfs.flatten().to_numpy()
            m = np.array([50 + 50 * n * documents // total for n in rows.column("n").to_pylist()], np.int64)
            impacts = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, lengths))
            tree = BallTree(lengths, columns, impacts, weight, leaf_docs)
            for own, (_, terms_of, w) in zip(best, asked, strict=True):
                least = -own[-1][0] if len(own) == top else 1
                docs, scores, _ = tree.search(terms_of, w, least, ranks, top)
                if len(docs):
                    own[:] = sorted([*own, *((-int(s), keys[d], ids[d]) for d, s in zip(docs.tolist(), scores.tolist(), strict=True))], key=lambda x: x[:2])[:top]

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            held.append(batch)
            while (n := sum(b.num_rows for b in held)) >= block_docs:
                rows = pa.Table.from_batches(held)
                block(rows.slice(0, block_docs))
                held = rows.slice(block_docs).to_batches() if n > block_docs else []
        if held and sum(b.num_rows for b in held):
            block(pa.Table.from_batches(held))
        out = [(q[0], i, -s) for q, own in zip(asked, best, strict=True) for s, _, i in own]
        if out:
            qid, ids, scores = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(ids, id_type), pa.array(scores, pa.int64())], ["qid", "doc_id", "score"])

    return vecs.where(F.size("ids") > 0).mapInArrow(search, f"qid long, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", block_docs: int = BLOCK_DOCS, leaf_docs: int = LEAF_DOCS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of each item with the highest scores above 0, all if fewer.

    Equal scores stand by ascending doc_id, null last. Every row of items is an item of its
    own and every row of docs a document, repeated ones, too. Null and empty texts have no
    terms: such items get no rows, such documents none either. Very long texts are read
    whole; other columns play no part, whatever their names. Empty tables give no rows.
    Items go in blocks of about item_bytes, whatever their number: what a block's
    terms and weights take is what is broadcast.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("t"), F.monotonically_increasing_id().alias("qid"))
    asked = materialize(asked, "items")
    size = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks, found = max(1, -(-size // item_bytes)), None
    for b in range(blocks):
        own = [(r["qid"], sorted(set(terms(r["t"])))) for r in asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).select("qid", "t").collect()]
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in own for t in ts}))}
        vecs = materialize(vectors(docs, vocabulary, text, doc_id), "vectors")
        documents, total = vecs.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not vocabulary or not total:
            continue
        df = dict(vecs.select(F.explode("ids").alias("i")).groupBy("i").count().collect())
        weights = np.array([term_weight(documents, df[i]) if i in df else 0 for i in range(len(vocabulary))], np.int64)
        queries = []
        for qid, ts in own:
            at = np.array([vocabulary[t] for t in ts], np.int64)
            at = at[weights[at] > 0] if len(at) else at
            if len(at):
                queries.append((qid, at, weights[at]))
        one = _ranked(vecs, queries, weights, documents, total, top, block_docs, leaf_docs)
        found = one if found is None else found.unionByName(one)
    names = asked.select("qid", "item_id")
    if found is None:
        found = spark.createDataFrame([], "qid long, score long").withColumn("doc_id", F.lit(None).cast(docs.schema[doc_id].dataType))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(names, "qid").select("item_id", "rank", "doc_id", "score")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(docs, benchmark)


#: The same as digest() for DuckDB, by postings of all terms.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ts
  FROM documents
), q AS (
  SELECT row_number() OVER () AS qid, item_id, list_distinct(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS ts
  FROM benchmark
), c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
p AS (SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) GROUP BY rid, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, c GROUP BY term, n_docs),
m AS (SELECT rid, doc_id, 50 + (50 * len(ts) * n_docs) // n_terms AS m FROM d, c WHERE len(ts) > 0),
s AS (
  SELECT qid, item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM (SELECT qid, item_id, unnest(ts) AS term FROM q) JOIN f USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY ALL
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
