"""Packing into optimal length buckets.

The histogram of encoded lengths over all documents is small; dynamic programming over it
finds the bucket boundaries with the least padding. The cost of a bucket is the padding of
its documents to its longest one, so the recurrence is a lower envelope of lines and each
layer takes linear time. Inside a bucket documents are ordered by length and cut into
batches whose padded size stays within the token budget. pack() gives every document its
place as numbers, which is what the query returns; batches() forms the padded batches.
Ids and masks are bytes, so that a batch is one block of memory for who trains on it and
Spark moves no single numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm._common import global_rank, materialize
from quantloom.llm.tokens import with_id_bytes, with_lengths

BUCKETS = 16
TOKEN_BUDGET = 65_536


def boundaries(histogram: list[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of `buckets` buckets at most that minimise total padding, exactly.

    histogram: (length, documents). With c and s the running counts of documents and
    tokens, a bucket of lengths i+1..j costs L[j]*(c[j]-c[i]) - (s[j]-s[i]). Empty in,
    empty out.
    """
    rows = sorted(histogram)
    if not rows:
        return []
    length = [x for x, _ in rows]
    c, s = [0], [0]
    for x, n in rows:
        c.append(c[-1] + n)
        s.append(s[-1] + x * n)
    m = len(rows)
    best: list[int | None] = [0] + [None] * m  # cost of the first j lengths
    choices = []
    for _ in range(min(buckets, m)):
        layer: list[int | None] = [None] * (m + 1)
        choice = [0] * (m + 1)
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i; slopes fall
        head = 0
        for j in range(1, m + 1):
            i = j - 1
            if best[i] is not None:
                line = (-c[i], best[i] + s[i], i)
                while len(hull) - head >= 2 and _useless(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            x = length[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                k, b, i = hull[head]
                layer[j], choice[j] = k * x + b + x * c[j] - s[j], i
        choices.append(choice)
        best = layer
        best[0] = None
    # With as many buckets as lengths allow, the last layer is the least: a cut never adds padding.
    out, j = [], m
    for choice in reversed(choices):
        if j == 0:
            break
        out.append(length[j - 1])
        j = choice[j]
    return sorted(out)


def _useless(a: tuple[int, int, int], b: tuple[int, int, int], c: tuple[int, int, int]) -> bool:
    """Whether line b is nowhere below both a and c (slopes fall from a to c)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def _placed(sized: DataFrame, buckets: int, token_budget: int) -> DataFrame:
    """sized (doc_id, n_tokens and more), a table in the shared folder, with bucket, bucket_len, batch, position and padding."""
    # One row for each distinct length: bounded by the longest document, not by how many there are.
    counts = [(r["n_tokens"], r["count"]) for r in sized.groupBy("n_tokens").count().collect()]
    tops = boundaries(counts, buckets)
    starts, at = [], 0
    for i, top in enumerate(tops):
        starts.append((i, top, at))
        low = tops[i - 1] if i else -1
        at += sum(n for x, n in counts if low < x <= top)
    ranked = global_rank(sized, [F.col("n_tokens"), F.col("doc_id")], "ranked")
    bucket = F.lit(None).cast("struct<bucket:int,top:long,start:long>")
    for i, top, start in reversed(starts):
        one = F.struct(F.lit(i).alias("bucket"), F.lit(top).cast("long").alias("top"), F.lit(start).cast("long").alias("start"))
        bucket = F.when(F.col("n_tokens") <= top, one).otherwise(bucket)
    room = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("b.top"), F.lit(1)))).cast("long")
    place = F.col("_rank") - F.col("b.start")
    out = ranked.withColumn("b", bucket).withColumns({"batch": F.floor(place / room).cast("long"), "position": place % room, "padding": F.col("b.top") - F.col("n_tokens")})
    return out.withColumns({"bucket": F.col("b.bucket"), "bucket_len": F.col("b.top")}).drop("b", "_rank")


def pack(docs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_len, batch, position, padding) for every row of docs.

    A batch holds token_budget // bucket_len documents of one bucket, one at least: a
    document over the budget is a batch of its own. Batches are numbered from 0 in each
    bucket, in the order of length, then doc_id, then as rows come; repeated rows have a
    place each. Null and empty texts have length 0. Very long texts are encoded whole.
    Other columns play no part, whatever their names. Empty in, empty out.
    """
    sized = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_t"))
    sized = materialize(with_lengths(sized, "_t", "n_tokens", tokenizer).select("doc_id", "n_tokens"), "lengths")
    return _placed(sized, buckets, token_budget).select("doc_id", "n_tokens", "bucket", "bucket_len", "batch", "position", "padding")


def batches(docs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, pad_id: int = 0) -> DataFrame:
    """(bucket, batch, bucket_len, doc_ids, lengths, ids, mask): the batches of pack(), a row each.

    ids and mask are arrays of binary, one for each document: bucket_len ids as little-endian
    32-bit numbers, padded with pad_id, and as many bytes, 1 over the document's own ids and 0
    over padding. A row of the result holds token_budget ids at most, or one longer document.
    Cases as in pack().
    """
    sized = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_t"))
    sized = materialize(with_id_bytes(sized, "_t", "ids", tokenizer).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids"), "ids")
    rows = _placed(sized, buckets, token_budget).select("bucket", "batch", "bucket_len", F.struct("position", "doc_id", "ids").alias("x"))
    whole = rows.groupBy("bucket", "batch").agg(F.max("bucket_len").alias("bucket_len"), F.array_sort(F.collect_list("x")).alias("xs"))
    pad, own, none = (F.lit(b) for b in (pad_id.to_bytes(4, "little"), b"\x01", b"\x00"))
    room = F.col("bucket_len").cast("int")
    size = lambda x: (F.octet_length(x["ids"]) / 4).cast("int")
    return whole.select(
        "bucket",
        "batch",
        "bucket_len",
        F.transform("xs", lambda x: x["doc_id"]).alias("doc_ids"),
        F.transform("xs", size).alias("lengths"),
        F.transform("xs", lambda x: F.rpad(x["ids"], 4 * room, pad)).alias("ids"),
        F.transform("xs", lambda x: F.rpad(F.rpad(F.lit(b""), size(x), own), room, none)).alias("mask"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return pack(docs)
