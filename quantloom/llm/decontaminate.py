"""Benchmark decontamination by winnowing.

A window is 13 consecutive words of a benchmark item. Each run of 13 words holds
``WINNOW`` = 8 grams of ``GRAM`` = 6 words; documents and items both keep the smallest
gram hash of every such run, so a shared window always leaves a shared fingerprint.
A place of a fingerprint is extended to the windows around it, 8 at most, and these are
joined and compared word by word: hashes propose, words decide, and what follows a preamble
that many items share makes no candidates. Items that share a window, or a whole short text,
are one row, with a name for their set. Items shorter than a
window are found by hashes that grow word by word: a place goes on while some item begins
with its words, and is joined where a whole item ends, then compared word by word.

Both tests run inside the scan of the documents against a table of FILTER_BITS bits, the
same at every size of the benchmark: it holds every fingerprint, and what it lets through
by chance goes in the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from quantloom.llm._common import discard, let, materialize, numbered, restored

SPAN = 13
GRAM = 6
WINNOW = SPAN - GRAM + 1
SIDE = SPAN - GRAM
#: Bits of the table of benchmark fingerprints that the scan carries (1 MB); a fuller table only lets more through to the join.
FILTER_BITS = 1 << 23
#: What the growing hashes start from, and what ends one.
SEED, END = 0, 1
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_HITS = "cast(array() as array<struct<p:int,h:bigint,l:array<string>,r:array<string>>>)"
NO_SHORT = "cast(array() as array<struct<h:bigint,r:array<string>,ps:array<int>>>)"


def bench_words(text: Column) -> Column:
    """Words after lower-casing A-Z only; lower() may stand in where all characters are ASCII."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, NOT_WORD), "")


def gram_hashes(words: Column, k: int) -> Column:
    """64-bit hashes of all runs of k words; empty if there are fewer."""
    return let(words, lambda w: _gram_hashes(w, k))


def _gram_hashes(words: Column, k: int) -> Column:
    n = F.size(words)
    return F.when(n < k, F.expr("cast(array() as array<bigint>)")).otherwise(
        F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    )


def winnow(hashes: Column) -> Column:
    """The distinct minima of all runs of WINNOW hashes; empty if there are fewer."""

    def minima(h: Column) -> Column:
        n = F.size(h)
        return F.when(n < WINNOW, F.expr("cast(array() as array<bigint>)")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - WINNOW + 1), lambda i: F.array_min(F.slice(h, i, WINNOW)))))

    return let(hashes, minima)


def _around(words: Column, p: Column, left: int, gram: int, right: int) -> list[Column]:
    """Up to `left` words before position p, nearest first, and up to `right` words after the gram there."""
    return [
        F.reverse(F.slice(words, F.greatest(p - left, F.lit(0)) + 1, F.least(p, F.lit(left)))).alias("l"),
        F.slice(words, p + gram + 1, right).alias("r"),
    ]


def winnow_places(hashes: Column) -> Column:
    """Positions of the minima of all runs of WINNOW hashes, the first of equal ones; empty if there are fewer."""

    def places(h: Column) -> Column:
        first = lambda i: let(F.slice(h, i, WINNOW), lambda run: (i - 2 + F.array_position(run, F.array_min(run))).cast("int"))
        n = F.size(h)
        return F.when(n < WINNOW, F.expr("cast(array() as array<int>)")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - WINNOW + 1), first)))

    return let(hashes, places)


def _at(words: Column, hashes: Column, places: Column, gram: int, left: int, right: int) -> Column:
    """The positions with their hash and the words on both sides."""
    return F.transform(places, lambda p: F.struct(p.alias("p"), F.get(hashes, p).alias("h"), *_around(words, p, left, gram, right)))


def _windows(h: Column, left: Column, right: Column) -> Column:
    """The windows of SPAN words around a gram, as array of (key, a: words before the gram, h, wl and wr: the words on both sides)."""

    def window(a: int) -> Column:
        wl, wr = F.slice(left, 1, a) if a else F.expr("cast(array() as array<string>)"), F.slice(right, 1, SIDE - a) if a < SIDE else F.expr("cast(array() as array<string>)")
        there = (F.size(left) >= a) & (F.size(right) >= SIDE - a)
        return F.when(there, F.struct(F.xxhash64(h, F.lit(a), wl, wr).alias("key"), F.lit(a).alias("a"), h.alias("h"), wl.alias("wl"), wr.alias("wr")))

    return F.filter(F.array(*[window(a) for a in range(SIDE + 1)]), lambda x: x.isNotNull())


def _named(grouped: GroupedData) -> DataFrame:
    """The groups with their items (sorted strings) and a name of that set."""
    out = grouped.agg(F.sort_array(F.collect_set("item")).alias("items"))
    return out.withColumn("group", F.sha2(F.array_join(F.transform("items", lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), "").cast("binary"), 256))


def bit_table(hashes: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """One row with `bits` bits as array<bigint>, in which the bit of every hash (column h) is set. bits: a power of two from 64."""
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = hashes.select(F.shiftright(at, 6).alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("w")).groupBy("i").agg(F.bit_or("w").alias("w"))
    every = hashes.sparkSession.range(bits >> 6).withColumnRenamed("id", "i").join(words, "i", "left").select("i", F.coalesce("w", F.lit(0).cast("long")).alias("w"))
    return every.agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("x")).select(F.transform("x", lambda x: x["w"]).alias("bits"))


def _holds(table: Column, h: Column, bits: int) -> Column:
    """Whether the bit of h is set."""
    at = h.bitwiseAND(F.lit(bits - 1))
    return F.get(table, F.shiftright(at, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))) != 0


def _grown(words: Column, p: Column, n: int) -> Column:
    """Hashes of the 1 to n words from p on, each made from the one before; nulls past the end."""
    none = F.lit(None).cast("bigint")
    step = lambda acc, j: let(F.get(words, p + j), lambda w: F.concat(acc, F.array(F.when(w.isNotNull(), F.xxhash64(F.coalesce(F.get(acc, j - 1), F.lit(SEED)), w)).otherwise(none))))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.expr("cast(array() as array<bigint>)"), step)


def _ended(h: Column) -> Column:
    """The hash of a whole short item, told apart from that of a beginning."""
    return F.xxhash64(h, F.lit(END))


def _short_places(words: Column, table: Column, longest: int, bits: int) -> Column:
    """(h, r: the words, ps: where they stand) wherever the table may hold a whole item of up to `longest` words, once for all places of the same words."""
    first = lambda w: F.xxhash64(F.lit(SEED).cast("bigint"), w)
    begun = F.filter(F.transform(words, lambda w, p: F.when(_holds(table, first(w), bits), p)), lambda p: p.isNotNull())

    def at(p: Column) -> Column:
        whole = lambda h, j: F.when(h.isNotNull() & _holds(table, _ended(h), bits), F.struct(_ended(h).alias("h"), F.slice(words, p + 1, j + 1).alias("r"), p.alias("p")))
        return F.filter(F.transform(_grown(words, p, longest), whole), lambda x: x.isNotNull())

    def once(places: Column) -> Column:
        kinds = F.array_distinct(F.transform(places, lambda x: F.struct(x["h"].alias("h"), x["r"].alias("r"))))
        own = lambda k: F.transform(F.filter(places, lambda x: (x["h"] == k["h"]) & (x["r"] == k["r"])), lambda x: x["p"])
        return F.transform(kinds, lambda k: F.struct(k["h"].alias("h"), k["r"].alias("r"), own(k).alias("ps")))

    return let(F.flatten(F.transform(begun, at)), once)


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", filter_bits: int = FILTER_BITS, keep_text: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, found, groups): every row of docs with a row number _rid and n_words, the hits, and the items of each.

    found has _rid, group and spans: words s to e (exclusive) of the row are a window of the
    items of that group, or the whole of shorter ones; a document's places of one short item
    are one row. groups has group and items (array of strings), a row for each set of items.
    rows was written to the shared folder (discard() it after use), without the text unless
    keep_text. Null texts have no words; empty tables give empty results; repeated rows each
    have their own _rid; columns called _rid, _w, _h, _b, _n and _hit are replaced.
    """
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), bench_words(F.col(f"`{item_text}`")).alias("w"))
    items = materialize(items.where(F.size("w") > 0), "items")
    fingerprints = (
        items.where(F.size("w") >= SPAN)
        .withColumn("h", gram_hashes(F.col("w"), GRAM))
        .withColumn("keep", winnow_places(F.col("h")))
        .select("item", F.explode(_at(F.col("w"), F.col("h"), F.col("keep"), GRAM, SIDE, SIDE)).alias("x"))
        .select("item", F.col("x.h").alias("h"), F.col("x.l").alias("il"), F.col("x.r").alias("ir"))
        .distinct()
    )
    fingerprints = materialize(fingerprints, "fingerprints")
    windows = fingerprints.select("item", F.explode(_windows(F.col("h"), F.col("il"), F.col("ir"))).alias("x")).select("item", "x.*")
    windows = materialize(_named(windows.groupBy("key", "a", "h", "wl", "wr")), "windows")
    short = items.where(F.size("w") < SPAN).withColumn("hs", _grown(F.col("w"), F.lit(0), SPAN - 1)).select("item", "w", F.filter("hs", lambda x: x.isNotNull()).alias("hs"))
    whole = materialize(_named(short.groupBy(_ended(F.element_at("hs", -1)).alias("h"), "w")), "short")
    longest = items.where(F.size("w") < SPAN).agg(F.max(F.size("w"))).first()[0]
    kept = [fingerprints.select("h"), *([short.select(F.explode("hs").alias("h")), whole.select("h")] if longest else [])]
    for more in kept[1:]:
        kept[0] = kept[0].unionByName(more)
    table = bit_table(kept[0], filter_bits)

    rows = docs.withColumns({"_rid": F.monotonically_increasing_id(), "_w": bench_words(F.col(f"`{text}`"))})
    rows = rows.withColumn("n_words", F.size("_w").cast("long")).withColumn("_h", gram_hashes(F.col("_w"), GRAM))
    # The table must reach the lambdas inside their own projection: as a column of the one below it would be copied with
    # every row. That one is kept apart by _h, which is used twice here and so isn't computed again.
    rows = rows.withColumns({"_b": F.array(table.scalar()), "_n": F.size("_h")})

    def marked(b: Column) -> Column:
        # Places are looked for only where a minimum passes.
        places = F.filter(winnow_places(F.col("_h")), lambda p: _holds(b, F.get("_h", p), filter_bits))
        none = F.expr(NO_HITS)
        found = F.when((F.col("_n") > 0) & F.exists(winnow(F.col("_h")), lambda h: _holds(b, h, filter_bits)), _at(F.col("_w"), F.col("_h"), places, GRAM, SIDE, SIDE)).otherwise(none)
        return F.struct(found.alias("hit"), (_short_places(F.col("_w"), b, longest, filter_bits) if longest else F.expr(NO_SHORT)).alias("short"))

    rows = rows.withColumn("_hit", F.get(F.transform("_b", marked), F.lit(0))).drop("_w", "_h", "_b", "_n", *[] if keep_text else [text])
    rows = materialize(rows, "rows")
    found = (
        rows.where(F.size("_hit.hit") > 0)
        .select("_rid", F.explode("_hit.hit").alias("x"))
        .select("_rid", "x.p", F.explode(_windows(F.col("x.h"), F.col("x.l"), F.col("x.r"))).alias("x"))
        .select("_rid", "p", "x.*")
        .join(windows, ["key", "a", "h", "wl", "wr"])
        .select("_rid", "group", F.array(F.struct((F.col("p") - F.col("a")).alias("s"), (F.col("p") - F.col("a") + SPAN).alias("e"))).alias("spans"))
    )
    if longest:
        found = found.unionByName(
            rows.where(F.size("_hit.short") > 0)
            .select("_rid", F.explode("_hit.short").alias("x"))
            .select("_rid", "x.ps", "x.h", "x.r")
            .join(whole, "h")
            .where(F.col("r") == F.col("w"))
            .select("_rid", "group", F.transform("ps", lambda p: F.struct(p.alias("s"), (p + F.size("w")).alias("e"))).alias("spans"))
        )
    groups = windows.select("group", "items").unionByName(whole.select("group", "items")).dropDuplicates(["group"])
    return rows, found, groups


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", filter_bits: int = FILTER_BITS, keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted array of strings) and contaminated.

    A word is hit inside any occurrence of a window; a row is contaminated if
    20 * n_hit >= n_words and n_hit > 0. Input columns of these names are replaced. Null
    and empty texts have no words and no hit, very long ones are searched whole, repeated
    rows are judged alike; an empty benchmark hits nothing.
    """
    docs = docs.drop("n_words", "n_hit", "n_items", "items", "contaminated")
    rows, found, groups = hits(docs, benchmark, text, item_text, item_id, filter_bits, keep_text)
    # The union of intervals: what each adds beyond the furthest end before it.
    spans = found.groupBy("_rid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("x"))
    items = found.select("_rid", "group").distinct().join(groups, "group").groupBy("_rid").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    union = F.aggregate(
        F.col("x"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["e"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["end"], x["s"]))).alias("n")),
        lambda acc: acc["n"].cast("long"),
    )
    marked = spans.select("_rid", union.alias("n_hit")).join(items, "_rid")
    none = F.expr("cast(array() as array<string>)")
    out = rows.drop("_hit").join(marked, "_rid", "left").drop("_rid")
    return out.withColumns(
        {
            "n_hit": F.coalesce("n_hit", F.lit(0).cast("long")),
            "items": F.coalesce("items", none),
        }
    ).withColumns({"n_items": F.size("items").cast("long"), "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))})


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = contamination(docs.select("doc_id", "text"), benchmark, keep_text=False)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, in its columns, whatever their names.

    Null and empty texts have no words and stay; repeated rows are judged alike.
    """
    renamed, names = numbered(docs)
    return restored(contamination(renamed, benchmark, names["text"]).where(~F.col("contaminated")), names)


__all__ = ["bench_words", "bit_table", "contamination", "digest", "discard", "gram_hashes", "hits", "stage", "winnow_places"]

#: The same as digest() for DuckDB: every window of both sides, joined as text.
SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), h AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
p AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS q FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
k AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN k USING (rid)
"""
