"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source has a target of words. Its documents stand on an axis in the order of their
hashes, once for each epoch; the axis up to the target is cut into blocks of equal length,
so that a source's quota is a whole number of blocks and a document belongs to the block
that holds its middle. All output shards form a binary tree. A node holds how many blocks
of each source its shards get; it gives its left half as many blocks as that half has
shards, and which ones is drawn without replacement: one hypergeometric draw for each
source, given those before it. So quotas are met exactly at every node, and a leaf knows its
count of each source and, by the counts to its left, a range of positions that no other
shard has. Positions name blocks through a permutation, and documents are shuffled inside
their shard.

A draw walks from the mode outwards with weights relative to it: no factorials, and the
steps end where what is left lies under the resolution of a double. All randomness is
hashes of a seed, so reruns agree.

Running sums over a source go by runs of its hash order, of some thousand rows each: sums
of runs first, rows inside their run then. No task holds a source, however hot. Everything
is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm._common import bound, discard, materialize, numbered, small_side, words_of

WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and how often a document may be taken.
SHARE, REPEATS = 1.5, 2
BLOCK_WORDS = 1 << 14
#: Blocks of an output shard.
SHARD_BLOCKS = 64
#: Rows that a run of a source's hash order holds, about.
RUN_ROWS = 4096
SEED = 42
#: A prime above every count of blocks: multiplying by it permutes positions.
PRIME = (1 << 61) - 1
#: Levels of the tree after which its nodes are dealt over tasks again.
DEAL_LEVELS = 10
BEFORE = (Window.unboundedPreceding, -1)


def size_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """sources (source, source_size and more; a row for each) with sidx, weight and target.

    Sources by code point, null last, get the weights in turn. Targets share `share` of all
    words by weight; none goes over `repeats` times its source, and what is over goes to the
    others by weight: a common price per unit of weight, at which the sources that would
    take more than they may are those with the least cap for their weight.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    out = sources.withColumn("sidx", (F.row_number().over(every) - 1).cast("long"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sidx") % len(weights) + 1).cast("int"))
    out = out.withColumns({"weight": pick, "_cap": F.col("source_size") * float(repeats)})
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "sidx")
    total = F.sum("source_size").over(Window.partitionBy()) * float(share)
    price = (total - F.coalesce(F.sum("_cap").over(order.rowsBetween(*BEFORE)), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("_price", price)
    free = F.when(F.col("_cap") > F.col("weight") * F.col("_price"), F.struct(F.col("_cap") / F.col("weight"), "sidx", F.col("_price").alias("price")))
    common = F.min(free).over(Window.partitionBy())["price"]
    return out.withColumn("target", F.coalesce(F.least("_cap", F.col("weight") * common), F.col("_cap"))).drop("_cap", "_price")


def hypergeometric(population: str, marked: str, draws: str, u: str) -> str:
    """SQL: how many of `draws` items drawn from `population` are among the `marked`, by inversion of u in [0, 1)."""
    # Weights relative to that of the mode h.m: from k to k + 1 above it, from k to k - 1 below.
    above = "(h.c - {k}) * (h.d - {k}) / (({k} + 1.0D) * (h.n - h.c - h.d + {k} + 1))".format(k="(h.m + i - 1)")
    below = "{k} * (h.n - h.c - h.d + {k}) / ((h.c - {k} + 1.0D) * (h.d - {k} + 1))".format(k="(h.m - i + 1)")

    def walk(ratio: str, steps: str, start: str, step: str, end: str) -> str:
        numbers = f"if({steps} > 0, sequence(1L, {steps}), cast(array() as array<bigint>))"
        return f"aggregate({numbers}, named_struct('w', 1.0D, {start}), (a, i) -> {bound(f'a.w * {ratio}', 'w', step)}, a -> {end})"

    def total(ratio: str, steps: str) -> str:
        return walk(ratio, steps, "'s', 0.0D", "named_struct('w', w, 's', a.s + w)", "a.s")

    def found(ratio: str, steps: str, rest: str, sign: str) -> str:
        return walk(ratio, steps, f"'left', {rest}, 'i', 0L", "if(a.left < 0, a, named_struct('w', w, 'left', a.left - w, 'i', i))", f"h.m {sign} a.i")

    sums = f"named_struct('above', {total(above, 'h.high')}, 'below', {total(below, 'h.low')})"
    place = f"case when t.x < 1 then h.m when t.x < 1 + t.above then {found(above, 'h.high', 't.x - 1', '+')} else {found(below, 'h.low', 't.x - 1 - t.above', '-')} end"
    drawn = bound(sums, "s", bound(f"named_struct('x', {u} * (1 + s.above + s.below), 'above', s.above)", "t", place))
    # 12 standard deviations and some: what lies further out has less weight than 2 ** -53, which u can't tell.
    reach = "cast(ceil(12 * sqrt(g.d * (g.c / g.n) * (1 - g.c / g.n) * ((g.n - g.d) / greatest(g.n - 1, 1)))) as bigint) + 64"
    near = f"named_struct('n', g.n, 'c', g.c, 'd', g.d, 'm', m, 'high', least(least(g.c, g.d) - m, {reach}), 'low', least(m - greatest(0L, g.d + g.c - g.n), {reach}))"
    mode = "cast(floor((g.d + 1.0D) * (g.c + 1) / (g.n + 2)) as bigint)"
    sure = f"case when g.c = 0 or g.d = 0 then 0L when g.c = g.n then g.d else {bound(mode, 'm', bound(near, 'h', drawn))} end"
    return bound(f"named_struct('n', cast({population} as bigint), 'c', cast({marked} as bigint), 'd', cast({draws} as bigint))", "g", sure)


def split(counts: str, draws: str, node: str, seed: int = SEED) -> str:
    """SQL: how many blocks of each source are among `draws` ones drawn from all of `counts`: a multivariate-hypergeometric draw."""
    u = f"shiftrightunsigned(xxhash64({seed}, {node}, x.i), 11) * {2.0**-53!r}D"
    one = bound(hypergeometric("a.n", "x.c", "a.d", u), "y", "named_struct('n', a.n - x.c, 'd', a.d - y, 'out', concat(a.out, array(y)))")
    start = f"named_struct('n', aggregate({counts}, 0L, (s, c) -> s + c), 'd', cast({draws} as bigint), 'out', cast(array() as array<bigint>))"
    return f"aggregate(transform({counts}, (c, i) -> named_struct('c', c, 'i', i)), {start}, (a, x) -> {one}, a -> a.out)"


def leaves(root: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(shard, counts, starts) of every shard; root: one row with the blocks of each source as array<bigint> `counts`."""
    zero = F.lit(0).cast("long")
    nodes = root.select(F.lit(1).cast("long").alias("node"), zero.alias("lo"), F.lit(shards).cast("long").alias("hi"), "counts", F.transform("counts", lambda _: zero).alias("starts"))
    for level in range(ceil(log2(shards)) if shards > 1 else 0):
        if level and level % DEAL_LEVELS == 0:
            nodes = nodes.repartition("node")
        # A node of one shard is handed on as it is.
        half = F.expr("lo + (hi - lo) div 2")
        nodes = nodes.withColumns({"mid": half, "draws": F.expr("(aggregate(counts, 0L, (s, c) -> s + c) * ((hi - lo) div 2)) div (hi - lo)")})
        nodes = nodes.withColumn("left", F.expr(f"case when hi - lo > 1 then {split('counts', 'draws', 'node', seed)} end"))
        child = lambda **x: F.struct(*[v.alias(k) for k, v in x.items()])
        both = F.array(
            child(node=F.col("node") * 2, lo=F.col("lo"), hi=F.col("mid"), counts=F.col("left"), starts=F.col("starts")),
            child(node=F.col("node") * 2 + 1, lo=F.col("mid"), hi=F.col("hi"), counts=F.zip_with("counts", "left", lambda a, b: a - b), starts=F.zip_with("starts", "left", lambda a, b: a + b)),
        )
        alone = F.array(child(node=F.col("node"), lo=F.col("lo"), hi=F.col("hi"), counts=F.col("counts"), starts=F.col("starts")))
        nodes = nodes.select(F.explode(F.when(F.col("left").isNull(), alone).otherwise(both)).alias("x")).select("x.*")
    return nodes.select(F.col("lo").alias("shard"), "counts", "starts")


def blocks(sources: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """(sidx, block, shard): the shard of every block of sources (sidx, quota)."""
    total = sources.agg(F.sum("quota")).first()[0] or 0
    root = sources.agg(F.array_sort(F.collect_list(F.struct("sidx", "quota"))).alias("x")).select(F.transform("x", lambda x: x["quota"]).alias("counts"))
    dealt = leaves(root, max(1, -(-total // shard_blocks)), seed)
    each = dealt.select("shard", F.posexplode(F.arrays_zip("counts", "starts"))).where("col.counts > 0")
    each = each.select(F.col("pos").cast("long").alias("sidx"), "shard", F.explode(F.expr("sequence(col.starts, col.starts + col.counts - 1)")).alias("q"))
    placed = each.join(small_side(sources.select("sidx", "quota")), "sidx")
    permuted = (F.col("q") * (F.lit(PRIME) % F.col("quota")) + F.pmod(F.xxhash64(F.lit(seed), "sidx"), F.col("quota"))) % F.col("quota")
    return placed.select("sidx", permuted.alias("block"), "shard")


@dataclass(frozen=True)
class Mix:
    """sources: source, source_size, sidx, weight, target, quota; rows: sidx, key, doc_id, size, n, as counted;
    draws: sidx, key, copy, epoch, size, shard, place: what the mix takes, in the order of its shards."""

    sources: DataFrame
    rows: DataFrame
    draws: DataFrame


def key_of(doc_id: Column, text: Column) -> Column:
    """What rows are ordered by in their source, as hex text; equal for rows of the same id and text."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text.cast("string"), F.lit(""))).cast("binary"))


def draw(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, text: str = "text", doc_id: str = "doc_id", source: str = "source", block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, run_rows: int = RUN_ROWS, seed: int = SEED) -> Mix:
    """The mix of docs as numbers: targets, and each taken copy's shard and place in it.

    A row is taken once for each epoch in which the middle of its words lies before the
    target; so taken words miss a target by half a document at most. Null and empty texts
    have no words and are never taken; a null source is one of its own, the last; rows of the
    same source, id and text are copies, told apart by number. Other columns play no part,
    whatever their names. An empty table, or one without words, has no draws.
    """
    if not (0 < share <= repeats and weights and min(weights) > 0 and repeats == int(repeats)):
        raise ValueError("weights must be positive and the share lie in (0, repeats], with whole repeats")
    t, own = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    rows = docs.select(F.col(f"`{source}`").alias("source"), own.alias("doc_id"), size_of(t).alias("size"), key_of(own, t).alias("key"))
    rows = rows.groupBy("source", "key", "size").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    rows = materialize(rows.select("source", F.unhex("key").alias("key"), F.conv(F.substring("key", 1, 8), 16, 10).cast("long").alias("h"), "size", "doc_id", "n"), "rows")
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("rows"))
    quota = F.when(F.col("target") > 0, F.greatest(F.lit(1), F.round(F.col("target") / block_words))).otherwise(0).cast("long")
    sources = materialize(targets(sums, weights, share, repeats).withColumn("quota", quota), "sources")
    most = sources.agg(F.max("rows")).first()[0] or 0
    bits = min(32, max(0, ceil(log2(most / run_rows)))) if most > run_rows else 0
    facts = sources.select(F.col("source").alias("_source"), "sidx", "source_size", "target", "quota")
    placed = rows.join(small_side(facts), F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source").withColumn("run", F.shiftright("h", 32 - bits))
    runs = placed.groupBy("sidx", "run").agg(F.sum(F.col("size") * F.col("n")).alias("w"))
    runs = runs.select("sidx", "run", F.coalesce(F.sum("w").over(Window.partitionBy("sidx").orderBy("run").rowsBetween(*BEFORE)), F.lit(0).cast("long")).alias("before"))
    inside = F.coalesce(F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("sidx", "run").orderBy("key").rowsBetween(*BEFORE)), F.lit(0).cast("long"))
    at = placed.where("size > 0").withColumn("inside", inside).join(runs, ["sidx", "run"])
    copies = at.select("sidx", "key", "size", "source_size", "target", "quota", (F.col("before") + F.col("inside")).alias("at"), F.explode(F.expr("sequence(0L, n - 1)")).alias("copy"))
    epochs = copies.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(int(repeats) - 1))))
    # Twice the middle, so that it is a whole number.
    middle = 2 * (F.col("epoch") * F.col("source_size") + F.col("at") + F.col("copy") * F.col("size")) + F.col("size")
    taken = epochs.withColumn("middle", middle).where(F.col("middle") < 2 * F.col("target"))
    block = F.least(F.floor(F.col("middle") / 2 / (F.col("target") / F.col("quota"))), F.col("quota") - 1)
    taken = taken.select("sidx", "key", "copy", "epoch", "size", block.alias("block"))
    shards = materialize(blocks(sources, shard_blocks, seed), "blocks")
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "key", "copy", "epoch"), "key", "copy", "epoch")
    draws = taken.join(shards, ["sidx", "block"]).withColumn("place", F.row_number().over(local) - 1)
    draws = materialize(draws.select("sidx", "key", "copy", "epoch", "size", "shard", "place"), "draws")
    discard(shards)
    return Mix(sources, rows, draws)


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mixed rows: docs as often as draw() takes them, with shard and place; columns of these names are replaced.

    Rows of the same source, id and text are drawn as one of them. Sorting by place inside a
    shard gives the shuffled order.
    """
    docs = docs.drop("shard", "place")
    renamed, names = numbered(docs)
    t, own, s = (F.col(names[c]) for c in (text, doc_id, source))
    made = draw(renamed, text=names[text], doc_id=names[doc_id], source=names[source], **options)
    drawn = made.draws.join(small_side(made.sources.select("sidx", F.col("source").alias("_source"))), "sidx")
    drawn = drawn.select(F.struct(F.col("_source").alias("s"), F.col("key").alias("k")).alias("_key"), "shard", "place")
    one = renamed.withColumn("_key", F.struct(s.alias("s"), F.unhex(key_of(own, t)).alias("k"))).dropDuplicates(["_key"])
    out = one.join(drawn, "_key")
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "shard", "place")


def digest(docs: DataFrame) -> DataFrame:
    made = draw(docs)
    facts = made.sources.select(F.col("source").alias("_source"), "sidx", "source_size", "target")
    each = made.rows.join(small_side(facts), F.col("source").eqNullSafe(F.col("_source"))).withColumn("copy", F.explode(F.expr("sequence(0L, n - 1)")))
    taken = made.draws.groupBy("sidx", "key", "copy").agg(F.sum("size").alias("taken"))
    return each.join(taken, ["sidx", "key", "copy"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


#: The same as digest() for DuckDB: what the blocks of all shards hold together.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS i
  FROM d GROUP BY source
), p AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS price
  FROM s
), q AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT price FROM p WHERE cap > weight * price ORDER BY cap / weight, i LIMIT 1)), cap) AS target FROM p),
a AS (SELECT *, coalesce(CAST(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS pos FROM d)
SELECT doc_id, size, source_size, target, size * (CASE WHEN 2 * pos + size < 2 * target THEN 1 ELSE 0 END + CASE WHEN 2 * (source_size + pos) + size < 2 * target THEN 1 ELSE 0 END) AS taken
FROM a JOIN q ON a.source IS NOT DISTINCT FROM q.source
"""
