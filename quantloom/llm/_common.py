"""Helpers shared by the corpus operators: shared-folder tables, global ranks, let-bindings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.sources.stored import _MADE, remove, stored

#: Words are maximal runs of anything but the ASCII white space 0x20 and 0x09-0x0D.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    return stored(df, label)


def discard(df: DataFrame) -> None:
    """Remove a table made by materialize()."""
    path = getattr(df, "_quantloom_path", None)
    if path:
        remove(df.sparkSession, path)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that operators write to the shared folder inside are removed at the end.

    Operators return lazy frames over such tables: write the result inside, to a place of
    your own or with materialize(), and add it to the list that this gives. Tables made
    before stay.
    """
    before, keep = set(_MADE), []
    try:
        yield keep
    finally:
        kept = {getattr(df, "_quantloom_path", None) for df in keep}
        for path in [p for p in _MADE if p not in before and p not in kept]:
            remove(spark, path)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1 and so on, which clash with no working column, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def restored(df: DataFrame, names: dict[str, str], **changed: Column) -> DataFrame:
    """The columns that numbered() renamed under their own names, those in `changed` with new values."""
    return df.select(*[changed.get(c, F.col(n)).alias(c) for c, n in names.items()])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also inside lambdas of body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), ASCII_SPACE), "")


def global_rank(df: DataFrame, order: list[Column], label: str, rank: str = "_rank") -> DataFrame:
    """df with a dense 0-based rank in the given order, and no window over all rows.

    The rows are dealt by range and sorted, numbered inside their partition by
    monotonically_increasing_id() and written to the shared folder; what reaches the
    driver is one count for each partition. Rows equal in `order` stand in that of their
    input, which is part of the range key: many equal ones spread over partitions.
    """
    spark = df.sparkSession
    order = [*order, F.col("_tie")]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    kept = materialize(dealt.withColumn("_mid", F.monotonically_increasing_id()), label)
    part, index = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(kept.groupBy(part.alias("part")).agg((F.max(index) + 1).alias("n")).collect())
    starts, at = [], 0
    for p, n in counts:
        starts.append((p, at))
        at += n
    table = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "_part long, _start long"))
    out = kept.join(table, part == F.col("_part")).withColumn(rank, F.col("_start") + index)
    out = out.drop("_part", "_start", "_mid")
    out._quantloom_path = kept._quantloom_path
    return out


#: Rows of a side that small_side() lets be broadcast.
SMALL_ROWS = 100_000


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, a table that was counted to be small, to be broadcast; unchanged with more rows, where joins deal both sides."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).collect()) <= rows else df


def quoted(value: str) -> str:
    """value as a SQL string."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(value: str, name: str, body: str) -> str:
    """SQL of body with `name` standing for value, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def running(values: str, zero: str, op: str, block: int = 64) -> str:
    """SQL: for each element of the array `values`, op (as '(a, y) -> ...') over the elements before it, from zero.

    The array is cut into blocks and the blocks' totals are run first, so the work is far
    from quadratic and no growing array is copied.
    """
    numbers = f"sequence(0, cast(ceil(size(v) / {block}) as int) - 1)"
    own = f"slice(v, b * {block} + 1, {block})"
    firsts = bound(f"transform({numbers}, b -> aggregate({own}, {zero}, {op}))", "t", f"transform({numbers}, b -> aggregate(slice(t, 1, b), {zero}, {op}))")
    inside = bound(own, "w", f"transform(w, (z, i) -> aggregate(slice(w, 1, i), first, {op}))")
    return bound(values, "v", f"case when size(v) = 0 then v else flatten(transform({firsts}, (first, b) -> {inside})) end")


def spans_of(text: str, pattern: str, context: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<s int, e int, m string>>, in code points. text: SQL.

    The pieces between the matches give the positions, so that the work stays in two
    passes of the regex engine. With `context`, l and r are that many characters before
    and after the match, up to the neighbouring matches.
    """
    starts = running("transform(f.m, (x, i) -> length(x) + length(get(f.g, i)))", "0", "(a, y) -> a + y")
    sides = f", 'l', right(get(f.g, i), {context}), 'r', left(get(f.g, i + 1), {context})" if context else ""
    span = bound("get(p, i) + length(get(f.g, i))", "s", f"named_struct('s', s, 'e', s + length(x), 'm', x{sides})")
    walk = f"case when size(f.m) = 0 then {no_spans(context)} else {bound(starts, 'p', f'transform(f.m, (x, i) -> {span})')} end"
    return F.expr(bound(f"named_struct('m', regexp_extract_all({text}, {quoted(pattern)}, 0), 'g', split({text}, {quoted(pattern)}, -1))", "f", walk))


def apart(spans: str, others: str) -> Column:
    """The spans, sorted and without overlaps among themselves, that overlap none of `others`, which may overlap. Both SQL."""
    last = str((1 << 31) - 1)
    marked = "array_sort(concat(transform(f.o, y -> named_struct('s', y.s, 'e', y.e, 'i', -1)), transform(f.x, (y, i) -> named_struct('s', y.s, 'e', y.e, 'i', i))))"
    ended = running("transform(c, y -> if(y.i < 0, y.e, 0))", "0", "(a, y) -> greatest(a, y)")
    begun = running(f"reverse(transform(c, y -> if(y.i < 0, y.s, {last})))", last, "(a, y) -> least(a, y)")
    kept = "filter(c, (y, k) -> y.i >= 0 and get(n.a, k) <= y.s and get(n.b, k) >= y.e)"
    free = bound(f"named_struct('a', {ended}, 'b', reverse({begun}))", "n", f"transform({kept}, y -> get(f.x, y.i))")
    return F.expr(bound(f"named_struct('x', {spans}, 'o', {others})", "f", f"case when size(f.x) = 0 or size(f.o) = 0 then f.x else {bound(marked, 'c', free)} end"))


#: Characters of a text that one piece holds where it is cut at many places.
CHUNK_CHARS = 1024


def replaced(text: str, spans: str, mark: str) -> Column:
    """text with the (maybe overlapping) spans replaced by mark, overlapping ones by one. Both SQL.

    The text is cut into chunks first, so that a span costs no walk over all before it.
    """
    n = CHUNK_CHARS

    def cut(s: str, e: str) -> str:
        piece = lambda i, lo, k: f"coalesce(substring(get(f.c, {i}), {lo}, {k}), '')"
        whole = f"array_join(slice(f.c, q.s div {n} + 2, greatest(q.e div {n} - q.s div {n} - 1, 0)), '')"
        apart = f"concat({piece(f'q.s div {n}', f'q.s % {n} + 1', n)}, {whole}, {piece(f'q.e div {n}', 1, f'q.e % {n}')})"
        # div gives bigint, which array positions don't take.
        apart, near = (x.replace(f"q.s div {n}", f"int(q.s div {n})").replace(f"q.e div {n}", f"int(q.e div {n})") for x in (apart, piece(f"q.s div {n}", f"q.s % {n} + 1", "q.e - q.s")))
        return bound(f"named_struct('s', {s}, 'e', {e})", "q", f"case when q.s div {n} = q.e div {n} then {near} else {apart} end")

    at = f"array_sort(transform({spans}, y -> named_struct('s', y.s, 'e', y.e)))"
    ended = running("transform(f.x, y -> y.e)", "0", "(a, y) -> greatest(a, y)")
    gaps = bound(ended, "p", f"transform(f.x, (y, i) -> case when y.s < get(p, i) then '' else concat({cut('get(p, i)', 'y.s')}, {quoted(mark)}) end)")
    walk = f"concat(array_join({gaps}, ''), {cut('array_max(transform(f.x, y -> y.e))', 'length(f.t)')})"
    pieces = f"regexp_extract_all({text}, {quoted('(?s).{1,%d}' % n)}, 0)"
    return F.expr(f"case when size({spans}) = 0 then {text} else {bound(f"named_struct('x', {at}, 'c', {pieces}, 't', {text})", 'f', walk)} end")


def no_spans(context: int = 0) -> str:
    """SQL of an empty array of spans."""
    return "cast(array() as array<struct<s:int,e:int,m:string" + (",l:string,r:string" if context else "") + ">>)"


def written(spans: Column, kind: str) -> Column:
    """Spans as array of 'kind:start:end'."""
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
