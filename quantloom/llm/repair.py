"""Token ids in binary files, compressed with Re-Pair grammars.

Documents are dealt by doc_id into shards, encoded, and each shard becomes one blob; a file
holds up to SHARDS_A_FILE of them, each followed by a line feed:

    magic "RPG2" | part u32 | shard u32 | first u64 | ids u64 | documents u32 | rules u32
    symbols u64 | base u32 | names u32 | width u8
    names             the documents' ids as a JSON list of strings and nulls, `names` bytes
    documents x u64   end of each document in ids, its end id included
    rules x 2 x u32   the pair that a nonterminal stands for
    rules x u32       how many ids the nonterminal expands to
    samples x u64     how many ids every SAMPLE-th symbol has before it
    symbols x u16     the low halves of the sequence: below `base` an id, else base + rule
    (width - 16) x packed bits of the sequence, the lowest first

All integers are little-endian. `first` counts the ids of the part before the shard. The
most frequent pairs of the sequence are replaced by nonterminals, without overlap, round
after round until no pair is left that LEAST places could take: a rule costs 12 bytes, so
fewer places of 16 bits and more don't pay. Each round counts pairs exactly, and only where
the last one changed something. Expansion lengths and samples find any position without
decoding what lies before it.

Spark writes the files, so that any store will do that it can write, and reads them whole.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.tokens import Encoder, default_tokenizer
from quantloom.sources.stored import new_path

MAGIC = b"RPG2"
HEADER = struct.Struct("<4sIIQQIIQIIB")
END_ID = 2
#: Characters that a shard holds, about; a longer document is a shard of its own.
SHARD_CHARS = 4_000_000
SHARDS_A_FILE = 8
#: Places that a pair must have for a rule to pay.
LEAST = 7
SAMPLE = 1024
#: The rank of a place whose pair doesn't pay.
_NONE = np.int32(2**31 - 1)


def compress(ids: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST, names: list[str | None] | None = None, part: int = 0, shard: int = 0, first: int = 0) -> bytes:
    """The blob of a shard. ids: all ids under `base`; ends: where each document ends in them."""
    seq, pairs = grammar(ids, base, least)
    lengths = _expansions(pairs, base)
    width = max(16, int(base + len(pairs) - 1).bit_length())
    sizes = np.where(seq >= base, lengths[np.maximum(seq.astype(np.int64) - base, 0)] if len(pairs) else 1, 1)
    samples = np.concatenate(([0], np.cumsum(sizes)))[:-1][::SAMPLE] if len(seq) else np.zeros(0)
    named = json.dumps(names if names is not None else [None] * len(ends), ensure_ascii=False).encode("utf-8", "surrogatepass")
    head = HEADER.pack(MAGIC, part, shard, first, len(ids), len(ends), len(pairs), len(seq), base, len(named), width)
    planes = [np.packbits(((seq >> b) & 1).astype(np.uint8), bitorder="little").tobytes() for b in range(16, width)]
    return b"".join([head, named, ends.astype("<u8").tobytes(), pairs.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), samples.astype("<u8").tobytes(), (seq & 0xFFFF).astype("<u2").tobytes(), *planes])


def grammar(ids: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, pairs): ids with pairs replaced until none has `least` places that don't overlap."""
    seq = ids.astype(np.uint32)
    pairs = [np.zeros((0, 2), np.uint32)]
    n_rules = 0
    # Places whose pair the last round may have brought about; at first all.
    look = np.arange(max(len(seq) - 1, 0), dtype=np.int32 if len(seq) < 1 << 31 else np.int64)
    while len(look) >= least:
        every = len(look) == len(seq) - 1
        first, second = (seq[:-1], seq[1:]) if every else (seq[look], seq[look + 1])
        frequent, order = _ranked(first, second, base + n_rules, least)
        if not len(frequent):
            break
        if 8 * len(look) > len(seq):
            by_place = order if every else np.full(len(seq) - 1, _NONE, np.int32)
            if not every:
                by_place[look] = order
            found = by_place != _NONE
            at = _without_overlap_of_all(by_place, found)
            at_order = by_place[at]
        else:
            own = order != _NONE
            found, at_order = look[own], order[own]
            chosen = _without_overlap(found, at_order)
            at, at_order = found[chosen], at_order[chosen]
        # Pairs whose places others took go without a rule; they may come again.
        real = np.bincount(at_order, minlength=len(frequent)) >= least
        if not real.any():
            # Runs of one symbol count twice what can be replaced; without those that are too short go on.
            runs = np.flatnonzero((first == second) & (order != _NONE))
            fit = np.bincount(order[runs[_without_overlap(look[runs], order[runs])]], minlength=len(frequent)) >= least
            short = np.zeros(len(look), bool)
            short[runs[~fit[order[runs]]]] = True
            if short.any():
                look = look[~short]
                continue
            # Each pair alone still has places enough: the most frequent one goes first.
            at = look[order == 0]
            at = at[_without_overlap(at, np.zeros(len(at), np.int64))]
            at_order = np.zeros(len(at), np.int64)
            real[0] = True
        keep = real[at_order]
        at, at_order = at[keep], at_order[keep]
        new = frequent[real]
        pairs.append(np.stack((new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)), axis=1).astype(np.uint32))
        seq[at] = (np.cumsum(real) - 1 + base + n_rules)[at_order]
        n_rules += len(new)
        seq, look = _next(seq, at, found)
    return seq, np.concatenate(pairs)


def _next(seq: np.ndarray, at: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """seq without the second symbols of the places `at`, and where to look now: at new symbols, before them, and `again` (places, or a mark for each)."""
    gone, before = at + 1, at - 1
    if again.dtype == bool:
        left = np.ones(len(seq), bool)
        left[gone] = False
        marks = np.append(again, False)
        # Where the place before is gone, a new symbol stands before that, which is marked.
        marks[at] = marks[before[before >= 0]] = True
        look = np.flatnonzero(marks[left]).astype(np.int32 if len(seq) < 1 << 31 else np.int64)
        seq = seq[left]
    else:
        before = np.where(gone[np.minimum(np.searchsorted(gone, before), len(gone) - 1)] == before, before - 1, before)
        look = np.sort(np.concatenate((again, at, before[before >= 0])))
        look = look[np.concatenate(([True], look[1:] != look[:-1]))]
        passed = np.searchsorted(gone, look).astype(at.dtype)
        look = (look - passed)[gone[np.minimum(passed, len(gone) - 1)] != look]
        seq = _without(seq, gone)
    return seq, look[look < len(seq) - 1]


def _without(seq: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """seq without the ascending places; few are cut out by slices."""
    if len(gone) > 2000:
        left = np.ones(len(seq), bool)
        left[gone] = False
        return seq[left]
    return np.concatenate([seq[a:b] for a, b in zip([0, *(gone + 1).tolist()], [*gone.tolist(), len(seq)], strict=True)])


def _ranked(first: np.ndarray, second: np.ndarray, symbols: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that occur `least` times or more, most frequent first, and for each place the rank of its pair, _NONE for other ones."""
    n, bits = len(first), np.uint64(int(symbols - 1).bit_length())
    place = np.uint64(int(n - 1).bit_length())
    codes = (first.astype(np.uint64) << bits) | second
    if 2 * bits + place <= 64:
        # Pairs and their places are sorted as one number.
        codes <<= place
        codes |= np.arange(n, dtype=np.uint64)
        codes.sort()
        index = (codes & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
        codes >>= place
    else:
        index = np.argsort(codes, kind="stable")
        codes = codes[index]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    counts = np.diff(np.append(starts, n))
    often = np.flatnonzero(counts >= least)
    often = often[np.argsort(-counts[often], kind="stable")]
    rank = np.full(len(starts), _NONE, np.int32)
    rank[often] = np.arange(len(often), dtype=np.int32)
    order = np.empty(n, np.int32)
    order[index] = np.repeat(rank, counts)
    code = codes[starts[often]]
    return ((code >> bits) << np.uint64(32)) | (code & ((np.uint64(1) << bits) - np.uint64(1))), order


def _without_overlap_of_all(order: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The places to take where all have an order, _NONE where not `found`: what _without_overlap() takes."""
    win = found.copy()
    less = order[1:] < order[:-1]
    win[:-1] &= order[:-1] < order[1:]
    win[1:] &= less
    rest = found & ~win
    rest[1:] &= ~win[:-1]
    rest[:-1] &= ~win[1:]
    rest = np.flatnonzero(rest)
    win[rest[_without_overlap(rest, order[rest])]] = True
    return np.flatnonzero(win)


def _without_overlap(at: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which of the ascending places to take: of neighbours the one of lower order, of equal ones every other."""
    taken = np.zeros(len(at), bool)
    i = np.arange(len(at), dtype=at.dtype)
    while len(i):
        p, o = at[i], order[i]
        touch = p[1:] - p[:-1] == 1
        step = o[1:] - o[:-1]
        # Runs of one order among neighbours; one gives way if a neighbour of lower order touches either of its ends.
        start = np.flatnonzero(np.concatenate(([True], ~(touch & (step == 0)))))
        length = np.diff(np.append(start, len(i)))
        beaten = np.concatenate(([False], touch & (step > 0)))[start] | np.concatenate((touch & (step < 0), [False]))[start + length - 1]
        single = length == 1
        win = np.zeros(len(i), bool)
        win[start[single & ~beaten]] = True
        for s, n in zip(start[~single & ~beaten].tolist(), length[~single & ~beaten].tolist(), strict=True):
            win[s : s + n : 2] = True
        taken[i[win]] = True
        stays = ~win
        stays[1:] &= ~(win[:-1] & touch)
        stays[:-1] &= ~(win[1:] & touch)
        i = i[stays]
    return taken


def _expansions(pairs: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to; a rule refers to earlier rules only."""
    out: list[int] = []
    for a, b in pairs.tolist():
        out.append((1 if a < base else out[a - base]) + (1 if b < base else out[b - base]))
    return np.array(out, np.int64)


class Shard:
    """A parsed blob."""

    def __init__(self, blob: bytes, at: int = 0) -> None:
        magic, self.part, self.shard, self.first, self.ids, docs, rules, self.symbols, self.base, named, self.width = HEADER.unpack_from(blob, at)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self.blob = blob
        at += HEADER.size
        self.named = (at, at + named)
        at += named
        self.ends = np.frombuffer(blob, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        self.pairs = np.frombuffer(blob, "<u4", 2 * rules, at).reshape(-1, 2)
        at += 8 * rules
        self.lengths = np.frombuffer(blob, "<u4", rules, at).astype(np.int64)
        at += 4 * rules
        n = -(-self.symbols // SAMPLE)
        self.samples = np.frombuffer(blob, "<u8", n, at).astype(np.int64)
        self.at = at + 8 * n
        #: Where the next blob of the file begins: after the planes of high bits and a line feed.
        self.end = self.at + 2 * self.symbols + (self.width - 16) * -(-self.symbols // 8) + 1

    def names(self) -> list[str | None]:
        return json.loads(self.blob[slice(*self.named)].decode("utf-8", "surrogatepass"))

    def sequence(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Symbols lo to hi; lo is a multiple of 8."""
        hi = self.symbols if hi is None else min(hi, self.symbols)
        out = np.frombuffer(self.blob, "<u2", hi - lo, self.at + 2 * lo).astype(np.uint32)
        plane = -(-self.symbols // 8)
        for k in range(self.width - 16):
            bits = np.frombuffer(self.blob, np.uint8, -(-hi // 8) - lo // 8, self.at + 2 * self.symbols + k * plane + lo // 8)
            out |= np.unpackbits(bits, bitorder="little")[: hi - lo].astype(np.uint32) << np.uint32(16 + k)
        return out


def _expand(seq: np.ndarray, pairs: np.ndarray, base: int) -> np.ndarray:
    """All nonterminals of seq written out; one pass for each level of nesting."""
    # The first and second half of every symbol; one that isn't a rule is its own first half.
    left = np.concatenate((np.arange(base), pairs[:, 0])).astype(np.uint32)
    right = pairs[:, 1].astype(np.uint32)
    while True:
        at = np.flatnonzero(seq >= base)
        if not len(at):
            return seq
        out = np.empty(len(seq) + len(at), np.uint32)
        second = at + np.arange(1, len(at) + 1)
        first = np.ones(len(out), bool)
        first[second] = False
        out[first] = left[seq]
        out[second] = right[seq[at] - base]
        seq = out


def _ids_of(s: Shard) -> np.ndarray:
    """All ids of a shard."""
    size = int(s.lengths.sum())
    if size > s.ids:
        return _expand(s.sequence(), s.pairs, s.base).astype("<u4", copy=False)
    # Each rule is written out once, then symbols are copied.
    table = np.concatenate((np.arange(s.base), _expand(np.arange(s.base, s.base + len(s.pairs)), s.pairs, s.base))).astype("<u4")
    offsets = 4 * np.concatenate((np.arange(s.base + 1), s.base + np.cumsum(s.lengths)))
    symbols = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(table)])
    return np.frombuffer(symbols.take(pa.array(s.sequence())).buffers()[2] or b"", "<u4", s.ids)


def decode(blob: bytes, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends) of the shard at an offset."""
    s = Shard(blob, at)
    return _ids_of(s), s.ends


def decode_range(blob: bytes, start: int, stop: int, at: int = 0) -> np.ndarray:
    """Ids start to stop of a shard; only the samples' blocks that reach into the range are read and expanded."""
    s = Shard(blob, at)
    start, stop = max(start, 0), min(stop, s.ids)
    if start >= stop:
        return np.zeros(0, "<u4")
    first = int(np.searchsorted(s.samples, start, "right")) - 1
    last = int(np.searchsorted(s.samples, stop, "left"))
    seq = s.sequence(first * SAMPLE, last * SAMPLE)
    rule = seq >= s.base
    size = np.ones(len(seq), np.int64)
    size[rule] = s.lengths[seq[rule] - s.base]
    ends = np.cumsum(size) + int(s.samples[first])
    lo, hi = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    skipped = int(ends[lo - 1]) if lo else int(s.samples[first])
    return _expand(seq[lo:hi], s.pairs, s.base)[start - skipped : stop - skipped].astype("<u4")


def shards_of(content: bytes) -> Iterator[Shard]:
    """The shards of a file."""
    at = 0
    while at < len(content):
        shard = Shard(content, at)
        at = shard.end
        yield shard


def write_files(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, shard_chars: int = SHARD_CHARS) -> int:
    """Write the ids of every whole text and END_ID into files of the format in the new folder `path`.

    Shards follow ascending doc_id over (part, shard), null first; repeated ids stand in the
    order of a hash of their texts, then as they come: many equal ones spread over parts.
    doc_id may be of any type with an order and a string form. Null and empty texts give the
    end id alone. A very long text is a shard of its own. Without rows there is no shard.
    Files are never compressed by an output codec of the cluster. Gives the number of documents written.
    """
    tokens = tokenizer or default_tokenizer()
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    own = own.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = ["doc_id", "hash", "row"]
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.spark_partition_id().alias("part"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokens)
        base = encoder.tokenizer.get_vocab_size()
        ids: list[np.ndarray] = []
        names: list[str | None] = []
        ends: list[np.ndarray] = []
        chars = total = shard = part = first = 0

        def flush() -> pa.RecordBatch:
            blob = compress(np.concatenate(ids), np.concatenate(ends), base, LEAST, names, part, shard, first)
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()), pa.array([len(names)], pa.int64())], ["blob", "documents"])

        for batch in batches:
            for at, own_ids, counts in encoder.blocks(batch["text"]):
                own_ends = np.cumsum(counts)
                own_ids = np.insert(own_ids, own_ends, END_ID)
                own_ends = own_ends + np.arange(1, len(counts) + 1)
                docs = batch.slice(at, len(counts))
                own_names, sizes = docs["doc_id"].to_pylist(), pc.utf8_length(docs["text"]).to_pylist()
                i = 0
                while i < len(sizes):
                    # Documents i to j still go into the shard; a first one always does.
                    j = i
                    while j < len(sizes) and (j == i and not names or chars + sizes[j] <= shard_chars):
                        chars += sizes[j]
                        j += 1
                    if i < j:
                        start = int(own_ends[i - 1]) if i else 0
                        ids.append(own_ids[start : own_ends[j - 1]])
                        ends.append(own_ends[i:j] - start + total)
                        total += int(own_ends[j - 1]) - start
                        names += own_names[i:j]
                        part = docs["part"][0].as_py()
                    if j < len(sizes):
                        yield flush()
                        first += total
                        ids, names, ends, chars, total, shard = [], [], [], 0, 0, shard + 1
                    i = j
        if names:
            yield flush()

    seen = Observation()
    blobs = dealt.mapInArrow(encode, "blob binary, documents long").observe(seen, F.sum("documents").alias("documents"))
    # A string of any bytes is written as it is, and a line feed after it.
    blobs.select(F.col("blob").cast("string").alias("value")).write.option("maxRecordsPerFile", SHARDS_A_FILE).option("compression", "none").text(path)
    return seen.get["documents"] or 0


def read_ids(spark: SparkSession, path: str, documents: int | None = None) -> DataFrame:
    """(doc_id string, start, n_tokens, ids_crc32) of every document, from the files in `path` alone.

    Two numbers for each part reach the driver: how many ids and documents it has. Other than
    `documents` in all, where that is given, are an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = [(s.part, s.first + s.ids, len(s.ends)) for s in shards_of(content)]
                yield pd.DataFrame(rows, columns=["part", "n", "documents"])

    sizes = sorted(files.mapInPandas(totals, "part long, n long, documents long").groupBy("part").agg(F.max("n"), F.sum("documents")).collect())
    found = sum(r[2] for r in sizes)
    if documents is not None and found != documents:
        raise RuntimeError(f"{documents} documents were written to {path}, its files hold {found}")
    starts, at = {}, 0
    for part, n, _ in sizes:
        starts[part] = at
        at += n

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for shard in shards_of(content):
                    begins = np.concatenate(([0], shard.ends[:-1]))
                    view = memoryview(np.ascontiguousarray(_ids_of(shard))).cast("B")
                    crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(begins.tolist(), shard.ends.tolist(), strict=True)]
                    yield pd.DataFrame({"doc_id": shard.names(), "start": begins + starts[shard.part] + shard.first, "n_tokens": shard.ends - begins, "ids_crc32": crc})

    return files.mapInPandas(read, "doc_id string, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id (of the type it has in docs), start, n_tokens and ids_crc32 from files written to the shared folder."""
    path = new_path(docs.sparkSession, "ids")
    written = write_files(docs.select("doc_id", "text"), path)
    return read_ids(docs.sparkSession, path, written).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
