"""Encoding with a public tokenizer, exact length histograms and totals for every context limit.

A byte-level BPE tokenizer never merges over the start of a white-space run between two
words, so a text is cut before every white-space character that stands alone between two
non-space ones; the pieces are encoded once for each worker and looked up from then on.
Where ids are asked for, pieces also end before a mark after a Latin letter and after such
a line break, which no word of the tokenizer spans either, and Arrow finds equal ones. The
ids are those of the tokenizer on the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm._common import materialize

#: Pieces that a worker remembers, and the longest one, in characters; neither changes a result.
CACHE_PIECES, CACHE_CHARS = 800_000, 40
#: Characters that are looked up at a time, about; bytes of them where ids are asked for.
BATCH_CHARS, BATCH_BYTES = 1_000_000, 4_000_000
_PIECES = re.compile(r"(?<=\S)(?=\s\S)")
#: White space that isn't a space or a line break.
_OTHER = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_SPACED, _BROKEN, _WORD = (re.compile(x) for x in (r" \S+\Z", r"\n\S+\Z", r" \S+\Z"))
#: White space of more than one byte, as numbers; whether a byte is a letter from A to z.
_WIDE = [int.from_bytes(c.encode(), "big") for c in _OTHER if not c.isascii()]
_LETTER = np.array([chr(i).isascii() and chr(i).isalpha() for i in range(256)])
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Where an added token would be cut, and one that could stand in words of Latin letters.
_MARKED, _PLAIN = re.compile(rf"[{_LATIN}][!-&(-.:;?]|\s"), re.compile(rf"[{_LATIN} \n]*\Z")
#: The characters that stand for bytes in a byte-level vocabulary, and tokens that reach over the start of a word of Latin letters.
_SHOWN = [i for i in range(256) if 33 <= i < 127 or 161 <= i and i != 173]
_CHARS = "".join(chr(i) if i in _SHOWN else chr(256 + i - sum(j < i for j in _SHOWN)) for i in range(256))
_OF_WORDS = "".join(c for i, c in enumerate(_CHARS) if _LETTER[i] or 0x80 <= i < 0xC0 or 0xC3 <= i <= 0xC9)
_JOINED = re.compile(f"(?=[{_OF_WORDS}ĠĊ]*\\Z).*([{_OF_WORDS}][ĠĊ]|Ċ[{_OF_WORDS}])")
#: Pieces that are encoded as one text.
_GROUP = 1000
#: Words of Latin letters that go to the tokenizer's model as one.
_RUN = 16
_ENCODERS: dict[str, Encoder] = {}
#: Lengths that share one block of the two-level suffix sums.
BLOCK = 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer file of the tokenizers library, without special tokens added."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if type(self.tokenizer.pre_tokenizer).__name__ != "ByteLevel" or self.tokenizer.normalizer is not None:
            raise ValueError("a byte-level BPE tokenizer without a normalizer is needed")
        # How many bytes each id stands for: one character of a token's name is one byte.
        added = {t.content: len(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()}
        vocab = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.sizes[i] = added.get(token, len(token))
        self.marks = not any(_MARKED.search(t) for t in added)
        # Whether words of Latin letters, each after a space or line break, have the same ids in one run as alone.
        self.joins = not any(map(_JOINED.match, vocab)) and not any(map(_PLAIN.match, added)) and not getattr(self.tokenizer.model, "ignore_merges", False)
        # Pieces and the bytes of their ids; counting needs no more than how many they are.
        self.pieces, self.ids = pa.array([], pa.binary()), pa.array([], pa.binary())
        self.counts: dict[str, int] = {}

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]

    def _runs(self, new: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, ids, starts, ends): where the ids of each key's piece stand. Regular pieces are encoded as one text and cut by their bytes."""
        regular = [k for k in new if k[0] != " " or _WORD.match(k)]
        odd = [k for k in new if k[0] == " " and not _WORD.match(k)]
        # A key without white space stands for the word after a space; a raw word follows a line break that is taken off again.
        texts = [k if k[0] == "\n" else "\n" + k[1:] if k[0] == " " else " " + k for k in regular]
        groups = range(0, len(regular), _GROUP)
        encoded = self.tokenizer.encode_batch_fast(["".join(texts[i : i + _GROUP]) for i in groups] + [k[1:] for k in odd], add_special_tokens=False)
        for k, e in zip(odd, encoded[len(groups) :], strict=True):
            yield [k], np.array(e.ids, "<u4"), np.array([0]), np.array([len(e.ids)])
        for i, e in zip(groups, encoded, strict=False):
            keys, ids = regular[i : i + _GROUP], np.array(e.ids, "<u4")
            last = np.cumsum([len(t) if t.isascii() else len(t.encode()) for t in texts[i : i + _GROUP]])
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), last) + 1
            starts = np.concatenate(([0], ends[:-1])) + np.array([k[0] == " " for k in keys])
            yield keys, ids, starts, ends

    def _encoded(self, new: pa.Array) -> pa.Array:
        """The bytes of the ids of each piece."""
        plain = pc.match_substring_regex(new, f"^ ?[{_LATIN}]+$") if self.joins else pa.repeat(False, len(new))
        rest = new.filter(pc.invert(plain)).to_pylist()
        keys = [p[1:] if _SPACED.match(p) else " " + p for p in rest]
        found = {}
        for own, ids, starts, ends in self._runs(keys):
            raw = ids.tobytes()
            found.update(zip(own, [raw[x:y] for x, y in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)], strict=True))
        out = pa.concat_arrays([self._words(new.filter(plain)), pa.array([found[k] for k in keys], pa.large_binary())])
        return out.take(pa.array(np.argsort(np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable"))))

    def _words(self, words: pa.Array) -> pa.Array:
        """The bytes of the ids of words of Latin letters, with a space before them or without: these follow a line break that is taken off again."""
        if not len(words):
            return pa.array([], pa.large_binary())
        bare = pc.invert(pc.starts_with(words, " "))
        texts = pc.if_else(bare, pc.binary_replace_slice(words, 0, 0, "\n"), words)
        last = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1)[1:]
        whole = texts.buffers()[2].to_pybytes()[: last[-1]].decode("latin-1").translate(_CHARS)
        cuts = [0, *last[_RUN - 1 : -1 : _RUN].tolist(), len(whole)]
        model = self.tokenizer.model
        ids = np.array([t.id for i, j in zip(cuts, cuts[1:], strict=False) for t in model.tokenize(whole[i:j])], "<u4")
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), last) + 1
        bare = bare.to_numpy(zero_copy_only=False)
        ids = np.delete(ids, np.concatenate(([0], ends))[:-1][bare])
        offsets = 4 * np.concatenate(([0], ends - np.cumsum(bare)))
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])

    def _counted(self, new: list[str]) -> dict[str, int]:
        out = {}
        for keys, _, starts, ends in self._runs(new):
            out.update(zip(keys, (ends - starts).tolist(), strict=True))
        return out

    def _learn(self, texts: list[str | None], known: dict[str, object], find: Callable[[list[str]], dict[str, object]]) -> tuple[list, np.ndarray]:
        """What `find` makes of all pieces of the texts, in order, and how many pieces each text has. `known` remembers it."""
        keys: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                own = _keys(t)
                sizes[i] = len(own)
                keys += own
        out = list(map(known.get, keys))
        missing = [i for i, found in enumerate(out) if found is None]
        if missing:
            fresh = find(list({keys[i] for i in missing}))
            for i in missing:
                out[i] = fresh[keys[i]]
            if len(known) + len(fresh) > CACHE_PIECES:
                known.clear()
            known.update((k, found) for k, found in fresh.items() if len(k) <= CACHE_CHARS)
        return out, sizes

    @staticmethod
    def _totals(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(counts)))
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, ids, counts in self.blocks(pa.array(texts, pa.large_string())):
            out += np.split(ids, np.cumsum(counts)[:-1])
        return out

    def blocks(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the first text, ids of all, how many each has) for runs of about BATCH_BYTES; null and empty texts have no ids."""
        texts = texts.cast(pa.large_string()).fill_null("")
        at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        cuts = np.flatnonzero(np.diff((at[1:] - at[0]) // BATCH_BYTES)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
            if i < j:
                yield i, *self._ids_of(data[at[i] : at[j]], at[i : j + 1] - at[i])
                # Else Arrow's pool holds on to about 100 MB in each worker.
                pa.default_memory_pool().release_unused()

    def _ids_of(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the texts that stand in the UTF-8 bytes `data` between the places `at`."""
        begins = _begins(data, at, self.marks)
        if not len(begins):
            return np.zeros(0, "<u4"), np.zeros(len(at) - 1, np.int64)
        kind, whole = (pa.binary(), np.int32) if len(data) < 1 << 28 else (pa.large_binary(), np.int64)
        offsets = np.append(begins, len(data)).astype(whole)
        pieces = pa.Array.from_buffers(kind, len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        # Equal pieces have one number; those that are known stand first.
        coded = pa.chunked_array([self.pieces.cast(kind), pieces]).dictionary_encode()
        coded = coded.chunk(coded.num_chunks - 1)
        new = self._encoded(coded.dictionary[len(self.pieces) :].cast(pa.large_string()))
        ids = pa.concat_arrays([self.ids.cast(kind), new.cast(kind)])
        own = ids.take(coded.indices)
        self._remember(coded.dictionary, ids, coded.indices)
        ends = np.frombuffer(own.buffers()[1], whole, len(own) + 1).astype(np.int64) // 4
        return np.frombuffer(own.buffers()[2] or b"", "<u4", int(ends[-1])), np.diff(ends[np.searchsorted(begins, at)])

    def _remember(self, pieces: pa.Array, ids: pa.Array, used: pa.Array) -> None:
        """Short pieces are kept; if they are too many, those of the last block alone, the first CACHE_PIECES of them."""
        keep = np.diff(np.frombuffer(pieces.buffers()[1], np.int32 if pieces.type == pa.binary() else np.int64, len(pieces) + 1)) <= CACHE_CHARS
        if np.count_nonzero(keep) > CACHE_PIECES:
            seen = np.zeros(len(keep), bool)
            seen[used.to_numpy()] = True
            keep &= seen
            keep &= np.cumsum(keep) <= CACHE_PIECES
        if not keep.all():
            pieces, ids = pieces.filter(pa.array(keep)), ids.filter(pa.array(keep))
        self.pieces, self.ids = pieces.cast(pa.binary()), ids.cast(pa.binary())

    def count_all(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        for own in _some(texts):
            counts, sizes = self._learn(own, self.counts, self._counted)
            out += self._totals(np.fromiter(counts, np.int64, len(counts)), sizes).tolist()
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]


def _keys(text: str) -> list[str]:
    """The pieces of a text: a word after a space as it is, one after a line break with it, others after a mark (a space)."""
    # Spaces and line breaks that don't stand alone between words leave fewer words than these would; other white space would make up for them.
    if len(text.split()) != text.count(" ") + text.count("\n") + 1 or any([c in text for c in _OTHER]):
        return [p[1:] if _SPACED.match(p) else p if _BROKEN.match(p) else " " + p for p in _PIECES.split(text)]
    own = text.replace("\n", " \n").split(" ")
    own[0] = " " + own[0]
    return own


def _begins(data: np.ndarray, at: np.ndarray, marks: bool) -> np.ndarray:
    """Where the pieces of the texts between the places `at` begin in their bytes, ascending."""
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    space = np.flatnonzero((data == 32) | (data == 10))
    space = space[~(edge[space] | edge[space + 1])]
    # It stands alone if neither neighbour is white: no control character or space, and no wider white space.
    before, after = data[space - 1], data[space + 1]
    alone = (before > 32) & (after > 32)
    wide = np.flatnonzero(alone & ((before > 127) | (after > 127)))
    if len(wide):
        i = space[wide]
        x = [data[np.minimum(i + k, len(data) - 1)].astype(np.int32) for k in (-3, -2, -1, 1, 2, 3)]
        white = [np.isin(x[a] << 8 | x[b], _WIDE) for a, b in ((1, 2), (3, 4))] + [np.isin(x[a] << 16 | x[a + 1] << 8 | x[a + 2], _WIDE) for a in (0, 3)]
        alone[wide] = ~np.logical_or.reduce(white)
    space = space[alone]
    if marks:
        mark = np.flatnonzero(((data - np.uint8(33) < 14) & (data != 39)) | (data == 58) | (data == 59) | (data == 63))
        before, lead = data[mark - 1], data[mark - 2]
        edge[mark[_LETTER[before] | ((lead == 0xC3) & (before != 0x97) & (before != 0xB7))]] = True
        edge[space[data[space] == 10] + 1] = True
    edge[space] = True
    return np.flatnonzero(edge[:-1])


def _some(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in lists of about BATCH_CHARS characters."""
    own, n = [], 0
    for t in texts:
        own.append(t)
        n += len(t or "")
        if n >= BATCH_CHARS:
            yield own
            own, n = [], 0
    if own:
        yield own


def with_lengths(docs: DataFrame, text: str = "text", column: str = "n_tokens", tokenizer: str | None = None) -> DataFrame:
    """docs with the encoded length of every whole text (null and empty: 0); a column of that name is replaced, rows stay as they are."""
    path = tokenizer or default_tokenizer()

    @F.pandas_udf("long")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder.of(path)
        for texts in batches:
            yield pd.Series(encoder.count_all(list(texts)), dtype="int64")

    return docs.withColumn(column, lengths(F.col(f"`{text}`")))


def with_id_bytes(docs: DataFrame, text: str = "text", column: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """docs with the ids of every whole text as little-endian 32-bit numbers in binary (null and empty: none); a column of that name is replaced, rows stay as they are."""
    path = tokenizer or default_tokenizer()

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder.of(path)
        for texts in batches:
            yield pd.Series([x.astype("<u4", copy=False).tobytes() for x in encoder.encode_all(list(texts))], dtype=object)

    return docs.withColumn(column, ids(F.col(f"`{text}`")))


def histogram(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length. Each partition counts its own first.

    Null and empty texts have length 0; repeated rows count each; very long texts are
    encoded whole; other columns play no part, whatever their names. Empty in, empty out.
    """
    return with_lengths(docs.select(F.col(f"`{text}`").alias("text")), "text", "n_tokens", tokenizer).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_totals(hist: DataFrame) -> DataFrame:
    """One row for each length of a histogram (n_tokens, n_docs), taken as a context limit.

    n_longer: documents over the limit; tokens_within: tokens of those that fit;
    tokens_truncated: tokens left if every document is cut at the limit; n_within and
    share_within answer quantiles. The sums run in blocks of BLOCK lengths, then over the
    blocks, so no task orders all lengths; n_docs adds up over repeated lengths. Empty in,
    empty out.
    """
    hist = materialize(hist.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK)), "histogram")
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(before), zero).alias("d0"), F.coalesce(F.sum("t").over(before), zero).alias("t0"), F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("t_all"))
    within = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(blocks, "block").withColumns({"n_within": F.col("d0") + F.sum("n_docs").over(within), "tokens_within": F.col("t0") + F.sum(tokens).over(within)})
    return out.select(
        "n_tokens",
        "n_docs",
        "n_within",
        (F.col("d_all") - F.col("n_within")).alias("n_longer"),
        "tokens_within",
        (F.col("tokens_within") + (F.col("d_all") - F.col("n_within")) * F.col("n_tokens")).alias("tokens_truncated"),
        F.col("t_all").alias("tokens_total"),
        (F.col("n_within") / F.col("d_all")).alias("share_within"),
    )


def at_limits(totals: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, n_longer, tokens_truncated) for any limits, of the result of context_totals()."""
    asked = totals.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    fits = F.coalesce(F.max(F.when(F.col("n_tokens") <= F.col("limit"), F.struct("n_tokens", "n_within", "tokens_within"))), F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_within", "tokens_within")]))
    joined = totals.join(F.broadcast(asked)).groupBy("limit").agg(fits.alias("x"), F.max(F.col("n_within") + F.col("n_longer")).alias("all"))
    over = F.col("all") - F.col("x.n_within")
    return joined.select("limit", over.alias("n_longer"), (F.col("x.tokens_within") + over * F.col("limit")).alias("tokens_truncated"))


def quantile(totals: DataFrame, q: float) -> int | None:
    """The smallest length that a share q of the documents doesn't exceed."""
    return totals.where(F.col("share_within") >= q).agg(F.min("n_tokens")).first()[0]


def digest(docs: DataFrame) -> DataFrame:
    return context_totals(histogram(docs))
