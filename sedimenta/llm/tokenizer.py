"""Corpus encoding with a byte-level BPE vocabulary: numpy merge rounds over many words at once."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.session import free_name, spread

#: Fixed value: the pattern that splits text into words before the merges.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NEVER = np.iinfo(np.int32).max
#: Characters of text that are encoded together, and words kept from earlier batches; memory bounds, not limits on a text.
CHUNK_CHARS = 4_000_000
CACHE_WORDS = 200_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBPE:
    """Merge tables of a byte-level BPE tokenizer file, as arrays sorted by pair key."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for letter, byte in byte_letters().items():
            self.byte_ids[byte] = vocab[letter]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.width = np.int64(max(vocab.values()) + 1)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int32), merged[order]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, offsets) by merge rounds: in each round every word merges
        all places of its lowest-ranked pair, from the left, until no word has a known pair."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        sym = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word = [], []
        while len(sym):
            rank = np.full(len(sym), _NEVER, dtype=np.int32)
            made = np.zeros(len(sym), dtype=np.int32)
            key = sym[:-1].astype(np.int64) * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][known] = self.ranks[at[known]]
            made[:-1][known] = self.merged[at[known]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            per = np.diff(np.r_[starts, len(sym)])
            goal = np.repeat(best, per)
            still = goal != _NEVER
            if not still.all():  # words without a known pair are finished
                done_sym.append(sym[~still]), done_word.append(word[~still])
                sym, word, rank, made, goal = sym[still], word[still], rank[still], made[still], goal[still]
                if not len(sym):
                    break
            take = rank == goal
            # overlapping places (a a a): every second one of a run, from its start
            run_start = take & ~np.r_[False, take[:-1]]
            where = np.flatnonzero(take)
            first = np.maximum.accumulate(np.where(run_start, np.arange(len(take)), 0))
            take[where] = (where - first[where]) % 2 == 0
            sym = np.where(take, made, sym)
            keep = ~np.r_[False, take[:-1]]
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.zeros(0, dtype=np.int32), np.zeros(len(words) + 1, dtype=np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        counts = np.bincount(word, minlength=len(words))
        return sym[order], np.r_[0, np.cumsum(counts)]


class _Encoder:
    """Encodes batches of texts in one worker; ids of frequent words are kept between batches."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe
        self.split = regex.compile(WORD_PATTERN).findall
        self.code: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.code.clear()
        self.ids = np.zeros(0, dtype=np.int32)
        self.offsets = np.zeros(1, dtype=np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets); a null or empty text has none."""
        if len(self.code) > CACHE_WORDS:
            self._reset()
        words: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                found = self.split(text)
                counts[i] = len(found)
                words += found
        if not words:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        new = list(set(words) - self.code.keys())
        if new:
            ids, offsets = self.bpe.encode_words([w.encode("utf-8") for w in new])
            base = len(self.code)
            self.code.update(zip(new, range(base, base + len(new))))
            self.offsets = np.r_[self.offsets, offsets[1:] + len(self.ids)]
            self.ids = np.r_[self.ids, ids]
        code = np.fromiter(map(self.code.__getitem__, words), dtype=np.int64, count=len(words))
        start, size = self.offsets[code], np.diff(self.offsets)[code]
        ends = np.cumsum(size)
        flat = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        at = np.r_[0, np.cumsum(counts)]
        return self.ids[flat], np.r_[0, ends][at]


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about CHUNK_CHARS each; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > CHUNK_CHARS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if batch.num_rows:
        yield batch.slice(start)


def encode(df: DataFrame, bpe: ByteBPE, key: str = "doc_id", text: str = "text", out: str = "ids") -> DataFrame:
    """(key, ``out``: list of ids) of each row's whole text, without special tokens; strings that look like
    special tokens are ordinary text. A null or empty text gives an empty list; repeated keys give
    a row each; an empty table gives no rows; ``out`` gets a leading underscore if it is the key's
    name. No shuffle beyond ``spread``; the merge tables (about 1 MB, fixed by
    the vocabulary) travel with the task."""
    kind, out = df.schema[key].dataType.simpleString(), free_name([key], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(bpe)
        for batch in batches:
            for part in _chunks(batch, 1):
                ids, offsets = encoder(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["k", "ids"])

    return spread(df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))).mapInArrow(run, f"k {kind}, ids array<int>").toDF(key, out)


def count_tokens(df: DataFrame, bpe: ByteBPE, text: str = "text", out: str = "tokens") -> DataFrame:
    """The rows without ``text`` and with their number of ids in ``out`` (bigint; 0 for a null or
    empty text); ``out`` gets a leading underscore while it is a column of ``df``."""
    out = free_name(df.columns, out)
    others = [c for c in df.columns if c != text]
    schema = T.StructType([*[df.schema[c] for c in others], T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(bpe)
        for batch in batches:
            for part in _chunks(batch, len(others)):
                _, offsets = encoder(part.column(len(others)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(offsets), pa.int64())], names=[*others, out])

    return spread(df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").cast("string"))).mapInArrow(run, schema)
