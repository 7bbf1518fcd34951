"""Encoding of a corpus with a public byte-level BPE vocabulary.

Each distinct word of a text is merged once and remembered. A word is merged on
a contiguous array of part boundaries beside an array with the rank of each
adjacent pair: find the least rank, delete the boundary inside that pair, and
refresh the ranks of the two pairs that touch it. That is quadratic in the
length of a word, so words beyond ``HEAP_FROM`` bytes take the same merges from
a heap of pairs over a linked list.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cardmill.sources.tables import spread, table

VOCABULARY = "byte_bpe_50k"
NO_RANK = 1 << 60
HEAP_FROM = 200
#: Words kept per Python worker; beyond it the memory starts anew.
CACHED_WORDS = 400_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(f"{name}.tiktoken"))


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


class Encoder(dict):
    """Maps a word (str) to its ids (tuple); merges unseen words on first use."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        super().__init__()
        self.ranks = ranks
        self.words = regex.compile(pattern).findall

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self[word] = self.merge(word.encode("utf-8", "replace"))
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.words(text))))

    def count(self, text: str) -> int:
        return sum(map(len, map(self.__getitem__, self.words(text))))

    def merge(self, word: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(word)
        if whole is not None:
            return (whole,)
        ends = self._merge_long(word) if len(word) > HEAP_FROM else self._merge_short(word)
        return tuple(self.ranks[word[a:b]] for a, b in zip(ends, ends[1:]))

    def _merge_short(self, word: bytes) -> list[int]:
        rank = self.ranks.get
        bounds = list(range(len(word) + 1))
        pairs = [rank(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
        while pairs:
            least = min(pairs)
            if least == NO_RANK:
                break
            at = pairs.index(least)
            del bounds[at + 1], pairs[at]
            if at < len(pairs):
                pairs[at] = rank(word[bounds[at] : bounds[at + 2]], NO_RANK)
            if at:
                pairs[at - 1] = rank(word[bounds[at - 1] : bounds[at + 1]], NO_RANK)
        return bounds

    def _merge_long(self, word: bytes) -> list[int]:
        rank, n = self.ranks.get, len(word)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\x01") * n
        while heap:
            _, left, end = heapq.heappop(heap)
            if not alive[left]:
                continue
            right = after[left]
            if right >= n or after[right] != end:
                continue
            alive[right] = 0
            after[left] = end
            if end < n:
                before[end] = left
                if (r := rank(word[left : after[end]])) is not None:
                    heapq.heappush(heap, (r, left, after[end]))
            if left:
                prior = before[left]
                if (r := rank(word[prior:end])) is not None:
                    heapq.heappush(heap, (r, prior, end))
        return [i for i in range(n) if alive[i]] + [n]


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker and vocabulary."""
    return Encoder(load_ranks(path), pattern)


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids array<int>) for every row, without special tokens.

    An empty or null text gives an empty array; a null key stays null; repeated
    rows give repeated rows; other columns are ignored. Whole texts are encoded,
    whatever their length. Narrow: no shuffle on a large scan.
    """
    path, pattern = path or vocabulary_path(), pattern or word_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            ids = [own.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            values = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[key, "ids"])

    kind = dict(docs.dtypes)[key]
    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns ``keep`` and n_tokens of every row; 0 for empty and null texts."""
    path, pattern = path or vocabulary_path(), pattern or word_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            counts = [own.count(t) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens bigint"])
    return spread(docs.select(*keep, text)).mapInArrow(run, schema)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"))


def p7_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), ["doc_id"])


QUERIES = {"p7_ids": p7_ids, "p7_lengths": p7_lengths}
SQL: dict[str, str] = {}
