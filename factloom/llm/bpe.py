"""Byte-level BPE ids of a whole corpus, by merge rounds over flat numpy arrays.

All distinct words of an Arrow batch lie in one flat array of symbols. A round looks up every adjacent pair by binary
search in the sorted pair keys of the vocabulary, finds the lowest rank of each word and merges its places. A word
leaves the array once none of its pairs can be merged. The job is one map over the table, without a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"
#: The split pattern published with this vocabulary.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHIFT, NONE = 20, np.int64(1) << 40
SLICE_CHARS = 2_000_000


def _printable() -> dict[str, int]:
    """The sign that stands for each byte in the vocabulary file: itself where printable, else one from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary of a tokenizer file: ids of the bytes, and pair keys in order with their rank and merged id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, byte_of = model["vocab"], _printable()
        self.byte_ids = np.zeros(256, np.int64)
        for sign, b in byte_of.items():
            self.byte_ids[b] = vocab[sign]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([(vocab[a] << SHIFT) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.split = regex.compile(WORDS)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and where each word begins (one more entry than words)."""
        size = np.array([len(w) for w in words], np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done_word, done_sym = [], []
        while len(sym):
            key = (sym[:-1] << SHIFT) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(sym), NONE)
            rank[:-1] = np.where((word[:-1] == word[1:]) & (self.keys[at] == key), self.ranks[at], NONE)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
            over = least == NONE
            done_word.append(word[over])
            done_sym.append(sym[over])
            hit = (rank == least) & ~over
            # In a run of equal signs the pairs overlap: every second one is merged, from the left.
            place = np.arange(len(sym))
            first = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
            hit &= (place - first) % 2 == 0
            sym = np.where(hit, self.merged[np.where(hit, rank, 0)], sym)
            keep = ~np.r_[False, hit[:-1]] & ~over
            sym, word = sym[keep], word[keep]
        if not done_word:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))]

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and where each text begins."""
        seen: dict[str, int] = {}
        index = [[seen.setdefault(w, len(seen)) for w in self.split.findall(t)] for t in texts]
        ids, begin = self.encode([w.encode("utf-8") for w in seen])
        which = np.fromiter((i for x in index for i in x), np.int64)
        size = np.diff(begin)[which]
        end = np.cumsum(size)
        flat = ids[np.repeat(begin[:-1][which] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
        words = np.r_[0, np.cumsum([len(x) for x in index])].astype(np.int64)
        return flat, np.r_[0, end][words]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= SLICE_CHARS:
            yield begin, i + 1
            begin, chars = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE_50K) -> DataFrame:
    """key, ids: the ids of each row's whole text without special tokens. Null and empty texts have an empty list.

    The strings of special tokens are ordinary text. Repeated rows come out as often as they are in the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merges(tokenizer)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in _slices(texts):
                flat, begin = bpe.encode_texts(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(begin.astype(np.int32), flat)], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE_50K) -> DataFrame:
    """key, n_tokens: the number of ids that encode() gives; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merges(tokenizer)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in _slices(texts):
                _, begin = bpe.encode_texts(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(begin))], names=[key, "n_tokens"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long")
