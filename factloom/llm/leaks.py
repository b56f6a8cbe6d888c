"""Evaluation texts leaking into training texts: longest matches against a generalised suffix automaton of the items, and
removal of the spans that exceed limits of length or coverage."""

from __future__ import annotations

import hashlib
import html
import math
import re
import unicodedata
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.storage import cut

#: Words of one automaton. More items than that are matched in several blocks of the query set.
BLOCK_WORDS = 400_000
#: Fewer words than that are never a leak.
SHORTEST = 4

_SUP = re.compile(r"<su[pb]\b[^<>]*>[\s\d,;*†‡§\[\]()a-e-]{0,12}</su[pb]>|[⁰¹²³⁴-⁹₀-₉]+|[†‡§]", re.I)
_NOTE = re.compile(r"\[\^?\s*\d{1,3}(?:\s*[,;–-]\s*\d{1,3})*\s*\]|\^\d{1,3}\b")
_INLINE = re.compile(r"</?(?:a|abbr|b|code|em|font|i|mark|s|small|span|strong|sub|sup|u)\b[^<>]*>", re.I)
_TAG = re.compile(r"<(?:!--.*?--|[/!?]?[a-z][^<>]*)>", re.I | re.S)
_QUOTE = re.compile(r"^[ \t]*(?:[>|][ \t]?)+", re.M)
_HYPHEN = re.compile(r"(?<=[^\W_])[-‐‑­][ \t]*(?:\r?\n[ \t]*)?(?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")
_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_LINE_END = re.compile("[-‐‑]\u00ad?(?=\r?\n)")
_ANY = re.compile(r"(?s:.)")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")


def words(text: str | None) -> list[str]:
    """Words of a text without what makes no difference: case, accents' encoding, punctuation, white space, line-end hyphens,
    quote signs, markup and footnote marks. A word with hyphens inside is one word."""
    if not text:
        return []
    t = _SUP.sub("", html.unescape(text))
    t = _TAG.sub(" ", _INLINE.sub("", t))
    t = unicodedata.normalize("NFKC", t)
    t = _LINE_END.sub("-", t)
    t = _QUOTE.sub("", t)
    t = _NOTE.sub("", t)
    t = _HYPHEN.sub("", _INVISIBLE.sub("", t))
    return _WORD.findall(t.casefold())


_CLUSTER = regex.compile(r"[\u1100-\u11ff]+|.\p{M}*", regex.S)


def located_words(text: str) -> tuple[list[str], list[int], list[int]]:
    """words(text), and where each begins and ends in the text as it stands."""
    t, at, to = text, list(range(len(text))), list(range(1, len(text) + 1))

    def sub(pattern, new: str | Callable) -> None:
        nonlocal t, at, to
        parts, a, b, last = [], [], [], 0
        for m in pattern.finditer(t):
            put = new(m[0]) if callable(new) else new
            parts += [t[last : m.start()], put]
            a += at[last : m.start()] + [at[m.start()]] * len(put)
            b += to[last : m.start()] + [to[m.end() - 1]] * len(put)
            last = m.end()
        t, at, to = "".join([*parts, t[last:]]), a + at[last:], b + to[last:]

    sub(_ENTITY, html.unescape)
    sub(_SUP, "")
    sub(_INLINE, "")
    sub(_TAG, " ")
    if not t.isascii():
        sub(_CLUSTER, lambda c: unicodedata.normalize("NFKC", c))
    sub(_LINE_END, "-")
    for p in (_QUOTE, _NOTE, _INVISIBLE, _HYPHEN):
        sub(p, "")
    sub(_ANY, str.casefold)
    found = [(m[0], at[m.start()], to[m.end() - 1]) for m in _WORD.finditer(t)]
    return ([], [], []) if not found else tuple(map(list, zip(*found)))


class Automaton:
    """Generalised suffix automaton over word sequences. Each state knows the items whose sequences it lies in."""

    def __init__(self, sequences: list[tuple[int, list[str]]], least: int):
        self.least = least
        self.code: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[tuple[int, int]] = []
        for item, seq in sequences:
            last = 0
            for w in seq:
                last = self._add(last, self.code.setdefault(w, len(self.code)))
                ends.append((last, item))
        # A state lies in every item that ends in it or in a state whose links lead to it; short states are not asked.
        items: list[set[int]] = [set() for _ in self.len]
        for state, item in ends:
            items[state].add(item)
        for state in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            up = self.link[state]
            if self.len[up] >= least:
                items[up] |= items[state]
        self.items = items

    def _state(self, size: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(size)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        if self.len[p] + 1 == self.len[q]:
            return q
        copy = self._state(self.len[p] + 1)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        new, p = self._state(self.len[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, c, self.next[p][c])
        return new

    def walk(self, seq: list[str]) -> Iterator[tuple[int, int, int]]:
        """(end, state, length) of the longest match that ends at each word, where that has `least` words or more."""
        code, nxt, link, size, least = self.code, self.next, self.link, self.len, self.least
        state = length = 0
        for i, w in enumerate(seq):
            c = code.get(w)
            if c is None:
                state = length = 0
                continue
            while state and c not in nxt[state]:
                state = link[state]
                length = size[state]
            to = nxt[state].get(c)
            if to is None:
                length = 0
                continue
            state, length = to, length + 1
            if length >= least:
                yield i + 1, state, length

    def matches(self, seq: list[str], need: dict[int, int], spans: list[tuple[int, int]] | None = None) -> dict[int, int]:
        """Longest match of each sequence that has one of as many words as it needs; spans gets (start, end) of all of these."""
        best: dict[int, int] = {}
        for end, at, long in self.walk(seq):
            # The sequences of the matched length are those of the state; longer links back hold more of them, but shorter matches.
            reach = 0
            while long >= self.least:
                for k in self.items[at]:
                    if long >= need[k]:
                        reach = max(reach, long)
                        if best.get(k, 0) < long:
                            best[k] = long
                at = self.link[at]
                long = self.len[at]
            if spans is not None and reach:
                spans.append((end - reach, end))
        return best


class Block:
    """Items of which one automaton is made, and how many words of each of their texts must be found."""

    def __init__(self, rows: list, texts: int, least: int, coverage: float | None):
        self.ids = [r["i"] for r in rows]
        self.owner: list[int] = []
        self.seqs: list[tuple[int, list[str]]] = []
        self.need: dict[int, int] = {}
        self.longest = [1] * len(rows)
        for k, r in enumerate(rows):
            for c in range(texts):
                w = words(r[f"t{c}"])
                short = coverage is not None and SHORTEST <= len(w) < least
                if len(w) >= least or short:
                    q = len(self.owner)
                    self.owner.append(k)
                    self.seqs.append((q, w))
                    self.need[q] = max(SHORTEST, math.ceil(coverage * len(w) - 1e-9)) if short else least
                    self.longest[k] = max(self.longest[k], len(w))
        self.least = min(self.need.values(), default=least)

    def find(self, seq: list[str], spans: list[tuple[int, int]] | None = None) -> dict[int, int]:
        """Words of the longest match of each item that is found."""
        best: dict[int, int] = {}
        for q, n in _automaton(self).matches(seq, self.need, spans).items():
            best[self.owner[q]] = max(best.get(self.owner[q], 0), n)
        return best


_kept: OrderedDict[str, Automaton] = OrderedDict()


def _automaton(block: Block) -> Automaton:
    """Built once a worker and turn of blocks."""
    if not hasattr(block, "key"):
        block.key = hashlib.sha1(repr((block.least, block.seqs)).encode()).hexdigest()
    if block.key not in _kept:
        while len(_kept) >= 2:
            _kept.popitem(last=False)
        _kept[block.key] = Automaton(block.seqs, block.least)
    return _kept[block.key]


def _blocks(items: DataFrame, item_key: str, item_texts: list[str], least: int, coverage: float | None) -> list:
    """The items in broadcast blocks of about BLOCK_WORDS words, of which the driver holds one at a time."""
    spark = items.sparkSession
    size = F.size(F.split(F.concat_ws(" ", *item_texts), r"\s+"))
    held = items.select(F.col(item_key).alias("i"), *(F.col(c).alias(f"t{k}") for k, c in enumerate(item_texts)), size.alias("n")).where(F.col("i").isNotNull())
    total = held.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-total // BLOCK_WORDS))
    if count > 1:
        held = cut(held)
    held = held.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(count)))
    return [spark.sparkContext.broadcast(Block(held.where(F.col("b") == b).collect(), len(item_texts), least, coverage)) for b in range(count)]


def leaks(docs: DataFrame, items: DataFrame, least: int = 12, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_texts: list[str] = ["text", "gold_answer"], coverage: float | None = None) -> DataFrame:
    """doc_key, item_key, n_words, coverage: items of which the document holds at least `least` consecutive words.

    With `coverage`, texts of items that have fewer words than that (but SHORTEST) are found where the document holds at
    least this share of them in a row. n_words is the longest match, coverage its share of the item's longest text. Whole
    documents are normalised once and streamed, word by word, through the automata of all blocks of items; the number of
    blocks follows from the items' words, so that an automaton has a bounded size whatever the number of items. Null and
    empty texts match nothing; rows with repeated keys give repeated rows only where their texts do, and pairs come out once.
    """
    kind_d, kind_i = (t.schema[k].dataType.simpleString() for t, k in ((docs, doc_key), (items, item_key)))
    blocks = _blocks(items, item_key, item_texts, least, coverage)

    def found(docs_: list[tuple[object, list[str]]], block: Block) -> Iterator[tuple]:
        for doc, seq in docs_:
            for k, n in block.find(seq).items():
                yield doc, block.ids[k], n, n / block.longest[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        held: list[tuple] = []
        for batch in batches:
            kind = batch.schema.field(0).type
            part = [(d, words(t)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t]
            if len(blocks) == 1:
                yield packed(list(found(part, blocks[0].value)), kind)
            else:  # the words of a partition are kept, so that an automaton is made once for all of them
                held += [(d, " ".join(w)) for d, w in part]
        for block in blocks if held else ():
            yield packed(list(found(((d, t.split(" ")) for d, t in held), block.value)), kind)

    def packed(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1]) if rows else pa.array([], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64())], names=[doc_key, item_key, "n_words", "coverage"])

    hit = docs.select(doc_key, doc_text).mapInArrow(run, f"`{doc_key}` {kind_d}, `{item_key}` {kind_i}, n_words int, coverage double")
    return hit.groupBy(doc_key, item_key).agg(F.max("n_words").alias("n_words"), F.max("coverage").alias("coverage"))


def remove_leaks(docs: DataFrame, items: DataFrame, least: int = 12, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_texts: list[str] = ["text", "gold_answer"], coverage: float | None = None) -> DataFrame:
    """doc_key, text without the spans that exceed the limits of leaks(), n_removed (their words); one row for each row of docs.

    A span runs from the first to the last word of a match, with all between them, and leaves one blank; spans that overlap
    are one. Texts without a match stay as they are; null stays null. A match that the normalised words show is located in
    the text as it stands.
    """
    kind = docs.schema[doc_key].dataType.simpleString()
    blocks = _blocks(items, item_key, item_texts, least, coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            seqs = [words(t) for t in texts]
            spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            for block in blocks:
                for seq, own in zip(seqs, spans):
                    if seq:
                        block.value.find(seq, own)
            removed = [0] * len(texts)
            for i, own in enumerate(spans):
                if own:
                    texts[i], removed[i] = without(texts[i], own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=[doc_key, "text", "n_removed"])

    return docs.select(doc_key, doc_text).mapInArrow(run, f"`{doc_key}` {kind}, text string, n_removed int")


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the words of the spans, and how many words these are."""
    _, start, end = located_words(text)
    joined: list[list[int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    pieces, at = [], 0
    for a, b in joined:
        pieces.append(text[at : start[a]].strip(" "))
        at = end[b - 1]
    pieces.append(text[at:].strip(" "))
    return " ".join(p for p in pieces if p), sum(b - a for a, b in joined)


def leak_report(found: DataFrame, item_key: str = "item_id") -> DataFrame:
    """item_id, n_docs, n_whole, longest: in how many documents each leaked item was found, and in how many wholly."""
    return found.groupBy(item_key).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("coverage") >= 1.0).alias("n_whole"), F.max("n_words").alias("longest"))
