"""Exact lexical search of many queries in blocks of facts: the sums of a query and fact stay in the memory of a task.

Each task holds an inverted index of one block of facts and answers queries one after the other, which stream past it. All
facts of a query's terms are added up in one pass over their lists, in which only the facts that its skill may use stand.
With a cap on candidates, terms are added up rarest first; once those left can't lift a new fact among the best k, they are
only looked up for the facts that can still be among them. Scores are whole billionths, so sums are the same in any order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Facts of a block, at most about: with some 30 terms each, its index takes about 100 MB, three times that while it is made.
BLOCK = 300_000


def meet_blocks(facts: DataFrame, queries: DataFrame, n: int, run: Callable, schema: str) -> DataFrame:
    """run(batches) of each block of facts and part of the queries: the facts' rows first, then the queries' by skill.

    facts: fact_idx, source, relation, terms, aliases; queries: qid, skill, terms, aliases, idf, df (null without cap). Queries go to every
    block; facts are copied if there are fewer blocks than the session has cores, of which then both take their share.
    """
    cores = facts.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // BLOCK), math.ceil(math.sqrt(cores)))
    parts = max(1, -(-cores // blocks))
    part = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    strings, empty = "array<string>", lambda kind: F.lit(None).cast(kind)
    left = facts.select((part("fact_idx", blocks) * parts).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), F.lit(0).alias("side"), F.col("fact_idx").alias("id"), F.col("source").alias("name"), "relation", F.col("terms").cast(strings), F.col("aliases").cast(strings), empty("array<double>").alias("idf"), empty("array<bigint>").alias("df"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) * parts), F.lit(parts))).alias("g"), part("qid", parts).alias("p"), F.lit(1).alias("side"), F.col("qid").alias("id"), F.col("skill").alias("name"), empty("string").alias("relation"), "terms", "aliases", "idf", F.col("df").cast("array<bigint>").alias("df"))
    both = left.unionByName(right).withColumn("g", F.col("g") + F.col("p")).drop("p")
    return both.repartitionById(blocks * parts, F.col("g")).sortWithinPartitions("side", "name").drop("g").mapInArrow(run, schema)


class Lists:
    """Inverted lists of an array column of strings: positions of rows, ascending, for each string."""

    def __init__(self, chunks: list[pa.Array]):
        sizes = np.concatenate([pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in chunks])
        coded = pa.chunked_array([c.flatten() for c in chunks], pa.string()).dictionary_encode()
        self.words = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.string())
        codes = np.concatenate([np.zeros(0, np.int32), *(pc.fill_null(c.indices, -1).to_numpy(zero_copy_only=False) for c in coded.chunks)])
        self.sizes = sizes.astype(np.int32)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        if len(codes) and codes.min() < 0:
            owner, codes = owner[codes >= 0], codes[codes >= 0]
        self.rows = owner[np.argsort(codes, kind="stable")]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.words)))])

    def codes(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes (-1 if unknown) of the strings of each list, end to end, and where each list begins."""
        found = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.words), -1).to_numpy(zero_copy_only=False)
        return found, np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])

    def of(self, code: int) -> np.ndarray:
        return self.rows[self.start[code] : self.start[code + 1]]


class Postings:
    """The term lists of the facts that may be used, with the parts that a term adds to them."""

    def __init__(self, lists: Lists, usable: np.ndarray | None, base: np.ndarray):
        self.rows, self.start = lists.rows, lists.start
        if usable is not None:
            kept = usable[self.rows]
            self.start = np.concatenate([[0], np.cumsum(kept)])[self.start]
            self.rows = self.rows[kept]
        self.size = lists.sizes[self.rows]
        self.base, self.known = base, {}

    def parts(self, code: int, idf: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows, what the term adds to each, and the most that it adds to any."""
        a, b = self.start[code], self.start[code + 1]
        if b - a < 256:
            w = np.floor(idf / self.base[self.size[a:b]] * 1e9 + 0.5).astype(np.int64)
            return self.rows[a:b], w, int(w.max())
        if code not in self.known:
            by_size = np.floor(idf / self.base * 1e9 + 0.5).astype(np.int64)
            self.known[code] = by_size, int(by_size[self.size[a:b].min()])
        by_size, most = self.known[code]
        return self.rows[a:b], by_size[self.size[a:b]], most

    def bound(self, code: int, idf: float) -> int:
        a, b = self.start[code], self.start[code + 1]
        if b - a >= 256 and code in self.known:
            return self.known[code][1]
        if b - a >= 256:
            return self.parts(code, idf)[2]
        return int(idf / self.base[self.size[a:b].min()] * 1e9 + 1)


class Sums:
    """The term lists of the facts that may be used, by their places among these, with what a term adds to each."""

    def __init__(self, lists: Lists, usable: np.ndarray | None, base: np.ndarray):
        rows, self.start = lists.rows, lists.start.tolist()
        self.kept = np.arange(len(lists.sizes)) if usable is None else np.flatnonzero(usable)
        self.place = np.full(len(lists.sizes), -1)
        self.place[self.kept] = np.arange(len(self.kept))
        if usable is not None:
            stay = usable[rows]
            rows, self.start = rows[stay], np.concatenate([[0], np.cumsum(stay)])[lists.start].tolist()
        self.rows, self.size = self.place[rows], lists.sizes[rows].astype(np.int16 if len(base) < 1 << 15 else np.int32)
        self.base, self.parts, self.known = base, np.empty(len(rows)), bytearray(len(self.start))
        self.groups = 64 if len(self.kept) >= 1 << 14 else 8
        self.room = max(1, -(-len(self.kept) // self.groups)) * self.groups
        self.hit = np.zeros(self.room, bool)

    def best(self, asked: list[tuple[int, float]], hits: np.ndarray, bonus: np.ndarray, k: int, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, sums and whether they are hits, of all facts that can be among the best k. Sums that differ by up to slack
        may count as equal. The parts are whole numbers below 2**53, so floating sums of them are exact."""
        rows, parts = [self.place[hits]], [bonus.astype(float)]
        for code, idf in asked:
            a, b = self.start[code], self.start[code + 1]
            if a < b:
                if not self.known[code]:
                    self.parts[a:b] = np.floor(idf / self.base[self.size[a:b]] * 1e9 + 0.5)
                    self.known[code] = 1
                rows.append(self.rows[a:b])
                parts.append(self.parts[a:b])
        sums = np.bincount(np.concatenate(rows), np.concatenate(parts), self.room)
        # The kth largest of the maxima of groups is no larger than the kth largest of all.
        most = sums.reshape(self.groups, -1).max(0)
        least = float(np.partition(most, len(most) - k)[len(most) - k]) if len(most) >= k else 0.0
        least = max(least - slack, 1.0)
        groups = np.flatnonzero(most >= least)
        row, at = np.nonzero(sums.reshape(self.groups, -1)[:, groups] >= least)
        at = row * len(most) + groups[at]
        self.hit[rows[0]] = True
        hit = self.hit[at]
        self.hit[rows[0]] = False
        return self.kept[at], sums[at].astype(np.int64), hit


def _first(ids: np.ndarray, score: np.ndarray, hit: np.ndarray, k: int, larger_first: bool) -> np.ndarray:
    """Places of the best k positive scores in order; of many that tie with the last, only those that can count are sorted."""
    at = np.flatnonzero(score > 0)
    if len(at) > 8 * k:
        least = _kth(score[at], k)
        tied = at[(score[at] == least) & ~hit[at]]
        at = at[(score[at] > least) | ((score[at] == least) & hit[at])]
        if len(tied) > k:
            by = -ids[tied] if larger_first else ids[tied]
            tied = tied[np.argpartition(by, k - 1)[:k]]
        at = np.concatenate([at, tied])
    found = ids[at]
    return at[np.lexsort((-found if larger_first else found, ~hit[at], -score[at]))[:k]]


def _looked_up(p: Postings, code: int, idf: float, docs: np.ndarray) -> np.ndarray:
    """What the term adds to each of docs."""
    a, b = p.start[code], p.start[code + 1]
    if a == b or not len(docs):
        return np.zeros(len(docs), np.int64)
    rows = p.rows[a:b]
    at = np.minimum(np.searchsorted(rows, docs), b - a - 1)
    return np.where(rows[at] == docs, np.floor(idf / p.base[p.size[a + at]] * 1e9 + 0.5).astype(np.int64), 0)


def _kth(x: np.ndarray, k: int) -> int:
    return int(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else -1


def best_of(p: Postings, acc: np.ndarray, mark: np.ndarray, terms: list[tuple[int, int, float]], lo: int, hi: int, hits: np.ndarray, bonus: np.ndarray, k: int, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, sums and first ranks of all facts that can be among the best k, and of all hits (first, with their bonus).

    terms: (rank, code, what the term's parts are made of), rarest first. Facts that are no hits need a term up to rank hi;
    only those with one up to lo are sure to count, so only they raise what another needs, and the first rank of the others
    is given (else 0). acc and mark are all zero, before and after. Sums that differ by up to slack may count as equal.
    """
    terms = [t for t in terms if p.start[t[1]] < p.start[t[1] + 1]]
    least = -1
    sums = bonus.copy()
    if len(hits):
        for _, code, idf in terms:
            sums += _looked_up(p, code, idf, hits)
        least = _kth(sums, k)
    rest = [0]
    for _, code, idf in reversed(terms):
        rest.append(rest[-1] + p.bound(code, idf))
    rest.reverse()
    touched, top, early, j = [], np.zeros(0, np.int32), 0, 0
    for j, (rank, code, idf) in enumerate(terms):
        if rank > hi or rest[j] < least - slack:
            break
        rows, w, _ = p.parts(code, idf)
        w = w + acc[rows]
        acc[rows] = w
        touched.append(rows)
        if rank <= lo:
            early = len(touched)
            more = rows[w > least] if least >= 0 else rows
            if len(more) > 4 * k:
                some = acc[more]
                more = more[np.argpartition(some, len(some) - k)[len(some) - k :]]
            if len(more):
                top = np.unique(np.concatenate([top, more]))
        if len(top) >= k:
            now = acc[top]
            if len(top) > k:
                top = top[np.argpartition(now, len(now) - k)[len(now) - k :]]
                now = acc[top]
            least = max(least, int(now.min()))
    else:
        j = len(terms)
    if not touched:
        return hits, sums, np.zeros(len(hits), np.int32)
    seen = np.concatenate(touched)
    docs = np.unique(seen[acc[seen] >= least - slack - rest[j]])
    part = acc[docs]
    acc[seen] = 0
    sure = np.ones(len(docs), bool)
    if early < len(touched):
        for rows in touched[:early]:
            mark[rows] = True
        sure = mark[docs]
        mark[seen] = False
    for i in range(j, len(terms)):
        part = part + _looked_up(p, *terms[i][1:], docs)
        least = max(least, _kth(part[sure], k))
        kept = part >= least - slack - rest[i + 1]
        docs, part, sure = docs[kept], part[kept], sure[kept]
    if len(hits):
        kept = ~np.isin(docs, hits)
        docs, part, sure = docs[kept], part[kept], sure[kept]
    first = np.zeros(len(docs), np.int32)
    if not sure.all():
        late, rank_of = np.flatnonzero(~sure), np.zeros(int((~sure).sum()), np.int32)
        for rank, code, idf in terms:
            if lo < rank <= hi and not rank_of.all():
                rank_of[(rank_of == 0) & (_looked_up(p, code, idf, docs[late]) > 0)] = rank
        first[late] = rank_of
    return np.concatenate([hits, docs]), np.concatenate([sums, part]), np.concatenate([np.zeros(len(hits), np.int32), first])


def _split(batches: Iterator[pa.RecordBatch], facts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of queries, after those of facts have been put into facts."""
    for b in batches:
        n = int(pc.sum(pc.equal(b.column("side"), 0)).as_py() or 0)
        if n:
            facts.append(b.slice(0, n))
        if n < b.num_rows:
            yield b.slice(n)


def _reach(df: list[int], cap: int | None) -> tuple[int, int]:
    """The ranks with which the facts of a query's terms may reach cap, and surely do, if they can; else beyond all."""
    if cap is None or not df or (sums := np.cumsum(df))[-1] < cap:
        return len(df), len(df)
    return int(np.searchsorted(sums, cap)) + 1, next((r for r, x in enumerate(df, 1) if x >= cap), len(df))


def ranked(k: int, avgdl: float, k1: float, b_: float, skills: dict[str, tuple[list[str], list[str]]] | None, alias_boost: int, graph_boost: int, graph_source: str, rounded: bool, larger_first: bool, cap: int | None = None) -> Callable:
    """For meet_blocks: qid, fact_idx, score (billionths, or ten-thousandths if rounded), hit, first: the best k of the block.

    With skills (sources and relations of each) a query only meets facts of them. An alias hit adds alias_boost, and
    graph_boost more if the fact is of graph_source. Equal scores: hits first, then the smaller fact_idx, or the larger.
    With cap, facts that are no hits need a term up to that with which the facts of the terms, rarest first, reach cap in
    all blocks. Where that depends on the other blocks, there are rows without fact_idx for the facts of this block (score)
    up to each rank in question (first), and the best k for each of these ranks, with the rank that a fact needs (else 0).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        terms = aliases = None
        skill, ready = None, False
        for b in _split(batches, held):
            if not held:
                return
            if terms is None:
                terms, aliases = Lists([x.column("terms") for x in held]), Lists([x.column("aliases") for x in held])
                ids = np.concatenate([x.column("id").to_numpy() for x in held])
                sources, relations = (pa.chunked_array([x.column(c) for x in held]) for c in ("name", "relation"))
                graph = pc.fill_null(pc.equal(sources, graph_source), False).to_numpy().astype(bool)
                acc, mark = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
                base = 1.0 + k1 * (1 - b_ + b_ * np.arange(int(terms.sizes.max()) + 1) / max(avgdl, 1.0))
                held = [held[0].slice(0, 0)]
            codes, at = terms.codes(b.column("terms"))
            alias_codes, alias_at = aliases.codes(b.column("aliases"))
            idf = b.column("idf").flatten().to_numpy() * (k1 + 1)
            dfs, names = b.column("df").to_pylist(), b.column("name").to_pylist()
            out: list[tuple[np.ndarray, ...]] = []
            for i in range(b.num_rows):
                if not ready or (skills is not None and names[i] != skill):
                    skill, ready, usable = names[i], True, None
                    if skills is not None:
                        may = skills.get(skill) if skill is not None else None
                        usable = (pc.and_(*(pc.fill_null(pc.is_in(c, value_set=pa.array(x, pa.string())), False) for c, x in zip((sources, relations), may))).to_numpy().astype(bool)) if may else np.zeros(len(ids), bool)
                    postings = (Sums if cap is None else Postings)(terms, usable, base)
                hits = [aliases.of(c) for c in alias_codes[alias_at[i] : alias_at[i + 1]] if c >= 0]
                hits = (np.unique(np.concatenate(hits)) if len(hits) > 1 else hits[0]) if hits else np.zeros(0, np.int32)
                hits = hits if usable is None else hits[usable[hits]]
                bonus = (alias_boost + graph_boost * graph[hits]).astype(np.int64) * 1_000_000_000
                asked = [(r + 1, int(c), float(w)) for r, (c, w) in enumerate(zip(codes[at[i] : at[i + 1]], idf[at[i] : at[i + 1]])) if c >= 0]
                if cap is None:
                    docs, score, hit = postings.best([x[1:] for x in asked], hits, bonus, k, 100_000 if rounded else 0)
                    score = (score + 50_000) // 100_000 if rounded else score
                    order = _first(ids[docs], score, hit, k, larger_first)
                    out.append((np.full(len(order), i), ids[docs[order]], score[order], hit[order], np.zeros(len(order), np.int32), np.zeros(len(order), bool)))
                    continue
                lo, hi = _reach(dfs[i], cap)
                if lo < hi:
                    counts = []
                    for r in range(hi - 1):
                        if (c := codes[at[i] + r]) >= 0:
                            mark[terms.of(c)] = True
                        if r >= lo - 1:
                            counts.append(int(np.count_nonzero(mark)))
                    mark[:] = False
                    out.append((np.full(hi - lo, i), np.zeros(hi - lo, np.int64), np.array(counts), np.zeros(hi - lo, bool), np.arange(lo, hi, dtype=np.int32), np.ones(hi - lo, bool)))
                docs, score, first = best_of(postings, acc, mark, asked, lo, hi, hits, bonus, k, 100_000 if rounded else 0)
                score = (score + 50_000) // 100_000 if rounded else score
                hit = np.arange(len(docs)) < len(hits)
                found = ids[docs]
                order = np.lexsort((-found if larger_first else found, ~hit, -score))
                order = order[score[order] > 0]
                if len(order) > k and first[order].any():
                    better = np.zeros(hi + 1, np.int64)
                    kept = []
                    for x, f in zip(order.tolist(), first[order].tolist()):
                        if better[f] < k:
                            kept.append(x)
                            better[f:] += 1
                            if better[0] >= k:
                                break
                    order = np.array(kept)
                else:
                    order = order[:k]
                out.append((np.full(len(order), i), found[order], score[order], hit[order], first[order], np.zeros(len(order), bool)))
            i, found, score, hit, first, count = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(i)), pa.array(found, mask=count), pa.array(score), pa.array(hit), pa.array(first)], names=["qid", "fact_idx", "score", "hit", "first"])

    return run
