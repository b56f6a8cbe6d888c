"""The k most similar vectors of every vector: additive quantisation with inverted lists, then exact reranking.

A vector is the sum of one full-dimensional codeword of each codebook, found by beam search over residual codebooks. The
sums of the first codebooks are cells; how many books make a cell grows with the number of vectors, so that a cell holds
about the same number of them at any size. The second of these books is one for each codeword of the first, fitted on the
vectors around it, so that its cells follow them wherever they lie. Every vector is scored against all vectors of the cells nearest to it, by tables
of its products with the codewords and the stored norms of the sums; a fixed number of the best is reranked exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.storage import checked_broadcast, cut


#: Queries scored at once.
STEP = 128


@dataclass(frozen=True)
class Settings:
    dim: int = 64
    k: int = 8
    sample: int = 40_000  # classes that the codebooks are fitted on, about, and never twice that
    hold: int = 300  # vectors of a cell, about
    lead: int = 4096  # codewords of the first codebook, at most
    books: int = 12  # residual codebooks after those that make the cells
    words: int = 256  # codewords of each of them, and of those after the first that make cells, at most
    beam: int = 3
    probes: int = 6  # cells whose vectors are scored for a vector, times the number of codebooks that make them
    rerank: tuple[int, ...] = (256, 96, 64, 48, 32, 32)  # vectors of the nearest cells that are compared exactly, the last number for all further cells
    rounds: int = 8  # of k-means
    local: int = 40  # classes that a word of the codebooks around the first one's words is fitted on, about
    seed: int = 11
    block: int = 4096  # vectors of a cell, and queries of it, that meet in one group, at most about

    def levels(self, n: int) -> list[int]:
        """Codewords of the codebooks that make the cells of n vectors; the cells are all their sums."""
        cells = max(1.0, n / self.hold)
        sizes = [int(min(self.lead, 2 ** round(np.log2(cells))))]
        while np.prod([float(x) for x in sizes]) * 1.5 < cells:
            sizes.append(int(min(self.words, np.ceil(cells / np.prod([float(x) for x in sizes])))))
        return sizes


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre**2).sum(1) / 2
    return np.concatenate([np.argmax(x[a : a + 8192] @ centre.T - half, axis=1) for a in range(0, len(x), 8192)])


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centre)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        total = np.add.reduceat(x[order], np.r_[0, np.cumsum(n)[:-1]].clip(max=len(x) - 1), axis=0)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)]).astype(np.float32)
    return centre


def fit(x: np.ndarray, levels: list[int], s: Settings, around: Callable[[np.ndarray, int], np.ndarray] | None = None) -> list[np.ndarray]:
    """Codebooks, those of the cells first, each fitted on what the ones before it leave over.

    around(first codebook, size): if given, the second codebook of the cells, one for each word of the first.
    """
    rng = np.random.default_rng(s.seed)
    books: list[np.ndarray] = []
    left = x
    for m, size in enumerate([*levels, *[s.words] * s.books]):
        if m == 1 and m < len(levels) and around:
            books.append(around(books[0], size))
            left = np.concatenate([beam_search(x[a : a + 1024], books, s.beam)[1][:, 0] for a in range(0, len(x), 1024)])
            continue
        books.append(_kmeans(left, size, s.rounds, rng))
        left = left - books[-1][_nearest(left, books[-1])]
    return books


def _around(classes: DataFrame, n: int, first: np.ndarray, size: int, s: Settings) -> np.ndarray:
    """A codebook of `size` words for each word of the first one, fitted on what that leaves over of the classes next to it:
    on about `local` a word, drawn by a hash. Words that nothing is there for lie far from all."""
    share = min(1.0, s.local * len(first) * size / max(n, 1))
    sent = classes.sparkSession.sparkContext.broadcast(first)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1).to_pylist(), s.dim)
            near = _nearest(x, sent.value) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64()), b.column(0), pa.array([r.tobytes() for r in x - sent.value[near]], pa.binary())], names=["word", "h", "left"])

    def one(t: pa.Table) -> pa.Table:
        word = t.column("word")[0].as_py()
        x = _matrix(t.take(pc.sort_indices(t.column("h"))).column("left").to_pylist(), s.dim)
        return pa.table({"word": [word], "book": pa.array([_kmeans(x, size, s.rounds, np.random.default_rng(s.seed + word)).tobytes()], pa.binary())})

    drawn = classes.where(F.pmod(F.xxhash64("h", F.lit(3)), F.lit(1_000_000_007)) < int(1_000_000_007 * share)).select("h", "u")
    out = np.full((len(first), size, s.dim), 1e3, np.float32)
    out[:, 0] = 0
    for r in drawn.mapInArrow(assign, "word long, h binary, left binary").groupBy("word").applyInArrow(one, "word long, book binary").collect():  # the codebook itself
        book = _matrix([r["book"]], s.dim)
        out[r["word"], : len(book)] = book
    return out


def beam_search(left: np.ndarray, books: list[np.ndarray], beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the beam best paths of codewords, best first, and what each leaves over. A book of three dimensions has a
    codebook for each word of the first."""
    n = len(left)
    left, path, error = left[:, None, :], np.zeros((n, 1, 0), np.int16), np.zeros((n, 1), np.float32)
    for book in books:
        if book.ndim == 3:
            square, first = (book**2).sum(2), path[:, :, 0]
            step = max(1, (1 << 23) // max(1, left.shape[1] * book.shape[1] * book.shape[2]))
            product = np.concatenate([np.matmul(book[first[a : a + step]], left[a : a + step, :, :, None])[..., 0] for a in range(0, max(n, 1), step)])
            cost = error[:, :, None] + square[first] - 2 * product
        else:
            cost = error[:, :, None] + (book**2).sum(1) - 2 * (left.reshape(-1, left.shape[2]) @ book.T).reshape(n, left.shape[1], -1)
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best, error, rows = np.empty((n, keep), np.int64), np.empty((n, keep), np.float32), np.arange(n)
        for j in range(keep):  # the least again and again, which is faster than a partition for so few
            best[:, j] = at = flat.argmin(axis=1)
            error[:, j] = flat[rows, at]
            flat[rows, at] = np.inf
        parent, word = best // book.shape[-2], best % book.shape[-2]
        added = book[np.take_along_axis(first, parent, axis=1), word] if book.ndim == 3 else book[word]
        left = np.take_along_axis(left, parent[:, :, None], axis=1) - added
        path = np.concatenate([np.take_along_axis(path, parent[:, :, None], axis=1), word[:, :, None].astype(np.int16)], axis=2)
    return path, left


def cell_ids(path: np.ndarray, sizes: list[int]) -> np.ndarray:
    out = np.zeros(path.shape[:-1], np.int64)
    for m, size in enumerate(sizes):
        out = out * size + path[..., m]
    return out


def encode(x: np.ndarray, books: list[np.ndarray], beam: int, levels: int = 1, probes: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest cells (paths over the first `levels` codebooks, best first), codes over all codebooks, of which the first
    are those of the nearest cell, and the norm of the sum of the codewords."""
    cells, codes, norms = [], [], []
    for a in range(0, max(len(x), 1), 2048):
        v = x[a : a + 2048]
        # Cells of several books lie about more words of the first than are asked in the end.
        near, left = beam_search(v, books[:levels], max(probes, beam) * min(levels, 2))
        path, rest = beam_search(left[:, 0], books[levels:], beam)
        cells.append(near[:, :probes])
        codes.append(np.concatenate([near[:, 0], path[:, 0]], axis=1))
        norms.append(np.linalg.norm(v - rest[:, 0], axis=1).astype(np.float32))
    return np.concatenate(cells), np.concatenate(codes), np.concatenate(norms)


def decode(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return sum(book[codes[:, 0], codes[:, m]] if book.ndim == 3 else book[codes[:, m]] for m, book in enumerate(books))


def _unit_rows(vectors: DataFrame, key: str, vector: str, version: str, dim: int) -> DataFrame:
    """k, h (hash of the direction), u (unit vector, float32 bytes) of the latest row of each key, where it has a direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.linalg.norm(flat, axis=1)
            ok = np.isfinite(norm) & (norm > 0)
            unit = (flat[ok] / norm[ok, None]).astype(np.float32) + np.float32(0)
            raw = [row.tobytes() for row in unit]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary())], names=["k", "h", "u"])

    kind = vectors.schema[key].dataType.simpleString()
    v = vectors.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max_by(F.struct(F.col(vector).alias("e")), F.struct(F.col(version), F.hash(vector))).alias("x"))
    v = v.select("k", F.col("x.e").cast("array<double>").alias("e")).where((F.size("e") == dim) & ~F.exists("e", lambda x: x.isNull()))
    return v.mapInArrow(run, f"k {kind}, h binary, u binary")


def _matrix(column, dim: int, kind=np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, dim)


def neighbours(vectors: DataFrame, key: str = "fact_idx", vector: str = "embedding", version: str = "encoded_at", s: Settings = Settings()) -> DataFrame:
    """key, near (array of structs neighbour, cosine; at most k, best first) of every key that has a direction.

    cosine is rounded to 6 decimals and ties go to the smaller key. Of repeated keys the latest row counts. Null vectors,
    vectors of another length, with null, NaN or infinite values or of length 0 have no row and are no one's neighbour.
    Vectors of the same direction are one class: a class is compared once, and as only its k + 1 least keys can be among
    anyone's nearest, copies never multiply. Codebooks are fitted on classes drawn by a hash, about `sample`, and `local` a cell;
    every class is indexed and every class is a query. Large or much asked cells are cut into blocks, all of which meet, and
    the work of a query doesn't grow with the table: cells are about as large, and probes and reranked vectors as many.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    units = cut(_unit_rows(vectors, key, vector, version, s.dim))
    members = units.select("k", "h")
    classes = cut(units.groupBy("h").agg(F.min("k").alias("c"), F.count(F.lit(1)).alias("n"), F.first("u").alias("u")))
    n, n_units = classes.agg(F.count(F.lit(1)), F.sum("n")).first()
    draw = classes.where(F.pmod(F.xxhash64("h"), F.lit(1_000_000_007)) < int(1_000_000_007 * min(1.0, s.sample / max(n, 1))))
    x = _matrix([r[0] for r in draw.select("u").limit(2 * s.sample).collect()], s.dim)
    if not len(x):
        return spark.createDataFrame([], f"`{key}` {kind}, near array<struct<neighbour:{kind},cosine:double>>")
    fitted = fit(x, s.levels(n), s, lambda first, size: _around(classes, n, first, size, s))
    sizes = [b.shape[-2] for b in fitted[: len(s.levels(n))]]
    books = spark.sparkContext.broadcast(fitted)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, codes, norms = encode(_matrix(b.column(1).to_pylist(), s.dim), books.value, s.beam, len(sizes), s.probes * len(sizes))
            ids = cell_ids(cells, sizes)
            width = codes.shape[1] * 2
            flat = pa.py_buffer(np.ascontiguousarray(codes).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(codes), [None, flat]).cast(pa.binary()), pa.array(norms), pa.ListArray.from_arrays(np.arange(0, ids.size + 1, ids.shape[1], dtype=np.int32), ids.ravel())],
                names=["c", "u", "codes", "norm", "probes"],
            )

    indexed = cut(classes.select("c", "u").mapInArrow(index, f"c {kind}, u binary, codes binary, norm float, probes array<long>"))
    # How many blocks a cell is cut into, by its vectors and by those that ask it, if it is more than one.
    count = indexed.select(F.posexplode("probes").alias("rank", "cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("q"), F.count_if(F.col("rank") == 0).alias("d"))
    count = count.select("cell", F.ceil(F.col("d") / s.block).cast("int").alias("d"), F.ceil(F.col("q") / s.block).cast("int").alias("q")).where("d > 1 or q > 1")
    blocks = checked_broadcast(cut(count), 200_000)[0]
    cutting = lambda df: df.join(blocks, "cell", "left").withColumns({"d": F.coalesce("d", F.lit(1)), "q": F.coalesce("q", F.lit(1))})
    part = lambda by, m: F.pmod(F.xxhash64("c", F.lit(by)), F.col(m)).cast("int")
    data = cutting(indexed.select("c", "u", "codes", "norm", F.col("probes")[0].alias("cell"))).select("cell", part(1, "d").alias("d"), F.explode(F.expr("sequence(0, q - 1)")).alias("q"), F.col("c").alias("o"), F.col("u").alias("v"), "codes", "norm")
    ask = cutting(indexed.select("c", "u", F.posexplode("probes").alias("rank", "cell"))).select("cell", F.explode(F.expr("sequence(0, d - 1)")).alias("d"), part(2, "q").alias("q"), "c", "u", "rank")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        c, start, others, cosines = search(left, right, books.value, s)
        near = pa.ListArray.from_arrays(start, pa.StructArray.from_arrays([pa.array(-cosines), others], ["s", "o"]))
        return pa.table([c, near], names=["c", "x"])

    by = ["cell", "d", "q"]
    best = ask.groupBy(*by).cogroup(data.groupBy(*by)).applyInArrow(compare, f"c {kind}, x array<struct<s: double, o: {kind}>>")
    nearest = best.groupBy("c").agg(F.slice(F.array_sort(F.flatten(F.collect_list("x"))), 1, s.k).alias("x"))
    flat = nearest.select("c", F.explode("x").alias("e")).select("c", "e.o", "e.s")
    # Only classes of several keys need their k + 1 least keys; the others are their one key.
    several = classes.where("n > 1").select("h", "c")
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("k"))).where(F.col("r") <= s.k + 1)
    firsts = cut(first.join(several, "h").groupBy("c").agg(F.collect_list("k").alias("ks")))
    known = checked_broadcast(firsts, 100_000, 160)[0]
    wide = flat.join(known.withColumnRenamed("c", "o"), "o", "left").select("c", F.explode(F.coalesce("ks", F.array("o"))).alias("f"), "s")
    ranked = wide.groupBy("c").agg(F.collect_list(F.struct("s", "f")).alias("x"))
    own = F.transform(F.coalesce("ks", F.array().cast(f"array<{kind}>")), lambda f: F.struct(F.lit(-1.0).alias("s"), f.alias("f")))
    all_ = F.slice(F.array_sort(F.concat(F.coalesce("x", F.array().cast(f"array<struct<s:double,f:{kind}>>")), own)), 1, s.k + 1)
    listed = classes.select("h", "c", "n").join(ranked, "c", "left").join(known, "c", "left").select("h", "c", "n", F.transform(all_, lambda e: F.struct(e["f"].alias("neighbour"), (-e["s"]).alias("cosine"))).alias("x"))
    listed = cut(listed) if not several.isEmpty() else listed
    near = lambda df: df.select(F.col("k").alias(key), F.slice(F.filter("x", lambda e: e["neighbour"] != F.col("k")), 1, s.k).alias("near"))
    single = near(listed.where("n = 1").withColumnRenamed("c", "k"))
    if several.isEmpty():
        return single
    # A direction that very many keys share has one list, which is sent to all of them; there are at most 1,000 such.
    hot = F.broadcast(classes.where(F.col("n") > max(1000, n_units // 1000)).select("h"))
    lists = listed.where("n > 1").select("h", "x")
    many = members.join(hot, "h", "left_semi").join(F.broadcast(lists.join(hot, "h", "left_semi")), "h")
    few = members.join(hot, "h", "left_anti").join(lists, "h")
    return single.unionByName(near(many)).unionByName(near(few))


def search(left: pa.Table, right: pa.Table, books: list[np.ndarray], s: Settings) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """The k best of the block's vectors (right) for each of its queries (left): queries, offsets, neighbours, cosines."""
    ids = right.column("o").combine_chunks() if right.num_rows else right.column("o")
    if not left.num_rows or not right.num_rows:
        return left.column("c").slice(0, 0).combine_chunks(), np.zeros(1, np.int32), pa.array([], right.schema.field("o").type), np.zeros(0)
    order = pc.sort_indices(right.column("o"))
    right = right.take(order)
    ids, data = right.column("o").combine_chunks(), _matrix(right.column("v").to_pylist(), s.dim)
    place = {k: i for i, k in enumerate(ids.to_pylist())}
    codes = _matrix(right.column("codes").to_pylist(), len(books), np.int16)
    norm = np.maximum(right.column("norm").to_numpy().astype(np.float32), 1e-6)[:, None]
    left = left.take(pc.sort_indices(left.column("rank")))
    rank = left.column("rank").to_numpy()
    qs = left.column("c").combine_chunks()
    self_ = np.array([place.get(k, -1) for k in qs.to_pylist()])
    queries = _matrix(left.column("u").to_pylist(), s.dim)
    starts, found, cosines = [np.zeros(1, np.int64)], [], []
    last = int(rank[-1])
    ends = np.searchsorted(rank, np.arange(last + 2))
    steps = [(a, min(a + STEP, ends[r + 1]), s.rerank[min(r, len(s.rerank) - 1)]) for r in range(last + 1) for a in range(ends[r], ends[r + 1], STEP)]
    for a, b, keep in steps:
        q, own = queries[a:b], self_[a:b]
        score = np.zeros((len(ids), b - a), np.float32)
        for m, book in enumerate(books):
            # All vectors here are of one cell, so of one word of the first book.
            score += np.take((book[codes[0, 0]] if book.ndim == 3 else book) @ q.T, codes[:, m], axis=0)
        score /= norm
        at = np.flatnonzero(own >= 0)
        score[own[at], at] = -9
        keep = min(len(ids), keep)
        top = np.argpartition(np.ascontiguousarray(-score.T), keep - 1, axis=1)[:, :keep] if keep < len(ids) else np.tile(np.arange(len(ids)), (b - a, 1))
        near = np.matmul(data[top], q[:, :, None])[:, :, 0]
        near[top == own[:, None]] = -9
        few = min(keep, 3 * s.k)  # float32 decides all but the last digits
        top = np.sort(np.take_along_axis(top, np.argpartition(-near, few - 1, axis=1)[:, :few], 1), axis=1)
        exact = np.round(np.einsum("qd,qrd->qr", q.astype(np.float64), data[top].astype(np.float64)), 6)
        exact[top == own[:, None]] = -9
        order = np.argsort(-exact, axis=1, kind="stable")[:, : s.k]
        exact, top = np.take_along_axis(exact, order, 1), np.take_along_axis(top, order, 1)
        some = exact > -2
        starts.append(some.sum(axis=1))
        found.append(top[some])
        cosines.append(exact[some])
    return qs, np.cumsum(np.concatenate(starts)).astype(np.int32), ids.take(pa.array(np.concatenate(found))), np.concatenate(cosines)


def neighbour_rows(near: DataFrame, key: str = "fact_idx") -> DataFrame:
    """key, rank (from 1), neighbour, cosine."""
    return near.select(key, F.posexplode("near").alias("r", "x")).select(key, (F.col("r") + 1).cast("int").alias("rank"), F.col("x.neighbour").alias("neighbour"), F.col("x.cosine").alias("cosine"))


def similar_pairs(near: DataFrame, least: float = 0.8, key: str = "fact_idx") -> DataFrame:
    """fact_a, fact_b (smaller first), cosine: pairs of which one is among the nearest of the other."""
    rows = neighbour_rows(near, key).where(F.col("cosine") >= least)
    return rows.groupBy(F.least(key, "neighbour").alias("fact_a"), F.greatest(key, "neighbour").alias("fact_b")).agg(F.max("cosine").alias("cosine"))
