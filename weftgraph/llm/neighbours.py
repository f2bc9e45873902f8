"""Most similar vectors for every vector (problem 4), by additive quantisation.

Index.  A unit vector is written as a sum of one full-dimensional codeword of each level:
a coarse level, whose codeword is also the vector's cell, and finer levels.  Codebooks are
fitted on a bounded sample (k-means on residuals, beam-search encoding, one least-squares
update of all codewords together); *every* vector is encoded by beam search and stored
with the norm of its reconstruction.

Search.  A query visits the cells of its nearest coarse codewords.  A query's products with
all codewords make a look-up table; a stored vector's score is the sum of its codewords'
entries.  What can be among the best is scored again by the vectors themselves:

* with a bound `min_cos` of 0.9 or more, all items whose score plus the stored length of what
  their codes leave out reaches it: within the visited cells nothing is lost;
* otherwise the best of each cell by score over norm; where even the last of these is a near
  copy, codes cannot rank them and all items of the cell are scored.

How many cells are visited is measured on the sample: as many as hold `recall` of the true
neighbours of its queries, 16 at least.  Work grows as n^1.5 for close neighbours; neighbours
far apart in many dimensions take more cells, up to all.  An item within `reach` of its codeword
is in its cell's core; a query also visits every cell whose core can hold a neighbour within
`reach` (triangle inequality), so that inside a dense group none is missed: there the work is
quadratic.  `probes` of all cells is the exact way for everything else.

Adjacent cells share a block of about `chunk` items, and a query goes to a block once, with the
cells it visits there, so its vector is shipped a few times only.

Equal vectors are one class with its smallest ids, so a vector that a third of all rows
share is searched once.  Large cells are cut into chunks of items and of queries: every
unit of work is bounded, and nothing is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.core.session import collect_bounded, spread, store

CODE = 256  # codewords of a fine level


@dataclass
class Codebooks:
    coarse: np.ndarray  # cells x dims
    fine: np.ndarray  # levels x CODE x dims

    def near_cells(self, u: np.ndarray, most: int) -> np.ndarray:
        """The cells of each row, nearest first."""
        score = u @ self.coarse.T - 0.5 * (self.coarse**2).sum(1)
        most = min(most, score.shape[1])
        top = np.argpartition(-score, most - 1, axis=1)[:, :most]
        order = np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable")
        return np.take_along_axis(top, order, 1)

    def encode(self, u: np.ndarray, beam: int, cell: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, reconstruction): the best of `beam` partial sums is kept at each level."""
        n = len(u)
        cell = self.near_cells(u, 1)[:, 0] if cell is None else cell
        rest = (u - self.coarse[cell])[:, None, :]
        codes = np.zeros((n, 1, 0), np.uint8)
        for book in self.fine:
            # |rest - c|^2 up to a constant of the whole row
            err = (rest**2).sum(2)[:, :, None] - 2 * (rest @ book.T) + (book**2).sum(1)
            width = min(beam, err.shape[1] * CODE)
            flat = err.reshape(n, -1)
            top = np.argpartition(flat, width - 1, axis=1)[:, :width]
            parent, code = top // CODE, (top % CODE).astype(np.uint8)
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[code]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), code[:, :, None]], axis=2)
        best = (rest**2).sum(2).argmin(1)
        pick = np.arange(n), best
        return cell, codes[pick], u - rest[pick]


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        half = 0.5 * (c**2).sum(1)
        label = np.concatenate([(x[a : a + 4096] @ c.T - half).argmax(1) for a in range(0, len(x), 4096)])
        order = np.argsort(label, kind="stable")
        starts = np.searchsorted(label[order], np.arange(k))
        count = np.bincount(label, minlength=k)
        total = np.add.reduceat(np.concatenate([x[order], np.zeros((1, x.shape[1]), x.dtype)]), starts, axis=0)
        c = np.where((count > 0)[:, None], total / np.maximum(count, 1)[:, None], c).astype(np.float32)
    return c


def fit_codebooks(sample: np.ndarray, cells: int, levels: int, beam: int, rounds: int = 8, seed: int = 3) -> Codebooks:
    """Codebooks from unit vectors `sample` (float32)."""
    rng = np.random.default_rng(seed)
    coarse = _kmeans(sample, cells, rounds, rng)
    books = Codebooks(coarse, np.zeros((0, CODE, sample.shape[1]), np.float32))
    if not levels:
        return books
    cell = books.near_cells(sample, 1)[:, 0]
    rest = sample - coarse[cell]
    fine = []
    for _ in range(levels):
        book = _kmeans(rest, CODE, rounds, rng)
        near = np.concatenate([(rest[a : a + 4096] @ book.T - 0.5 * (book**2).sum(1)).argmax(1) for a in range(0, len(rest), 4096)])
        rest = rest - book[near]
        fine.append(book)
    books = Codebooks(coarse, np.stack(fine))
    # Least squares over all fine codewords at once, given the beam-searched codes.
    codes = np.concatenate([books.encode(sample[a : a + 1024], beam, cell[a : a + 1024])[1] for a in range(0, len(sample), 1024)])
    width = levels * CODE
    gram, right = np.eye(width, dtype=np.float64) * 1e-2, np.zeros((width, sample.shape[1]))
    at = codes.astype(np.int64) + np.arange(levels) * CODE
    for a in range(levels):
        np.add.at(right, at[:, a], sample - coarse[cell])
        for b in range(levels):
            np.add.at(gram, (at[:, a], at[:, b]), 1.0)
    right += 1e-2 * books.fine.reshape(width, -1)
    fitted = np.linalg.solve(gram, right).astype(np.float32).reshape(levels, CODE, -1)
    return Codebooks(coarse, fitted)


def usable(vec: Column, n_dims: int) -> Column:
    """Exactly n_dims components, all finite, not all zero."""
    good = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce((F.size(vec) == n_dims) & good & F.exists(vec, lambda v: v != 0), F.lit(False))


def _units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision; scaled first, so that very large components do not overflow."""
    x = vectors / np.abs(vectors).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _matrix(col: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(len(col), width)


def _pack(books_cast, beam: int):
    """(rep, vec) -> (rep, u, cell, codes, norm, rest, off): rest is the length of what the codes leave out, off that from the cell's codeword."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = books_cast.value
        for batch in parts:
            if not batch.num_rows:
                continue
            u = _units(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            cell = books.near_cells(u, 1)[:, 0]
            codes, made = np.zeros((len(u), len(books.fine)), np.uint8), np.empty_like(u)
            for a in range(0, len(u), 1024):
                part = slice(a, a + 1024)
                _, codes[part], made[part] = books.encode(u[part], beam, cell[part])
            length = lambda x: pa.array(np.linalg.norm(x, axis=1).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _binary(u), pa.array(cell.astype(np.int32)), _binary(codes), length(made), length(u - made), length(u - books.coarse[cell])],
                ["rep", "u", "cell", "codes", "norm", "rest", "off"],
            )

    return run


def _blocks(coarse: np.ndarray, items: np.ndarray, chunk: int) -> np.ndarray:
    """The block of each cell: the fullest free cell and its nearest free ones, up to `chunk` items (or one cell)."""
    block, free = np.zeros(len(coarse), np.int32), np.ones(len(coarse), bool)
    for seed in np.argsort(-items, kind="stable"):
        if not free[seed]:
            continue
        near = np.flatnonzero(free)
        near = near[np.argsort(((coarse[near] - coarse[seed]) ** 2).sum(1), kind="stable")]
        taken = near[np.cumsum(items[near]) <= max(chunk, items[seed])]
        free[seed] = free[taken] = False
        block[taken] = block[seed] = seed
    return block


def _visits(books_cast, probes: int, block: np.ndarray, core: np.ndarray, reach: float):
    """(rep, u) -> (rep, u, blk, cells): a row for each block with cells to visit.

    core: a cell's largest distance of a core item, negative without any.
    """
    cored = np.flatnonzero(core >= 0)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = books_cast.value
        cells, dims = books.coarse.shape
        square = (books.coarse[cored] ** 2).sum(1)
        for batch in parts:
            for a in range(0, batch.num_rows, 4096):
                own = batch.slice(a, 4096)
                u = _matrix(own.column(1), np.float32, dims)
                near = books.near_cells(u, probes)
                row, col = np.nonzero(1 + square - 2 * (u @ books.coarse[cored].T) <= (core[cored] + reach + 1e-3) ** 2)
                both = np.unique(np.concatenate([(np.arange(len(u))[:, None] * cells + near).ravel(), row * cells + cored[col]]))
                row, cell = both // cells, both % cells
                order = np.lexsort((cell, block[cell], row))
                row, cell = row[order], cell[order]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[cell[1:]] != block[cell[:-1]])])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), pa.array(cell.astype(np.int32)))
                at = pa.array(row[first])
                yield pa.RecordBatch.from_arrays([own.column(0).take(at), own.column(1).take(at), pa.array(block[cell[first]]), lists], ["rep", "u", "blk", "cells"])

    return run


def _best(row: np.ndarray, col: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest values of each row, rows in order."""
    order = np.lexsort((col, -value, row))
    sorted_row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(sorted_row, sorted_row) < k]


def _all_scored(q: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, product) of the `most` best items of each row, all scored."""
    score = q @ x.T
    most = min(most, len(x))
    c = np.argpartition(-score, most - 1, axis=1)[:, :most]
    return np.repeat(np.arange(len(q)), most), c.ravel(), np.take_along_axis(score, c, 1).ravel()


def _score(books_cast, spare: int, min_cos: float, near_copy: float = 0.9):
    """For applyInPandas: the items and queries of a block -> the `spare` best items of each query in it."""
    close = min_cos >= near_copy

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        books = books_cast.value
        dims, levels = books.coarse.shape[1], len(books.fine)
        is_q = pdf["is_q"].to_numpy()
        items, qs = pdf[~is_q].sort_values("cell", kind="stable"), pdf[is_q]
        none = pd.DataFrame({"q": np.zeros(0, np.int64), "item": np.zeros(0, np.int64), "cos": np.zeros(0, np.float32)})
        if not len(items) or not len(qs):
            return none
        x, u = (np.frombuffer(b"".join(f["u"]), np.float32).reshape(len(f), dims) for f in (items, qs))
        codes = np.frombuffer(b"".join(items["codes"]), np.uint8).reshape(len(items), levels)
        norm, rest = np.maximum(items["norm"].to_numpy(), np.float32(1e-6)), items["rest"].to_numpy()
        own, ids = items["rep"].to_numpy(), qs["rep"].to_numpy()
        cells, start = np.unique(items["cell"].to_numpy().astype(np.int64), return_index=True)
        stop = np.r_[start[1:], len(items)]
        size = qs["cells"].map(len).to_numpy()
        visit_q, visit_c = np.repeat(np.arange(len(qs)), size), np.concatenate(qs["cells"].to_list())
        out = []
        for a in range(0, len(qs), 2048):
            part = u[a : a + 2048]
            here = slice(*np.searchsorted(visit_q, [a, a + 2048]))
            vq, vc = visit_q[here] - a, visit_c[here]
            coarse, fine = part @ books.coarse[cells].T, [part @ book.T for book in books.fine]
            order = np.argsort(vc, kind="stable")
            vq, vc = vq[order], vc[order]
            found = []
            for n, (lo, hi) in enumerate(zip(np.searchsorted(vc, cells), np.searchsorted(vc, cells, "right"))):
                step = max(1, 4_000_000 // (stop[n] - start[n]))
                for b in range(lo, hi, step):
                    row, at = vq[b : min(hi, b + step)], slice(start[n], stop[n])
                    score = np.repeat(coarse[row, n][:, None], stop[n] - start[n], 1)
                    for level in range(levels):
                        score += np.take(fine[level][row], codes[at, level], axis=1)
                    if close:
                        r, c = np.nonzero(score + rest[at] >= min_cos - 1e-3)
                        if len(r) > 0.05 * score.size:  # a dense group
                            r, c, value = _all_scored(part[row], x[at], spare + 1)  # one may be itself
                        else:
                            value = np.concatenate([np.einsum("nd,nd->n", part[row[r[i : i + 100_000]]], x[at][c[i : i + 100_000]]) for i in range(0, len(r), 100_000)] or [np.zeros(0, np.float32)])
                    else:
                        short = min(max(2 * spare, 32), stop[n] - start[n])
                        c = np.argpartition(-score / norm[at], short - 1, axis=1)[:, :short]
                        value = np.einsum("qd,qsd->qs", part[row], x[at][c])
                        full = np.flatnonzero(value.min(1) >= near_copy) if short < stop[n] - start[n] else []
                        r = np.repeat(np.arange(len(row)), short)
                        c, value = c.ravel(), value.ravel()
                        if len(full):
                            again, at_c, at_v = _all_scored(part[row[full]], x[at], spare + 1)
                            keep = ~np.isin(r, full)
                            r, c, value = np.r_[r[keep], full[again]], np.r_[c[keep], at_c], np.r_[value[keep], at_v]
                    q, i = row[r], start[n] + c
                    keep = (value >= min_cos - 1e-4) & (ids[a + q] != own[i])
                    q, i, value = q[keep], i[keep], value[keep]
                    top = _best(q, i, value, spare)
                    found.append((q[top], i[top], value[top]))
            if found:
                q, i, value = (np.concatenate(f) for f in zip(*found))
                top = _best(q, i, value, spare)
                out.append(pd.DataFrame({"q": ids[a + q[top]], "item": own[i[top]], "cos": value[top].astype(np.float32)}))
        return pd.concat(out) if out else none

    return run


def calibrate(books: Codebooks, sample: np.ndarray, k: int, min_cos: float, recall: float, least: int = 16, n_queries: int = 1_000) -> int:
    """Cells to visit so that `recall` of the sample's true neighbours are met (k best with cosine >= min_cos)."""
    q = sample[:n_queries]
    cos = q @ sample.T
    cos[np.arange(len(q)), np.arange(len(q))] = -2
    cos[cos > 1 - 1e-6] = -2  # copies are always in the query's own cell
    k = min(k, len(sample))
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    row, col = np.nonzero(np.take_along_axis(cos, near, 1) >= max(min_cos, -1.0))
    if not len(row):
        return min(least, len(books.coarse))
    cell = books.near_cells(sample, 1)[:, 0]
    rank = np.argsort(books.near_cells(q, len(books.coarse)), axis=1)  # the place of each cell
    place = np.sort(rank[row, cell[near[row, col]]])
    return int(min(len(books.coarse), max(least, place[math.ceil(recall * len(place)) - 1] + 1)))


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    k: int = 3,
    min_cos: float = -1.0,
    queries: Column | None = None,
    n_dims: int = 64,
    probes: int | None = None,
    recall: float = 0.97,
    levels: int | None = None,
    beam: int = 4,
    sample_rows: int = 20_000,
    max_cells: int = 16_384,
    chunk: int = 16_384,
) -> DataFrame:
    """(id, other, cos): for each usable vector its k most similar others with cos >= min_cos.

    Ordered by cosine (double precision) descending, then id ascending; ids with fewer such
    others have fewer rows.  Usable: exactly n_dims components, none null, NaN or infinite,
    not all zero.  Each id counts once: of an id's repeated rows the smallest usable vector
    stands for it.  Null ids are left out.  `queries`: a condition on column `id`; the result has
    rows for those ids only, always against all vectors.  Empty input gives no rows.

    `probes`: cells a query visits, by default as many as reach `recall` on the sample.
    `levels`: fine codebooks, by default 4 for a `min_cos` of 0.9 or more (where a bound decides
    what is scored by vectors) and 12 otherwise, as the k best may be far.
    The number of cells is sqrt(n) up to `max_cells`; `sample_rows`, or 8 a cell if that is more,
    bounds the vectors that codebooks are fitted on (those of the smallest id hashes).
    """
    spark = df.sparkSession
    # Distance of unit vectors within which a dense group's neighbours are complete.
    reach = math.sqrt(2 - 2 * min(1.0, max(min_cos, 0.9)))
    vec = F.col(vec_col).cast("array<double>")
    rows, _ = store(
        df.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & usable(F.col("vec"), n_dims))
        .groupBy("id").agg(F.min("vec").alias("vec"))
        .select("id", "vec", F.struct(F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(1), "vec").alias("g")).alias("key"))
    )
    members = rows.select("id", "key")
    # The k + 1 smallest ids of a class: each task sends at most so many of any class.
    first = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    low = members.withColumn("r", first).filter(F.col("r") <= k + 1).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes, _ = store(low.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key").select("key", "size", "ids", F.element_at("ids", 1).alias("rep")))
    reps, _ = store(rows.select(F.col("id").alias("rep"), "vec").join(classes.select("rep"), "rep", "left_semi"))
    n = reps.count()
    empty = spark.createDataFrame([], "q bigint, item bigint, cos double")
    if n > 1:
        cells = max(1, min(max_cells, math.isqrt(n)))
        sample_rows = max(sample_rows, 8 * cells)
        picked = reps.select("vec").orderBy(F.xxhash64("rep", F.lit(5)), "rep").limit(sample_rows).toArrow()
        sample = _units(picked["vec"].combine_chunks().flatten().to_numpy().reshape(-1, n_dims))
        close = min_cos >= 0.9
        books = fit_codebooks(sample, cells, levels or (4 if close else 12), beam)
        probes = probes or calibrate(books, sample, k, min_cos, recall)
        books_cast = spark.sparkContext.broadcast(books)  # cells and levels x 256 codewords
        packed, _ = store(spread(reps).mapInArrow(_pack(books_cast, beam), "rep bigint, u binary, cell int, codes binary, norm float, rest float, off float"))
        asked = packed.select("rep", "u")
        if queries is not None:
            wanted = members.filter(queries).select("key").distinct().join(classes.select("key", "rep"), "key").select("rep")
            asked = asked.join(wanted, "rep", "left_semi")
        core = F.when(F.col("off") <= reach, F.col("off"))
        held = packed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(core).alias("far"))
        # One row a cell, at most max_cells.
        count, far = np.zeros(cells), np.full(cells, -1.0)
        for r in collect_bounded(held, max_cells, "cells"):
            count[r["cell"]], far[r["cell"]] = r["n"], -1.0 if r["far"] is None else r["far"]
        block = _blocks(books.coarse, count, chunk)
        visits = asked.mapInArrow(_visits(books_cast, probes, block, far, reach), "rep bigint, u binary, blk int, cells array<int>")
        load = dict(collect_bounded(visits.groupBy("blk").agg(F.count(F.lit(1)).alias("n")), max_cells, "blocks"))
        size = np.bincount(block, weights=count, minlength=cells)
        # A block with very many items or queries is cut into chunks of both.
        plan = [(int(b), math.ceil(size[b] / (2 * chunk)), math.ceil(load[b] / (4 * chunk))) for b in np.unique(block) if size[b] and load.get(b)]
        plan = F.broadcast(spark.createDataFrame(plan, "blk int, ics int, parts int"))  # at most max_cells rows
        to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        place = lambda c, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(c)).cast("int")
        stored = packed.withColumn("blk", F.element_at(F.lit(block.tolist()), F.col("cell") + 1).cast("int")).join(plan, "blk")
        visits = visits.join(plan, "blk")
        keys, nothing = ["blk", "ic", "part"], lambda c, t: F.lit(None).cast(t).alias(c)
        both = stored.withColumn("ic", place("ics", 11)).withColumn("part", to("parts")).select(
            *keys, "rep", "u", "cell", "codes", "norm", "rest", nothing("cells", "array<int>"), F.lit(False).alias("is_q")
        ).unionByName(
            visits.withColumn("part", place("parts", 13)).withColumn("ic", to("ics")).select(
                *keys, "rep", "u", nothing("cell", "int"), nothing("codes", "binary"), nothing("norm", "float"), nothing("rest", "float"), "cells", F.lit(True).alias("is_q"))
        )
        spare = k + 3  # single precision decides which are reranked
        found = both.groupBy(*keys).applyInPandas(_score(books_cast, spare, min_cos), "q bigint, item bigint, cos float")
        best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cos"), "item"))
        found = found.withColumn("r", best).filter(F.col("r") <= spare).select("q", "item")
        vq, vi = reps.select(F.col("rep").alias("q"), F.col("vec").alias("vq")), reps.select(F.col("rep").alias("item"), F.col("vec").alias("vi"))
        exact = found.join(vq, "q").join(vi, "item").select("q", "item", _cosine(F.col("vq"), F.col("vi")).alias("cos"))
        exact = exact.filter(F.col("cos") >= min_cos)
    else:
        exact = empty
    ids = members if queries is None else members.filter(queries)
    own = classes.filter("size > 1").select("key", "ids")
    alike = ids.join(own, "key").select("id", F.explode("ids").alias("other"), F.lit(1.0).alias("cos")).filter("id <> other")
    # A class of at most k ids lists all of them; a larger one is complete in itself.
    mine = classes.filter(F.col("size") <= k).select(F.col("rep").alias("q"), F.explode("ids").alias("id"))
    if queries is not None:
        mine = mine.filter(queries)
    theirs = classes.select(F.col("rep").alias("item"), F.col("ids").alias("others"))
    further = exact.join(mine, "q").join(theirs, "item").select("id", F.explode("others").alias("other"), "cos")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos"), "other"))
    return alike.unionByName(further).withColumn("r", rank).filter(F.col("r") <= k).select("id", "other", "cos")


def close_pairs(near: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: each pair of `nearest` once."""
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
