"""Nearest neighbours by cosine distance inside hard-filter partitions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of either side that one block of a partition holds.
BLOCK_ROWS = 20_000
#: Entries of a block pair's product that are held at a time (4 MB).
CHUNK = 1 << 19
#: A sweep's blocks have no fewer queries than this where they need not; rows that it meets at a time; queries and rows of one product.
LEAST_ROWS, SWEEP_ROWS, SWEEP_TILE = 2_000, 16_384, (128, 1_024)


def unit(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of a matrix, scaled to length 1; zero vectors stay zero."""
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1, length)


def blocks_of(df: DataFrame, keys: list[str], tag: str, rows: int) -> DataFrame:
    """Keys with the number of blocks that keep each near ``rows`` rows."""
    return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(tag))


def nearest(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the ``k`` largest finite entries of each row, largest first; of equal ones the first columns.

    The k-th largest of the maxima of many runs of columns is no larger than the k-th largest
    entry, so only the few entries from there on are sorted.
    """
    n = sims.shape[1]
    width = max(1, n // (16 * k))
    runs = sims[:, : n // width * width].reshape(len(sims), -1, width).max(axis=2) if width > 1 else sims
    low = min(k, runs.shape[1])
    edge = np.partition(runs, -low, axis=1)[:, -low] if n > k else np.full(len(sims), -np.inf)
    at, nb = np.nonzero(sims >= np.maximum(edge, np.finfo(sims.dtype).min)[:, None])
    value = sims[at, nb]
    order = np.lexsort((nb, -value, at))
    at, nb, value = at[order], nb[order], value[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    kept = (place < k) & np.isfinite(value)
    return at[kept], nb[kept], value[kept]


def hide_own(sims: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray) -> None:
    """No row is its own neighbour. ``c_ids`` are in order."""
    first, last = np.searchsorted(c_ids, q_ids, "left"), np.searchsorted(c_ids, q_ids, "right")
    for more in range(int((last - first).max(initial=0))):
        rows = np.flatnonzero(first + more < last)
        sims[rows, first[rows] + more] = -np.inf


def distinct(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct rows of a matrix, and for each row the number of its own among them."""
    if not m.size:
        return np.arange(min(1, len(m))), np.zeros(len(m), np.int64)
    raw = np.ascontiguousarray(m + 0.0).view(np.dtype((np.void, m.itemsize * m.shape[1]))).ravel()  # -0.0 reads as 0.0
    _, first, place = np.unique(raw, return_index=True, return_inverse=True)
    return first, place


def paired(x: np.ndarray, y: np.ndarray, at: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Dot products of the rows ``at`` of x with ``nb`` of y, each summed in the same order wherever it stands; ``CHUNK`` entries at a time."""
    step = max(1, CHUNK // max(1, x.shape[1]))
    return np.concatenate([np.zeros(0), *((x[at[s : s + step]] * y[nb[s : s + step]]).sum(axis=1) for s in range(0, len(at), step))])


def knn(
    queries: DataFrame, corpus: DataFrame, keys: list[str], k: int = 10, vec: str = "vec", id_col: str = "id",
    band: str | None = None, block_rows: int = BLOCK_ROWS, apart: list[str] | None = None, valid: tuple[str, str, str] | None = None,
) -> DataFrame:
    """For every query the ``k`` nearest corpus rows of its partition: query, nb, distance, rank.

    Both sides are cut into blocks of about ``block_rows`` within their partition, so
    a partition with a third of all rows is many blocks; each block pair is one matrix
    product that yields at most ``k`` rows per query, and a window merges them. A row is
    never its own neighbour. Ties go to the smaller id; equal vectors tie, in one block or in
    several, though a matrix product rounds by a row's place. ``band``: a column; neighbours
    must lie within [max(0, floor(q / 2)), floor(3 q / 2)] of the query's, unless that is -1.
    ``apart``: columns; a row that has the query's values in all of them (nulls are equal) is
    no neighbour. ``valid``: the query's time and the corpus's columns added and removed; a
    neighbour was added by that time and not removed (0: never) by then. Rows that these
    rule out are masked before the ``k`` nearest are taken, so ``k`` others are found.
    Rows whose vector is null or has an entry that is no number are nobody's neighbours and have none.
    """
    return ranked(block_nearest(queries, corpus, keys, k, vec, id_col, band, block_rows, apart, valid), k)


def ranked(found: DataFrame, k: int, *more: str) -> DataFrame:
    """The ``k`` nearest of each query among what its block pairs found, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*more, "query").orderBy("distance", "nb"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def block_nearest(
    queries: DataFrame, corpus: DataFrame, keys: list[str], k: int, vec: str, id_col: str, band: str | None = None, block_rows: int = BLOCK_ROWS,
    apart: list[str] | None = None, valid: tuple[str, str, str] | None = None,
) -> DataFrame:
    """The ``k`` nearest of each query in each block pair of :func:`knn`: query, nb, distance."""
    queries, corpus = queries.where(F.col(vec).isNotNull()), corpus.where(F.col(vec).isNotNull())
    kinds = {f.name: f.dataType for f in queries.schema}
    shared = [*([band] if band else []), *(apart or [])]
    asked, held = [*shared, *(valid or [])[:1]], [*shared, *(valid or [])[1:]]
    sizes = blocks_of(corpus, keys, "_nc", block_rows).join(blocks_of(queries, keys, "_nq", block_rows), keys)
    left = queries.select(*keys, id_col, vec, *[c for c in asked if c not in keys]).join(sizes, keys)
    left = left.withColumn("_q", F.pmod(F.xxhash64(id_col), "_nq")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_nc") - 1)))
    right = corpus.select(*keys, id_col, vec, *[c for c in held if c not in keys]).join(sizes, keys)
    right = right.withColumn("_c", F.pmod(F.xxhash64(id_col), "_nc").cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nq").cast("long") - 1)))
    out = T.StructType([T.StructField("query", kinds[id_col]), T.StructField("nb", kinds[id_col]), T.StructField("distance", T.DoubleType())])

    def block(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query": [], "nb": [], "distance": []})
        c = c.sort_values(id_col, kind="stable").reset_index(drop=True)
        qm, cm, q_ids, c_ids = unit(q[vec]), unit(c[vec]), q[id_col].to_numpy(), c[id_col].to_numpy()
        made = []
        if apart:
            codes = pd.concat([q[apart], c[apart]]).groupby(apart, dropna=False, sort=False).ngroup().to_numpy()
            q_group, c_group = codes[: len(q)], codes[len(q) :]
        bad_q, bad_c = (~np.isfinite(m).all(axis=1) for m in (qm, cm))
        qm[bad_q], cm[bad_c] = 0, 0
        first, place = distinct(cm)
        copies = len(first) < len(c)
        own = cm[first] if copies else cm
        step = max(1, CHUNK // len(c))
        for start in range(0, len(q), step):
            rows = slice(start, start + step)
            sims = qm[rows] @ own.T
            if copies:
                sims = sims[:, place]
            hide_own(sims, q_ids[rows], c_ids)
            sims[bad_q[rows]] = -np.inf
            sims[:, bad_c] = -np.inf
            if band:
                b = q[band].to_numpy(float)[rows, None]
                x = c[band].to_numpy(float)[None, :]
                sims[(b != -1) & ((x < np.maximum(0, np.floor(b * 0.5))) | (x > np.floor(b * 1.5)))] = -np.inf
            if apart:
                sims[q_group[rows, None] == c_group[None, :]] = -np.inf
            if valid:
                t, added, removed = q[valid[0]].to_numpy()[rows, None], c[valid[1]].to_numpy()[None, :], c[valid[2]].to_numpy()[None, :]
                sims[~((added <= t) & ((removed == 0) | (removed > t)))] = -np.inf
            at, nb, _ = nearest(sims, k)
            made.append(pd.DataFrame({"query": q_ids[start + at], "nb": c_ids[nb], "distance": 1 - paired(qm, cm, start + at, nb)}))
        return pd.concat(made)

    parts = [*keys, "_q", "_c"]
    left = left.toDF(*left.columns)  # both sides may come from one table
    return left.groupBy(*parts).cogroup(right.groupBy(*parts)).applyInPandas(block, out)


def knn_sweep(
    df: DataFrame, keys: list[str], blocks: dict[str, list[str]], settings: list[tuple[str, float]], k: int = 10, base: list[str] | None = None,
    id_col: str = "id", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every row's ``k`` nearest others under several vectors at once: setting (place in ``settings``), query, nb, distance, rank.

    A setting (name, weight) stands for the columns ``base`` (arrays) followed by those of
    ``blocks[name]`` times the weight. A partition's queries are cut into blocks of at most about
    ``block_rows``; a task holds a block, and the partition's rows come past it in order of
    their id, whatever their number (see :class:`Sweep`). So a query's neighbours are whole when
    its task ends, and nothing is merged later. Ties, and rows that have no neighbours, are as in :func:`knn`.
    """
    assert all(name in blocks for name, _ in settings)
    base = base or ["vec"]
    searches = list(dict.fromkeys((name, float(w)) if w else ("", 0.0) for name, w in settings))  # without a weight all blocks are alike
    of = [searches.index((name, float(w)) if w else ("", 0.0)) for name, w in settings]
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, [*keys, "_q"]
    columns = list(dict.fromkeys([*base, *[c for own in blocks.values() for c in own]]))
    given = df.select(*keys, id_col, *columns).dropna(subset=[id_col, *columns])
    rows = F.least(F.lit(block_rows), F.greatest(F.lit(LEAST_ROWS), F.ceil(F.col("_all") / (2 * cores))))
    sizes = given.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).crossJoin(F.broadcast(given.agg(F.count(F.lit(1)).alias("_all"))))  # one row
    sized = given.join(sizes.select(*keys, F.ceil(F.col("_rows") / rows).cast("int").alias("_n")), keys)
    # a row goes to its own block as a query (-1), and to every block of its partition
    sent = sized.withColumn("_c", F.explode(F.sequence(F.lit(-1), F.col("_n") - 1))).withColumn("_held", F.col("_c") >= 0)
    sent = sent.withColumn("_q", F.when(F.col("_held"), F.col("_c")).otherwise(F.pmod(F.xxhash64(id_col), "_n").cast("int"))).drop("_c", "_n")
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * cores)
    # blocks are few and long: a partition's go to tasks of their own, where by a hash some would meet in one
    sent = sent.repartitionById(tasks, F.pmod(F.xxhash64(*keys) + F.col("_q"), F.lit(tasks)).cast("int")).sortWithinPartitions(*parts, "_held", id_col)
    kind = df.schema[id_col].dataType
    out = T.StructType([T.StructField("setting", T.IntegerType()), T.StructField("query", kind), T.StructField("nb", kind), T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType())])

    def search(batches):
        now, block = None, None
        for batch in batches:
            for key, held, part in runs(batch, parts, "_held"):
                if key != now:
                    yield from block.found(of) if block else ()
                    now, block = key, Sweep(base, blocks, searches, k, id_col)
                block.meet(part) if held else block.asked.append(part)
        yield from block.found(of) if block else ()

    return sent.mapInArrow(search, out)


def runs(batch: pa.RecordBatch, keys: list[str], flag: str) -> Iterator[tuple[str, bool, pa.RecordBatch]]:
    """Runs of rows with equal keys and flag: the keys as text, the flag, the rows."""
    values = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, flag)]
    new = np.zeros(batch.num_rows + 1, bool)
    new[[0, -1]] = True
    for v in values:
        new[1:-1] |= (v[1:] != v[:-1]) & ((v[1:] == v[1:]) | (v[:-1] == v[:-1]))  # what is no number equals itself as a key
    cuts = np.flatnonzero(new)
    for start, end in zip(cuts[:-1], cuts[1:]):
        yield repr([v[start] for v in values[:-1]]), bool(values[-1][start]), batch.slice(start, end - start)


def matrix(parts: list[pa.RecordBatch], columns: list[str]) -> np.ndarray:
    """Array columns side by side, a row of doubles for each row."""
    made = []
    for part in parts:
        lists = [part.column(c) for c in columns]
        widths = [np.unique(x.value_lengths().to_numpy()) for x in lists]
        if any(len(w) > 1 for w in widths):
            raise ValueError(f"vectors of several lengths in {columns}")
        made.append(np.concatenate([x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), *w) for x, w in zip(lists, widths)], axis=1))
    return np.concatenate(made)


class Side:
    """Rows of one side of a sweep. ``exact``: each search's vectors, of length 1; ``fine``: which of them are numbers.

    ``base``, ``more`` and ``length`` are single-precision forms, scaled by the base's length: a
    search's dot product is that of ``base`` plus that of its ``more``.
    """

    def __init__(self, parts: list[pa.RecordBatch], base: list[str], blocks: dict[str, list[str]], searches: list[tuple[str, float]], id_col: str) -> None:
        self.ids = np.concatenate([p.column(id_col).to_numpy(zero_copy_only=False) for p in parts])
        plain = matrix(parts, base)
        wide = [np.concatenate([plain, matrix(parts, blocks[name]) * w], axis=1) if w else plain for name, w in searches]
        self.fine = [np.isfinite(m).all(axis=1) for m in wide]
        wide = [np.where(ok[:, None], m, 0) for ok, m in zip(self.fine, wide)]
        plain = np.where(np.isfinite(plain).all(axis=1)[:, None], plain, 0)
        lengths = [np.linalg.norm(m, axis=1) for m in wide]
        self.exact = [m / np.where(x == 0, 1, x)[:, None] for m, x in zip(wide, lengths)]
        scale = np.linalg.norm(plain, axis=1)
        scale = np.where(scale == 0, np.max(lengths, axis=0), scale)
        scale = np.where(scale == 0, 1, scale)[:, None]
        self.base = (plain / scale).astype(np.float32)
        # a column of zeros keeps the narrow product a matrix's: that of two vectors is slower
        self.more = [np.pad(m[:, plain.shape[1] :] / scale, ((0, 0), (0, 1))).astype(np.float32) for m in wide]
        self.length = [(x / scale[:, 0]).astype(np.float32) for x in lengths]


class Sweep:
    """A block's queries and the ``k`` nearest of each so far, under several vectors, among rows that come in order of their id.

    A search (name, weight) adds a block of entries to the base. A product in single precision
    is taken once for the base, and a narrow one for each search, which also has what a row must reach
    to be among a query's ``k`` nearest so far, less ``slack``. The few that reach it are candidates, and their distances
    are summed in double precision, in one order for all. ``slack`` is over twice the most that a
    product in single precision can be off, so no neighbour is lost. Of equal vectors only the first k + 1 ids
    can be anyone's neighbours. What is held: the block, some ``SWEEP_ROWS`` rows, and candidates up to about ``CHUNK`` a search.
    """

    def __init__(self, base: list[str], blocks: dict[str, list[str]], searches: list[tuple[str, float]], k: int, id_col: str) -> None:
        self.form, self.searches, self.k = (base, blocks, searches, id_col), range(len(searches)), k
        self.asked, self.held, self.seen, self.known, self.own = [], [], 0, 0, None

    def meet(self, part: pa.RecordBatch) -> None:
        """Some rows of the corpus; they wait until there are enough for a product."""
        self.held.append(part)
        if sum(p.num_rows for p in self.held) >= SWEEP_ROWS:
            self.look()

    def look(self) -> None:
        """The rows that wait against all queries."""
        rows = Side(self.held, *self.form)
        self.id_type = self.held[0].schema.field(self.form[-1]).type
        self.held = []
        if not self.asked:
            return
        if self.own is None:
            self.own = own = Side(self.asked, *self.form)
            self.slack = [(m.shape[1] + 16) * 2.0**-23 for m in own.exact]
            self.floor = [np.full(len(own.ids), -2.0) for _ in self.searches]
            nothing = np.zeros(0, np.int64)
            self.best = [(nothing, np.zeros(0), nothing, rows.ids[:0]) for _ in self.searches]
            self.begin(rows)
        may = [fine.copy() for fine in rows.fine]
        for m, exact in zip(may, rows.exact):
            m[m] = first_copies(exact[m], rows.ids[m], self.k)
        edge = [self.edge(s) for s in self.searches]
        asked = [np.concatenate([np.where(rows.length[s] == 0, 1, rows.length[s])[:, None], rows.more[s]], axis=1) for s in self.searches]
        waiting, counts = [[] for _ in self.searches], [0 for _ in self.searches]
        tall, wide = SWEEP_TILE
        sims, bound, hit = np.empty(tall * wide, np.float32), np.empty(tall * wide, np.float32), np.empty(tall * wide, bool)
        for left in range(0, len(rows.ids), wide):
            for top in range(0, len(self.own.ids), tall):
                q, c = slice(top, top + tall), slice(left, left + wide)
                shape = (len(self.own.base[q]), len(rows.base[c]))
                x, y, z = (m[: shape[0] * shape[1]].reshape(shape) for m in (sims, bound, hit))
                np.matmul(self.own.base[q], rows.base[c].T, out=x)
                for s in self.searches:
                    np.matmul(edge[s][q], asked[s][c].T, out=y)
                    np.greater(x, y, out=z)
                    if not may[s][c].all():
                        z &= may[s][c]
                    some = np.flatnonzero(z.any(axis=1))
                    if len(some):
                        at, nb = np.divmod(np.flatnonzero(z[some]), shape[1])
                        waiting[s].append((some[at] + top, nb + left))
                        counts[s] += len(at)
                    if counts[s] > CHUNK:
                        self.take(s, rows, waiting[s])
                        waiting[s], counts[s], edge[s] = [], 0, self.edge(s)
            met = self.seen + min(left + wide, len(rows.ids))
            if met >= 2 * self.known or met == self.seen + len(rows.ids):
                for s in self.searches:
                    if waiting[s]:
                        self.take(s, rows, waiting[s])
                        waiting[s], counts[s], edge[s] = [], 0, self.edge(s)
                self.known = met
        self.seen += len(rows.ids)

    def begin(self, rows: Side) -> None:
        """What a row must reach, from the first rows."""
        first = slice(0, max(1024, 4 * self.k))
        for s in self.searches if len(rows.ids) > self.k else ():
            step = max(1, CHUNK // len(rows.ids[first]))
            may = rows.fine[s][first] & (rows.length[s][first] > 0)
            for top in range(0, len(self.own.ids), step):
                q = slice(top, top + step)
                sims = self.own.base[q] @ rows.base[first].T + self.own.more[s][q] @ rows.more[s][first].T
                sims /= np.maximum(self.own.length[s][q, None] * rows.length[s][None, first], np.finfo(np.float32).tiny)
                sims[:, ~may] = -np.inf
                hide_own(sims, self.own.ids[q], rows.ids[first])
                least = np.partition(sims, -self.k, axis=1)[:, -self.k].astype(np.float64)
                known = np.isfinite(least) & (self.own.length[s][q] > 0)
                self.floor[s][q] = np.where(known, np.minimum(least, 1) - self.slack[s], -2.0)

    def edge(self, s: int) -> np.ndarray:
        """The queries' side of the narrow product: its value is the least dot product with the base that counts."""
        length, floor = self.own.length[s].astype(np.float64), self.floor[s]
        # a query of length 0 that has its neighbours gets no others: all are as near, and ids only grow
        reach = np.where(floor > -2, (floor - self.slack[s]) * length, -2 * np.where(length == 0, 1, length))
        return np.concatenate([reach[:, None].astype(np.float32), -self.own.more[s]], axis=1)

    def take(self, s: int, rows: Side, waiting: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Candidates join the best so far."""
        at, nb = (np.concatenate(x) for x in zip(*waiting))
        kept = (self.own.ids[at] != rows.ids[nb]) & self.own.fine[s][at]
        at, nb = at[kept], nb[kept]
        far = 1 - paired(self.own.exact[s], rows.exact[s], at, nb)
        at, far, place, ids = (np.concatenate(x) for x in zip(self.best[s], (at, far, self.seen + nb, rows.ids[nb])))
        order, rank = ranks(at, far, place, self.k)
        at, far = at[order], far[order]
        self.best[s] = at, far, place[order], ids[order]
        last = rank == self.k - 1
        self.floor[s][at[last]] = 1 - far[last]

    def found(self, of: list[int]) -> Iterator[pa.RecordBatch]:
        """Every setting's neighbours, where ``of`` has its search. Queries that share an id are one."""
        if self.held:
            self.look()
        for number, s in enumerate(of if self.own is not None else ()):
            at, far, place, ids = self.best[s]
            code = pd.factorize(self.own.ids)[0]
            order, rank = ranks(code[at], far, place, self.k)
            own = [pa.array(x, type=self.id_type) for x in (self.own.ids[at[order]], ids[order])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), number, np.int32)), *own, pa.array(far[order]), pa.array((rank + 1).astype(np.int32))], names=["setting", "query", "nb", "distance", "rank"])


def ranks(at: np.ndarray, far: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the ``k`` nearest of each query are, in order, and their rank from 0; of equally near ones those with the first places."""
    order = np.lexsort((place, far, at))
    at = at[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    return order[rank < k], rank[rank < k]


def first_copies(m: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first k + 1 ids of their vector. ``ids`` are in order."""
    first, own = distinct(m)
    if len(first) == len(m):
        return np.ones(len(m), bool)
    order = np.argsort(own, kind="stable")
    own, ids = own[order], ids[order]
    other = np.r_[True, own[1:] != own[:-1]]
    number = np.cumsum(other | np.r_[True, ids[1:] != ids[:-1]])
    few = np.zeros(len(m), bool)
    few[order] = number - number[other][np.cumsum(other) - 1] <= k
    return few


def knn_lsh(queries: DataFrame, corpus: DataFrame, keys: list[str], k: int = 10, vec: str = "vec", id_col: str = "id", tables: int = 8, planes: int = 6, dims: int = 64, seed: int = 5) -> DataFrame:
    """Approximate form: candidates share the signs of ``planes`` random projections in one of ``tables``; re-ranked exactly.

    A code is one more partition key of :func:`knn`: a bucket gives each of its queries at most ``k``
    rows, so no pair of candidates is ever a row, and a bucket with many rows is many blocks.
    """
    rng = np.random.default_rng(seed)
    normals = rng.normal(size=(tables, planes, dims)).round(4).reshape(-1, dims).T
    bits = 1 << np.arange(planes)

    @F.pandas_udf("array<int>")
    def codes(v: pd.Series) -> pd.Series:
        signs = (unit(v) @ normals > 0).reshape(len(v), tables, planes)
        return pd.Series(list(((signs * bits).sum(axis=2) + np.arange(tables) * (1 << planes)).astype(np.int32)))

    hashed = lambda df: df.where(F.col(vec).isNotNull()).select(*keys, id_col, vec).withColumn("_code", F.explode(codes(F.col(vec))))
    found = block_nearest(hashed(queries), hashed(corpus), [*keys, "_code"], k, vec, id_col)
    return ranked(found.groupBy("query", "nb").agg(F.min("distance").alias("distance")), k)  # a pair may share several codes


@dataclass(frozen=True)
class Cells:
    """Unit centroids of an inverted-file index, and the cells that a query looks into."""

    centroids: np.ndarray
    probes: int


def fit_cells(
    corpus: DataFrame, k: int = 10, vec: str = "vec", id_col: str = "id", recall: float = 0.95, max_sample: int = 20_000, seed: int = 5, keys: list[str] | None = None, asked: int = 300,
) -> Cells:
    """Spherical k-means over at most ``max_sample`` rows, those first by a hash of the id.

    There are about as many cells as the root of the corpus's rows. ``probes`` is the least
    number of cells with which ``asked`` rows of the sample find ``recall`` of their ``k`` nearest
    among all rows of their partition by ``keys``, as brute force finds them: a sample's own nearest
    rows lie elsewhere than the corpus's, and a partition's elsewhere than those of all rows. The
    centroids are fitted without those rows (a quarter of the sample at most), as a fit draws centroids to its own.
    """
    n = corpus.count()
    first = corpus.where(F.col(vec).isNotNull()).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col)
    rows = first.limit(max_sample).select(*(keys or [F.lit(0).alias("_all")]), id_col, vec).collect()  # bounded
    m = unit(pd.Series([r[vec] for r in rows])) if rows else np.zeros((0, 1))
    own, m = rows[: min(asked, len(rows) // 4)], m[min(asked, len(rows) // 4) :]
    cells = int(max(1, min(4096, round(math.sqrt(n)), len(m))))
    centroids = m[:cells].copy()
    for _ in range(8):
        nearest_cell = np.argmax(m @ centroids.T, axis=1) if len(m) else np.zeros(0, int)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest_cell, m)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.where(length == 0, 1, length), centroids)
    if len(m) <= k + 1:
        return Cells(centroids, cells)
    parts = keys or ["_all"]
    every = corpus if keys else corpus.withColumn("_all", F.lit(0))
    queries = corpus.sparkSession.createDataFrame(own, every.select(*parts, id_col, vec).schema)
    pairs = knn(queries, every, parts, k, vec, id_col).select("query", F.col("nb").alias(id_col))
    near = every.select(id_col, vec).join(F.broadcast(pairs), id_col).select("query", vec).toPandas()  # at most asked * k rows
    if near.empty:
        return Cells(centroids, cells)
    place = {r[id_col]: np.argsort(np.argsort(-(unit(pd.Series([r[vec]])) @ centroids.T)[0], kind="stable"), kind="stable") for r in own}
    cell = np.argmax(unit(near[vec]) @ centroids.T, axis=1)
    needed = np.sort([place[q][c] for q, c in zip(near["query"], cell)])
    return Cells(centroids, int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1)


def knn_cells(queries: DataFrame, corpus: DataFrame, keys: list[str], cells: Cells, k: int = 10, vec: str = "vec", id_col: str = "id") -> DataFrame:
    """Approximate form of :func:`knn` over an inverted file: every row lies in its nearest cell, a query looks into ``probes`` of them.

    The cell is one more partition key, so cells with many rows are cut into blocks like
    any partition; a query's rows from its cells are merged by the same window.
    """
    centroids, probes = cells.centroids, cells.probes

    def places(n: int):
        @F.pandas_udf("array<int>")
        def found(v: pd.Series) -> pd.Series:
            near = unit(v) @ centroids.T
            top = np.argsort(-near, axis=1, kind="stable")[:, :n]
            return pd.Series(list(top.astype(np.int32)))

        return found

    asked = queries.withColumn("_cell", F.explode(places(probes)(F.col(vec))))
    held = corpus.withColumn("_cell", F.explode(places(1)(F.col(vec))))
    return knn(asked, held, [*keys, "_cell"], k, vec, id_col)


def sparseness(neighbours: DataFrame, queries: DataFrame, tau: float = 0.5, n_min: int = 3, id_col: str = "id") -> DataFrame:
    """Per query: neighbours, largest distance, sparse (too few, or one beyond ``tau``)."""
    got = neighbours.groupBy(F.col("query").alias(id_col)).agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("max_distance"))
    both = queries.select(id_col).join(got, id_col, "left").fillna(0, ["n"])
    return both.withColumn("sparse", (F.col("n") < n_min) | (F.col("max_distance") > tau))


Neighbours = Callable[[DataFrame, DataFrame], DataFrame]
