"""Exact cosine top-n and threshold joins over vector columns.

Top-n: one side goes to every task, in parts of a fixed size, and the other is
read where it lies; only the best of each query leave a task. Threshold pairs:
vectors are dealt to cells around pivots and packed into blocks, and blocks to
groups of a fixed size; a task holds two groups, passes over the pairs of blocks
that the triangle inequality rules out, and a matrix product gives the
similarities of the others. Nothing but bounded parts of one side and numbers
per pivot pass through the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.session import stage

#: Bytes of vectors that go to every task at a time.
SHIP_BYTES = 32 << 20
#: Bytes of vectors in a group of blocks; a task of the threshold join holds two.
GROUP_BYTES = 32 << 20


def _unit(mat: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(mat, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return mat / n


def _stack(col: pd.Series) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in col.to_numpy()])


def _matrix(ids, data: bytes, kind: type) -> np.ndarray:
    """Unit vectors of a block, whose data are the given ones of type ``kind``."""
    return _unit(np.frombuffer(data, kind).reshape(len(ids), -1).astype(np.float64))


def _local_top_n(sims: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``n`` largest; ties by the smaller id.

    A partial sort finds the n-th value of every row; rows sort only what reaches it."""
    n = min(n, sims.shape[1])
    least = np.partition(sims, sims.shape[1] - n, axis=1)[:, -n]
    row, col = np.nonzero(sims >= least[:, None])
    order = np.lexsort((ids[col], -sims[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < n], col[place < n]


class _Best:
    """The ``n`` best (similarity, id) per row so far; ties to the smaller id."""

    def __init__(self, rows: int, n: int):
        self.s = np.full((rows, n), -np.inf)
        self.i = np.full((rows, n), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> None:
        """``sims``: a row for each of the rows ``at``, a column for each of ``ids``."""
        n = self.s.shape[1]
        row, col = _local_top_n(sims, ids, n)
        place = np.arange(len(row)) - np.searchsorted(row, row)
        s, i = np.full((len(at), n), -np.inf), np.full((len(at), n), np.iinfo(np.int64).max)
        s[row, place], i[row, place] = sims[row, col], ids[col]
        s, i = np.hstack([self.s[at], s]), np.hstack([self.i[at], i])
        order = np.lexsort((i, -s), axis=-1)[:, :n]
        self.s[at], self.i[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def found(self, ids: np.ndarray, names: tuple[str, str]) -> pd.DataFrame:
        row, place = np.nonzero(np.isfinite(self.s))
        return pd.DataFrame({names[0]: ids[row], names[1]: self.i[row, place], "similarity": self.s[row, place], "rank": place + 1})


def _blocks_of(ids: np.ndarray, m: np.ndarray, rows: int) -> list[tuple]:
    """The shipped side in blocks of near vectors: (positions, ids, matrix,
    centre, radius). Each goes to the nearest of some of its own rows."""
    k = -(-len(ids) // rows)
    cell = (m @ m[:: max(1, len(ids) // k)][:k].T).argmax(axis=1) if k > 1 else np.zeros(len(ids), np.int64)
    out = []
    for c in np.unique(cell):
        every = np.flatnonzero(cell == c)
        for at in (every[j:j + rows] for j in range(0, len(every), rows)):
            centre = _unit(m[at].mean(axis=0, keepdims=True))[0]
            radius = np.arccos(np.clip((m[at] @ centre).min(), -1, 1)) if m[at].any(axis=1).all() else np.pi
            out.append((at, ids[at], m[at], centre, radius))
    return out


def _most(m: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    """How similar each row can at most be to a vector of a block."""
    angle = np.arccos(np.clip(m @ centre, -1, 1)) - radius
    return np.where(m.any(axis=1), np.cos(np.maximum(angle, 0)) + 1e-9, 1.0)


def top_n_similar(queries: DataFrame, candidates: DataFrame, n: int = 3,
                  q_id: str = "query_id", q_vec: str = "embedding",
                  c_id: str = "row_id", c_vec: str = "embedding",
                  block_rows: int = 1024, ship: str = "queries", ship_bytes: int = SHIP_BYTES) -> DataFrame:
    """For each query, the ``n`` candidates of highest cosine similarity.

    Output ``(q_id, c_id, similarity DOUBLE, rank BIGINT)``; similarities are
    compared at 12 decimals, ties broken by the smaller candidate id. Ids must
    be integral and tell rows apart; rows without a vector take no part.

    The side named by ``ship`` is written and goes to every task, ``ship_bytes``
    of it at a time; the other side is read where it lies, once for each such
    part. A block of shipped vectors is skipped for rows that the triangle
    inequality keeps from their n-th best."""
    if ship not in ("queries", "candidates"):
        raise ValueError(f"ship: {ship}")
    (few, f_id, f_vec), (many, m_id, m_vec) = ((queries, q_id, q_vec), (candidates, c_id, c_vec))[:: 1 if ship == "queries" else -1]
    names = (q_id, c_id)
    schema = T.StructType([T.StructField(q_id, T.LongType()), T.StructField(c_id, T.LongType()),
                           T.StructField("similarity", T.DoubleType()), T.StructField("rank", T.LongType())])
    sent = stage(_rows(few, f_id, f_vec).withColumn("row", F.monotonically_increasing_id()), "shipped-vectors")
    spark, width = sent.sparkSession, sent.agg(F.max(F.size("v"))).first()[0]
    rows = _rows(many, m_id, m_vec)
    if width is None:
        return spark.createDataFrame([], schema)

    def part(held) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array([r.id for r in held], np.int64),
                                               np.array([r.v for r in held], np.float64)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            blocks = _blocks_of(ids, _unit(m), min(block_rows, 256))
            kept = _Best(len(ids), n)
            for b in batches:
                for start in range(0, len(b), block_rows):
                    mine = b.iloc[start:start + block_rows]
                    b_ids, b_m = mine["id"].to_numpy(np.int64), _unit(_stack(mine["v"]))
                    if ship == "queries":
                        for at, _, vectors, centre, radius in blocks:
                            near = np.flatnonzero(_most(b_m, centre, radius) >= kept.s[at, -1].min())
                            if len(near):
                                kept.add(at, np.round(vectors @ b_m[near].T, 12), b_ids[near])
                    else:
                        own = _Best(len(b_ids), n)
                        for _, c_ids, vectors, centre, radius in blocks:
                            near = np.flatnonzero(_most(b_m, centre, radius) >= own.s[:, -1])
                            if len(near):
                                own.add(near, np.round(b_m[near] @ vectors.T, 12), c_ids)
                        yield own.found(b_ids, names)
            if ship == "queries":
                yield kept.found(ids, names)

        return rows.mapInPandas(run, schema)

    parts = max(1, -(-sent.count() // max(1, ship_bytes // (8 * width))))
    if parts == 1:
        best = part(sent.select("id", "v").collect())  # at most ship_bytes
        if ship == "candidates":
            return best
    else:
        dealt = [part(sent.filter(F.pmod(F.xxhash64("row"), F.lit(parts)) == i).select("id", "v").collect()) for i in range(parts)]
        best = functools.reduce(DataFrame.unionByName, dealt)
    w = Window.partitionBy(q_id).orderBy(F.col("similarity").desc(), F.col(c_id))
    return best.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n)


def _rows(df: DataFrame, id_col: str, vec_col: str, kind: str = "double") -> DataFrame:
    return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("v"))
            .filter("id is not null and v is not null"))


def _number_type(df: DataFrame, vec_col: str) -> tuple[str, type]:
    """The type in which vectors move: single precision where they came so."""
    single = isinstance(df.schema[vec_col].dataType.elementType, T.FloatType)
    return ("float", np.float32) if single else ("double", np.float64)


def _cells(vectors: DataFrame, id_col: str, vec_col: str, block_rows: int, n_pivots: int,
           keep_zero: bool) -> tuple[DataFrame, np.ndarray]:
    """Rows ``(id, cell, angle, v)``: vectors with the nearest of up to
    ``n_pivots`` pivots (the rows of least id hash; no more than there are
    blocks to fill) and the angle to it."""
    kind, _ = _number_type(vectors, vec_col)
    rows = _rows(vectors, id_col, vec_col, kind)
    if not keep_zero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    n_pivots = max(1, min(n_pivots, rows.count() // block_rows))
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(n_pivots).select("v").collect()  # n_pivots vectors
    pivots = np.unique(_unit(np.array([r.v for r in taken], np.float64)), axis=0) if taken else np.zeros((0, 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = _unit(_stack(b["v"]))
                near = m @ pivots.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(m)), cell], -1, 1))
                yield pd.DataFrame({"id": b["id"], "cell": cell.astype(np.int32), "angle": angle, "v": b["v"]})

    return rows.mapInPandas(run, f"id bigint, cell int, angle double, v array<{kind}>"), pivots


def _cell_blocks(rows: DataFrame, pivots: np.ndarray, block_rows: int) -> DataFrame:
    """Blocks of rows of one cell, in order of their angle, so that a large
    cell becomes many blocks: ids, data, cell, the largest angle to the cell's
    pivot, and the least and largest angle to each pivot."""
    names = ["ids", "data", "cell", "wide", "low", "high"]

    def made(part: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(part["v"].to_list())
        angles = np.arccos(np.clip(_unit(m.astype(np.float64)) @ pivots.T, -1, 1))
        return pd.DataFrame([(part["id"].to_numpy(np.int64), m.tobytes(), int(part["cell"].iloc[0]), float(part["angle"].max()),
                              angles.min(axis=0), angles.max(axis=0))], columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            cut = np.flatnonzero(np.diff(held["cell"].to_numpy())) + 1
            start = 0
            for end in [*cut.tolist(), len(held)]:
                while end - start > block_rows:
                    yield made(held.iloc[start:start + block_rows])
                    start += block_rows
                if end < len(held):
                    yield made(held.iloc[start:end])
                    start = end
            held = held.iloc[start:].reset_index(drop=True)
        if held is not None and len(held):
            yield made(held)

    order = ["cell", "angle", "id"]
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(
        run, "ids array<bigint>, data binary, cell int, wide double, low array<double>, high array<double>")
    return out.withColumn("block", F.monotonically_increasing_id())


def _vector_blocks(vectors: DataFrame, threshold: float, id_col: str, vec_col: str, block_rows: int,
                   n_pivots: int) -> tuple[DataFrame, np.ndarray, float]:
    """``(blocks, pivots, reach)``: written blocks, and the largest angle of a
    pair of cosine ``>= threshold``."""
    reach = float(np.arccos(min(threshold, 1.0))) + 1e-6 if threshold > 0 else np.pi
    rows, pivots = _cells(vectors, id_col, vec_col, block_rows, n_pivots, keep_zero=threshold <= 0)
    return stage(_cell_blocks(rows, pivots, block_rows), "vector-blocks"), pivots, reach


def candidate_blocks(vectors: DataFrame, threshold: float, id_col: str = "row_id", vec_col: str = "embedding",
                     block_rows: int = 1024, n_pivots: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(blocks, pairs)``: blocks of near vectors, and the pairs of blocks
    (a_block, b_block; a block with itself too) that may hold a pair of cosine
    ``>= threshold``.

    Angles between unit vectors obey the triangle inequality. Two cells are
    ruled out where the angle of their pivots exceeds both radii and the
    threshold's angle (at most ``n_pivots`` squared, on the driver); then two
    blocks of the cells that are left where, seen from any pivot, their angles
    lie further apart than the threshold's. At a threshold of zero or less
    nothing is ruled out."""
    blocks, pivots, reach = _vector_blocks(vectors, threshold, id_col, vec_col, block_rows, n_pivots)
    wide = {r.cell: r.wide for r in blocks.groupBy("cell").agg(F.max("wide").alias("wide")).collect()}
    apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1)) if len(pivots) else pivots
    near = [(a, b) for a in wide for b in wide if a <= b and (a == b or apart[a, b] <= wide[a] + wide[b] + reach)]
    cells = vectors.sparkSession.createDataFrame(near, "a_cell int, b_cell int")
    head = blocks.select("block", "cell", "low", "high")
    a, b = (head.select([F.col(c).alias(f"{side}_{c}") for c in head.columns]) for side in "ab")

    def beyond(low: str, high: str):
        return F.exists(F.zip_with(low, high, lambda x, y: x - y), lambda gap: gap > reach)

    pairs = (a.join(cells, "a_cell").join(b, "b_cell")
             .filter((F.col("a_cell") < F.col("b_cell")) | (F.col("a_block") <= F.col("b_block")))
             .filter(~beyond("a_low", "b_high") & ~beyond("b_low", "a_high")).select("a_block", "b_block"))
    return blocks, stage(pairs, "block-pairs")


def local_forest(x: np.ndarray, y: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
    """Positions of the edges (x, y) of a maximum spanning forest on nodes
    below ``n``; of equal similarities the earlier edge is the stronger."""
    rank = np.empty(len(s), np.int64)
    rank[np.argsort(-s, kind="stable")] = np.arange(len(s))
    label, live, kept = np.arange(n), np.arange(len(s)), []
    while len(live):
        a, b = label[x[live]], label[y[live]]
        live, a, b = live[a != b], a[a != b], b[a != b]
        if not len(live):
            break
        best = np.full(n, len(s))
        np.minimum.at(best, a, rank[live])
        np.minimum.at(best, b, rank[live])
        take = (best[a] == rank[live]) | (best[b] == rank[live])
        kept.append(live[take])
        # both ends of a taken edge get the least label of their tree
        a, b = a[take], b[take]
        root = np.arange(n)
        while True:
            least = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
            root = root[root]
            if (root == before).all():
                break
        label = root[label]
    return np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.int64)


class _Forest:
    """A maximum spanning forest of the pairs seen so far on nodes below ``n``.

    Similarities fall into levels. Nodes that the forest joins above a pair's
    level make that pair superfluous, so that of a dense group few pairs are
    kept and sorted. Of equal similarities the pair of least ids is the stronger."""

    LEVELS, ROOM = 16, 1 << 20

    def __init__(self, ids: np.ndarray, limit: float):
        self.ids, self.limit, self.step = ids, limit, max((1.0 - limit) / self.LEVELS, 1e-12)
        self.edges = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.waiting, self.n_waiting = [], 0
        #: per level the least node that is joined to each node at that level or above
        self.joined = np.tile(np.arange(len(ids)), (self.LEVELS + 1, 1))

    def level(self, s: np.ndarray) -> np.ndarray:
        return np.clip((s - self.limit) / self.step, 0, self.LEVELS - 1).astype(np.int64)

    def least(self, level: int) -> float:
        """No similarity below this is of ``level`` or above."""
        return self.limit if level == 0 else self.limit + level * self.step - 1e-9

    def add(self, x: np.ndarray, y: np.ndarray, s: np.ndarray) -> bool:
        """True where the forest was brought up to date."""
        above = self.level(s) + 1
        new = self.joined[above, x] != self.joined[above, y]
        if new.any():
            self.waiting.append((x[new], y[new], s[new]))
            self.n_waiting += int(new.sum())
        if self.n_waiting <= max(self.ROOM, 2 * len(self.ids)):
            return False
        self.settle()
        return True

    def settle(self) -> None:
        x, y, s = (np.concatenate(c) for c in zip(self.edges, *self.waiting))
        low, high = np.minimum(self.ids[x], self.ids[y]), np.maximum(self.ids[x], self.ids[y])
        order = np.lexsort((high, low))
        x, y, s = x[order], y[order], s[order]
        at = local_forest(x, y, s, len(self.ids))
        self.edges, self.waiting, self.n_waiting = (x[at], y[at], s[at]), [], 0
        x, y, s = self.edges
        level, label = self.level(s), np.arange(len(self.ids))
        for k in range(self.LEVELS - 1, -1, -1):
            label = _joined(label, x[level == k], y[level == k])
            self.joined[k] = label

    def found(self) -> pd.DataFrame:
        self.settle()
        x, y, s = self.edges
        a, b = self.ids[x], self.ids[y]
        return pd.DataFrame({"src": np.minimum(a, b), "dst": np.maximum(a, b), "similarity": s})


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after the trees at both ends of each pair (x, y) became one."""
    a, b, root = label[x], label[y], np.arange(len(label))
    while len(a):
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            break
    return root[label]


def _group_pairs(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Rows (pair, part, block...): every block in each pair of groups that its
    group (``part``) takes part in, and the number of groups. Groups are of
    ``GROUP_BYTES``, or smaller where the pairs would not fill the cores: g groups
    have work for g * g / 2, as a group with itself has half the pairs."""
    n, size = blocks.agg(F.count("*"), F.sum(F.length("data"))).first()
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    groups = max(1, min(n, max(-(-(size or 0) // GROUP_BYTES), int(np.ceil(np.sqrt(2 * cores))))))
    part = F.pmod(F.xxhash64("block"), F.lit(groups))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    met = blocks.select(part.alias("part"), "block", "ids", "data", "low", "high").select("*", other.alias("other"))
    pair = F.least("part", "other") * groups + F.greatest("part", "other")
    met = met.select(pair.alias("pair"), "part", "block", "ids", "data", "low", "high")
    return met.repartition(groups * (groups + 1) // 2, "pair").sortWithinPartitions("pair", "part", "block"), groups


def similarity_edges(vectors: DataFrame, threshold: float, id_col: str = "row_id",
                     vec_col: str = "embedding", block_rows: int = 1024, n_pivots: int = 64,
                     forest: bool = False) -> DataFrame:
    """All pairs ``(src < dst)`` with cosine similarity ``>= threshold``; exact.

    Blocks are dealt to groups, and a task holds two groups at a time, so a
    vector moves once per group, not once per block that it meets. Of their
    pairs of blocks only those that :func:`candidate_blocks` would leave are
    multiplied. With ``forest`` each pair of groups keeps a maximum spanning
    forest of its pairs, at most one edge per row: the components, the maximum
    spanning forest and every row's best similarity stay those of all pairs, and
    a dense group does not leave its pairs behind. Ids must tell rows apart;
    rows without a vector have no edge."""
    schema = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()),
                           T.StructField("similarity", T.DoubleType())])
    limit, columns, kind = float(threshold), 8192, _number_type(vectors, vec_col)[1]
    blocks, _, reach = _vector_blocks(vectors, threshold, id_col, vec_col, block_rows, n_pivots)
    met, groups = _group_pairs(blocks)

    def pairs(held: pd.DataFrame) -> Iterator[pd.DataFrame]:
        pair = int(held["pair"].iloc[0])
        first = (held["part"] == pair // groups).to_numpy()
        ids = [np.asarray(i, np.int64) for i in held["ids"]]
        mats = [_matrix(i, d, kind) for i, d in zip(ids, held["data"])]
        low, high = np.stack(held["low"].to_list()), np.stack(held["high"].to_list())
        starts = np.cumsum([0, *map(len, ids)])
        row_ids = np.concatenate(ids)
        names, node = np.unique(row_ids, return_inverse=True)
        kept = _Forest(names, limit) if forest else None
        own = pair // groups == pair % groups

        def whole() -> np.ndarray:
            """Per level and block the label that all its nodes share, else one of its own."""
            label = kept.joined[:, node]
            least, most = (f.reduceat(label, starts[:-1], axis=1) for f in (np.minimum, np.maximum))
            return np.where(least == most, least, -1 - np.arange(len(ids)))

        shared = whole() if forest else None
        for a in np.flatnonzero(first):
            far = ((low - high[a] > reach) | (low[a] - high > reach)).any(axis=1)
            near = np.flatnonzero(~far & (np.arange(len(ids)) >= a if own else ~first))
            raised = (shared[:, near] == shared[:, [a]]).sum(axis=0) if forest else np.zeros(len(near), np.int64)
            if own and forest:  # a block with itself
                raised[near == a] = (shared[:, a] >= 0).sum()
            raised = np.minimum(raised - 1, _Forest.LEVELS).clip(0)
            order = np.argsort(raised, kind="stable")
            near, raised = near[order], raised[order]
            taken = 0
            while taken < len(near):
                size = np.cumsum([len(ids[b]) for b in near[taken:]])
                end = taken + max(1, int(np.searchsorted(size, columns, side="right")))
                some, level = near[taken:end], int(raised[taken])
                taken = end
                sims = mats[a] @ np.concatenate([mats[b] for b in some]).T
                i, j = np.nonzero(sims >= (kept.least(level) if forest else limit))
                s = sims[i, j]
                right = np.concatenate([np.arange(starts[b], starts[b + 1]) for b in some])[j]
                left = starts[a] + i
                if own and a in some:
                    ahead = left < right
                    left, right, s = left[ahead], right[ahead], s[ahead]
                if not forest:
                    x, y = row_ids[left], row_ids[right]
                    yield pd.DataFrame({"src": np.minimum(x, y), "dst": np.maximum(x, y), "similarity": s})
                elif kept.add(node[left], node[right], s):
                    shared = whole()
        if forest:
            yield kept.found()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            cut = np.flatnonzero(np.diff(held["pair"].to_numpy())) + 1
            start = 0
            for end in cut.tolist():
                yield from pairs(held.iloc[start:end])
                start = end
            held = held.iloc[start:].reset_index(drop=True)
        if held is not None and len(held):
            yield from pairs(held)

    return met.mapInPandas(run, schema)
