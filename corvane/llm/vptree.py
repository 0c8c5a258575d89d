"""Nearest neighbours by cosine with a vantage-point tree in every shard.

Vectors are compared at length 1, where the chord between two orders as their cosine does. A top tree, built from a bounded sample by
the same rule as all others, deals the rows to its leaves: at each node those within a radius of the vantage point go near, the others
far, so a query knows from its chords to the vantage points on the way how near a leaf's rows can be. Every row is in the index: a leaf's rows
make shards of about ``SHARD_ROWS``, split by a hash of the id, and a shard keeps its distinct vectors in a tree whose nodes know the
least and largest chord on either side. A side, or a leaf, whose triangle-inequality bound, times ``factor``, exceeds the query's worst
kept chord is passed over; factor 1 restores exact search. How far a factor may go depends on how the vectors lie, so unless one is given
it is the largest of ``FACTORS`` that finds a share of ``RECALL`` of the true neighbours within a bounded sample. Queries go
down in groups, a node's chords being one matrix product.

1. Blocks of queries meet the shards of their own leaf, which gives each query its first neighbours and a worst chord.
2. Blocks go to the other leaves that the bound leaves open, with the worst chords, and meet their shards.
3. The k best of all answers are ranked. Both meetings are joins on the leaf; nothing is broadcast but the top tree.

Scores are computed from the original vectors in double precision, by the same sums for every pair, so equal vectors have equal scores.
Of equal vectors in a shard a node holds one, with the k + 1 smallest ids: no other can be an answer.

Defined results: vectors that are null or of length 0, or that hold null or non-finite components, take no part; vectors of
different dimensions aren't compared; rows without id aren't indexed; repeated rows of an id with the same vector count
once, and the answers to different vectors of one id are ranked together; an empty table or query set gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import batched, bounded_sample, lean, stored

SHARD_ROWS, LEAF, BLOCK = 2048, 48, 2048
#: Most leaves of the top tree, and sampled rows for each: at most 32,768 vectors.
LEAVES, SAMPLED = 2048, 16
#: Factors from the boldest one, the recall that one must reach, and the sampled rows and queries on which it is measured.
FACTORS, RECALL, TUNED_ON, TUNED_BY = (12.0, 9.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.5, 1.0), 0.97, 4096, 128
#: Vantage points that are tried at a node, and rows on which they are.
TRIED, TRIED_ON = 6, 128
_ROUNDING = 1e-9


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<double>, dimension) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    return (
        vectors.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v"))
        .where(F.col("_id").isNotNull() & F.col("_v").isNotNull() & F.forall("_v", lambda x: x.isNotNull()))
        .where(F.forall("_v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0))
        .select("_id", "_v", F.size("_v").alias("_dim"))
    )


def _chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * np.maximum(cosine, -np.inf), 0))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors**2).sum(axis=1))[:, None]


def vantage(unit: np.ndarray, rows: np.ndarray) -> int:
    """Of a few rows, evenly spaced, the one from which the others' chords spread most."""
    some = rows[np.linspace(0, len(rows) - 1, min(TRIED_ON, len(rows))).astype(int)]
    tried = some[np.linspace(0, len(some) - 1, min(TRIED, len(some))).astype(int)]
    return int(tried[np.argmax(_chord(unit[tried] @ unit[some].T).std(axis=1))])


class TopTree:
    """Nodes (vantage vector, radius) of a complete tree, and the leaves below them."""

    def __init__(self, unit: np.ndarray, leaves: int):
        self.depth = max(0, (max(leaves, 1) - 1).bit_length())
        self.points = np.zeros(((1 << self.depth) - 1, unit.shape[1]))
        self.radii = np.zeros(len(self.points))
        self._fill(unit, np.arange(len(unit)), 0)

    def _fill(self, unit: np.ndarray, rows: np.ndarray, node: int) -> None:
        if node >= len(self.points) or not len(rows):
            return
        self.points[node] = unit[vantage(unit, rows)]
        chord = _chord(unit[rows] @ self.points[node])
        self.radii[node] = np.median(chord)
        near = chord <= self.radii[node]
        self._fill(unit, rows[near], 2 * node + 1)
        self._fill(unit, rows[~near], 2 * node + 2)

    def leaf_of(self, unit: np.ndarray) -> np.ndarray:
        node = np.zeros(len(unit), np.int64)
        for _ in range(self.depth):
            chord = _chord((unit * self.points[node]).sum(axis=1))
            node = 2 * node + 1 + (chord > self.radii[node])
        return node - len(self.points)

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """The least chord from each query to any row of each leaf that the way there allows."""
        chord = _chord(unit @ self.points.T)
        bound = np.zeros((len(unit), 1))
        for level in range(self.depth):
            first = (1 << level) - 1
            d, r = chord[:, first : 2 * first + 1], self.radii[first : 2 * first + 1]
            both = np.stack([np.maximum(bound, d - r), np.maximum(bound, r - d)], axis=2)
            bound = both.reshape(len(unit), -1)
        return bound


class Tree:
    """Distinct vectors of a shard with their ids, and the nodes over them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int):
        order = np.lexsort([ids])
        ids, vectors = ids[order], vectors[order]
        self.vectors, inverse = np.unique(vectors, axis=0, return_inverse=True)
        of: list[list[int]] = [[] for _ in self.vectors]
        for i, k in zip(ids.tolist(), inverse.ravel().tolist(), strict=True):
            if len(of[k]) < keep and i not in of[k]:
                of[k].append(i)
        self.ids = of
        self._scale()
        self.root = self._build(np.arange(len(self.unit)))

    def _scale(self) -> None:
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))
        self.unit = self.vectors / self.norms[:, None]
        self.compared = 0

    def __getstate__(self):
        return self.vectors, self.ids, self.root

    def __setstate__(self, state) -> None:
        self.vectors, self.ids, self.root = state
        self._scale()

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        corner = vantage(self.unit, rows)
        rest = rows[rows != corner]
        chord = _chord(self.unit[rest] @ self.unit[corner])
        cut = np.argsort(chord, kind="stable")
        half = len(rest) // 2
        near, far = cut[:half], cut[half:]
        sides = [(float(chord[s].min()), float(chord[s].max()), self._build(rest[s])) for s in (near, far)]
        return int(corner), sides

    def search(self, unit: np.ndarray, k: int, factor: float, worst: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the ``k`` nearest distinct vectors found for each unit query, -1 where there are fewer; none need be
        farther than the chords ``worst``. ``compared`` counts the pairs whose chord was taken."""
        best = np.full((len(unit), k), -np.inf)
        rows = np.full((len(unit), k), -1)
        least = np.full(len(unit), np.inf) if worst is None else worst

        def offer(who: np.ndarray, candidates: np.ndarray) -> None:
            self.compared += len(who) * len(candidates)
            cosine = np.concatenate([best[who], unit[who] @ self.unit[candidates].T], axis=1)
            names = np.concatenate([rows[who], np.broadcast_to(candidates, (len(who), len(candidates)))], axis=1)
            top = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            best[who], rows[who] = np.take_along_axis(cosine, top, 1), np.take_along_axis(names, top, 1)

        def visit(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if isinstance(node, np.ndarray):
                if len(node):
                    offer(who, node)
                return
            corner, sides = node
            offer(who, np.array([corner]))
            chord = _chord(unit[who] @ self.unit[corner])
            nearer = chord * 2 <= sides[0][1] + sides[1][0]
            for first, own in ((0, nearer), (1, ~nearer)):
                group, far = who[own], chord[own]
                for low, high, child in (sides[first], sides[1 - first]):
                    limit = np.minimum(_chord(best[group].min(axis=1)), least[group])
                    bound = np.maximum(np.maximum(far - high, low - far), 0) * factor
                    visit(child, group[bound <= limit + _ROUNDING])

        visit(self.root, np.arange(len(unit)))
        return rows, best


def in_memory(vectors: np.ndarray, queries: np.ndarray, k: int, factor: float, shard_rows: int = 0) -> tuple[list[list[int]], float, float]:
    """The rows found for the rows ``queries`` by the two steps, the share of all pairs that was compared, and that of the leaves
    that was visited."""
    unit = _unit(vectors)
    top = TopTree(unit, min(LEAVES, -(-len(unit) // (shard_rows or SHARD_ROWS))))
    leaf, bounds = top.leaf_of(unit), top.bounds(unit[queries])
    trees = {x: Tree(rows, vectors[rows], k + 1) for x in np.unique(leaf).tolist() for rows in (np.flatnonzero(leaf == x),)}
    found: list[dict[int, float]] = [{} for _ in queries]
    worst, visits = np.full(len(queries), np.inf), 0

    def best(own: dict[int, float]) -> list[int]:
        return sorted(own, key=lambda i: (-own[i], i))[:k]

    for home in (True, False):
        for x, tree in trees.items():
            go = leaf[queries] == x
            go = go if home else ~go & (bounds[:, x] * factor <= worst + _ROUNDING)
            visits += int(go.sum())
            for q, rows, cosine in zip(np.flatnonzero(go).tolist(), *tree.search(unit[queries][go], k + 1, factor, worst[go]), strict=True):
                found[q].update((i, c) for r, c in zip(rows.tolist(), cosine.tolist(), strict=True) if r >= 0 for i in tree.ids[r] if i != queries[q])
        for q, own in enumerate(found):
            worst[q] = np.sqrt(max(0.0, 2 - 2 * own[best(own)[-1]])) if len(own) >= k else np.inf
    compared = sum(t.compared for t in trees.values())
    return [best(x) for x in found], compared / max(1, len(queries) * len(unit)), visits / max(1, len(queries) * len(trees))


def tuned_factor(vectors: np.ndarray, k: int) -> float:
    """The largest of ``FACTORS`` with a recall of ``RECALL`` among at most ``TUNED_ON`` of ``vectors``, by brute force."""
    vectors = np.unique(vectors, axis=0)
    vectors = vectors[np.linspace(0, len(vectors) - 1, min(TUNED_ON, len(vectors))).astype(int)]
    queries = np.unique(np.linspace(0, len(vectors) - 1, min(TUNED_BY, len(vectors))).astype(int))
    cosine = _unit(vectors)[queries] @ _unit(vectors).T
    cosine[np.arange(len(queries)), queries] = -np.inf
    want = [set(x[:k]) for x in np.argsort(-cosine, axis=1)[:, : min(k, len(vectors) - 1)].tolist()]
    total = sum(map(len, want))
    for factor in FACTORS[:-1]:
        found, *_ = in_memory(vectors, queries, k, factor)
        if sum(len(w & set(f)) for w, f in zip(want, found, strict=True)) >= RECALL * total:
            return factor
    return FACTORS[-1]


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("_dim").to_numpy()
    for d in np.unique(dims).tolist():
        yield d, batch.filter(pa.array(dims == d))


class Index:
    """The top trees by dimension, and (_dim, _leaf, _tree), one row a shard, in the shared folder. Every usable row is in it."""

    def __init__(self, vectors: DataFrame, k: int, factor: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding"):
        rows = stored(usable(vectors, id_col, vector_col).distinct())
        counts = {r["_dim"]: r["count"] for r in rows.groupBy("_dim").count().collect()}
        sample = bounded_sample(rows, "_dim", LEAVES * SAMPLED, "_id").toArrow()
        self.tops, self.factor = {}, FACTORS[-1]
        for d, n in sorted(counts.items(), key=lambda x: x[1]):
            own = [v for v, x in zip(sample.column("_v").to_pylist(), sample.column("_dim").to_pylist(), strict=True) if x == d]
            own = np.array(sorted(own), float).reshape(-1, d)  # the tree doesn't depend on the order in which rows came
            self.tops[d] = TopTree(_unit(own), min(LEAVES, -(-n // SHARD_ROWS)))
            self.factor = tuned_factor(own, k) if factor is None else factor  # of the dimension with most rows in the end
        self.sent = vectors.sparkSession.sparkContext.broadcast(self.tops)
        dealt = stored(self.dealt(rows))
        # How many shards a leaf is split into, by its rows.
        sizes = {(r["_dim"], r["_leaf"]): -(-r["count"] // SHARD_ROWS) for r in dealt.groupBy("_dim", "_leaf").count().collect()}
        split = F.lit(1)
        if sizes:
            split = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for (d, i), n in sizes.items() if n > 1 for x in (f"{d}:{i}", n)]), F.concat_ws(":", "_dim", "_leaf")), F.lit(1)) if max(sizes.values()) > 1 else F.lit(1)
        self.shards = sum(sizes.values())
        rows = dealt.withColumn("_shard", F.pmod(F.xxhash64("_id"), split))

        def build(table: pa.Table) -> pa.Table:
            dim = table.column("_dim")[0].as_py()
            flat = table.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            tree = Tree(table.column("_id").to_numpy(), flat.reshape(-1, dim).astype(float), k + 1)
            return pa.table({"_dim": pa.array([dim], pa.int32()), "_leaf": table.column("_leaf").slice(0, 1), "_tree": [pickle.dumps(tree)]})

        self.trees = stored(rows.groupBy("_dim", "_leaf", "_shard").applyInArrow(build, "_dim int, _leaf int, _tree binary"))

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` (_id, _v, _dim) with their ``_leaf``."""
        sent = self.sent

        def run(batches):
            lean()
            for batch in batches:
                for d, part in _by_dimension(batch):
                    top = sent.value.get(d)
                    leaf = top.leaf_of(_unit(_vectors(part, d))) if top else np.zeros(part.num_rows, np.int64)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("_id", "_v", "_dim")), pa.array(leaf, pa.int32())], ["_id", "_v", "_dim", "_leaf"])

        return batched(rows.select("_id", "_v", "_dim")).mapInArrow(run, "_id long, _v array<double>, _dim int, _leaf int")


def _blocks(queries: DataFrame, index: Index, factor: float, home: bool) -> DataFrame:
    """(_dim, _leaf, _block): queries for their own leaf, or for the others that their worst chords (_worst) leave open."""
    sent = index.sent

    def run(batches):
        lean()
        for batch in batches:
            for d, whole in _by_dimension(batch):
                for at in range(0, whole.num_rows, BLOCK):
                    part = whole.slice(at, BLOCK)
                    ids, vectors, leaf = part.column("_id").to_numpy(), _vectors(part, d), part.column("_leaf").to_numpy()
                    worst = np.full(len(ids), np.inf) if home else part.column("_worst").to_numpy()
                    if home:
                        go = {k: leaf == k for k in np.unique(leaf).tolist()}
                    else:
                        open_ = sent.value[d].bounds(_unit(vectors)) * factor <= worst[:, None] + _ROUNDING
                        open_[np.arange(len(ids)), leaf] = False
                        go = {k: open_[:, k] for k in np.flatnonzero(open_.any(axis=0)).tolist()}
                    for k, own in go.items():
                        data = pickle.dumps((ids[own], vectors[own], worst[own]))
                        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["_dim", "_leaf", "_block"])

    return batched(queries).mapInArrow(run, "_dim int, _leaf int, _block binary")


def _met(index: Index, blocks: DataFrame, k: int, factor: float) -> DataFrame:
    """(query_id, vec_id, score): the answers of the shards to the blocks of their leaf."""

    def run(batches):
        lean()
        for batch in batches:
            for tree, block in zip(batch.column("_tree"), batch.column("_block"), strict=True):
                yield _answers(pickle.loads(tree.as_buffer()), *pickle.loads(block.as_buffer()), k, factor)

    joined = index.trees.join(blocks, ["_dim", "_leaf"]).select("_tree", "_block")
    return batched(joined).mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, factor: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each usable row where ``is_query`` holds, the ``k`` nearest other rows
    found (all, if there are fewer), the largest cosine first, ties by the smaller id."""
    index = Index(vectors, k, factor, id_col, vector_col)
    factor = index.factor
    queries = index.dealt(usable(vectors.where(is_query), id_col, vector_col).distinct())
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    first = stored(ranked(_met(index, _blocks(queries, index, factor, True), k, factor)).drop("rank"))
    # The chord of the k-th best; without k answers everything is open.
    worst = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.greatest(2 - 2 * F.min("score"), F.lit(0.0)))).alias("_worst"))
    again = queries.join(worst, queries["_id"] == worst["query_id"], "left").select("_id", "_v", "_dim", "_leaf", F.coalesce("_worst", F.lit(float("inf"))).alias("_worst"))
    rest = _met(index, _blocks(again, index, factor, False), k, factor)
    return ranked(first.unionByName(rest)).select("query_id", "rank", "vec_id", "score")


def _answers(tree: Tree, ids: np.ndarray, vectors: np.ndarray, worst: np.ndarray, k: int, factor: float) -> pa.RecordBatch:
    norms = np.sqrt((vectors**2).sum(axis=1))
    rows, _ = tree.search(vectors / norms[:, None], k + 1, factor, worst)
    who, place = np.nonzero(rows >= 0)
    row = rows[who, place]
    score = (vectors[who] * tree.vectors[row]).sum(axis=1) / (norms[who] * tree.norms[row])
    out: list[list[tuple[float, int]]] = [[] for _ in ids]
    for q, r, s in zip(who.tolist(), row.tolist(), score.tolist(), strict=True):
        out[q] += [(-s, i) for i in tree.ids[r] if i != ids[q]]
    flat = [(int(q), i, -s) for q, own in zip(ids.tolist(), out, strict=True) for s, i in sorted(own)[:k]]
    return pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat], t) for j, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], ["query_id", "vec_id", "score"])
