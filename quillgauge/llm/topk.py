"""Exact top-k by inner product with a three-phase uniform threshold.

Vectors are cut into ``slices`` runs of components, whose partial inner products are the local
scores. Queries go in blocks of at most ``block`` rows, each three phases over all vectors:

1. Every task gathers, per query and slice, its k best local scores and adds up the scores of those
   rows; the k-th best sum per query over all tasks is a safe cutoff: k rows reach it.
2. The cutoffs are broadcast. A row that reaches a cutoff c has a local score of at least c/slices
   somewhere. Each task collects such entries; an entry whose known local scores, with c/slices for
   the others, stay below c is out.
3. The scores that the entries left are missing are resolved exactly, and each task passes on the k
   best that reach the cutoff, ties to the smaller id, from which the k best of all are taken.

Scores are integers; products are formed in float64 where that is exact, else with Python integers.
Only a block of queries and its cutoffs are ever broadcast: ``block`` rows, a fixed bound.

Edge cases: vectors that are null, hold a null or non-finite component, or have no id take no part;
vectors of different lengths are not compared; rows with the query's own id are no candidates; a
query that repeats is answered once per row; with fewer candidates than k all are returned; scores
beyond a long are clamped to it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgauge.session import stored

_LONG = 2**63 - 1
_NONE = -np.inf
_ROWS = 1024


def quantised(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * component) of the vectors that take part, as doubles."""
    ok = F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    # Not floor(): it would cut what lies beyond a long. The remainder is exact.
    whole = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    down = F.transform(whole, lambda y: y - F.pmod(y, F.lit(1.0)))
    return df.filter(ok).select(F.col(vec_id).cast("long").alias("vec_id"), down.alias("v"))


def _batches(stream) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and a matrix of the vectors of one length, a bounded number of rows at a time."""
    for batch in stream:
        ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.cumsum(lengths)))
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            for part in range(0, len(rows), _ROWS):
                own = rows[part : part + _ROWS]
                yield ids[own], flat[starts[own][:, None] + np.arange(n)]


class _Queries:
    """The queries of a block that have one length, cut into slices."""

    def __init__(self, rows: list[tuple[int, int, list[float]]], slices: int):
        self.at = np.array([r[0] for r in rows])
        self.ids = np.array([r[1] for r in rows])
        self.matrix = np.array([r[2] for r in rows], np.float64).reshape(len(rows), -1)
        n = self.matrix.shape[1]
        edges = np.linspace(0, n, min(slices, max(n, 1)) + 1).astype(int)
        self.cuts = list(zip(edges[:-1], edges[1:], strict=True))
        self.largest = float(np.abs(self.matrix).max(initial=0))

    def local(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Local scores of every slice, one row per query."""
        n = self.matrix.shape[1]
        bound = self.largest * float(np.abs(vectors).max(initial=0)) * max(n, 1)
        if bound < 2.0**53:
            return [self.matrix[:, a:b] @ vectors[:, a:b].T for a, b in self.cuts]
        q, v = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (self.matrix, vectors))
        return [q[:, a:b].dot(v[:, a:b].T) if b > a else np.zeros((len(q), len(v)), object) for a, b in self.cuts]


def _by_length(rows: list[tuple[int, int, list[float]]], slices: int) -> dict[int, _Queries]:
    groups = defaultdict(list)
    for row in rows:
        groups[len(row[2])].append(row)
    return {n: _Queries(own, slices) for n, own in groups.items()}


class _Best:
    """The k best (score, id) per query seen by a task."""

    def __init__(self, k: int):
        self.k, self.rows = k, defaultdict(list)

    def add(self, query: int, scores, ids) -> None:
        own = self.rows[query]
        own.extend(zip((-s for s in scores), ids, strict=True))
        own.sort()
        del own[self.k :]

    def batch(self) -> pa.RecordBatch:
        rows = [(q, i, max(-_LONG - 1, min(_LONG, -int(s)))) for q, own in self.rows.items() for s, i in own]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["at", "vec_id", "score"]
        )


def _gather(queries, k: int, slices: int):
    """Phase 1: rows on a task's local score lists, with their sums."""

    def run(stream):
        groups, best = _by_length(queries.value, slices), _Best(k)
        for ids, vectors in _batches(stream):
            group = groups.get(vectors.shape[1])
            if group is None:
                continue
            local = group.local(vectors)
            own = group.ids[:, None] == ids[None, :]
            n = min(k + 1, len(ids))  # one may be the query's own
            listed = np.zeros(own.shape, bool)
            for part in local:
                top = np.argpartition(part, len(ids) - n, axis=1)[:, -n:] if part.dtype != object else np.argsort(part, axis=1)[:, -n:]
                np.put_along_axis(listed, top, True, axis=1)
            _collect(group, ids, local, listed & ~own, None, best)
        yield best.batch()

    return run


def _collect(group: _Queries, ids: np.ndarray, local: list, wanted: np.ndarray, cutoff: np.ndarray | None, best: _Best) -> None:
    """Add up the local scores of the wanted entries and keep those that reach the cutoff."""
    at, col = np.nonzero(wanted)
    total = sum(part[at, col] for part in local)
    if cutoff is not None and len(at):
        high = total >= cutoff[at, 0]
        at, col, total = at[high], col[high], total[high]
    edges = np.searchsorted(at, np.arange(len(group.at) + 1))
    for row in np.unique(at):
        own = slice(edges[row], edges[row + 1])
        best.add(int(group.at[row]), total[own].tolist(), ids[col[own]].tolist())


def _resolve(queries, cutoffs, k: int, slices: int):
    """Phases 2 and 3: sufficient entries, then their exact scores."""

    def run(stream):
        groups, best = _by_length(queries.value, slices), _Best(k)
        cut = {n: np.array([cutoffs.value.get(int(a), _NONE) for a in g.at])[:, None] for n, g in groups.items()}
        for ids, vectors in _batches(stream):
            group = groups.get(vectors.shape[1])
            if group is None:
                continue
            local, cutoff = group.local(vectors), cut[vectors.shape[1]]
            even = np.floor(cutoff / len(local))
            ceiling, seen = 0, np.zeros(local[0].shape, bool)
            for part in local:
                known = part >= even
                seen |= known
                ceiling = ceiling + np.where(known, part, even)
            own = group.ids[:, None] == ids[None, :]
            _collect(group, ids, local, seen & (ceiling >= cutoff) & ~own, cutoff, best)
        yield best.batch()

    return run


def _floor(score: int) -> float:
    """A double that is not above the score."""
    return float(score) if abs(score) < 2**53 else float(np.nextafter(float(score), _NONE))


def _blocks(queries: DataFrame, block: int) -> Iterator[list[tuple[int, int, list[float]]]]:
    rows = []
    for n, (vec_id, vector) in enumerate(queries.toLocalIterator(prefetchPartitions=False)):
        rows.append((n, vec_id, vector))
        if len(rows) == block:
            yield rows
            rows = []
    if rows:
        yield rows


_FOUND = "at long, vec_id long, score long"


def top_k(
    df: DataFrame,
    queries: DataFrame,
    k: int = 5,
    scale: int = 256,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    slices: int = 4,
    block: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``df`` for every row of ``queries``."""
    spark = df.sparkSession
    context = spark.sparkContext
    vectors = stored(quantised(df, vec_id, vector, scale), "vectors")
    asked = stored(quantised(queries, vec_id, vector, scale), "queries")
    results = []
    for rows in _blocks(asked, block):
        shared = context.broadcast(rows)
        lists = vectors.mapInArrow(_gather(shared, k, slices), _FOUND)
        place = Window.partitionBy("at").orderBy(F.desc("score"), "vec_id")
        kth = lists.withColumn("r", F.row_number().over(place)).filter(F.col("r") == k).select("at", "score")
        cutoffs = context.broadcast({at: _floor(score) for at, score in kth.collect()})
        found = vectors.mapInArrow(_resolve(shared, cutoffs, k, slices), _FOUND)
        ranked = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(at, i) for at, i, _ in rows], "at long, query_id long")
        results.append(stored(ranked.join(F.broadcast(names), "at").select("query_id", "rank", "vec_id", "score"), "ranked"))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
