"""Exact top-k by inner product, pruned by segment statistics at several resolutions.

A vector is cut into segments of l components with mean m and deviation s. For two vectors the squared distance is at least
sum l((m-m')^2 + (s-s')^2), which for inner products says a.b <= sum l(mm' + ss'). The bound is taken with few segments
first, then with more for what is left, and the exact product only for the survivors. What a bound must reach is known from the
start: every query is first compared with some seeds, rows drawn by a hash of their ids.

Queries are packed in blocks and rows in chunks, and one plan has every block meet every chunk; a chunk's few rows and a
block's few queries are all that a pair carries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, sliced, table

LEVELS = (1, 4, 16, 32)
#: Bytes of a block of queries.
QUERY_BYTES = 4_000_000
#: Blocks of up to so many bytes in all are broadcast.
BROADCAST_BYTES = 32_000_000
#: Rows of a chunk, and queries that meet it at a time.
CHUNK, TILE = 4096, 512
#: About so many rows are seeds; all rows where there are fewer.
SEEDS = 1024
EXACT = 2**53
LONG = 2**63 - 1


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """floor(1024 x) of list arrays as doubles; shorter vectors are filled up with zeros, which add nothing to a product."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 1024)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(l) times the means and deviations of the segments, so that a dot product of two is the bound."""
    parts = []
    for piece in np.array_split(np.arange(x.shape[1]), min(segments, max(1, x.shape[1]))):
        if len(piece):
            own = x[:, piece[0] : piece[-1] + 1]
            parts += [own.mean(1) * len(piece) ** 0.5, own.std(1) * len(piece) ** 0.5]
    return np.stack(parts, 1) if parts else np.zeros((len(x), 1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows, by pairs; doubles are exact below 2**53, Python's integers beyond."""
    if not a.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.array([max(-LONG, min(LONG, sum(int(x) * int(y) for x, y in zip(p, q)))) for p, q in zip(a, b)], np.int64)


class Best:
    """The k best of every query so far: higher scores first, ties to smaller ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, levels: Sequence[int], seed_ids: np.ndarray, seeds: np.ndarray):
        self.ids, self.k, self.levels = ids, k, levels
        self.score = [np.empty(0, np.int64)] * len(ids)
        self.found = [np.empty(0, np.int64)] * len(ids)
        self.least = np.full(len(ids), -np.inf)
        self.pairs = self.exact = 0
        self._set(vectors)
        self._seed(seed_ids, seeds)

    def _set(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        self.bounds = [statistics(vectors, n) for n in self.levels]
        self.norms = np.linalg.norm(vectors, axis=1)

    def _alike(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors, and the queries, as long as the longest of both."""
        apart = vectors.shape[1] - self.vectors.shape[1]
        if apart > 0:
            self._set(np.pad(self.vectors, ((0, 0), (0, apart))))
        return np.pad(vectors, ((0, 0), (0, -apart))) if apart < 0 else vectors

    def _seed(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """The k-th best of the seeds is reached by the k-th best of all rows; seeds come again as rows."""
        if len(ids) <= self.k:
            return
        vectors = self._alike(vectors)
        for begin in range(0, len(self.ids), TILE):
            own = slice(begin, begin + TILE)
            score = self.vectors[own] @ vectors.T
            score -= 1e-9 * (1 + np.abs(score))  # rounding of products beyond 2**53
            score[self.ids[own][:, None] == ids[None, :]] = -np.inf
            self.least[own] = np.partition(score, -self.k, axis=1)[:, -self.k]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        vectors = self._alike(vectors)
        fine = [statistics(vectors, n) for n in self.levels]
        longest = 1 + np.linalg.norm(vectors, axis=1).max(initial=0)
        for begin in range(0, len(self.ids), TILE):
            self._add(slice(begin, begin + TILE), ids, vectors, fine, longest)

    def _add(self, own: slice, ids: np.ndarray, vectors: np.ndarray, fine: list[np.ndarray], longest: float) -> None:
        queries, names = self.vectors[own], self.ids[own]
        least = self.least[own] - 1e-9 * (1 + self.norms[own]) * longest
        coarse = self.bounds[0][own] @ fine[0].T
        q, c = np.nonzero((coarse >= least[:, None]) & (names[:, None] != ids[None, :]))
        self.pairs += coarse.size
        for bound, other in zip(self.bounds[1:], fine[1:]):
            if not len(q):
                return
            if len(q) * 4 > coarse.size:
                left = (bound[own] @ other.T)[q, c] >= least[q]
            else:
                left = np.einsum("ij,ij->i", bound[own][q], other[c]) >= least[q]
            q, c = q[left], c[left]
        self.exact += len(q)
        exact = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, vectors.shape[1]) < EXACT
        score = (queries @ vectors.T)[q, c].astype(np.int64) if exact and len(q) * 4 > coarse.size else products(queries[q], vectors[c])
        left = score >= self.least[own][q]
        q, c, score = q[left], c[left], score[left]
        edges = np.searchsorted(q, np.arange(len(names) + 1))
        for i in np.flatnonzero(np.diff(edges)):
            s = slice(edges[i], edges[i + 1])
            at = own.start + i
            scores, found = np.append(self.score[at], score[s]), np.append(self.found[at], ids[c[s]])
            order = np.lexsort((found, -scores))[: self.k]
            self.score[at], self.found[at] = scores[order], found[order]
            if len(order) == self.k:
                self.least[at] = max(self.least[at], self.score[at][-1])


PACKED = "n int, ids binary, vectors binary"


def _packed(ids: np.ndarray, vectors: np.ndarray) -> tuple[int, bytes, bytes]:
    return len(ids), ids.astype("<i8").tobytes(), vectors.astype("<f8").tobytes()


def _unpacked(n: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(n, -1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector), packed."""
    for batch in sliced(batches, CHUNK):
        n, ids, vectors = _packed(batch.column(0).to_numpy(), matrix(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([ids]), pa.array([vectors])], names=["n", "ids", "vectors"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries (block, id, vector) sorted by block, packed."""

    def rows():
        for batch in batches:
            for k in range(batch.num_rows):
                yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py()

    for block, own in groupby(rows(), key=lambda r: r[0]):
        _, ids, vectors = zip(*own)
        n, ids, vectors = _packed(np.array(ids, np.int64), matrix(pa.array(vectors, pa.list_(pa.float64()))))
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([n], pa.int32()), pa.array([ids]), pa.array([vectors])], names=["block", "query_n", "query_ids", "query_vectors"])


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", levels: Sequence[int] = LEVELS, query_bytes: int = QUERY_BYTES, seeds: int = SEEDS, tally: tuple | None = None) -> DataFrame:
    """query_id, rank, id and score of the k rows with the highest inner product with each query row, without its own id.

    Components are floor(1024 x). Rows with a null id or an unusable vector take no part; with fewer than k other rows, all
    are returned; ties go to the smaller id; repeated rows are candidates each, repeated query rows are one query (the first
    by its vector); vectors of different lengths are filled up with zeros; scores beyond a long are cut to it; an empty
    table gives no rows; extra columns are not read. Queries are taken in blocks of bounded size, each against all rows.
    `tally`, two accumulators, counts the pairs that met and those whose product was taken.
    """
    spark = df.sparkSession
    rows = df.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("is_query"))
    counted = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_query"), 1)), F.max(F.size("vector"))).first()
    if not counted[1]:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    scratch = Scratch(spark, "topk")
    count = max(1, -(-counted[1] * max(1, counted[2]) * 8 // query_bytes))
    queries = rows.where("is_query").groupBy("id").agg(F.min("vector").alias("vector")).select(F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("block"), "id", "vector")
    blocks = queries.repartition(count, "block").sortWithinPartitions("block", "id").mapInArrow(_blocks, "block int, query_n int, query_ids binary, query_vectors binary")
    blocks = scratch.write(blocks, "queries")
    # As many seeds as `seeds` to be expected, whatever the table's size.
    chance = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    drawn = rows.where(chance < min(1.0, seeds / max(1, counted[0]))).select("id", "vector").orderBy("id").toArrow()
    sent = spark.sparkContext.broadcast((drawn.column("id").to_numpy(), matrix(drawn.column("vector").combine_chunks())))
    chunks = rows.select("id", "vector").mapInArrow(_chunks, PACKED)
    pairs = chunks.crossJoin(F.broadcast(blocks) if count * query_bytes <= BROADCAST_BYTES else blocks.repartition(count, "block"))
    found = pairs.mapInArrow(_search(sent, k, tuple(levels), tally), "query_id long, id long, score long")
    return _first(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.select("query_id", "id", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(sent, k: int, levels: tuple[int, ...], tally: tuple | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Best] = {}
        for batch in sliced(batches, 1):
            n, ids, vectors, block, query_n, query_ids, query_vectors = (c[0].as_py() for c in batch.columns)
            if block not in held:
                held[block] = Best(*_unpacked(query_n, query_ids, query_vectors), k, levels, *sent.value)
            held[block].add(*_unpacked(n, ids, vectors))
        for best in held.values():
            if tally is not None:
                tally[0].add(best.pairs), tally[1].add(best.exact)
            sizes = [len(x) for x in best.found]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(best.ids, sizes)), pa.array(np.concatenate(best.found)), pa.array(np.concatenate(best.score))], names=["query_id", "id", "score"])

    return run


def op1_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all rows for every row whose vec_id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
