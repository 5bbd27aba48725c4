"""Exact top-k inner products by a three-phase uniform threshold.

The components of a vector are dealt to ``lists`` lists; a list ranks candidates by the
part of the inner product that its components give.

1. Every task ranks its candidates per query by all lists but the last and gives the full
   scores of the best of each of ``k`` shares of them. The k-th best of all of these is a
   safe cutoff t: no answer lies below it.
2. The cutoffs are broadcast. An entry is sufficient if its parts in the lists seen and the
   most that the lengths of the rest allow (Cauchy-Schwarz) reach t; others are left out.
3. The remaining parts of sufficient entries are resolved exactly, and what reaches t goes
   on to a ranking per query, at most ``k`` entries a task.

Queries are taken in blocks of ``block`` rows. A block is one pass over the vectors, its
results are written to the shared folder and what was broadcast for it is removed, so that
no plan and no memory grows with the number of queries. Vectors that are null or hold a null
or non-finite component take no part. Vectors of other lengths count as padded by zeros.
Ties go to the smaller id. Rows repeated under one id are candidates each, and queries each,
with the other as candidate. Without enough candidates, all of them are returned; empty
tables give an empty result. Columns other than id and vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import append, new_table, settle
from .sharding import number_rows

ENTRIES = "query long, vec_id long, score long"
_SCHEMA = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_HEADS = pa.schema([("part", pa.int64()), ("scores", pa.binary())])
#: Queries and candidates whose products are held at once, and the score of nothing.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 2048, 2048
_NONE = -(2**62)


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``(vec_id, vector array<long>)`` with components floor(scale * x), without unfit vectors."""
    fit = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col(id_col).isNotNull()
    return df.where(fit).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("vector"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    width = width or max(1, int(lengths.max(initial=0)))
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keep = at < width
    out[row[keep], at[keep]] = flat[keep]
    return out


class Queries:
    """A block of queries: numbers of their rows, matrix, and the components that the first lists and the last one hold."""

    def __init__(self, uid: np.ndarray, matrix: np.ndarray, lists: int):
        self.uid, self.matrix = uid, matrix
        number = np.arange(matrix.shape[1]) % max(1, min(lists, matrix.shape[1]))
        last = (number == number.max()) & (number > 0)
        self.lead, self.last = np.flatnonzero(~last), np.flatnonzero(last)
        self.top = int(np.abs(matrix).max(initial=0))

    def parts(self):
        for at in range(0, len(self.uid), QUERIES_AT_ONCE):
            yield at, self.matrix[at : at + QUERIES_AT_ONCE]

    def kind(self, them: np.ndarray):
        """Products are exact in float64 where sums stay below 2**53."""
        return np.float64 if self.top * int(np.abs(them).max(initial=0)) * self.matrix.shape[1] < 2**53 else np.int64

    def leading(self, rows: np.ndarray, them: np.ndarray) -> np.ndarray:
        kind = self.kind(them)
        return rows[:, self.lead].astype(kind) @ them[:, self.lead].astype(kind).T

    def rest(self, rows: np.ndarray) -> np.ndarray:
        """Lengths of what the last list holds, rounded up."""
        return np.sqrt((rows[:, self.last].astype(float) ** 2).sum(1)) * (1 + 1e-9)


def _candidates(batches, width: int):
    """``(number of the row, id, matrix)`` of bounded size."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            part = b.slice(at, ROWS_AT_ONCE)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), width)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k best of each row, whatever their order; short rows are filled up with nothing."""
    if scores.shape[1] < k:
        scores = np.pad(scores, ((0, 0), (0, k - scores.shape[1])), constant_values=_NONE)
    return -np.partition(-scores, k - 1, axis=1)[:, :k]


def _told(part: int, scores: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part]), pa.array([scores.astype("<i8").tobytes()], pa.binary())], schema=_HEADS)


def _merged(k: int):
    """applyInArrow function: the k best scores per query of one part, from several tasks."""

    def merge(t: pa.Table) -> pa.Table:
        best = None
        for raw in t.column("scores"):
            own = np.frombuffer(raw.as_py(), "<i8").reshape(-1, k)
            best = own if best is None else _best(np.concatenate([best, own], 1), k)
        return pa.Table.from_batches([_told(t.column("part")[0].as_py(), best)])

    return merge


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, lists: int = 4, block: int = 32_768) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` from ``(vec_id, vector)`` and the rows of it that are queries; a query's own row is no candidate of it.

    ``queries`` is a condition on the columns of ``vectors``, as a column.
    """
    spark = vectors.sparkSession
    vectors = settle(vectors.withColumn("uid", F.monotonically_increasing_id()).select("uid", "vec_id", "vector"))
    asked = settle(number_rows(vectors.where(queries), ["vec_id", "uid"]))
    path = new_table(spark)
    for at in range(0, asked.count(), block):
        table = asked.where(F.col("row_no").between(at, at + block - 1)).orderBy("row_no").select("uid", "vector").toArrow()
        shared = spark.sparkContext.broadcast(Queries(table.column(0).to_numpy(), _matrix(table.column(1)), lists))
        cut = spark.sparkContext.broadcast(_cutoffs(vectors, shared, k))
        found = vectors.select("uid", "vec_id", "vector").mapInArrow(_resolve(shared, cut, k), ENTRIES)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        append(ranked, path)
        shared.destroy()
        cut.destroy()
    schema = "query long, vec_id long, score long, rank int"
    found = spark.read.schema(schema).parquet(path) if at_least_one(asked) else spark.createDataFrame([], schema)
    names = asked.select(F.col("uid").alias("query"), F.col("vec_id").alias("query_id"))
    return found.join(names, "query").select("query_id", "rank", "vec_id", "score")


def at_least_one(df: DataFrame) -> bool:
    return bool(df.head(1))


def _cutoffs(vectors: DataFrame, shared, k: int) -> np.ndarray:
    """Phase 1: per query a score that k candidates reach; ``_NONE`` where there are not so many."""

    def heads(batches):
        q: Queries = shared.value
        best: dict[int, np.ndarray] = {}
        for uid, _, them in _candidates(batches, q.matrix.shape[1]):
            shares = np.linspace(0, len(them), min(k, len(them)) + 1).astype(int)
            for at, rows in q.parts():
                first = q.leading(rows, them)
                own = np.nonzero(q.uid[at : at + len(rows), None] == uid[None])
                first[own] = _NONE
                head = np.stack([a + first[:, a:b].argmax(1) for a, b in zip(shares, shares[1:])], 1)
                full = np.einsum("qd,qkd->qk", rows, them[head])
                full[np.take_along_axis(first, head, 1) == _NONE] = _NONE
                best[at] = _best(full if at not in best else np.concatenate([best[at], full], 1), k)
        for at, scores in best.items():
            yield _told(at // QUERIES_AT_ONCE, scores)

    told = vectors.select("uid", "vec_id", "vector").mapInArrow(heads, "part long, scores binary").withColumn("_t", F.spark_partition_id() % 64)
    some = told.groupBy("part", "_t").applyInArrow(lambda t: _merged(k)(t.drop_columns(["_t"])), "part long, scores binary")
    out = np.full(len(shared.value.uid), _NONE, np.int64)
    for r in some.groupBy("part").applyInArrow(_merged(k), "part long, scores binary").toLocalIterator():
        scores = np.frombuffer(r["scores"], "<i8").reshape(-1, k)
        out[r["part"] * QUERIES_AT_ONCE :][: len(scores)] = scores.min(1)
    return out


def sufficient(q: Queries, rows: np.ndarray, them: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 2: the parts that the first lists give, and which entries may reach the cutoff of their query.

    Bounds are taken for 128 neighbouring candidates at once, so candidates had better come by the length of their rest.
    """
    known = q.leading(rows, them)
    own, rest = q.rest(rows), q.rest(them)
    enough = np.empty(known.shape, bool)
    for at in range(0, len(them), 128):
        reach = np.ceil(own * rest[at : at + 128].max()) + 1
        np.greater_equal(known[:, at : at + 128], (cut - reach)[:, None], out=enough[:, at : at + 128])
    return known, enough


def resolved(q: Queries, rows: np.ndarray, them: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 3: ``(query, candidate, score)`` of the entries whose score reaches the query's cutoff."""
    known, enough = sufficient(q, rows, them, cut)
    left, right = rows[:, q.last].astype(known.dtype), them[:, q.last].astype(known.dtype)
    if 10 * np.count_nonzero(enough) > enough.size:  # of most entries: one product is less work than many lookups
        known += left @ right.T
        row, col = np.nonzero(known >= cut[:, None])
        return row, col, known[row, col].astype(np.int64)
    row, col = np.nonzero(enough)
    score = known[row, col]
    for at in range(0, len(row), 65_536):
        score[at : at + 65_536] += np.einsum("nd,nd->n", left[row[at : at + 65_536]], right[col[at : at + 65_536]])
    reach = score >= cut[row]
    return row[reach], col[reach], score[reach].astype(np.int64)


def _resolve(shared, cut, k: int):
    def resolve(batches):
        q: Queries = shared.value
        best = {at: (np.empty(0, np.int64),) * 3 for at, _ in q.parts()}
        for uid, ids, them in _candidates(batches, q.matrix.shape[1]):
            order = np.argsort(q.rest(them), kind="stable")
            uid, ids, them = uid[order], ids[order], them[order]
            for at, rows in q.parts():
                row, col, score = resolved(q, rows, them, cut.value[at : at + len(rows)])
                other = q.uid[at + row] != uid[col]
                row, vec, score = (np.concatenate(c) for c in zip(best[at], (row[other], ids[col[other]], score[other])))
                order = np.lexsort((vec, -score, row))
                row, vec, score = row[order], vec[order], score[order]
                # the place of an entry among its query's
                place = np.arange(len(row)) - np.searchsorted(row, row)
                best[at] = row[place < k], vec[place < k], score[place < k]
        for at, (row, vec, score) in best.items():
            if len(row):
                yield pa.record_batch([pa.array(c) for c in (q.uid[at + row], vec, score)], schema=_SCHEMA)

    return resolve
