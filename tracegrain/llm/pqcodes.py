"""Vector code compression: each of a vector's parts becomes the index of its nearest codebook entry.

Components are scaled to integers, so every distance, sum and mean is exact. Each round a kd-tree for each part's codebook
is broadcast, and tasks search it by branch and bound: a node is visited as long as the squared distance to its box is
not above the best distance so far. Nodes at exactly that bound are visited too, so of entries at one distance the one of
the lowest index is found. Tasks return integer sums and counts of each entry's parts, which are added up by entry and
component and update the entries: the driver holds the codebooks and those sums, `parts` x `entries` x width numbers.

Edge cases: rows whose vector is null, empty, or holds a null or non-finite component are dropped, and so are vectors of
another length than most (the shorter length, if two are as common). Lengths that the number of parts does not divide are
cut as evenly as can be. Scaled components are held within bounds that keep squared distances in 64 bits (beyond a
hundred million for parts of 16 components). Repeated rows are encoded and counted each; where rows of one id differ, the least
vector starts a codebook. Null ids are encoded but start no codebook. Fewer rows than entries give smaller codebooks. Null
labels are one label. An empty table has no result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.scratch import written

#: Entries of a leaf of the tree, and vectors searched together.
LEAF, TOGETHER = 16, 4096


def finite(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


class Tree:
    """A kd-tree over integer points; every node has the box of its points."""

    def __init__(self, points: np.ndarray, index: np.ndarray | None = None):
        index = np.arange(len(points)) if index is None else index
        own = points[index]
        self.low, self.high = own.min(axis=0), own.max(axis=0)
        self.index = self.points = None
        self.children: tuple[Tree, ...] = ()
        spread = self.high - self.low
        if len(index) <= LEAF or not spread.any():
            self.index = np.sort(index)
            self.points = points[self.index]
        else:
            axis = int(spread.argmax())
            order = index[np.argsort(own[:, axis], kind="stable")]
            half = len(order) // 2
            self.children = (Tree(points, order[:half]), Tree(points, order[half:]))

    def bound(self, queries: np.ndarray) -> np.ndarray:
        """The least squared distance that a point of the box can have."""
        apart = np.maximum(self.low - queries, 0) + np.maximum(queries - self.high, 0)
        return np.einsum("ij,ij->i", apart, apart)

    def _visit(self, queries: np.ndarray, at: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        if not len(at):
            return
        if not self.children:
            apart = queries[at][:, None, :] - self.points[None, :, :]
            distance = np.einsum("ijk,ijk->ij", apart, apart)
            first = distance.argmin(axis=1)  # entries of a leaf stand by index
            least, index = distance[np.arange(len(at)), first], self.index[first]
            better = (least < best[at]) | ((least == best[at]) & (index < found[at]))
            best[at[better]], found[at[better]] = least[better], index[better]
            return
        bounds = [child.bound(queries[at]) for child in self.children]
        for near in (0, 1):
            mine = bounds[0] <= bounds[1] if near == 0 else bounds[0] > bounds[1]
            for child in (near, 1 - near):
                own, bound = at[mine], bounds[child][mine]
                self.children[child]._visit(queries, own[bound <= best[own]], best, found)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each query's nearest point, the lowest among equals, and its squared distance."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        found = np.full(len(queries), np.iinfo(np.int64).max)
        self._visit(queries, np.arange(len(queries)), best, found)
        return found, best


def cuts(length: int, parts: int) -> list[int]:
    return [i * length // parts for i in range(parts + 1)]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _batches(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(a, TOGETHER)


def _sums(trees, edges: list[int]):
    """For mapInArrow: of each part and entry, how many of a task's vectors it is nearest to, and their component sums."""

    def run(batches):
        known = trees.value
        entries = len(known[0][1])
        counts = np.zeros((len(known), entries), np.int64)
        sums = [np.zeros((entries, b - a), np.int64) for a, b in zip(edges, edges[1:], strict=False)]
        for batch in _batches(batches):
            values = _matrix(batch.column("values"))
            for p, (tree, _) in enumerate(known):
                own = np.ascontiguousarray(values[:, edges[p] : edges[p + 1]])
                nearest, _ = tree.nearest(own)
                counts[p] += np.bincount(nearest, minlength=entries)
                np.add.at(sums[p], nearest, own)
        part, entry = np.nonzero(counts)
        rows = [sums[p][e] for p, e in zip(part.tolist(), entry.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _coder(trees, edges: list[int], digits: int):
    """For mapInArrow: code and error of each vector."""

    def run(batches):
        known = trees.value
        for batch in _batches(batches):
            values = _matrix(batch.column("values"))
            error, codes = np.zeros(len(values), np.int64), []
            for p, (tree, _) in enumerate(known):
                nearest, distance = tree.nearest(np.ascontiguousarray(values[:, edges[p] : edges[p + 1]]))
                error += distance
                codes.append(nearest)
            names = ["".join(f"{x:0{digits}x}" for x in row) for row in np.array(codes).T.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(names, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def _broadcast(spark, books: list[np.ndarray]):
    return spark.sparkContext.broadcast([(Tree(book), book) for book in books])


def scaled(rows: DataFrame, scale: int, parts: int) -> tuple[DataFrame | None, int]:
    """rows (vec_id, vector, label) to vec_id, label, values: integers, written, and the vectors' length."""
    kept = rows.filter(finite(F.col("vector")))
    length = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None or length[0] < parts:
        return None, 0
    most = float(min((1 << 30), math.isqrt((1 << 61) // (-(-length[0] // parts) * parts)) // 2))
    whole = F.transform("vector", lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x.cast("double") * scale))).cast("int"))
    return written(kept.filter(F.size("vector") == length[0]).select("vec_id", "label", whole.alias("values")), "vectors"), length[0]


def codebooks(values: DataFrame, length: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> list[np.ndarray]:
    """values (vec_id, values) to each part's codebook after so many rounds of assignment and update."""
    edges = cuts(length, parts)
    first = values.filter("vec_id is not null").groupBy("vec_id").agg(F.min("values").alias("values")).orderBy("vec_id").limit(entries).collect()
    start = np.array([r["values"] for r in first], np.int64).reshape(len(first), length)
    books = [start[:, a:b].copy() for a, b in zip(edges, edges[1:], strict=False)]
    for _ in range(rounds if len(first) else 0):
        trees = _broadcast(values.sparkSession, books)
        found = values.select("values").mapInArrow(_sums(trees, edges), "part int, entry int, n bigint, sums array<bigint>")
        by = found.select("part", "entry", "n", F.posexplode("sums").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        for part, entry, place, n, x in by.collect():
            books[part][entry, place] = x // n
        trees.unpersist()
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()


def compressed(rows: DataFrame, scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, list[np.ndarray]]:
    """rows (vec_id, vector, label) to (vec_id, label, code, error), and the codebooks."""
    kind = rows.schema["label"].dataType.simpleString()
    schema = f"vec_id bigint, label {kind}, code string, error bigint"
    values, length = scaled(rows, scale, parts)
    books = codebooks(values, length, parts, entries, rounds) if values is not None else []
    if not books or not len(books[0]):
        return rows.sparkSession.createDataFrame([], schema), []
    coder = _coder(_broadcast(rows.sparkSession, books), cuts(length, parts), max(1, -(-(entries - 1).bit_length() // 4)))
    return values.mapInArrow(coder, schema), books


def decoded(codes: DataFrame, books: list[np.ndarray], scale: int = 1024) -> DataFrame:
    """codes (vec_id, code) to (vec_id, vector): the middle of each scaled component's step, from the codebooks."""
    known = [[[(x + 0.5) / scale for x in entry] for entry in book.tolist()] for book in books]
    digits = max(1, -(-(max(len(b) for b in books) - 1).bit_length() // 4)) if books else 1

    def run(batches):
        for batch in batches:
            rows = [[x for p, book in enumerate(known) for x in book[int(code[p * digits : (p + 1) * digits], 16)]] for code in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(rows, pa.list_(pa.float64()))], ["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id bigint, vector array<double>")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("vector"), "label")
    codes, books = compressed(rows)
    codes = written(codes, "codes")
    by = codes.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    found = codes.join(by, F.col("label").eqNullSafe(F.col("same")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The same by comparing every part with every entry, a query for each round."""
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) AS t(p))",
        f"book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM cut WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))",
    ]
    near = "SELECT vec_id, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT vec_id, cut.p, x, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM cut JOIN book{0} USING (p)) GROUP BY vec_id, p, x"
    for r in range(rounds):
        steps.append(f"near{r} AS MATERIALIZED ({near.format(r)})")
        steps.append(f"mean{r} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(x[i]) / count(*)) AS m FROM near{r}, range(1, 1 + len(x)) AS t(i) GROUP BY p, e, i) GROUP BY p, e)")
        steps.append(f"book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{r}.c, book{r}.c) AS c FROM book{r} LEFT JOIN mean{r} USING (p, e))")
    steps.append(f"last AS MATERIALIZED ({near.format(rounds)})")
    steps.append("codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last GROUP BY vec_id)")
    steps.append(f"sha AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})")
    steps.append("labelled AS (SELECT vec_id, code, error, label FROM codes JOIN kept USING (vec_id))")
    return "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM labelled, sha"


OP13_SQL = _sql()
