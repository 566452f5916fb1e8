"""Approximate nearest neighbours by a permutation index.

Pivots are fitted on a bounded sample. A vector is represented by its nearest pivots, in order, and posted in the inverted
file of each of the first `posted` of them. A query looks into the files of its own first `probed` pivots, ranks what it
finds there by footrule distance (how far each pivot of the query's prefix stands from its place in the vector's; the
prefix length for pivots that it lacks), and reranks the best by inner product on the original vectors.

Files are cut into blocks of bounded size, and so are the queries of a file, so a common pivot is many tasks. Equal
vectors are indexed once, with as many of their ids as a result can hold; that is exact, as they tie.

Queries whose files hold fewer candidates than were asked for are compared with all vectors, in blocks.

Edge cases: vectors that are null, empty, of another length than most, zero, or hold a null or non-finite component take
no part, as candidate or as query; nor do null ids. Rows that repeat an id and a vector count once. Ties go to the smaller
id. An empty table has no result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.llm.scratch import written

#: Vectors of a file, and queries of a file, that one task takes at a time.
BLOCK = 4096
SALTS = 64


def valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def classes(rows: DataFrame, k: int) -> DataFrame:
    """rows (id, vector) to class, vector, ids: distinct vectors and the k + 1 smallest ids of each, in order."""
    key = F.sha2(F.to_json(F.struct("vector")), 256)
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    rows = rows.withColumn("class", key).dropDuplicates(["class", "id"])
    some = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("r", first("class", "salt")).filter(F.col("r") <= k + 1)
    some = some.withColumn("r", first("class")).filter(F.col("r") <= k + 1)
    return some.groupBy("class").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def pivots(vectors: DataFrame, count: int, sample: int, rounds: int = 8) -> np.ndarray:
    """`count` unit vectors: k-means centres of a sample of at most `sample` vectors, the first by hash."""
    rows = vectors.select("class", "vector").orderBy("class").limit(sample).select("vector").collect()
    if not rows:
        return np.zeros((0, 1))
    points = np.array([r[0] for r in rows], np.float64)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centres = points[: min(count, len(points))].copy()
    for _ in range(rounds):
        nearest = (points @ centres.T).argmax(axis=1)
        for j in range(len(centres)):
            own = points[nearest == j]
            if len(own):
                mean = own.mean(axis=0)
                norm = np.linalg.norm(mean)
                centres[j] = mean / norm if norm else own[0]
    return centres


def _permutations(known: np.ndarray, prefix: int):
    """For mapInArrow: each class with the order of its nearest pivots."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                points = _matrix(batch.column("vector"))
                near = points @ known.T
                top = np.argsort(-near, axis=1, kind="stable")[:, :prefix].astype(np.int32)
                order = pa.FixedSizeListArray.from_arrays(pa.array(top.reshape(-1)), top.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, order], [*batch.schema.names, "pivots"])

    return run


def footrule(queries: np.ndarray, others: np.ndarray, count: int) -> np.ndarray:
    """Footrule distance of each query's prefix to each other's: absent pivots stand at the prefix length."""
    prefix = queries.shape[1]
    place = np.full((len(others), count), prefix, np.int16)
    place[np.arange(len(others))[:, None], others] = np.arange(prefix, dtype=np.int16)
    total = np.zeros((len(queries), len(others)), np.int32)
    for j in range(prefix):
        total += np.abs(place[:, queries[:, j]].T - np.int16(j))
    return total


def _block_search(count: int, k: int, rerank: float, least: int, exact: bool):
    """For cogrouped applyInArrow: the best of a block of vectors for each query of a block of queries."""
    names = ["query_class", "class", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            q, x = _matrix(left.column("vector")), _matrix(right.column("vector"))
            theirs = np.array(right.column("class").to_pylist(), object)
            mine = left.column("class").to_pylist()
            take = min(max(least, int(rerank * len(x))), len(x))
            if not exact:
                qp, xp = (_matrix(t.column("pivots")).astype(np.int64) for t in (left, right))
            for at in range(0, len(q), 256):
                some = slice(at, at + 256)
                score = q[some] @ x.T
                if not exact and take < len(x):
                    far = footrule(qp[some], xp, count)
                    np.put_along_axis(score, np.argpartition(far, take - 1, axis=1)[:, take:], -np.inf, axis=1)
                most = min(k + 1, take)
                best = np.argpartition(-score, most - 1, axis=1)[:, :most]
                # whatever ties with the last one is kept: ids decide later
                edge = np.take_along_axis(score, best, axis=1).min(axis=1)
                i, j = np.nonzero((score >= edge[:, None]) & (score > -np.inf))
                out[0] += [mine[at + n] for n in i.tolist()]
                out[1] += theirs[j].tolist()
                out[2] += np.einsum("ij,ij->i", q[at + i], x[j]).tolist()
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names)

    return run


def _blocks(df: DataFrame, pivot: str, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """df with a block number within its pivot, so that a block has about `size` rows, and the number of blocks of each pivot."""
    counts = df.groupBy(pivot).agg(F.ceil(F.count("*") / size).cast("int").alias(f"{name}s"))
    return df.join(F.broadcast(counts), pivot).withColumn(name, F.pmod(F.xxhash64("class"), F.col(f"{name}s")).cast("int")), counts


def search(rows: DataFrame, queries: Column, k: int = 20, count: int = 128, prefix: int = 32, posted: int = 8, probed: int = 16, rerank: float = 0.7, least: int = 400, sample: int = 20_000) -> DataFrame:
    """rows (id, vector); queries: which ids are queries. Returns query_id, rank, vec_id, score.

    count: pivots, a number that bounds all that is broadcast; rerank: share of a block's candidates that is reranked,
    of which `least` always are.
    """
    rows = rows.filter("id is not null").filter(valid(F.col("vector")))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.filter(F.size("vector") == length[0]).select("id", "vector")
    known = written(classes(rows, k), "vectors")
    centres = pivots(known, count, sample)
    prefix, posted, probed = (min(n, len(centres)) for n in (prefix, posted, probed))
    index = known.mapInArrow(_permutations(centres, prefix), "class string, vector array<float>, ids array<bigint>, pivots array<int>")
    index = written(index, "index")
    asked = rows.filter(queries).select("id", F.sha2(F.to_json(F.struct("vector")), 256).alias("class")).distinct()
    wanted = index.join(asked.select("class").distinct(), "class", "left_semi")
    files, sizes = _blocks(index.select("class", "vector", "pivots", F.explode(F.slice("pivots", 1, posted)).alias("pivot")), "pivot", BLOCK, "block")
    # every query block of a pivot meets every vector block of that pivot
    probes, _ = _blocks(wanted.select("class", "vector", "pivots", F.explode(F.slice("pivots", 1, probed)).alias("pivot")), "pivot", BLOCK, "part")
    probes = probes.join(F.broadcast(sizes), "pivot").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    files = files.join(F.broadcast(probes.groupBy("pivot").agg(F.max("parts").alias("parts"))), "pivot").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = ["pivot", "block", "part"]
    names = [*group, "class", "vector", "pivots"]
    found = probes.select(*names).toDF(*names).groupBy(*group).cogroup(files.select(*names).toDF(*names).groupBy(*group)).applyInArrow(_block_search(len(centres), k, rerank, least, False), "query_class string, class string, score double")
    found = written(found.groupBy("query_class", "class").agg(F.max("score").alias("score")), "found")
    # a class of equal vectors fills several places; a query with too few is compared with every vector
    total = known.agg(F.sum(F.size("ids"))).first()[0]
    sized = found.join(known.select("class", F.size("ids").alias("n")), "class").groupBy("query_class").agg(F.sum("n").alias("n"))
    short = wanted.join(sized.filter(F.col("n") > min(k, total - 1)).select(F.col("query_class").alias("class")), "class", "left_anti").select("class", "vector")
    if not short.isEmpty():
        n = max(1, -(-known.count() // BLOCK))
        left = short.withColumn("part", F.pmod(F.xxhash64("class"), F.lit(max(1, -(-short.count() // BLOCK))))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        parts = max(1, -(-short.count() // BLOCK))
        right = known.select("class", "vector").withColumn("block", F.pmod(F.xxhash64("class"), F.lit(n)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
        more = left.toDF(*left.columns).groupBy("part", "block").cogroup(right.toDF(*right.columns).groupBy("part", "block")).applyInArrow(_block_search(len(centres), k, rerank, least, True), "query_class string, class string, score double")
        found = found.unionByName(more).groupBy("query_class", "class").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("query_class").orderBy(F.desc("score"), F.col("ids")[0]))
    top = found.join(known.select("class", "ids"), "class").withColumn("r", best).filter(F.col("r") <= k + 1)
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    pairs = asked.select(F.col("id").alias("query_id"), F.col("class").alias("query_class")).join(top, "query_class").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("query_id <> vec_id")
    return pairs.withColumn("rank", ranked).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_permutation_index(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("vector"))
    return search(rows, F.col("id") % 20 == 0)
