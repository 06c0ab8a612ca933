"""Approximate nearest neighbours by counting collisions on single projections.

Rows are indexed in blocks: a block keeps its vectors' values on each of many random lines as a sorted array. For a
query a window around its own value opens on every line; a row that falls into enough windows is a candidate
and is verified on the original vectors. As long as a block has too few candidates, the windows widen about the query
(virtual rehashing), and only what a wider window adds is counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evenstep.llm.common import schema_of

FOUND = "query_key long, query_id long, vec_id long, score double"
#: First half-width of a window, in units of the spread of unit vectors on a line, and its growth per widening.
FIRST, GROWTH = 0.3, 1.2


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, dim`` of the vectors that take part: no null or non-finite component, not all zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & nonzero)


def _matrix(table: pa.Table) -> np.ndarray:
    lists = table.column("embedding").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _search(rows: pa.Table, queries: pa.Table, k: int, lines: int, collisions: float, share: float, least: int) -> pa.Table:
    """The ``k`` nearest of ``rows`` found for each query."""
    found: list[tuple] = []
    if rows.num_rows and queries.num_rows:
        vectors, asked = _matrix(rows), _matrix(queries)
        ids, query_ids = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        keys = queries.column("query_key").to_numpy()
        n, dim = vectors.shape
        norms, asked_norms = np.sqrt((vectors * vectors).sum(axis=1)), np.sqrt((asked * asked).sum(axis=1))
        directions = np.random.default_rng(dim).standard_normal((dim, lines))
        values = ((vectors / norms[:, None]) @ directions).T
        centres = ((asked / asked_norms[:, None]) @ directions).T
        order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        values = np.take_along_axis(values, order, axis=1)
        needed, enough = int(np.ceil(collisions * lines)), min(n, max(least, int(share * n)) + k + 1)
        counts = np.zeros((len(asked), n), np.uint16)
        low = high = np.stack([np.searchsorted(v, c) for v, c in zip(values, centres)])
        waiting, width = np.arange(len(asked)), FIRST
        while len(waiting):
            new_low = np.stack([np.searchsorted(v, c[waiting] - width) for v, c in zip(values, centres)])
            new_high = np.stack([np.searchsorted(v, c[waiting] + width, "right") for v, c in zip(values, centres)])
            short = []
            for at, q in enumerate(waiting):
                added = [order[j, a:b] for j, (a, b) in enumerate(zip(new_low[:, at], low[:, at])) if a < b]
                added += [order[j, a:b] for j, (a, b) in enumerate(zip(high[:, at], new_high[:, at])) if a < b]
                if added:
                    counts[q] += np.bincount(np.concatenate(added), minlength=n).astype(np.uint16)
                close = np.flatnonzero(counts[q] >= needed)
                if len(close) < enough:
                    short.append(at)
                    continue
                close = close[ids[close] != query_ids[q]]
                scores = (vectors[close] * asked[q]).sum(axis=1) / (norms[close] * asked_norms[q])
                best = np.lexsort((ids[close], -scores))[:k]
                found += zip([keys[q]] * k, [query_ids[q]] * k, ids[close][best], scores[best])
            waiting, low, high, width = waiting[short], new_low[:, short], new_high[:, short], width * GROWTH
    columns = list(zip(*found)) or [[]] * 4
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema_of(FOUND))], schema=schema_of(FOUND))


def nearest(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    lines: int = 192,
    collisions: float = 0.5,
    share: float = 0.1,
    least: int = 256,
    rows_per_block: int = 8192,
    queries_per_block: int = 2048,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows by cosine found for each row whose ``vec_id`` is
    divisible by ``every``, nearest first, ties to the smaller ``vec_id``.

    A row is a candidate on ``collisions`` of the ``lines``; windows widen until a block has a ``share`` of its
    rows, and ``least`` of them or all, as candidates. Candidates are all rows but those of the query's own id, of the query's
    number of components. Vectors that are null, zero, or hold null or non-finite components, and rows without an id,
    take no part. A repeated row is a candidate each time; a repeated query is asked once.
    """
    rows = usable(vectors)
    key = F.xxhash64("vec_id", F.col("embedding").cast("string"))
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("query_key", key).dropDuplicates(["query_key"])
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked")).first()
    blocks, sets = max(1, -(-sizes.n // rows_per_block)), max(1, -(-sizes.asked // queries_per_block))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    spread = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(sets)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )
    groups = ["dim", "block", "part"]
    found = placed.groupBy(*groups).cogroup(spread.groupBy(*groups)).applyInArrow(
        lambda left, right: _search(left, right, k, lines, collisions, share, least), FOUND
    )
    best = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
