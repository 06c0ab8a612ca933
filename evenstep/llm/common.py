"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

Batches = Iterator[pa.RecordBatch]

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser: every input bit moves every output bit."""
    x = values + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[name] = np.cumprod(run)
    return _powers["up"][:n], _powers["down"][:n]


def hasher(data: np.ndarray):
    """``hash(starts, ends)``: 64-bit hashes of ``data[starts[i]:ends[i]]``, equal for equal bytes, from one running sum."""
    up, down = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:-1], out=sums[1:])
    return lambda starts, ends: mixed((sums[ends] - sums[starts]) * down[starts])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return hasher(data)(starts, ends)


def shingles_at(text: bytes | None, width: int = 5) -> np.ndarray:
    """Hash of the ``width``-word shingle that starts at each word; of all words as one where there are fewer.

    Words are runs of bytes other than ASCII white space, after lower-casing A-Z.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    data = np.frombuffer(b" " + b" ".join(words), np.uint8)
    starts = np.flatnonzero(data == 32)
    if len(words) <= width:
        return span_hashes(data, starts[:1], np.array([len(data)]))
    return span_hashes(data, starts[: 1 - width], np.append(starts[width:], len(data)))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def schema_of(ddl: str) -> pa.Schema:
    """Arrow schema of a ``name type`` list of the few types in use."""
    kinds = {
        "long": pa.int64(),
        "int": pa.int32(),
        "double": pa.float64(),
        "float": pa.float32(),
        "boolean": pa.bool_(),
        "string": pa.string(),
        "binary": pa.binary(),
        "array<int>": pa.list_(pa.int32()),
        "array<long>": pa.list_(pa.int64()),
        "array<float>": pa.list_(pa.float32()),
        "array<string>": pa.list_(pa.string()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def per_batch(df: DataFrame, function: Callable[[pa.RecordBatch], dict | None], ddl: str) -> DataFrame:
    """``function`` turns a batch into columns by name; each batch is answered before the next is read."""

    def run(batches: Batches) -> Batches:
        schema = schema_of(ddl)
        for batch in batches:
            if batch.num_rows and (columns := function(batch)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, ddl)


def groups(batches: Batches, keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``keys`` (integers without nulls) in batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows - 1, bool)
        for v in values:
            changed |= v[1:] != v[:-1]
        edges = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            key = tuple(v[start] for v in values)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def by_group(df: DataFrame, keys: list[str], function: Callable[[pa.Table], dict | None], ddl: str) -> DataFrame:
    """``function`` on every group of ``keys``; one Python call per group, no Spark group overhead.

    The caller sees to it that a group is bounded.
    """

    def run(batches: Batches) -> Batches:
        schema, held, rows = schema_of(ddl), [], 0
        for group in groups(batches, keys):
            if (columns := function(group)) is None:
                continue
            held.append(pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema))
            rows += held[-1].num_rows
            if rows >= 4096:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ddl)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` worked out once a row however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null where the key is."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


#: More strata than this are refused by bounded_sample, which sends their counts to every task.
MAX_STRATA = 10_000


def bounded_sample(rows: DataFrame, stratum: str, order: str, size: int) -> DataFrame:
    """At most ``size`` rows of each value of ``stratum``, those with the smallest hash of ``order``.

    A first cut at a hash threshold from each stratum's count leaves about twice ``size`` rows of it where the
    rows are read, so that the exact cut sees bounded groups however large a stratum is.
    """
    place = F.pmod(F.xxhash64(order), F.lit(1 << 40)) / float(1 << 40)
    counted = rows.groupBy(F.col(stratum).alias("_of")).agg(F.count(F.lit(1)).alias("_rows")).limit(MAX_STRATA + 1)
    counts = counted.collect()
    if len(counts) > MAX_STRATA:
        raise ValueError(f"{stratum} has more than {MAX_STRATA} values")
    bounds = rows.sparkSession.createDataFrame(counts, counted.schema)
    near = rows.withColumn("_place", place).join(F.broadcast(bounds), F.col(stratum) == F.col("_of"))
    near = near.where(F.col("_place") * F.col("_rows") <= 2 * size + 50)
    rank = F.expr(f"row_number() over (partition by {stratum} order by _place, {order})")
    return near.withColumn("_rank", rank).where(F.col("_rank") <= size).drop("_place", "_of", "_rows", "_rank")
