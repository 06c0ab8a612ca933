"""Near-duplicate documents by fast similarity sketching.

A document is the set of its five-word shingles. Its sketch has a fixed number of coordinates, filled in
rounds: each round throws every shingle into a hashed bin with a hashed value, a coordinate keeps the first
round's smallest value that reaches it, and the last rounds aim at one coordinate each, so that none stays
empty however few shingles there are. Two sketches agree in a coordinate about as often as their sets
overlap.

Equal sets are one class and represented by one document. Sketches of representatives are cut into bands; where a
band agrees, sketches are compared in full, in blocks, and documents whose sketches come near are gathered. In such a
gathering, links are confirmed on the full sets, nearest sketches first and only between documents that
are not yet connected. So no pairs of a crowded group are written out, and none is skipped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from evenstep.llm.common import by_group, mixed, per_batch, shingles_at, texts
from evenstep.llm.components import components
from evenstep.sources.storage import settle

SHINGLE = 5
#: 51 bands of 5 coordinates: at a similarity of 0.75 a pair is missed once in a million.
BANDS, ROWS = 51, 5
COORDINATES = 256
#: Sketches that agree less than this are told apart without the sets: 0.75 is 5 deviations away.
NEAR = 0.61
#: Documents of one bucket or gathering that one task compares with another such block.
BLOCK = 512
SKETCH = "doc_id long, n_shingles long, high long, low long, bands array<long>, sketch binary"


def sketch(shingles: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """Coordinates of a set of 64-bit hashes; equal sets have equal sketches. The set must not be empty."""
    filled = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    low = np.uint64((1 << 54) - 1)
    for turn in range(2 * size):
        thrown = mixed(shingles, turn + 1)
        values = (thrown & low) | np.uint64(turn) << np.uint64(54)
        if turn < size:
            # High bits give the bin, low bits the value.
            np.minimum.at(filled, (thrown >> np.uint64(56)).astype(np.int64) * size >> 8, values)
        else:
            filled[turn - size] = min(filled[turn - size], values.min())
        if (filled >> np.uint64(54) <= np.uint64(turn)).all():
            break
    return filled


def sketched(docs: DataFrame) -> DataFrame:
    """A row per document: size and fingerprint of its shingle set, keys of its bands, one byte per coordinate."""
    seeds = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1))[:, None]

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_shingles": [], "high": [], "low": [], "bands": [], "sketch": []}
        for text in texts(batch):
            shingles = np.unique(shingles_at(text, SHINGLE))
            out["n_shingles"].append(len(shingles))
            if not len(shingles):
                for name in ("high", "low", "bands", "sketch"):
                    out[name].append(None)
                continue
            print_of = xxhash.xxh3_128_intdigest(shingles.tobytes())
            for name, value in (("high", print_of >> 64), ("low", print_of & (1 << 64) - 1)):
                out[name].append(value - (1 << 64) if value >> 63 else value)
            coordinates = mixed(sketch(shingles))
            parts = coordinates[: BANDS * ROWS].reshape(BANDS, ROWS)
            keys = seeds.ravel()
            for k in range(ROWS):
                keys = mixed(keys ^ parts[:, k], k)
            out["bands"].append(keys.view(np.int64))
            out["sketch"].append((coordinates >> np.uint64(56)).astype(np.uint8).tobytes())
        return {"doc_id": batch.column("doc_id"), **out}

    return per_batch(docs.select("doc_id", "text"), rows, SKETCH)


class Forest:
    """Which of ``n`` items are connected so far."""

    def __init__(self, n: int) -> None:
        self.parents = list(range(n))

    def find(self, i: int) -> int:
        while self.parents[i] != i:
            self.parents[i] = self.parents[self.parents[i]]
            i = self.parents[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parents[max(i, j)] = min(i, j)
        return i != j


def _agreement(sketches: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of every pair, freed of the chance agreement of single bytes."""
    if len(sketches) * len(others) <= 4096:
        equal = np.count_nonzero(sketches[:, None, :] == others[None, :, :], axis=2)
    else:
        equal = np.zeros((len(sketches), len(others)), np.int16)
        for column, other in zip(sketches.T, others.T):
            equal += column[:, None] == other[None, :]
    return (equal / sketches.shape[1] - 1 / 256) * 256 / 255


def _near_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows whose sketches are near and whose sizes allow 0.75, with their agreement; across the blocks only."""
    sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
    sizes = table.column("n_shingles").to_numpy()
    sides = table.column("side").to_numpy()
    first, second = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
    near = _agreement(sketches[first], sketches[second])
    small, large = np.minimum.outer(sizes[first], sizes[second]), np.maximum.outer(sizes[first], sizes[second])
    i, j = np.nonzero((near >= NEAR) & (4 * small >= 3 * large))
    kept = (sides[first[i]] != 2) | (first[i] < second[j])
    i, j = i[kept], j[kept]
    return first[i], second[j], near[i, j]


def _in_blocks(members: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """Members of ``key`` dealt to pairs of blocks, so that any two meet in a group of about two blocks at most.

    ``sizes`` has the number of members (``n``) of each key. Side 0 and 1 are the two blocks of a pair; in the pair
    of a block with itself every member has side 2.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id", "high", "low"), blocks).cast("int")
    dealt = members.join(sizes.select(F.col(key).alias("_key"), blocks.alias("blocks"), "n"), F.col(key) == F.col("_key"))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return dealt.select(
        key, "id", "high", "low", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), side.alias("side")
    )


def _gather(table: pa.Table) -> dict | None:
    """Documents of a bucket whose sketches come near, each with the first of those it is connected with."""
    if table.num_rows < 2:
        return None
    first, second, _ = _near_pairs(table)
    if not len(first):
        return None
    forest = Forest(table.num_rows)
    for i, j in zip(first.tolist(), second.tolist()):
        forest.union(i, j)
    roots = np.array([forest.find(i) for i in range(table.num_rows)])
    moved = np.flatnonzero(roots != np.arange(len(roots)))
    ids = table.column("id").to_numpy()
    return {"a": ids[moved], "b": ids[roots[moved]]}


def _confirm(table: pa.Table) -> dict | None:
    """Links of a gathering that hold on the full sets and connect what was not connected."""
    if table.num_rows < 2:
        return None
    first, second, near = _near_pairs(table)
    ids = table.column("id").to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
    forest, links = Forest(table.num_rows), []
    for at in np.argsort(-near, kind="stable").tolist():
        i, j = int(first[at]), int(second[at])
        if forest.find(i) != forest.find(j):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                forest.union(i, j)
                links.append((ids[i], ids[j]))
    return {"a": [a for a, _ in links], "b": [b for _, b in links]} if links else None


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id``, ``text``).

    Linked are documents with ``100 * |A & B| >= 75 * |A | B|`` on their whole shingle sets; a component is named
    after its smallest ``doc_id`` and keeps that one. A text that is null or has no word has no shingle and is
    alone. A null ``doc_id`` takes no part: null component, not kept. Rows that share a ``doc_id`` are one
    document: what links to one is linked to all, and each is answered. Other columns are not looked at.
    Shingles are compared as 64-bit hashes, and equal sets are found by a 128-bit fingerprint.
    """
    all_rows = settle(sketched(docs))
    known = all_rows.where("doc_id is not null and n_shingles > 0")
    classes = known.groupBy("high", "low").agg(F.min("doc_id").alias("id"))
    heads = known.join(classes.select(F.col("high").alias("h"), F.col("low").alias("l"), "id"), (F.col("high") == F.col("h")) & (F.col("low") == F.col("l")) & (F.col("doc_id") == F.col("id")))
    heads = settle(heads.select("id", "high", "low", "n_shingles", "bands", "sketch").dropDuplicates(["id", "high", "low"]))
    facts = heads.select(F.col("id").alias("_id"), F.col("high").alias("_high"), F.col("low").alias("_low"), "n_shingles", "sketch")
    same = (F.col("id") == F.col("_id")) & (F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low"))

    banded = heads.select(F.explode("bands").alias("bucket"), "id", "high", "low")
    crowded = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    in_buckets = settle(_in_blocks(banded, "bucket", crowded))
    placed = in_buckets.join(facts, same).select("bucket", "one", "two", "side", "id", "n_shingles", "sketch")
    gathered = components(by_group(placed, ["bucket", "one", "two"], _gather, "a long, b long"))

    gathered = settle(gathered.select(F.col("id").alias("member"), F.col("root").alias("gathering")))
    met = heads.join(gathered, F.col("id") == F.col("member")).select("gathering", "id", "high", "low", "n_shingles", "sketch")
    sizes = met.groupBy("gathering").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = _in_blocks(met.select("gathering", "id", "high", "low"), "gathering", sizes)
    sets = settle(_sets(docs, met.select("id").distinct()))
    compared = dealt.join(facts, same).select("gathering", "one", "two", "side", "id", "high", "low", "n_shingles", "sketch")
    compared = compared.join(sets, same).select("gathering", "one", "two", "side", "id", "n_shingles", "sketch", "shingles")
    links = by_group(compared, ["gathering", "one", "two"], _confirm, "a long, b long")
    # Rows of one id are one document, whatever their sets.
    twice = known.join(classes.withColumnsRenamed({"high": "h", "low": "l"}), (F.col("high") == F.col("h")) & (F.col("low") == F.col("l")) & (F.col("doc_id") != F.col("id")))
    repeated = known.groupBy("doc_id").agg(F.count_distinct("high", "low").alias("n")).where("n > 1").select(F.col("doc_id").alias("again"))
    same_id = twice.join(repeated, F.col("doc_id") == F.col("again")).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    joined = components(links.unionByName(same_id))

    named = classes.join(joined.withColumnRenamed("id", "member"), F.col("id") == F.col("member"), "left")
    named = named.select(F.col("high").alias("_high"), F.col("low").alias("_low"), F.coalesce("root", "id").alias("component"))
    answer = all_rows.select("doc_id", "n_shingles", "high", "low").join(named, (F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return answer.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Shingle sets of the documents in ``ids``, worked out again from their texts."""
    chosen = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("id"), "left_semi")

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"_high": [], "_low": [], "shingles": []}
        for text in texts(batch):
            shingles = np.unique(shingles_at(text, SHINGLE))
            print_of = xxhash.xxh3_128_intdigest(shingles.tobytes())
            for name, value in (("_high", print_of >> 64), ("_low", print_of & (1 << 64) - 1)):
                out[name].append(value - (1 << 64) if value >> 63 else value)
            out["shingles"].append(shingles.tobytes())
        return {"_id": batch.column("doc_id"), **out}

    return per_batch(chosen, rows, "_id long, _high long, _low long, shingles binary").dropDuplicates(["_id", "_high", "_low"])


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but those of documents that are linked to one with a smaller ``doc_id``; unchanged.

    Rows that share a ``doc_id`` stay or go together; rows without one stay.
    """
    dropped = near_duplicates(docs).where("doc_id is not null and not kept").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col("_dropped"), "left_anti")
