"""Best-fit packing of tokenised documents into sequences of a fixed length.

Rounds of residual packing: every task packs its items best-fit, longest first; bins that are nearly full
leave, the others go on as items of the next round, dealt out anew over fewer tasks, until one task holds
them or a round joins none. A bin carries its members, at most one per token of its length, so no lookup is needed
when it leaves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenstep.llm.byte_level import ByteLevel, byte_level
from evenstep.llm.common import schema_of
from evenstep.sources.storage import settle

LENGTH = 1024
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMBER = "uid long, sequence_id long, offset long"
BIN = "fill int, uids array<long>, lengths array<long>"


def encoded(text: str, tokenizer: ByteLevel) -> list[int]:
    """Ids of a text; those of an added token wherever its string stands."""
    for content, number in tokenizer.added.items():
        if content in text:
            first, *others = text.split(content)
            ids = encoded(first, tokenizer)
            for part in others:
                ids.append(number)
                ids += encoded(part, tokenizer)
            return ids
    return tokenizer.encode(text) if text else []


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of ``length`` of which only the first may be shorter.

    ``tokenizer`` is the file of a byte-level tokenizer. A null text counts as empty and is ``end_id`` alone; a null ``doc_id`` is carried along; repeated rows give
    repeated pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, schema = byte_level(tokenizer), schema_of(PIECE)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.array([*encoded(text or "", known), end_id], "<u4").tobytes()
                    start, n = 0, len(ids) // 4
                    end = n % length or length
                    for piece in range(-(-n // length)):
                        rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                        start, end = end, end + length
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE)


def best_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """Bin number of every item: longest first, each into the fullest bin that still has room for it.

    A set of residual sizes kept as the bits of one number finds that bin without a search.
    """
    bins = np.empty(len(sizes), np.int64)
    waiting: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0
    opened = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
        else:
            room, chosen = length, opened
            opened += 1
        left = room - size
        if left:
            waiting[left].append(chosen)
            rooms |= 1 << left
        bins[i] = chosen
    return bins


def _round(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Pack the bins of one task into fewer; a bin keeps its members in order."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    rows = pa.Table.from_batches(table)
    fills = rows.column("fill").to_numpy()
    bins = best_fit(fills, length)
    order = np.argsort(bins, kind="stable")
    cuts = np.flatnonzero(np.diff(bins[order], prepend=-1))
    merged = rows.take(pa.array(order)).combine_chunks()
    schema = schema_of(BIN)

    def joined(name: str) -> pa.Array:
        lists = merged.column(name).combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offsets = np.append(lists.offsets.to_numpy()[cuts], lists.offsets.to_numpy()[-1]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), lists.values)

    filled = np.add.reduceat(fills[order], cuts).astype(np.int32)
    out = pa.RecordBatch.from_arrays([pa.array(filled), joined("uids"), joined("lengths")], schema=schema)
    for start in range(0, out.num_rows, 4096):
        yield out.slice(start, 4096)


def pack(items: DataFrame, length: int = LENGTH, open_below: float = 0.995, per_task: int = 200_000, members_per_task: int = 2_000_000) -> DataFrame:
    """``uid, sequence_id, offset`` for ``items`` (``uid`` unique, ``length`` from 1 to ``length``).

    A bin filled to ``open_below`` of ``length`` leaves after the round that filled it; the rest meet again, at
    most about ``per_task`` of them with ``members_per_task`` members in a task. Rounds go on until one task has packed what is left, or a round no
    longer lowers the number of bins. Nothing is dropped: what is open at the end leaves as it is.
    The number of a sequence is the ``uid`` of its first item.
    """
    bins = items.select(
        F.col("length").cast("int").alias("fill"),
        F.array("uid").alias("uids"),
        F.array(F.col("length").cast("long")).alias("lengths"),
    )
    full = F.col("fill") >= int(open_below * length)
    finished, tasks = [], None
    sizes = F.count(F.lit(1)), F.coalesce(F.sum(F.size("uids")), F.lit(0))
    waiting, members = bins.agg(*sizes).first()
    while waiting and tasks != 1:
        fewest = max(-(-waiting // per_task), -(-members // members_per_task))
        tasks = max(fewest, -(-tasks // 4)) if tasks else fewest
        packed = settle(bins.repartition(tasks).mapInArrow(lambda batches: _round(batches, length), BIN))
        finished.append(packed.where(full))
        bins = packed.where(~full)
        before, (waiting, members) = waiting, bins.agg(*sizes).first()
        if waiting + finished[-1].count() == before:
            break
    for done in finished:
        bins = bins.unionByName(done)
    return bins.mapInArrow(_members, MEMBER)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per member of each bin, with the bin's number and the member's place in it."""
    for batch in batches:
        counts = batch.column("uids").value_lengths().to_numpy(zero_copy_only=False)
        uids = batch.column("uids").flatten().to_numpy()
        sizes = batch.column("lengths").flatten().to_numpy()
        firsts = np.cumsum(counts) - counts
        starts = np.cumsum(sizes) - sizes
        columns = (uids, np.repeat(uids[firsts], counts), starts - np.repeat(starts[firsts], counts))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema_of(MEMBER))


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """A row per piece of every document with its place in a sequence.

    Full pieces are sequences of their own; all other pieces are packed. An empty table packs to nothing;
    columns other than ``doc_id`` and ``text`` are not looked at.
    """
    cut = settle(pieces(docs, tokenizer, end_id, length).withColumn("uid", F.monotonically_increasing_id()))
    whole = cut.where(F.col("length") == length).select(*_PIECE_COLUMNS, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = cut.where(F.col("length") < length)
    placed = part.join(pack(part.select("uid", "length"), length), "uid").select(*_PIECE_COLUMNS, "sequence_id", "offset")
    return whole.unionByName(placed)


_PIECE_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")
