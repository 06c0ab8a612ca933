"""Byte-level BPE: encoding by one global pass over distinct words, decoding by the token table.

Documents travel in compressed blocks. Each block names its distinct words, dealt by a hash of the word, so that
a word meets its like from all blocks; there it is encoded once and its ids go back to every block that named
it. A block then puts its documents together again word by word, by position. What is shuffled is the text once
and each block's distinct words, not a row for each word of the corpus.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from evenstep.llm.common import schema_of
from evenstep.llm.pretokens import pretokens

BLOCK = "block long, doc_ids array<long>, sizes array<long>, packed binary"
WORDS = "part int, block long, packed binary"
#: Bytes of text in a block, unless a single document has more.
BLOCK_BYTES = 2 << 20
#: Words whose ids a task keeps at hand; beyond that it forgets them and may encode a word again.
KEPT_WORDS = 300_000
#: Ids that are decoded at once, unless a single document has more.
DECODED_IDS = 1 << 18


@cache
def ranks(path: str) -> dict[bytes, int]:
    """The tokenizer's table of merged byte strings, in the order of their merging."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@cache
def _encoder(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def _batch(ddl: str, *columns: list) -> pa.RecordBatch:
    schema = schema_of(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents packed into blocks; a size of -1 stands for a null text."""
    number = TaskContext.get().partitionId() << 32
    press = zstandard.ZstdCompressor(level=6)
    doc_ids: list = []
    found: list[bytes | None] = []
    held = 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()):
            if found and held + len(text or b"") > BLOCK_BYTES:
                sizes = [-1 if t is None else len(t) for t in found]
                yield _batch(BLOCK, [number], [doc_ids], [sizes], [press.compress(b"".join(t or b"" for t in found))])
                number, doc_ids, found, held = number + 1, [], [], 0
            doc_ids.append(doc_id)
            found.append(text)
            held += len(text or b"")
    if found:
        sizes = [-1 if t is None else len(t) for t in found]
        yield _batch(BLOCK, [number], [doc_ids], [sizes], [press.compress(b"".join(t or b"" for t in found))])


def _opened(packed: bytes, sizes: list[int]) -> Iterator[list[str]]:
    """The words of each document of a block, in order."""
    data, at = zstandard.ZstdDecompressor().decompress(packed), 0
    for size in sizes:
        end = at + max(size, 0)
        yield pretokens(data[at:end].decode("utf-8"))
        at = end


def _by_part(words: Iterable[str], parts: int) -> list[list[str]]:
    """Distinct words dealt by hash, in their own order; the same words give the same lists."""
    dealt: list[list[str]] = [[] for _ in range(parts)]
    for word in words:
        dealt[xxhash.xxh64_intdigest(word) % parts].append(word)
    return dealt


def _packed_words(words: list[str]) -> bytes:
    encoded = [w.encode("utf-8") for w in words]
    sizes = np.array([len(w) for w in encoded], "<u4").tobytes()
    return zstandard.compress(struct.pack("<I", len(words)) + sizes + b"".join(encoded), 6)


def _opened_words(packed: bytes) -> list[str]:
    data = zstandard.decompress(packed)
    (count,) = struct.unpack_from("<I", data)
    ends = (4 + 4 * count + np.cumsum(np.frombuffer(data, "<u4", count, 4))).tolist()
    return [data[a:b].decode("utf-8") for a, b in zip([4 + 4 * count, *ends], ends)]


def encode(docs: DataFrame, path: str, pattern: str, parts: int | None = None) -> DataFrame:
    """``doc_id, ids`` for every row of ``docs``: the ids of the whole text, each match of ``pattern`` by itself.

    ``pattern`` must be the public one of ``pretokens``, which splits without it. A null or empty text has no
    ids; a null ``doc_id`` is carried along and repeated rows are answered one by one; other columns are not
    looked at. ``parts`` is the number of shares that distinct words are dealt to (as many as shuffle partitions).
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def name_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "sizes", "packed"))):
                named: dict[str, None] = {}  # in the order of their first place
                for words in _opened(packed, sizes):
                    named.update(dict.fromkeys(words))
                rows = [(part, _packed_words(words)) for part, words in enumerate(_by_part(named, parts)) if words]
                if rows:
                    yield _batch(WORDS, [r[0] for r in rows], [block] * len(rows), [r[1] for r in rows])

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = _encoder(path, pattern), {}
        for batch in batches:
            for part, block, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "packed"))):
                words = _opened_words(packed)
                if len(known) > KEPT_WORDS:
                    known = {}
                for word in words:
                    if word not in known:
                        known[word] = np.array(encoder.encode_ordinary(word), "<u4").tobytes()
                ids = [known[w] for w in words]
                sizes = np.array([len(i) // 4 for i in ids], "<u4").tobytes()
                yield _batch(WORDS, [part], [block], [zstandard.compress(sizes + b"".join(ids), 6)])

    def assemble(texts: pa.Table, encoded: pa.Table) -> pa.Table:
        """Every word of the block by its number, and the ids of all numbers in a row; the documents' ids are picked from it."""
        schema = schema_of("doc_id long, ids array<int>")
        tables = [schema.empty_table()]
        answers = dict(zip(encoded.column("part").to_pylist(), encoded.column("packed").to_pylist()))
        for row in texts.to_pylist():
            numbers: dict[str, int] = {}
            places, counts = [], []
            for words in _opened(row["packed"], row["sizes"]):
                for word in words:
                    if word not in numbers:
                        numbers[word] = len(numbers)
                places.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                counts.append(len(words))
            sizes, starts = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
            ids, at = [], 0
            for part, words in enumerate(_by_part(numbers, parts)):
                if words:
                    data = np.frombuffer(zstandard.decompress(answers[part]), "<u4").astype(np.int32)
                    own, of = data[: len(words)], np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                    sizes[of], starts[of] = own, at + np.cumsum(own) - own
                    ids.append(data[len(words) :])
                    at += len(ids[-1])
            place = np.concatenate(places)
            lengths = sizes[place]
            ends = np.cumsum(lengths)
            picked = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[place] - (ends - lengths), lengths)
            flat = np.concatenate(ids)[picked] if ids else np.empty(0, np.int32)
            offsets = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            tables.append(pa.Table.from_arrays([pa.array(row["doc_ids"], pa.int64()), lists], schema=schema))
        return pa.concat_tables(tables)

    blocks = docs.select("doc_id", "text").mapInArrow(_blocks, BLOCK).repartition("block")
    words = blocks.mapInArrow(name_words, WORDS)
    encoded = words.repartition("part").mapInArrow(encode_words, WORDS)
    return blocks.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(assemble, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (with ``ids``) and ``decoded``, the bytes of its ids, by a join with the token table.

    The table has a row for each token of the tokenizer, whatever the data, and is joined inside the tasks. An
    id that is not in it raises; null ids give null bytes.
    """
    names = encoded.columns

    def in_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sums = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy())
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + DECODED_IDS, "right")))
            yield batch.slice(at, end - at)
            at = end

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = sorted((rank, token) for token, rank in ranks(path).items())
        table = pa.array([token for _, token in by_id], pa.large_binary())
        for batch in chain.from_iterable(map(in_slices, batches)):
            lists = batch.column("ids")
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            tokens = pc.take(table, pc.list_flatten(lists))
            bounds = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int64())
            joined = pc.binary_join(pa.LargeListArray.from_arrays(bounds, tokens), pa.scalar(b"", pa.large_binary()))
            joined = pc.if_else(pc.is_null(lists), pa.scalar(None, pa.large_binary()), joined).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), joined], names=[*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(join, f"{fields}, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """Number of ids and digests of ids and bytes, by document."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
