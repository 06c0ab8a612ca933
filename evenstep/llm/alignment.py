"""Alignment of two tokenizers over a corpus: groups of tokens that cover the same bytes, and counts of ids that end together.

Both tokenizers' ids of a slice of documents are Arrow lists. Flattened, with the number of the document each token came
from, token lengths are summed up within each document, which gives every token the byte it ends at. An Acero hash join
of both sides on (document, end) finds the ends that they share: these cut both token sequences into groups.

A pair of ids that end together is a link. Each block of documents counts its distinct pairs (Arrow ``group_by``), Spark
merges the counts of all blocks, and each block gets the counts of its own pairs back to sum them up by document. So a
pair travels once a block, however often it occurs there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from evenstep.llm.byte_level import byte_level
from evenstep.llm.common import schema_of
from evenstep.sources.storage import settle

#: Links of a block and bytes of text of a slice, unless a single document has more.
BLOCK_LINKS = 2_000_000
SLICE_BYTES = 1 << 20
BLOCK = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, links array<long>, "
    "digests array<string>, codes array<long>, times array<long>, places binary"
)
ANSWER = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: A pair of ids in one number.
_SHIFT = 24
class Vocabulary:
    """Bytes, lengths and decimal numbers of a tokenizer's ids."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = pa.array(tokens, pa.large_binary())
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.digits = pa.array([str(i) for i in range(len(tokens))], pa.large_string())


class Bytes:
    """A byte-level tokenizer with what its ids stand for."""

    def __init__(self, path: str) -> None:
        self.tokenizer = byte_level(path)
        self.vocabulary = Vocabulary(self.tokenizer.tokens)

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text)


class Pieces:
    """A sentencepiece model that puts a blank before the text and falls back to bytes."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(count)]
        byte = [self.model.is_byte(i) for i in range(count)]
        self.vocabulary = Vocabulary([bytes([int(n[3:5], 16)]) if b else n.replace("▁", " ").encode() for n, b in zip(names, byte)])

    @cached_property
    def apart(self) -> bool:
        """Whether no piece goes on beyond a blank that follows something else, so that a text may be cut there."""
        return not any(re.search("[^▁]▁", self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


_CUT = re.compile(r"(?<=\S) (?=\S)")


@cache
def _tokenizers(a: str, b: str) -> tuple[Bytes, Pieces]:
    """One of each for all tasks of a worker process."""
    return Bytes(a), Pieces(b)


def _parts(text: str) -> Iterator[str]:
    """A long text cut at single blanks, which both tokenizers start a token at; a part stands for blank and text."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        cut = _CUT.search(text, at + SLICE_BYTES)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def _encoded(text: str, first: Bytes, second: Pieces) -> tuple[list[int], list[int]]:
    a: list[int] = []
    b: list[int] = []
    for part in _parts(text) if len(text) > SLICE_BYTES and second.apart else (text,):
        a += first.encode(" " + part)
        b += second.encode(part)
    return a, b


def _lists(ids: list[list[int]]) -> pa.LargeListArray:
    offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids])))
    flat = np.concatenate([np.array(i, np.int32) for i in ids]) if ids else np.empty(0, np.int32)
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(flat, pa.int32()))


def _joined(strings: pa.Array, starts: np.ndarray, between: str | bytes) -> pa.Array:
    """One string of each run of ``strings``; ``starts`` has where runs begin, and the end."""
    lists = pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), strings)
    return pc.binary_join(lists, pa.scalar(between, strings.type))


def _sides(lists: pa.LargeListArray, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, id and end byte of every token: lengths summed up within each document."""
    ids = pc.list_flatten(lists).to_numpy()
    parents = pc.list_parent_indices(lists).to_numpy()
    sums = np.cumsum(known.lengths[ids])
    before = np.concatenate(([0], sums))[lists.offsets.to_numpy()[:-1]]
    return parents, ids, sums - before[parents]


def align(texts: list[str], first: Bytes, second: Pieces) -> dict[str, np.ndarray | list]:
    """Numbers of tokens, groups and links of each text, digests of the groups, and the id pair of every link in order."""
    encoded = [_encoded(t, first, second) if t else ([], []) for t in texts]
    wanted = pa.array([b" " + t.encode() if t else b"" for t in texts], pa.large_binary())
    lists = [_lists([e[side] for e in encoded]) for side in (0, 1)]
    vocabularies = (first.vocabulary, second.vocabulary)
    # A text that either tokenizer changes has no tokens.
    same = np.ones(len(texts), bool)
    for side, known in zip(lists, vocabularies):
        told = _joined(pc.take(known.tokens, pc.list_flatten(side)), side.offsets.to_numpy(), b"")
        same &= pc.equal(told, wanted).to_numpy(zero_copy_only=False)
    if not same.all():
        lists = [_lists([e[side] if s else [] for e, s in zip(encoded, same)]) for side in (0, 1)]
    counts = [np.diff(side.offsets.to_numpy()) for side in lists]
    sides = [_sides(side, known) for side, known in zip(lists, vocabularies)]

    keys = [parents << 40 | ends for parents, _, ends in sides]
    tables = [pa.table({"key": key, name: ids}) for key, (_, ids, _), name in zip(keys, sides, "ab")]
    links = tables[0].join(tables[1], "key", join_type="inner", use_threads=False).sort_by("key")
    key, a, b = (links.column(c).to_numpy() for c in ("key", "a", "b"))
    shared = key[np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]]
    document = shared >> 40
    n_groups = np.bincount(document, minlength=len(texts))

    # A group is all tokens up to an end that both share, from the one before.
    told = []
    for own, (_, ids, _), known in zip(keys, sides, vocabularies):
        starts = np.concatenate(([0], np.searchsorted(own, shared, "right")))
        told.append(_joined(pc.take(known.digits, pa.array(ids)), starts, ","))
    groups = pc.binary_join_element_wise(*told, pa.scalar("|", pa.large_string()))
    whole = _joined(groups, np.concatenate(([0], np.cumsum(n_groups))), ";")
    digests = [hashlib.sha256(g.encode()).hexdigest() if n else "" for g, n in zip(whole.to_pylist(), counts[0])]
    return {
        "n_a": counts[0],
        "n_b": counts[1],
        "n_groups": n_groups,
        "links": np.bincount(key >> 40, minlength=len(texts)),
        "digests": digests,
        "codes": a.astype(np.int64) << _SHIFT | b,
    }


def _block(number: int, doc_ids: list, parts: list[dict]) -> pa.RecordBatch:
    """A block as a row: what is known of each document, its distinct pairs with their counts, and each link's pair."""
    links = pa.table({"code": np.concatenate([p["codes"] for p in parts])})
    counted = links.group_by("code", use_threads=False).aggregate([("code", "count")])
    codes = counted.column("code").combine_chunks()
    codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
    places = pc.index_in(links.column("code"), value_set=codes).to_numpy().astype("<u4")
    own = [np.concatenate([p[name] for p in parts]) for name in ("n_a", "n_b", "n_groups", "links")]
    digests = [d for p in parts for d in p["digests"]]
    columns = (number, doc_ids, *own, digests, codes.to_numpy(), counted.column("code_count").to_numpy(), zstandard.compress(places.tobytes(), 3))
    return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, schema_of(BLOCK))], schema=schema_of(BLOCK))


def aligned_blocks(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Documents aligned and put into blocks of about ``BLOCK_LINKS`` links."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _tokenizers(a, b)
        number = TaskContext.get().partitionId() << 32
        doc_ids: list = []
        parts: list[dict] = []
        size = 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(np.cumsum(lengths[at:]), SLICE_BYTES)) + at)
                parts.append(align(batch.column("text").slice(at, end - at).to_pylist(), first, second))
                doc_ids += batch.column("doc_id").slice(at, end - at).to_pylist()
                size += len(parts[-1]["codes"])
                at = end
                if size >= BLOCK_LINKS:
                    yield _block(number, doc_ids, parts)
                    number, doc_ids, parts, size = number + 1, [], [], 0
        if parts:
            yield _block(number, doc_ids, parts)

    return docs.select("doc_id", "text").mapInArrow(rows, BLOCK)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``code, n, best``: links that hold a pair, corpus-wide, and whether no pair with the same second id has more."""
    counted = blocks.select(F.explode(F.arrays_zip("codes", "times")).alias("of")).groupBy(F.col("of.codes").alias("code")).agg(F.sum("of.times").alias("n"))
    counted = settle(counted)
    second = F.col("code").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    most = counted.groupBy(second.alias("second")).agg(F.max("n").alias("most"))
    return counted.join(most, second == F.col("second")).select("code", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))


def _summed(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """Rows of a block's documents, with the counts of its pairs summed up over each one's links."""
    schema = schema_of(ANSWER)
    if not blocks.num_rows:
        return schema.empty_table()
    row = blocks.slice(0, 1).to_pylist()[0]
    n, best = np.zeros(len(row["codes"]) + 1, np.int64), np.zeros(len(row["codes"]) + 1, np.int64)
    place = answers.column("place").to_numpy()
    n[place], best[place] = answers.column("n").to_numpy(), answers.column("best").to_numpy()
    places = np.frombuffer(zstandard.decompress(row["places"]), "<u4")
    ends = np.cumsum(row["links"])
    starts = ends - row["links"]
    sums = [np.concatenate(([0], np.cumsum(x[places]))) for x in (best, n)]
    n_best, count_sum = (s[ends] - s[starts] for s in sums)
    columns = (row["doc_ids"], row["n_a"], row["n_b"], row["n_groups"], row["links"], n_best, count_sum, row["digests"])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    ``a`` is the file of a byte-level tokenizer, which encodes a blank and the text; ``b`` a sentencepiece
    model that puts that blank there itself. A text that is null, empty, or not given back byte by byte by both has no
    tokens: zeros and an empty digest. ``n_best`` counts links whose pair is the most frequent of its ``b`` id, ties included. A null ``doc_id`` is carried
    along, repeated rows count each, an empty table gives no rows, other columns are not looked at. Texts of more than a
    mebibyte are encoded in parts, cut where both tokenizers start anew.
    """
    blocks = settle(aligned_blocks(docs, a, b))
    counts = settle(pair_counts(blocks))
    asked = blocks.select(F.col("block").alias("of"), F.posexplode("codes").alias("place", "_code"))
    answers = asked.join(counts.hint("merge"), F.col("_code") == F.col("code")).select("of", "place", "n", "best")
    return blocks.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_summed, ANSWER)
