"""Ranked lexical search by hashed max-sketches and exact rescoring.

A document's sketch is an array of coordinates; each of its terms reaches two of them by its hash, and a coordinate keeps the
largest term frequency that reaches it. The impact of a term grows with its frequency, so a coordinate's frequency, put
through the document's own length, gives the largest impact of all terms that reach it, and the smaller of a term's two
coordinates bounds the term's impact in the document. A block of queries looks all its terms up in a batch of sketches at
once, which gives an upper bound of every score.

The documents with the highest bounds are rescored exactly first. The k-th best of these scores is the threshold: a document
whose bound is below it cannot be among the k best, and all others are rescored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evenstep.llm.common import hasher, per_batch, schema_of, texts
from evenstep.sources.storage import settle

#: Coordinates for each distinct term of a document at least; the number is a power of two.
ROOM, FEWEST = 8, 64
#: A coordinate holds frequencies below this; it stands for itself and all above, whose impact is below ``MOST``.
FULL, MOST = 255, 1_000_000
#: Documents of the first slice, by query.
FIRST = 32
#: Queries in a block, and bytes of their texts.
BLOCK_ITEMS, BLOCK_BYTES = 512, 1 << 20
#: Rows of documents to rescore that are sent to every task; beyond that both sides are shuffled.
BROADCAST_ROWS = 50_000
PIECE = 1 << 20
INDEX = "doc_id long, mark long, n long, sketch binary, terms array<long>, docs array<long>"
BOUND = "item int, doc_id long, mark long, bound long"
# Bytes of a term; A-Z become a-z, everything else a blank.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case."""
    return (text or b"").translate(_TERM_BYTES).split()


def _pieces(data: bytes) -> Iterator[bytes]:
    """``data`` cut at blanks into pieces of about ``PIECE`` bytes; a longer term stays whole."""
    at = 0
    while len(data) - at > PIECE:
        cut = data.find(b" ", at + PIECE)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


def hashed_terms(found: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, hash, frequency)`` of the distinct terms of every text, in the order of the texts."""
    of, hashes, first, held, size = [], [], 0, [], 0

    def add(parts: list[bytes], numbers: np.ndarray) -> None:
        data = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
        gap = data == 32
        starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        firsts = 1 + np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])[:-1]))
        hashes.append(hasher(data)(starts, ends))
        of.append(numbers[np.searchsorted(firsts, starts, "right") - 1])

    for number, text in enumerate(found):
        plain = (text or b"").translate(_TERM_BYTES)
        if held and size + len(plain) > PIECE:
            add(held, np.arange(first, number))
            first, held, size = number, [], 0
        if len(plain) > PIECE:
            for piece in _pieces(plain):
                add([piece], np.array([number]))
            first = number + 1
        else:
            held.append(plain)
            size += len(plain)
    if held:
        add(held, np.arange(first, len(found)))
    if not hashes:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    of, hashed = np.concatenate(of), np.concatenate(hashes)
    order = np.lexsort((hashed, of))
    of, hashed = of[order], hashed[order]
    new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (hashed[1:] != hashed[:-1])))[: len(of)])
    return of[new], hashed[new], np.diff(np.append(new, len(of)))


def _coordinates(hashes: np.ndarray, sizes: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The two coordinates of each hash in sketches of ``sizes``, which are powers of two."""
    mask = np.asarray(sizes, np.uint64) - np.uint64(1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def sketches(of: np.ndarray, hashes: np.ndarray, frequencies: np.ndarray, count: int) -> list[np.ndarray | None]:
    """Max-sketch of each of ``count`` texts from its distinct terms; none without a term."""
    distinct = np.bincount(of, minlength=count)
    sizes = np.maximum(FEWEST, 1 << np.ceil(np.log2(np.maximum(distinct * ROOM, 1))).astype(np.int64))
    ends = np.cumsum(np.where(distinct > 0, sizes, 0))
    starts = np.concatenate(([0], ends[:-1]))
    flat = np.zeros(ends[-1] if count else 0, np.uint8)
    kept = np.minimum(frequencies, FULL).astype(np.uint8)
    for places in _coordinates(hashes, sizes[of]):
        np.maximum.at(flat, starts[of] + places, kept)
    return [flat[a:b] if n else None for a, b, n in zip(starts, ends, distinct)]


def build_index(docs: DataFrame) -> DataFrame:
    """Sketches of all ``docs`` (``doc_id, text``), and in the same pass how many documents hold each term.

    Rows with a sketch are documents with a term (``n`` terms with repeats, ``mark`` a hash of the text); rows with
    ``terms`` are partial counts, which each task sends once for all its texts. Written to shared storage.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(INDEX)
        seen: list[np.ndarray] = []
        counted: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            hashes, numbers = np.concatenate(seen), np.concatenate(counted)
            order = np.argsort(hashes, kind="stable")
            hashes, numbers = hashes[order], numbers[order]
            new = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            return hashes[new], np.add.reduceat(numbers, new)

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                of, hashes, frequencies = hashed_terms(texts(part))
                if not len(of):
                    continue
                found = sketches(of, hashes, frequencies, part.num_rows)
                sums = np.bincount(of, frequencies, minlength=part.num_rows).astype(np.int64)
                has = np.flatnonzero(sums)
                empty = [None] * len(has)
                columns = (part.column("doc_id").take(pa.array(has)), part.column("mark").take(pa.array(has)), sums[has], [found[i].tobytes() for i in has], empty, empty)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
                values, numbers = np.unique(hashes, return_counts=True)
                seen.append(values)
                counted.append(numbers)
                if sum(map(len, seen[1:])) > 1 << 20:
                    values, numbers = merged()
                    seen, counted = [values], [numbers]
        if seen:
            values, numbers = merged()
            for start in range(0, len(values), 1 << 16):
                part = [values[start : start + (1 << 16)].view(np.int64)], [numbers[start : start + (1 << 16)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([None],) * 4 + part, schema)], schema=schema)

    return settle(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(rows, INDEX))


@dataclass(frozen=True)
class Asked:
    """A block of queries: its distinct known terms with their weights, and each query's terms as numbers of these."""

    terms: list[bytes]
    hashes: np.ndarray
    weights: np.ndarray
    #: Numbers of terms, query after query, and where each query's begin.
    uses: np.ndarray
    starts: np.ndarray
    #: Number of each query among the items of its block.
    items: np.ndarray
    n_docs: int
    n_terms: int

    def length_part(self, n: np.ndarray) -> np.ndarray:
        return 100 - 75 + (75 * n * self.n_docs) // self.n_terms

    def bounds(self, found: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Upper bound of the score of each text (rows of ``found``, sketches of one size) for each query."""
        first, second = _coordinates(self.hashes, found.shape[1])
        frequencies = np.minimum(found[:, first], found[:, second])
        impacts = _impact(np.arange(256)[None, :], self.length_part(n)[:, None])
        impacts[:, FULL] = MOST
        parts = np.take_along_axis(impacts, frequencies.astype(np.intp), axis=1) * self.weights
        return np.add.reduceat(parts[:, self.uses], self.starts, axis=1)

    def score(self, words: list[bytes], wanted: list[int]) -> list[int]:
        """Exact score of a text for the queries of the given numbers."""
        counts = Counter(words)
        m = int(self.length_part(np.int64(len(words))))
        ends = np.append(self.starts[1:], len(self.uses))
        scores = []
        for q in wanted:
            total = 0
            for use in self.uses[self.starts[q] : ends[q]].tolist():
                if tf := counts.get(self.terms[use]):
                    total += int(self.weights[use]) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            scores.append(total)
        return scores


def _impact(frequency: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * frequency // (1000 * frequency + 8 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _asked(index: DataFrame, queries: list[list[bytes]], n_docs: int, n_terms: int) -> Asked:
    """Terms that no document holds are left out, and queries that have no other."""
    terms = sorted(set().union(*queries))
    _, hashes, _ = hashed_terms([t for t in terms])
    block = index.sparkSession.createDataFrame([(h,) for h in hashes.view(np.int64).tolist()], "term long")
    counts = index.where("terms is not null").select(F.explode(F.arrays_zip("terms", "docs")).alias("of")).select("of.terms", "of.docs")
    counts = counts.join(F.broadcast(block), F.col("terms") == F.col("term")).groupBy("term").agg(F.sum("docs").alias("df"))
    df = {r.term: r.df for r in counts.collect()}
    known = [i for i, h in enumerate(hashes.view(np.int64).tolist()) if h in df]
    place = {terms[i]: at for at, i in enumerate(known)}
    weights = [weight(n_docs, df[int(hashes.view(np.int64)[i])]) for i in known]
    uses, starts, items = [], [], []
    for number, words in enumerate(queries):
        own = [place[w] for w in words if w in place]
        if own:
            starts.append(len(uses))
            items.append(number)
            uses += own
    return Asked([terms[i] for i in known], hashes[known], np.array(weights, np.int64), np.array(uses, np.int64), np.array(starts, np.int64), np.array(items, np.int64), n_docs, n_terms)


def _bounds(batches: Iterator[pa.RecordBatch], asked: Asked) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of documents with their bounds (document by query); documents with sketches of one size at a time."""
    most = max(1, (1 << 21) // max(1, len(asked.uses)))
    for batch in batches:
        kept = batch.column("sketch").to_pylist()
        sizes = np.array([len(s) for s in kept])
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            for start in range(0, len(rows), most):
                some = rows[start : start + most]
                found = np.frombuffer(b"".join(kept[i] for i in some), np.uint8).reshape(len(some), -1)
                n = batch.column("n").to_numpy()[some]
                yield batch.take(pa.array(some)), asked.bounds(found, n)


def _foremost(found: DataFrame, asked: Asked, slice_: int) -> DataFrame:
    """The ``slice_`` documents with the highest bounds of each query."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(asked.items)
        best = np.zeros((count, slice_), np.int64)
        docs, marks = np.zeros_like(best), np.zeros_like(best)
        for part, bounds in _bounds(batches, asked):
            every = np.concatenate((best, bounds.T), axis=1)
            top = np.argpartition(-every, slice_ - 1, axis=1)[:, :slice_]
            ids = [np.concatenate((held, np.broadcast_to(part.column(c).to_numpy(), bounds.T.shape)), axis=1) for c, held in (("doc_id", docs), ("mark", marks))]
            best, docs, marks = (np.take_along_axis(x, top, axis=1) for x in (every, *ids))
        query, place = np.nonzero(best)
        columns = (query, docs[query, place], marks[query, place], best[query, place])
        schema = schema_of(BOUND)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    ranked = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id")
    return found.mapInArrow(rows, BOUND).withColumn("_place", F.row_number().over(ranked)).where(F.col("_place") <= slice_).drop("_place")


def _reaching(found: DataFrame, asked: Asked, thresholds: np.ndarray) -> DataFrame:
    """All documents whose bound comes up to the query's threshold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(BOUND)
        for part, bounds in _bounds(batches, asked):
            row, query = np.nonzero(bounds >= thresholds)
            columns = (query, *(part.column(c).to_numpy()[row] for c in ("doc_id", "mark")), bounds[row, query])
            for start in range(0, len(row), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[start : start + (1 << 16)], f.type) for c, f in zip(columns, schema)], schema=schema)

    return found.mapInArrow(rows, BOUND)


def _rescored(docs: DataFrame, reached: DataFrame, asked: Asked, k: int) -> DataFrame:
    """``item, doc_id, score`` of the documents reached, each text scored once for all queries that reached it.

    Documents of one text have one score, so a query needs the ``k`` smallest ids of each text only.
    """
    of_text = Window.partitionBy("item", "mark").orderBy("doc_id")
    reached = settle(reached.withColumn("_place", F.row_number().over(of_text)).where(F.col("_place") <= k).drop("_place"))
    wanted = settle(reached.groupBy("mark").agg(F.min("doc_id").alias("_doc"), F.collect_set("item").alias("items")).withColumnRenamed("mark", "_mark"))
    held = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("mark"))
    rows = wanted.agg(F.sum(F.size("items"))).first()[0] or 0
    wanted = F.broadcast(wanted) if rows <= BROADCAST_ROWS else wanted.hint("merge")
    met = held.join(wanted, (F.col("doc_id") == F.col("_doc")) & (F.col("mark") == F.col("_mark"))).select("mark", "text", "items")

    def score(batch: pa.RecordBatch) -> dict:
        out = []
        for mark, text, items in zip(batch.column("mark").to_pylist(), texts(batch), batch.column("items").to_pylist()):
            out += [(item, mark, s) for item, s in zip(items, asked.score(terms_of(text), items))]
        columns = list(zip(*out)) or [[]] * 3
        return dict(zip(("_item", "_mark", "score"), columns))

    # Repeated rows bring a text twice.
    scores = settle(per_batch(met, score, "_item int, _mark long, score long").distinct())
    same = (F.col("item") == F.col("_item")) & (F.col("mark") == F.col("_mark"))
    return reached.join(scores, same).where("score > 0").select("item", "doc_id", "score")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, first: int = FIRST) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of all ``docs`` for each row of ``items``.

    A document's score for an item sums weight times impact over the item's terms, repeats included. Scores of 0 are not
    ranked; equal scores rank by ``doc_id``. Null and empty texts have no term: such documents count nowhere and such
    items get no rows. Rows without a ``doc_id`` count in the statistics but are not ranked; repeated rows are ranked each. Rows
    of ``items`` are answered one by one, also under one ``item_id`` or none. Other columns are not looked at. Terms are counted by 64-bit hashes
    and scored by their letters.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    facts = index.where("sketch is not null").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    size = items.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not facts.docs or not size.bytes:
        return empty
    blocks = max(-(-size.rows // BLOCK_ITEMS), -(-size.bytes // BLOCK_BYTES))
    found = index.where("sketch is not null and doc_id is not null").select("doc_id", "mark", "n", "sketch")
    answers = empty
    for block in range(blocks):
        rows = items.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        queries = [terms_of((r.text or "").encode()) for r in rows]
        asked = _asked(index, queries, facts.docs, facts.terms) if any(queries) else None
        if asked is None or not len(asked.items):
            continue
        leading = _best(_rescored(docs, _foremost(found, asked, max(first, k)), asked, k), k).where(F.col("rank") == k)
        thresholds = np.ones(len(asked.items), np.int64)
        for row in leading.select("item", "score").collect():
            thresholds[row.item] = row.score
        best = _best(_rescored(docs, _reaching(found, asked, thresholds), asked, k), k)
        names = spark.createDataFrame([(q, rows[i].item_id) for q, i in enumerate(asked.items.tolist())], "_item int, item_id long")
        named = best.join(F.broadcast(names), F.col("item") == F.col("_item"))
        answers = answers.unionByName(named.select("item_id", "rank", "doc_id", "score"))
    return answers


#: The same ranking over all pairs of item and document that share a term.
RANKED_SQL = """
WITH doc_terms AS (
  SELECT doc_id, rid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS rid FROM documents)
), tfs AS (SELECT doc_id, rid, term, count(*) AS tf FROM doc_terms GROUP BY ALL
), lengths AS (SELECT rid, sum(tf)::BIGINT AS n FROM tfs GROUP BY rid
), facts AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), facts
), items AS (
  SELECT row_number() OVER () AS item, item_id, text FROM benchmark
), asked AS (
  SELECT item, term, count(*) AS times FROM (
    SELECT item, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM items
  ) GROUP BY ALL
), scores AS (
  SELECT item, rid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (rid), facts
  WHERE doc_id IS NOT NULL GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked JOIN items USING (item) WHERE rank <= 10
"""
