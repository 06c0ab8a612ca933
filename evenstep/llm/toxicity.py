"""Toxicity by comparing two class-conditional Kneser-Ney models.

Each class has an interpolated Kneser-Ney model of the bytes of words: the class's discounted counts of a byte after the
four before it, and for the mass set aside a backoff that both classes share, made of continuation counts (how many
different bytes an expression follows) and backing off in turn to shorter contexts. A rare or invented word is so told
by the stretches that it has in common with others, and its first byte by the end of the word before it, so that word
order counts. The difference of a word's log-likelihoods under both models is
what it says for toxicity; a document is judged by the mean over its words of what is clear of it.

A stretch of five bytes is a 40-bit number, so counts are tables of whole numbers, built and joined by Spark, which grow
with the labelled texts. Documents travel in compressed blocks; a block asks for each of its distinct stretches once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from evenstep.llm.common import bounded_sample, remainder, schema_of, texts
from evenstep.sources.storage import settle

#: Bytes of a stretch: the one that is told and the context before it.
ORDER = 5
DISCOUNT = 0.75
#: Of a word's difference only what is above this many nats counts.
CLEAR = 3.0
#: Bytes of text in a block, unless a single document has more.
BLOCK_BYTES = 16 << 20
#: Stretches that a task counts before it merges them.
MERGED = 1 << 20
#: Labelled documents that are sent to every task as ids; beyond that the texts are shuffled to their labels.
BROADCAST_LABELS = 2_000_000
THRESHOLD = 0.3
#: Contexts are asked for beside stretches, told apart by a high bit.
_CONTEXT = 1 << 62
_BLANK = 32
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else _BLANK for b in range(256))
_BLOCK = "block long, doc_ids array<long>, sizes array<long>, packed binary"
_FEATURES = "doc_id long, words long, clear double, told double"


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of letters, with A-Z in lower case."""
    return (text or b"").translate(_LETTERS).split()


def stretches(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of every word but its first, and the blank after it, each with the ``ORDER - 1`` before it in its word;
    and the word's number. Blanks stand before a word, as many as a context has.
    """
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gap = b" " * (ORDER - 1)
    data = np.frombuffer(gap + gap.join(words) + gap, np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    packed = np.zeros(len(data) - ORDER + 1, np.int64)
    for k in range(ORDER):
        packed |= data[k : k + len(packed)] << (8 * (ORDER - 1 - k))
    firsts = np.cumsum(lengths + ORDER - 1) - (lengths + ORDER - 1)
    number = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(number)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return packed[np.repeat(firsts + 1, lengths) + place], number


def edges(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word its end with the blank after it, as a context, and its first byte."""
    size = ORDER - 1
    tails = np.fromiter((int.from_bytes((w + b" ")[-size:].rjust(size), "big") for w in words), np.int64, len(words))
    return tails, np.fromiter((w[0] for w in words), np.int64, len(words))


def joints(text: np.ndarray, tails: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The first byte of each word of a text (by the words' numbers) after the end of the word before it, or after blanks."""
    start = int.from_bytes(b" " * (ORDER - 1), "big")
    return np.concatenate(([start], tails[text[:-1]]))[: len(text)] << 8 | heads[text]


def _summed(gram: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    new = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    return gram[new], np.add.reduceat(counts[order], new, axis=0)


def counted(labelled: DataFrame) -> DataFrame:
    """``gram, n0, n1``: occurrences of each stretch by class over all rows of ``text, toxic``.

    A task sends each of its distinct stretches about once.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("gram long, n0 long, n1 long")
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                number: dict[bytes, int] = {}
                found = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int64) for t in texts(part)]
                if not number:
                    continue
                words, edge = list(number), edges(list(number))
                toxic = np.repeat(part.column("toxic").to_numpy(), [len(f) for f in found])
                by_class = np.zeros((len(words), 2), np.int64)
                np.add.at(by_class, (np.concatenate(found), toxic), 1)
                gram, word = stretches(words)
                joint = np.concatenate([joints(f, *edge) for f in found])
                once = np.eye(2, dtype=np.int64)[toxic]
                held.append(_summed(np.concatenate((gram, joint)), np.concatenate((by_class[word], once))))
            if sum(len(g) for g, _ in held) > MERGED:
                held = [_summed(*map(np.concatenate, zip(*held)))]
        if held:
            gram, counts = _summed(*map(np.concatenate, zip(*held)))
            for at in range(0, len(gram), 1 << 16):
                columns = (gram[at : at + (1 << 16)], *counts[at : at + (1 << 16)].T)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    found = labelled.select("text", "toxic").mapInArrow(rows, "gram long, n0 long, n1 long")
    return found.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _context(gram: str) -> Column:
    return F.shiftright(gram, 8)


def _suffix(gram: str, size: int) -> Column:
    """The last ``size`` bytes."""
    return F.col(gram).bitwiseAND(F.lit((1 << (8 * size)) - 1))


def shared_backoff(grams: DataFrame) -> DataFrame:
    """``part, p``: Kneser-Ney probability of a byte after a context shorter by one than that of ``grams``, for both classes.

    Probabilities are of continuations: an expression counts once for each byte that it follows.
    """
    levels = []
    part = grams.select("gram")
    for size in range(ORDER - 1, 0, -1):
        part = settle(part.groupBy(_suffix("gram", size).alias("gram")).agg(F.count(F.lit(1)).alias("follows")))
        levels.append((size, part))
    lower = None
    for size, part in reversed(levels):
        totals = part.groupBy(_context("gram").alias("context")).agg(F.sum("follows").alias("all"), F.count(F.lit(1)).alias("kinds"))
        known = part.join(totals, _context("gram") == F.col("context"))
        below = F.lit(1 / 256)
        if lower is not None:
            known, below = known.join(lower, _suffix("gram", size - 1) == F.col("part")), F.col("p")
        p = (F.greatest(F.col("follows") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * below) / F.col("all")
        lower = settle(known.select(F.col("gram").alias("_part"), p.alias("_p")).toDF("part", "p"))
    return lower


def log_ratios(grams: DataFrame) -> DataFrame:
    """``key, value``: log-ratio of a byte under the toxic and the ordinary class, of stretches and of contexts.

    A stretch never seen backs off in both classes to the same probability, so after a known context only the masses set
    aside differ; that is the context's value.
    """
    sums = [F.sum(f"n{c}").alias(f"all{c}") for c in (0, 1)]
    kinds = [F.count_if(F.col(f"n{c}") > 0).alias(f"kinds{c}") for c in (0, 1)]
    contexts = settle(grams.groupBy(_context("gram").alias("context")).agg(*sums, *kinds))

    def aside(c: int) -> Column:
        return F.when(F.col(f"all{c}") > 0, DISCOUNT * F.col(f"kinds{c}") / F.col(f"all{c}")).otherwise(1.0)

    def likely(c: int) -> Column:
        own = F.when(F.col(f"all{c}") > 0, F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"all{c}")).otherwise(0.0)
        return own + aside(c) * F.col("p")

    met = grams.join(contexts, _context("gram") == F.col("context")).join(shared_backoff(grams), _suffix("gram", ORDER - 1) == F.col("part"))
    seen = met.select(F.col("gram").alias("key"), F.log(likely(1) / likely(0)).alias("value"))
    backs = contexts.select((F.col("context") + _CONTEXT).alias("key"), F.log(aside(1) / aside(0)).alias("value"))
    return seen.unionByName(backs)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents' words packed into blocks, ``BLOCK_BYTES`` of them or a single document."""
    number = TaskContext.get().partitionId() << 32
    schema = schema_of(_BLOCK)
    doc_ids: list = []
    sizes: list[int] = []
    press, packed = zstandard.ZstdCompressor(level=3).compressobj(), []

    def block() -> pa.RecordBatch:
        row = (number, doc_ids, sizes, b"".join([*packed, press.flush()]))
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts(part)):
                plain = b" ".join(words_of(text))
                if doc_ids and sum(sizes) + len(plain) > BLOCK_BYTES:
                    yield block()
                    number, doc_ids, sizes = number + 1, [], []
                    press, packed = zstandard.ZstdCompressor(level=3).compressobj(), []
                doc_ids.append(doc_id)
                sizes.append(len(plain))
                packed.append(press.compress(plain))
    if doc_ids:
        yield block()


@dataclass(frozen=True)
class Opened:
    """The texts of a block as stretches: distinct ones and contexts, and which of them words and texts are made of."""

    distinct: np.ndarray
    contexts: np.ndarray
    #: Stretches of the distinct words by number, and the word of each.
    number: np.ndarray
    word: np.ndarray
    #: Words of each text by number, and the joints of all texts, one after the other, by number.
    texts: list[np.ndarray]
    joint: np.ndarray


def _opened(packed: bytes, sizes: list[int]) -> Opened:
    data, at = zstandard.ZstdDecompressor().decompressobj().decompress(packed), 0
    number: dict[bytes, int] = {}
    found = []
    for size in sizes:
        words = data[at : at + size].split()
        found.append(np.array([number.setdefault(w, len(number)) for w in words], np.int32))
        at += size
    words, edge = list(number), edges(list(number))
    gram, word = stretches(words)
    joint = np.concatenate([joints(f, *edge) for f in found])
    distinct = np.union1d(gram, joint)
    return Opened(distinct, np.unique(distinct >> 8), np.searchsorted(distinct, gram), word, found, np.searchsorted(distinct, joint))


def features(docs: DataFrame, ratios: DataFrame) -> DataFrame:
    """``doc_id, words, clear, told`` for every row of ``docs``: number of words, mean of what is clear of a word's
    difference of log-likelihoods, and mean of the whole difference; zeros without a word.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("of long, place int, asked long")
        for batch in batches:
            for block, sizes, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "sizes", "packed"))):
                block_of = _opened(packed, sizes)
                keys = np.concatenate((block_of.distinct, block_of.contexts + _CONTEXT))
                for at in range(0, len(keys), 1 << 16):
                    part = keys[at : at + (1 << 16)]
                    columns = (np.full(len(part), block), np.arange(at, at + len(part)), part)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def judge(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        schema = schema_of(_FEATURES)
        if not blocks.num_rows:
            return schema.empty_table()
        row = blocks.to_pylist()[0]
        own = _opened(row["packed"], row["sizes"])
        n = len(own.distinct)
        value = np.full(n + len(own.contexts), np.nan)
        value[answers.column("place").to_numpy()] = answers.column("value").to_numpy()
        back = value[n + np.searchsorted(own.contexts, own.distinct >> 8)]
        ratio = np.where(np.isnan(value[:n]), np.nan_to_num(back), value[:n])
        lengths = np.array([len(f) for f in own.texts])
        inside = np.bincount(own.word, ratio[own.number])
        told = inside[np.concatenate(own.texts)] + ratio[own.joint] if len(inside) else np.zeros(0)
        of = np.repeat(np.arange(len(lengths)), lengths)
        sums = [np.bincount(of, x, minlength=len(lengths)) for x in (np.maximum(told - CLEAR, 0), told)]
        columns = (row["doc_ids"], lengths, *(x / np.maximum(lengths, 1) for x in sums))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    blocks = docs.select("doc_id", "text").mapInArrow(_blocks, _BLOCK).repartition("block")
    asked = blocks.mapInArrow(ask, "of long, place int, asked long")
    answers = asked.join(ratios.hint("merge"), F.col("asked") == F.col("key")).select("of", "place", "value")
    return blocks.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(judge, _FEATURES)


def _curve() -> list[Column]:
    """What the logistic curve sees of a document."""
    return [F.col("clear") * 10.0, F.log1p(F.col("words").cast("double")), F.log1p(F.col("clear") * F.col("words"))]


@dataclass(frozen=True)
class ToxicityModel:
    """``ratios`` of stretches and contexts as a stored table; weights of the logistic curve, the offset last."""

    ratios: DataFrame
    weights: np.ndarray

    def scored(self, found: DataFrame) -> DataFrame:
        """``doc_id, score`` from ``features``."""
        total = F.lit(float(self.weights[-1]))
        for weight, column in zip(self.weights, _curve()):
            total = total + float(weight) * column
        return found.select("doc_id", (1 / (1 + F.exp(-total))).alias("score"))


def _logistic(x: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Damped Newton steps for a small logistic regression; the last weight is the offset."""
    x = np.column_stack([x, np.ones(len(x))])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - labels @ z + ridge * w @ w / 2)

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (labels - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-8:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learned(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log-ratios from all labels but one in eight, by a hash of ``doc_id``; and those set aside for the curve.

    Labels other than 0 and 1 teach nothing. A document with several labels counts once for each.
    """
    labels = settle(labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")))
    aside = F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(8)) == 0
    taught = labels.where(~aside)
    # Ids are small beside texts: as long as they are few enough, they go to the texts.
    taught = F.broadcast(taught) if taught.count() <= BROADCAST_LABELS else taught.hint("merge")
    grams = settle(counted(docs.select("doc_id", "text").join(taught, "doc_id")))
    return settle(log_ratios(grams)), labels.where(aside)


def fitted_curve(found: DataFrame, aside: DataFrame, per_class: int = 4000) -> np.ndarray:
    """Weights of the curve from at most ``per_class`` documents of either label in ``aside`` and their ``features``.

    Without labels of both kinds all weights are 0, so every score is 0.5. The offset is set for the labels as
    they occur, since the sample may even out the classes.
    """
    sample = bounded_sample(aside, "toxic", "doc_id", per_class)
    rows = found.join(F.broadcast(sample), "doc_id").select("toxic", F.array(*_curve()).alias("x")).collect()
    y = np.array([r.toxic for r in rows], float)
    if len(set(y.tolist())) < 2:
        return np.zeros(len(_curve()) + 1)
    weights = _logistic(np.array([r.x for r in rows], float), y)
    shares = {r["toxic"]: r["count"] for r in aside.groupBy("toxic").count().collect()}
    kept = {c: (y == c).sum() for c in (0, 1)}
    weights[-1] += np.log(shares[1] / kept[1]) - np.log(shares[0] / kept[0])
    return weights


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> ToxicityModel:
    """Fit on ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``)."""
    ratios, aside = learned(docs, labels)
    sample = bounded_sample(aside, "toxic", "doc_id", per_class).select("doc_id").distinct()
    found = settle(features(docs.join(F.broadcast(sample), "doc_id", "left_semi"), ratios))
    return ToxicityModel(ratios, fitted_curve(found, aside, per_class))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` for every row of ``docs``.

    A text without a word (null, empty, no letters) has no likelihood to compare and gets the curve's answer
    at difference 0. A null ``doc_id`` is carried along; repeated rows are scored alike, other columns are not
    looked at; an empty table gives no rows.
    """
    return model.scored(features(docs, model.ratios))


def held_out_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held: int = 2) -> DataFrame:
    """Learn from labelled rows whose crc32 remainder is not ``held``, score all, and mark the rows held out."""
    fold: Column = remainder(F.col("doc_id"), modulus)
    ratios, aside = learned(docs, labels.where(fold != held).select("doc_id", F.col(label).alias("toxic")))
    # One pass over all texts serves the curve as well.
    found = settle(features(docs, ratios))
    model = ToxicityModel(ratios, fitted_curve(found, aside))
    return model.scored(found).select(
        "doc_id",
        F.coalesce(fold == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
