"""Quality scores learned from preferences: a Bradley-Terry model of pairs of documents.

A document has a vector of measures. For a pair of a better and a worse document the chance that the better
one wins is the logistic curve of the difference of their scores, so the weights come from logistic loss on
differences of measures. A quantile of the scores of labelled documents is the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from evenstep.llm.common import mixed, per_batch, remainder, schema_of, span_hashes, texts
from evenstep.sources.storage import settle

THRESHOLD = 0.3
#: Cells of hashed word forms, beside the plain measures.
SHAPES = 32
#: Cells of scores in a round towards a quantile, and rows among which it is looked up.
CELLS = 4096
_KIND = np.zeros(256, np.uint8)
# Byte kinds: 0 other, 1 white space, 2 lower case, 3 upper case, 4 digit, 5 beyond ASCII, 6 symbol, 7 mark.
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[97:123] = 2
_KIND[65:91] = 3
_KIND[48:58] = 4
_KIND[128:] = 5
_KIND[[ord(c) for c in "#*$%&|<>@\\^~=+_{}[]/"]] = 6
_KIND[[ord(c) for c in "!?.,;:'\"()-"]] = 7


def _share(part: float, whole: float) -> float:
    return float(part) / float(whole) if whole else 0.0


def measures(text: bytes | None) -> np.ndarray:
    """Measures of the whole text; all zero but for a flag when it has no word."""
    data = np.frombuffer(b" " + (text or b"") + b" ", np.uint8)
    kinds = _KIND[data]
    gap = kinds == 1
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    n = len(starts)
    out = np.zeros(13 + SHAPES, np.float32)
    if not n:
        out[0] = 1.0
        return out
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    size = int((ends - starts).sum())
    tally = np.bincount(kinds, minlength=8)
    words = span_hashes(data, starts, ends)
    distinct = len(np.unique(words))
    lines = [line for line in text.split(b"\n") if line.strip()]
    firsts, lasts = kinds[starts], kinds[ends - 1]
    out[1:13] = (
        np.log1p(n),
        np.log1p(size / n),
        _share(tally[3], tally[2] + tally[3] + tally[5]),
        _share(tally[6], size),
        _share(tally[7], size),
        _share(tally[4], size),
        _share((words[1:] == words[:-1]).sum(), n),
        1 - distinct / n,
        1 - _share(len(set(lines)), len(lines)),
        _share((lasts == 6).sum(), n),
        _share((data == ord("!")).sum(), n),
        np.log1p(n / max(len(lines), 1)),
    )
    # Forms: kind of the first, last and last but one byte, hashed; a share of the words each.
    before = kinds[np.maximum(ends - 2, starts)]
    forms = firsts.astype(np.uint64) * np.uint64(64) + before * np.uint64(8) + lasts
    out[13:] = np.bincount((mixed(forms) >> np.uint64(59)).astype(np.int64), minlength=SHAPES) / n
    return out


@dataclass(frozen=True)
class QualityModel:
    """Weights on standardised measures; ``threshold`` is a score, ``steepness`` the curve around it."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    steepness: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.centre) / self.spread) @ self.weights

    def calibrated(self, rows: np.ndarray) -> np.ndarray:
        """Scores moved to 0..1 so that THRESHOLD falls on the threshold."""
        x = self.steepness * (self.scores(rows) - self.threshold) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _rows(batch: pa.RecordBatch, name: str = "measures") -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), np.float32).reshape(batch.num_rows, -1).astype(float)


def _total(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``part``, an array of ``size`` numbers, over all batches of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], schema=schema_of("at int, value double"))

    out = np.zeros(size)
    for at, value in rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value")).collect():
        out[at] = value
    return out


def _numbered(taught: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``taught`` with ``at``, a row's number from 0 among those of its label by ``doc_id``, and the rows of each label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {0: 0, 1: 0}
        for batch in batches:
            quality = batch.column("quality").to_numpy()
            place = np.zeros(len(quality), np.int64)
            for label in (0, 1):
                own = np.flatnonzero(quality == label)
                place[own] = seen[label] + np.arange(len(own))
                seen[label] += len(own)
            columns = [pa.array(np.full(len(quality), part), pa.int32()), batch.column("quality"), pa.array(place), batch.column("measures")]
            yield pa.RecordBatch.from_arrays(columns, schema=schema_of(ddl))

    ddl = "part int, quality int, place long, measures binary"
    ordered = taught.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "measures")
    placed = settle(ordered.mapInArrow(count, ddl))
    counts = placed.groupBy("quality", "part").count().orderBy("part").collect()
    sizes, before = {0: 0, 1: 0}, []
    for quality, part, n in counts:
        before.append((quality, part, sizes[quality]))
        sizes[quality] += n
    offsets = taught.sparkSession.createDataFrame(before, "quality int, part int, before long")
    numbered = placed.join(F.broadcast(offsets), ["quality", "part"])
    return numbered.select("quality", (F.col("before") + F.col("place")).alias("at"), "measures"), sizes


def _pairs(numbered: DataFrame, sizes: dict[int, int], partners: int) -> DataFrame:
    """Differences of measures, better less worse: every document of the label with more is met by ``partners`` of the other.

    With ``longer`` documents of that label, step ``k`` pairs for every ``i`` below it the better document ``i + k * longer``
    and the worse one ``i + k * (longer + 1)``, each counted round its label.
    """
    longer = max(sizes.values())
    more = int(sizes[1] != longer)  # 0: the better ones are more or as many; 1: the worse ones are
    many, few = 1 - more, more
    k = F.explode(F.sequence(F.lit(0), F.lit(partners - 1)))
    step = longer + 1 if few == 0 else longer
    first = F.expr(f"pmod(at - k * {step}L, {sizes[few]}L)")
    i = F.explode(F.sequence(first, F.lit(longer - 1).cast("long"), F.lit(sizes[few]).cast("long")))
    met = F.col("i") if few == 0 else F.expr(f"pmod(i + k, {longer}L)")
    others = numbered.where(F.col("quality") == few).select("at", "measures", k.alias("k")).select("k", "measures", i.alias("i"))
    others = others.select(met.alias("at"), F.col("measures").alias("other"))
    both = numbered.where(F.col("quality") == many).join(others, "at").select("measures", "other")
    sign = 1 if many else -1

    def apart(batch: pa.RecordBatch) -> dict:
        return {"measures": [x.tobytes() for x in (sign * (_rows(batch) - _rows(batch, "other"))).astype(np.float32)]}

    return settle(per_batch(both, apart, "measures binary"))


def _bradley_terry(pairs: DataFrame, spread: np.ndarray, n: int, ridge: float) -> np.ndarray:
    """Newton steps on the logistic loss of ``n`` differences; a pair has no offset, since it cancels."""
    size = len(spread)
    w = np.zeros(size)
    for _ in range(60):

        def part(batch: pa.RecordBatch, w: np.ndarray = w) -> np.ndarray:
            x = _rows(batch) / spread
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            return np.concatenate((x.T @ (1 - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()))

        sums = _total(pairs, part, size + size * size)
        slope = sums[:size] - ridge * n * w
        normal = sums[size:].reshape(size, size) + ridge * n * np.eye(size)
        step = np.linalg.solve(normal, slope)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _quantile(scored: DataFrame, mass: dict[int, float], target: float) -> float:
    """Mean of the score up to which the rows' ``mass`` comes to ``target`` and of the next one.

    ``scored`` has ``quality, score``. Counts in cells of the scores narrow the range down until few rows are left in it.
    """
    span = scored.agg(F.min("score"), F.max("score"), F.count(F.lit(1))).first()
    low, high, rows = span
    below, before, after = 0.0, None, None
    while rows > CELLS and low < high:
        # The last cell is that of the highest score alone, so that every round has two cells at least.
        cell = F.floor((F.col("score") - low) / (high - low) * CELLS)
        counts = [F.sum((F.col("quality") == c).cast("long")).alias(f"n{c}") for c in (0, 1)]
        inside = scored.where(F.col("score").between(low, high)).groupBy(cell.alias("cell"))
        cells = sorted(inside.agg(*counts, F.min("score").alias("low"), F.max("score").alias("high")).collect(), key=lambda r: r.low)
        upto = below + np.cumsum([mass[0] * r.n0 + mass[1] * r.n1 for r in cells])
        at = min(int(np.searchsorted(upto, target)), len(cells) - 1)
        if at:
            below, before = float(upto[at - 1]), cells[at - 1].high
        if at + 1 < len(cells):
            after = cells[at + 1].low
        low, high, rows = cells[at].low, cells[at].high, cells[at].n0 + cells[at].n1
    near = scored.where(F.col("score").between(low, high)).groupBy("score", "quality").count().collect()
    near.sort()
    upto = below + np.cumsum([mass[r.quality] * r["count"] for r in near])
    at = min(int(np.searchsorted(upto, target)), len(near) - 1)
    value, quality, n = near[at]
    # Of equal scores all but the last are followed by their like.
    last = below + sum(mass[r.quality] * r["count"] for r in near[:at]) + mass[quality] * (n - 1) < target
    if n > 1 and not last:
        return float(value)
    following = near[at + 1].score if at + 1 < len(near) else after
    if following is None:
        following = value if n > 1 else near[at - 1].score if at else before if before is not None else value
    return (float(value) + float(following)) / 2


def fit(docs: DataFrame, labels: DataFrame, partners: int = 8, ridge: float = 1e-3) -> QualityModel | None:
    """Fit on ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, quality``: 1 better, 0 worse; others teach nothing).

    Every labelled document counts. Those of the label with more are each paired with ``partners`` of the other, met by
    stepping through it, so pairs grow with the documents and never are all pairs. None when a label is missing. The
    threshold is the quantile of the labelled scores at the share of worse documents among all labels.
    """
    labels = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    shares = {r.quality: r["count"] for r in labels.groupBy("quality").count().collect()}
    if len(shares) < 2:
        return None

    def measured(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "measures": [measures(t).tobytes() for t in texts(batch)]}

    # Measures are far shorter than the texts, so these are what is joined.
    known = per_batch(docs.where("doc_id is not null").select("doc_id", "text"), measured, "doc_id long, measures binary")
    numbered, sizes = _numbered(settle(known.join(labels, "doc_id")))
    if not sizes[0] or not sizes[1]:
        return None
    n, size = sum(sizes.values()), 13 + SHAPES
    centre = _total(numbered, lambda batch: _rows(batch).sum(axis=0), size) / n
    spread = np.sqrt(_total(numbered, lambda batch: ((_rows(batch) - centre) ** 2).sum(axis=0), size) / n)
    spread[spread < 1e-6] = 1.0
    weights = _bradley_terry(_pairs(numbered, sizes, partners), spread, partners * max(sizes.values()), ridge)
    model = QualityModel(centre, spread, weights, 0.0, 1.0)
    answer = lambda batch: {"quality": batch.column("quality"), "score": model.scores(_rows(batch))}
    scored = settle(per_batch(numbered, answer, "quality int, score double"))
    # Each label has its share of all labelled rows, also of those without a document.
    return replace(model, threshold=_quantile(scored, {c: shares[c] / sizes[c] for c in (0, 1)}, shares[0]))


def _answers(batch: pa.RecordBatch, model: QualityModel | None) -> np.ndarray:
    rows = np.array([measures(t) for t in texts(batch)], float)
    return model.calibrated(rows) if model else np.full(len(rows), 0.5)


def score(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """``doc_id, score`` for every row of ``docs``; 0.5 throughout when nothing was learned.

    A text that is null or has no word is scored by that alone; a null ``doc_id`` is carried along; repeated
    rows are scored alike. Only ``doc_id`` and ``text`` are looked at.
    """

    def answer(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": _answers(batch, model)}

    return per_batch(docs.select("doc_id", "text"), answer, "doc_id long, score double")


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> QualityModel | None:
    """Fit on the labels whose crc32 remainder is not ``held``."""
    return fit(docs, labels.where(remainder(F.col("doc_id"), modulus) != held))


def held_out_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """Learn from labelled rows outside the held-out fold, score all rows, and mark the fold."""
    fold = remainder(F.col("doc_id"), modulus)
    return score(docs, learn(docs, labels, modulus, held)).select(
        "doc_id",
        F.coalesce(fold == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, unchanged; all rows when nothing was learned.

    Rows are judged where they are read, so nothing is joined back and repeated or keyless rows keep their own
    verdict.
    """
    model = learn(docs, labels)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_answers(batch, model) >= THRESHOLD))

    return docs.mapInArrow(choose, docs.schema)
