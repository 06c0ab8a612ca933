"""Language identification with a string kernel, Nystroem landmarks and kernel ridge regression.

The kernel is a blended spectrum: a text is the set of its letter n-grams of several lengths (presence, not
counts), hashed into a fixed number of cells, and two texts are as similar as the cosine of their sets. Some
training texts are landmarks; the kernel against them, whitened, is the feature map on which one ridge
regression per language is fitted. Scoring is a product of batches of presence rows with the landmark matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenstep.llm.common import bounded_sample, per_batch, remainder
from evenstep.llm.pretokens import code_points, lower_letters

LENGTHS = (1, 2, 3)
CELLS = 1 << 14
UNDETERMINED = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def presence(text: str | None) -> np.ndarray | None:
    """Cells of the letter n-grams of the whole text; None without a letter."""
    if not text:
        return None
    letters = lower_letters(code_points(text))
    if not (letters != 32).any():
        return None
    cells = np.zeros(CELLS, bool)
    for n in LENGTHS:
        if len(letters) < n:
            break
        grams = np.full(len(letters) - n + 1, n, np.uint32)
        for k in range(n):
            grams += letters[k : len(letters) - n + 1 + k] * _FACTORS[k]
        grams ^= grams >> np.uint32(15)
        cells[(grams * _FACTORS[3]) >> np.uint32(32 - 14)] = True
    return cells


@dataclass(frozen=True)
class LanguageModel:
    """``score = k(text, landmarks) @ weights + offsets``; its size is set by the fit's bounds, not by the data."""

    languages: tuple[str, ...]
    landmarks: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """One-versus-rest answers, -1 to 1 in the main, for presence rows."""
        return _kernel(rows.astype(np.float32), self.landmarks) @ self.weights + self.offsets


def _kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    sizes = np.maximum(rows.sum(axis=1, keepdims=True), 1)
    return (rows @ landmarks.T) / np.sqrt(sizes * np.maximum(landmarks.sum(axis=1), 1))


def fit(labelled: DataFrame, per_language: int = 250, per_landmark: int = 32, ridge: float = 1e-3) -> LanguageModel | None:
    """Fit on ``doc_id, text, lang``.

    Bounds: at most ``per_language`` texts of each language are read (those with the smallest hash of
    ``doc_id``), of which ``per_landmark`` become landmarks. Rows without a language or a letter teach nothing;
    None when no row is left.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sample = bounded_sample(rows, "lang", "doc_id", per_language)

    def packed(batch: pa.RecordBatch) -> dict:
        found = [presence(t) for t in batch.column("text").to_pylist()]
        return {
            "doc_id": batch.column("doc_id"),
            "lang": batch.column("lang"),
            "cells": [None if f is None else np.packbits(f).tobytes() for f in found],
        }

    taught = per_batch(sample, packed, "doc_id long, lang string, cells binary").where("cells is not null").toPandas()
    if taught.empty:
        return None
    taught = taught.sort_values(["lang", "doc_id"], ignore_index=True)
    rows_of = np.unpackbits(np.frombuffer(b"".join(taught.cells), np.uint8).reshape(len(taught), -1), axis=1)
    rows_of = rows_of.astype(np.float32)
    languages = tuple(sorted(taught.lang.unique()))
    marks = np.concatenate([np.flatnonzero(taught.lang == lang)[:per_landmark] for lang in languages])
    landmarks = rows_of[marks]
    values, vectors = np.linalg.eigh(_kernel(landmarks, landmarks).astype(np.float64))
    solid = values > 1e-6 * values[-1]
    whiten = vectors[:, solid] / np.sqrt(values[solid])
    features = _kernel(rows_of, landmarks) @ whiten
    target = np.where(taught.lang.to_numpy()[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # A rare language weighs as much as a frequent one.
    weight = (1.0 / taught.lang.map(taught.lang.value_counts())).to_numpy(float)[:, None]
    weight *= len(taught) / weight.sum()
    centre = (features * weight).mean(axis=0)
    level = (target * weight).mean(axis=0)
    centred = (features - centre) * np.sqrt(weight)
    normal = centred.T @ centred + ridge * len(taught) * np.eye(features.shape[1])
    solved = np.linalg.solve(normal, centred.T @ ((target - level) * np.sqrt(weight)))
    return LanguageModel(
        languages, landmarks, (whiten @ solved).astype(np.float32), (level - centre @ solved).astype(np.float32)
    )


def identify(docs: DataFrame, model: LanguageModel | None, rows_at_once: int = 64) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs``.

    The score is the winning regression's answer moved to 0..1. A text that is null, empty or without a letter
    is ``und`` with score 0, and so is every text when nothing was learned. Equal scores go to the first
    language in order. A null ``doc_id`` is carried along; other columns are not looked at.
    """

    def predict(batch: pa.RecordBatch) -> dict:
        found = batch.column("text").to_pylist()
        langs, scores = [UNDETERMINED] * len(found), np.zeros(len(found))
        for start in range(0, len(found) if model else 0, rows_at_once):
            rows = [presence(t) for t in found[start : start + rows_at_once]]
            at = [i for i, row in enumerate(rows) if row is not None]
            if at:
                answer = model.scores(np.stack([rows[i] for i in at]))
                best = answer.argmax(axis=1)
                for i, k, value in zip(at, best, answer.max(axis=1)):
                    langs[start + i] = model.languages[k]
                    scores[start + i] = min(max((float(value) + 1) / 2, 0.0), 1.0)
        return {"doc_id": batch.column("doc_id"), "lang_pred": langs, "score": scores}

    return per_batch(docs.select("doc_id", "text"), predict, "doc_id long, lang_pred string, score double")


def held_out_identification(docs: DataFrame, **bounds: int) -> DataFrame:
    """Learn from rows whose crc32 remainder by 5 is not 0, predict all, and mark the rows held out."""
    fold = remainder(F.col("doc_id"), 5)
    model = fit(docs.where(fold != 0), **bounds)
    answer = identify(docs, model)
    return answer.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
