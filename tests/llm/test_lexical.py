"""Ranked lexical search against a plain scoring of every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import TABLES, connect, differences
from llm_cases import CLASHING, prose

from evenstep.llm import lexical
from evenstep.llm.lexical import hashed_terms, search, sketches, terms_of
from evenstep.llm.queries import LLM_ORACLES, LLM_QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=10):
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(term for _, c, _ in counts for term in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in counts:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = 0
            for term in plain_terms(text):
                if tf := c[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * (1000000000 * tf // (1000 * tf + 8 * m))
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def answered(spark, docs, items, **options):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(map(tuple, search(frame, spark.createDataFrame(items, ITEMS), **options).collect()), key=str)


@pytest.mark.parametrize("text", ["", "Äb C1_d-É 日本 x\x7fy\x80z", "a.B!c", "\x00\n\t", "  one  ONE one"])
def test_terms(text):
    assert [t.decode() for t in terms_of(text.encode())] == plain_terms(text)


def test_long_texts_are_hashed_in_pieces_alike(monkeypatch):
    found = [prose(i, 300).encode() for i in range(4)] + [b"", None, b"x" * 500, b". " * 300]
    whole = hashed_terms(found)
    monkeypatch.setattr(lexical, "PIECE", 97)
    for a, b in zip(whole, hashed_terms(found)):
        assert (a == b).all()
    counts = Counter(terms_of(found[0]))
    assert sorted(whole[2][whole[0] == 0]) == sorted(counts.values())


def test_a_sketch_bounds_every_frequency():
    found = [(prose(i, 400) + " z" * i * 100).encode() for i in range(5)]
    of, hashes, frequencies = hashed_terms(found)
    made = sketches(of, hashes, frequencies, len(found))
    for i, sketch in enumerate(made):
        first, second = lexical._coordinates(hashes[of == i], len(sketch))
        bound = np.minimum(sketch[first], sketch[second])
        assert (bound >= np.minimum(frequencies[of == i], lexical.FULL)).all()
        assert len(sketch) >= lexical.ROOM * (of == i).sum()


def test_random_texts(spark):
    draw = random.Random(5)
    texts = [prose(draw.randint(0, 60), draw.choice([1, 5, 40, 300])) for _ in range(150)]
    docs = list(enumerate(texts)) + [(200, None), (201, ""), (202, "...."), (None, texts[0])]
    items = [(i, prose(i, 20)) for i in range(25)] + [(30, None), (31, ""), (32, "unheard of words"), (None, texts[3]), (30, texts[4])]
    assert answered(spark, docs, items) == plain_search(docs, items)


@pytest.mark.parametrize("first, room", [(1, 1), (3, 8)])
def test_loose_bounds_change_nothing(spark, monkeypatch, first, room):
    monkeypatch.setattr(lexical, "ROOM", room)
    monkeypatch.setattr(lexical, "FEWEST", 4)
    docs = [(i, prose(i % 40, 30) + " " + prose(i, 30)) for i in range(120)]
    items = [(i, prose(i, 15)) for i in range(8)]
    assert answered(spark, docs, items, k=3, first=first) == plain_search(docs, items, 3)


def test_ties_copies_and_repeated_rows(spark):
    docs = [(i, "same words here") for i in range(50, 0, -1)] + [(7, "same words here"), (90, "other"), (91, "same")]
    items = [(1, "same words"), (1, "same words"), (2, "words words words")]
    assert answered(spark, docs, items) == plain_search(docs, items)


def test_frequencies_beyond_a_coordinate(spark):
    docs = [(i, "rare " * n + "filler " * 50) for i, n in enumerate([1, 254, 255, 256, 1000, 3000])] + [(9, "filler")] * 3
    items = [(0, "rare filler"), (1, "rare rare")]
    assert answered(spark, docs, items, k=2, first=2) == plain_search(docs, items, 2)


def test_shuffled_texts_and_several_blocks(spark, monkeypatch):
    docs = [(i, prose(i, 60)) for i in range(80)]
    items = [(i, prose(i, 10)) for i in range(12)]
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 5)
    assert answered(spark, docs, items) == plain_search(docs, items)


def test_empty_tables_and_clashing_columns(spark, documents):
    items = spark.createDataFrame([(1, "ka lo")], ITEMS)
    assert search(documents([]), items).count() == 0
    assert search(documents(["ka", "lo mi"]), items.limit(0)).count() == 0
    assert search(documents([None, ""]), items).count() == 0
    clashing = items.withColumnRenamed("item_id", "item_id").selectExpr("*", "'x' as mark", "5 as rank", "1 as doc_id")
    got = search(documents(["ka", "lo mi", "ne"], CLASHING), clashing).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 0), (1, 2, 1)]


def test_whole_tables_equal_their_sql(spark):
    got = LLM_QUERIES["op13_lexical_search"](spark, str(TABLES / "sf0.01")).toPandas()
    assert differences(got, connect("sf0.01").execute(LLM_ORACLES["op13_lexical_search"]).df()) is None
