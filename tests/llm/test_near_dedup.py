"""Near-duplicates against every pair of shingle sets."""

from __future__ import annotations

import random

import numpy as np
import pytest

from evenstep.llm.common import mixed, shingles_at
from evenstep.llm.components import components
from evenstep.llm.near_dedup import BANDS, ROWS, near_duplicates, sketch, without_near_duplicates
from llm_cases import CLASHING, prose


def brute_force(rows):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        found = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        sets.setdefault(i, []).append(found)
    roots = {i: i for i in sets}

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((find(a), find(b)))
                roots[high] = low
    return {i: find(i) for i in ids}


def edited(text, n, seed):
    words, draw = text.split(" "), random.Random(seed)
    for at in draw.sample(range(len(words)), n):
        words[at] = f"w{seed}x{at}"
    return " ".join(words)


def test_sketches_agree_as_often_as_sets_overlap():
    draw = np.random.default_rng(3)
    shared, a, b = (mixed(draw.integers(0, 2**63, n, dtype=np.uint64)) for n in (600, 100, 100))
    first, second = sketch(np.concatenate([shared, a])), sketch(np.concatenate([shared, b]))
    assert abs((first == second).mean() - 0.75) < 0.12
    tiny = sketch(shared[:1])
    assert (tiny < np.iinfo(np.uint64).max).all() and BANDS * ROWS <= len(tiny)


def test_shingle_hashes_follow_words():
    assert (shingles_at(b"A b\tC d e F") == shingles_at(b" a  B c D\ne f ")).all()
    assert len(shingles_at(b"one two")) == 1 and len(shingles_at(b" \n ")) == 0 and len(shingles_at(None)) == 0


@pytest.mark.parametrize("schema", [None, CLASHING])
def test_components_equal_brute_force(documents, schema):
    base = [prose(s, 120) for s in range(6)]
    texts = list(base)
    texts += [edited(base[0], n, n) for n in (1, 2, 3, 4, 5, 6)]
    texts += [edited(base[1], 3, 100 + s) for s in range(30)]
    texts += [base[2]] * 25 + [base[2].upper()]
    texts += [None, "", "  \n ", "one", "one", "ONE", "two words", "two  words"]
    texts += [prose(9, 8000), edited(prose(9, 8000), 100, 5)]
    rows = list(enumerate(texts)) + [(900, base[3]), (900, base[4]), (3, base[3]), (None, base[0])]
    frame = documents(rows, **({"schema": schema} if schema else {}))
    found = near_duplicates(frame).collect()
    assert len(found) == len(rows)
    expected = brute_force([r for r in rows if r[0] is not None])
    for r in found:
        assert r.component_id == (None if r.doc_id is None else expected[r.doc_id])
        assert r.kept == (r.doc_id is not None and r.doc_id == r.component_id)
    left = without_near_duplicates(frame)
    assert left.columns == frame.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in left.collect()) == sorted(
        [-1] + [i for i, _ in rows if i is not None and expected[i] == i]
    )


def test_crowded_bucket_is_compared_in_blocks(documents, monkeypatch):
    from evenstep.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    texts = [edited(prose(1, 150), 3, s) for s in range(40)] + [prose(1, 150)]
    expected = brute_force(list(enumerate(texts)))
    assert len(set(expected.values())) < 41
    assert {r.doc_id: r.component_id for r in near_duplicates(documents(texts)).collect()} == expected


def test_empty_table(documents):
    assert near_duplicates(documents([])).collect() == []


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    found = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)} | {7: 7}
