"""Alignment of two tokenizers against the tokenizers' own libraries and plain loops."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from llm_cases import CLASHING, prose
from tokenizers import Tokenizer

from evenstep.llm import alignment
from evenstep.llm.alignment import Bytes, aligned

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "  two  blanks ", "tabs\tand\nlines\n\n  x", "it's we'll 'S", "日本語のテキスト 🙂🙂 ñandú", "<s> </s> <|endoftext|> <unk> <0x41>",
    "▁lower block", "a" * 3000, " " * 3000 + "x", " 　x  y", "ÀÉ é", "\x00\x01\x7f", "x\r\n y", "﻿bom", "!!! ??? ...,,,",
]


@pytest.fixture(scope="module")
def libraries():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_table():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            table[chr(256 + n)] = b
            n += 1
    return table


def plain_alignment(texts, first, second):
    table, rows, counts = byte_table(), [], Counter()
    for text in texts:
        links, groups, a, b = [], [], [], []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            sides = (
                [bytes(table[c] for c in first.id_to_token(i)) for i in a],
                [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b],
            )
            if any(b"".join(s) != (" " + text).encode() for s in sides):
                a, b = [], []
            else:
                ends = [list(accumulate(map(len, s))) for s in sides]
                at_a, at_b = 0, 0
                for end in sorted(set(ends[0]) & set(ends[1])):
                    i, j = ends[0].index(end) + 1, ends[1].index(end) + 1
                    groups.append(",".join(map(str, a[at_a:i])) + "|" + ",".join(map(str, b[at_b:j])))
                    links.append((a[i - 1], b[j - 1]))
                    at_a, at_b = i, j
        counts.update(links)
        rows.append((len(a), len(b), groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (na, nb, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for na, nb, groups, links in rows
    ]


def answers(frame):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return [tuple(r[n] for n in names) for r in sorted(aligned(frame, A, B).collect(), key=lambda r: r.doc_id)]


def test_odd_and_ordinary_texts(documents, libraries):
    texts = ODD + [prose(i, 50) for i in range(20)] + [prose(1, 50)] * 3
    assert answers(documents(texts)) == plain_alignment(texts, *libraries)


def test_random_characters(documents, libraries):
    draw = random.Random(11)
    texts = ["".join(draw.choice(" \n\t aábcßЖ日🙂'.,1２<>▂") for _ in range(draw.randint(1, 80))) for _ in range(150)]
    assert answers(documents(texts)) == plain_alignment(texts, *libraries)


def test_blocks_and_slices_change_nothing(documents, monkeypatch):
    texts = ODD + [prose(i, 80) for i in range(30)]
    whole = answers(documents(texts).coalesce(1))
    # Workers are forked anew for a changed module: both numbers travel with the functions that use them.
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 100)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 200)
    first, second = Bytes(A), alignment.Pieces(B)
    parts = [alignment.align([t], first, second) for t in texts]
    assert [int(p["n_groups"][0]) for p in parts] == [w[2] for w in whole]
    assert [p["digests"][0] for p in parts] == [w[6] for w in whole]


def test_long_texts_in_parts(libraries, monkeypatch):
    first, second = Bytes(A), alignment.Pieces(B)
    assert second.apart
    for text in (prose(3, 2000), "x  y \n z " * 500, "日本 é " * 700, "a" * 5000, " b" * 3000, "\t c" * 900):
        whole = first.encode(" " + text), second.encode(text)
        monkeypatch.setattr(alignment, "SLICE_BYTES", 100)
        assert alignment._encoded(text, first, second) == (whole[0], whole[1])
        monkeypatch.undo()
        assert whole[0] == libraries[0].encode(" " + text, add_special_tokens=False).ids


def test_nulls_repeats_extra_columns_and_empty_tables(documents):
    got = aligned(documents([(None, "one two"), (3, "one two"), (3, "one two"), (4, None)], CLASHING), A, B).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_links > 0) for r in got) == [(False, 3, True), (False, 3, True), (False, 4, False), (True, 0, True)]
    assert len({(r.n_a, r.count_sum, r.groups_sha256) for r in got if r.doc_id != 4}) == 1
    assert aligned(documents([]), A, B).count() == 0
