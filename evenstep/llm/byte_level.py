"""Ids of a byte-level BPE from its tokenizer file, by merge ranks."""

from __future__ import annotations

import json
import re
from functools import cache

import tiktoken

from evenstep.llm.pretokens import pretokens

# Fixed value: how a byte-level pre-tokenizer with its own pattern splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that goes on for longer is split without the pattern, whose look-ahead is costly there.
LONG_BLANK = 500
_BLANKS = re.compile(r"\s{%d}" % LONG_BLANK)
# Bytes that a byte-level vocabulary writes as themselves; the others follow from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


@cache
def _byte_of() -> dict[str, int]:
    rest = [b for b in range(256) if b not in _PLAIN]
    return {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A tokenizer file's plain byte-level BPE; strings of its added tokens are ordinary text here."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            told = json.load(file)
        model, byte_of = told["model"], _byte_of()
        #: Texts of added tokens and their ids, for callers that look for them.
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        ids = {t: i for t, i in model["vocab"].items() if t not in self.added}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in ids.items()}
        # An id is the rank of the merge that makes it, so that ids alone say what is merged first.
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        made = [ids[m.replace(" ", "", 1)] for m in merges]
        split = told["pre_tokenizer"]
        own_pattern = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        if told["normalizer"] or not own_pattern or model["type"] != "BPE" or made != sorted(made):
            raise ValueError(f"{path} is no plain byte-level BPE in the order of its merges")
        self.encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token

    def encode(self, text: str) -> list[int]:
        if _BLANKS.search(text):
            return [i for word in pretokens(text) for i in self.encoding._encode_single_piece(word)]
        return self.encoding.encode_ordinary(text)


@cache
def byte_level(path: str) -> ByteLevel:
    """One for all tasks of a worker process."""
    return ByteLevel(path)
