from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = DOCUMENTS + ", id long, uid long, bucket long, kept string, score string, ids string, length string, host string, n long"


@pytest.fixture
def documents(spark):
    """Documents from texts, numbered from 0; or from ``(doc_id, text)``."""

    def build(texts, schema=DOCUMENTS, lang="en"):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        extra = (7,) * 3 + ("x",) * 5 + (7,) if schema == CLASHING else ()
        return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), *extra) for i, t in rows], schema)

    return build


def prose(seed: int, words: int) -> str:
    """Words of a made-up language, the same for the same seed."""
    import random

    draw = random.Random(seed)
    return " ".join("".join(draw.choice(["ka", "lo", "mi", "ne", "ru", "ta", "the"]) for _ in range(draw.randint(1, 3))) for _ in range(words))
