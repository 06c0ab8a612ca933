"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evenstep.llm.common import let

WINDOW = 5
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son "
    "el los del se las por con no una su para al lo como más pero sus o esta entre cuando muy sin sobre"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= 100 * part / whole <= high``, asked of documents of at least ``from_words`` words.

    ``part`` and ``whole`` name measures; all sides are whole numbers, so no rounding takes part.
    """

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    from_words: int = 0

    def passed(self) -> Column:
        part, whole = F.col(self.part) * 100, F.col(self.whole)
        within = F.lit(True)
        if self.low is not None:
            within &= part >= self.low * whole
        if self.high is not None:
            within &= part <= self.high * whole
        return within | (F.col("n_words") < self.from_words)


RULES = (
    Rule("word_length", "word_chars", "n_words", low=150, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=30),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=30),
    Rule("stop_words", "n_stop_words", "n_words", low=3, from_words=60),
)


def _covered(words: Column) -> Column:
    """Number of words that lie in a window of WINDOW words which the text holds twice or more."""
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(WINDOW)]))

    def places(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(rows: Column) -> Column:
            before = F.concat(F.slice(rows, 1, 1), F.slice(rows, 1, F.size(rows) - 1))
            after = F.concat(F.slice(rows, 2, F.size(rows) - 1), F.slice(rows, F.size(rows), F.lit(1)))
            beside = F.zip_with(
                F.zip_with(rows, before, lambda x, b: F.struct(x.alias("x"), b.alias("b"))),
                after,
                lambda xb, a: F.when(
                    ((xb["x"]["h"] == xb["b"]["h"]) & (xb["x"]["i"] != xb["b"]["i"]))
                    | ((xb["x"]["h"] == a["h"]) & (xb["x"]["i"] != a["i"])),
                    xb["x"]["i"],
                ),
            )
            return F.sort_array(F.array_compact(beside))

        return let(ordered, repeated)

    def length(at: Column) -> Column:
        nexts = F.slice(at, 2, F.size(at))
        parts = F.zip_with(at, nexts, lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(parts, F.lit(0), lambda total, part: total + part)

    def count(hashes: Column) -> Column:
        distinct = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(distinct, F.lit(0)).otherwise(let(places(hashes), length))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashed, count))


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts that rules compare; a null text has no words."""
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            _covered(w).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    text = F.coalesce("text", F.lit(""))
    return (
        docs.select("doc_id", text.alias("text"))
        .select(
            "doc_id",
            of_words.alias("w"),
            of_lines.alias("l"),
            F.length(F.translate("text", " \t\n\v\f\r", "")).cast("long").alias("word_chars"),
            (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        )
        .select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "w.n_stop_words", "l.n_lines")
    )


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per row of ``docs`` (``doc_id``, ``text``): the measures, ``base_failed`` and ``kept``.

    Nulls: a null text counts as empty and fails; a null ``doc_id`` is carried along. Repeated rows are judged
    one by one, an empty table gives an empty answer, and other columns are not looked at.
    """
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    passed = reduce(lambda a, b: a & b, (rule.passed() for rule in rules), F.lit(True))
    return measures(docs).select("*", failed.alias("base_failed"), (~failed & passed).alias("kept"))


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged; the verdict is worked out in the row itself."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    judged = judge(docs.select(row.alias("doc_id"), F.col("text").alias("text")), rules)
    return judged.where("kept").select("doc_id.*")


def judged_sql(rules: tuple[Rule, ...] = RULES, table: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

    def side(rule: Rule) -> str:
        asked = [f"100 * {rule.part} >= {rule.low} * {rule.whole}"] if rule.low is not None else []
        asked += [f"100 * {rule.part} <= {rule.high} * {rule.whole}"] if rule.high is not None else []
        return f"(n_words < {rule.from_words} OR ({' AND '.join(asked) or 'true'}))"

    verdict = " AND ".join(side(rule) for rule in rules) or "true"
    return rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM {table}),
windows AS (SELECT doc_id, i, ws[i:i + {WINDOW - 1}] AS g FROM split, unnest(range(1, len(ws) - {WINDOW - 2})) AS t(i)),
found AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows),
parts AS (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS k
          FROM found WHERE n > 1),
covered AS (SELECT doc_id, sum(k) AS k FROM parts GROUP BY doc_id),
measured AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(k, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(ws, lambda w: lower(w) IN ({stop}))) AS BIGINT) AS n_stop_words,
         CAST(len(ls) AS BIGINT) AS n_lines
  FROM split LEFT JOIN covered USING (doc_id)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND {verdict} AS kept FROM based"""
