"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Measures are lengths, symbols, stop words, repeated windows and lines of each whole text. Each rule bounds one
measure by percent of another, in whole numbers, so that every engine decides alike. The compiled query has no
shuffle at all, so skew cannot arise.

Defined results: a null or empty text has no words and fails the base; repeated rows are judged alike; an
empty table gives an empty table; only doc_id and text are read, so other columns may have any name; a null doc_id stays
null.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.llm.common import SPACES, WORD, table, words

SYMBOLS = "#*$%&|<>"
BULLETS = "-*•"
WINDOW = 8
#: Common words of English, French, German and Spanish, lower case.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he at are this have from or an they which you we "
    "le la les des et du est dans pour qui au sur par une un pas avec que en de "
    "der die und den von zu das mit sich auf ist ein dem nicht eine im für "
    "el los las se del por con no su para es al y una"
).split()


class Rule(NamedTuple):
    """A text passes if low * of <= 100 * what <= high * of; a bound of None does not count."""

    what: str
    of: str
    low: int | None
    high: int | None


#: Of texts that pass the base.
THRESHOLDS = (
    Rule("word_chars", "n_words", 250, 1000),
    Rule("n_symbols", "n_words", None, 10),
    Rule("n_stop_words", "n_words", 2, None),
    Rule("n_dup_lines", "n_lines", None, 30),
    Rule("n_bullet_lines", "n_lines", None, 90),
)
MIN_WORDS, MAX_REPEATED = 20, 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Words inside windows whose word sequence the text has twice or more, by sorting the windows' hashes."""

    def covered(starts: Column) -> Column:
        n = F.size(starts)
        width = F.transform(starts, lambda x, i: F.when(i + 1 < n, F.least(F.lit(window), F.get(starts, i + 1) - x)).otherwise(F.lit(window)))
        return F.aggregate(width, F.lit(0), lambda a, b: a + b).cast("long")

    def starts_of(keys: Column) -> Column:
        def twice(s: Column) -> Column:
            same = lambda x, i: F.get(s, i)["k"].eqNullSafe(x["k"])
            flagged = F.transform(s, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"]).otherwise(F.lit(-1)))
            return F.sort_array(F.filter(flagged, lambda x: x >= 0))

        return let(F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), twice)

    def of(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
        return F.when(F.size(w) < window + 1, F.lit(0)).otherwise(let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(let(starts_of(k), covered)))).cast("long")

    return let(found, of)


def measures(text: Column) -> dict[str, Column]:
    """Every measure of the table, by name, of a text that is not null."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(without(x, SPACES)) > 0)
    found = words(text)
    return {
        "n_words": F.size(found).cast("long"),
        "word_chars": F.length(without(text, SPACES)).cast("long"),
        "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(found),
        "n_stop_words": F.size(F.filter(found, lambda w: w.isin(STOP_WORDS))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: F.ltrim(x).substr(1, 1).isin(*BULLETS))).cast("long"),
    }


def compiled(rules: tuple[Rule, ...]) -> Column:
    """One boolean: every rule holds."""
    holds = F.lit(True)
    for r in rules:
        if r.low is not None:
            holds = holds & (F.col(r.what) * 100 >= F.col(r.of) * r.low)
        if r.high is not None:
            holds = holds & (F.col(r.what) * 100 <= F.col(r.of) * r.high)
    return holds


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of docs(doc_id, text)."""
    measured = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", *(c.alias(n) for n, c in measures(F.col("text")).items()))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))


def _duck_rules() -> str:
    parts = [f"{r.what} * 100 >= {r.of} * {r.low}" for r in THRESHOLDS if r.low is not None] + [f"{r.what} * 100 <= {r.of} * {r.high}" for r in THRESHOLDS if r.high is not None]
    return " AND ".join(parts)


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS w,
  list_filter(string_split(text, chr(10)), lambda x: length(translate(x, {_SPACES}, '')) > 0) AS l FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT r, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM w)),
twice AS (SELECT r, k FROM win GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + j AS p FROM win JOIN twice USING (r, k), (SELECT unnest(generate_series(0, {WINDOW - 1})) AS j)) GROUP BY 1),
m AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, length(translate(text, {_SPACES}, ''))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  len(list_filter(w, lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words, len(l)::BIGINT AS n_lines,
  len(list_filter(l, lambda x: ltrim(x, ' ')[1] IN ('-', '*', '•')))::BIGINT AS n_bullet_lines FROM w),
f AS (SELECT m.*, coalesce(n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEATED} AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines, n_bullet_lines, base_failed, NOT base_failed AND ({_duck_rules()}) AS kept FROM b
"""
