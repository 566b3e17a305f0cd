"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every measure is a built-in expression over the whole text. Arrays that several measures need are
bound once by a one-element ``transform`` so that Spark evaluates them once for each row.

Defined results: a null text has no words (all counts 0, ``base_failed`` true, ``kept`` false), as has an
empty or blank one. Repeated rows are judged one by one. Extra columns pass through ``score`` untouched;
columns of the input with a measure's name are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SYMBOLS = "#*$%&|<>"
#: Frequent words of the corpus languages (en, fr, de, es); lower case.
STOP_WORDS = tuple(
    dict.fromkeys(
        (
            "the of and to in a is that for it with as was on be by this an at from or are not which you what "
            "le la les de des du un une et est que qui en dans pour par sur avec au aux ne pas il elle ce "
            "der die das und ist zu den mit von für auf nicht ein eine im dem sich auch als es "
            "el los las del y se no su al lo como más con para"
        ).split()
    )
)


@dataclass(frozen=True)
class Rule:
    """Keep a document only if ``low * denominator <= measure <= high * denominator``."""

    name: str
    measure: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Measures are columns that ``measures`` makes; "one" stands for 1.
RULES = (
    Rule("length", "n_words", "one", low=10),
    Rule("repeats", "n_repeat_words", "n_words", high=0.20),
    Rule("word_length", "word_chars", "n_words", low=2.0, high=15.0),
    Rule("symbols", "n_symbols", "n_words", high=0.10),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.50),
)


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and binds it to ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeated_words() -> str:
    """Words inside 5-word windows that occur twice or more, given the words ``w``.

    h: word hashes; d: window hashes; only where windows repeat, their (hash, position) pairs are sorted, positions
    with an equal neighbour kept, and the union of the 5-word stretches that begin there is measured.
    """
    equal = "(j > 0 AND s[greatest(j - 1, 0)].x = e.x) OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].x = e.x)"
    union = (
        "aggregate(sequence(0, size(p) - 1), 0L, (a, j) -> a + CASE WHEN j = size(p) - 1 THEN 5L "
        "ELSE CAST(least(5, p[least(j + 1, size(p) - 1)] - p[j]) AS BIGINT) END)"
    )
    positions = f"array_sort(transform(filter(s, (e, j) -> {equal}), e -> e.i))"
    ordered = "array_sort(transform(d, (x, i) -> named_struct('x', x, 'i', i)))"
    counted = let(ordered, "s", let(positions, "p", union))
    windows = "transform(sequence(0, size(h) - 5), i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4]))"
    body = let(windows, "d", f"CASE WHEN size(array_distinct(d)) = size(d) THEN 0L ELSE {counted} END")
    return f"CASE WHEN size(w) < 6 THEN 0L ELSE {let('transform(w, x -> xxhash64(x))', 'h', body)} END"


def measures_sql(text: str) -> str:
    """One SQL expression: a struct of all measures of the column ``text``."""
    t = f"coalesce({text}, '')"
    ws = r"' \t\n\u000B\f\r'".replace(r"\f", r"\u000C")
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    words = f"CASE WHEN length(btrim({t}, {ws})) = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE split(btrim({t}, {ws}), '[\\\\x20\\\\x09-\\\\x0D]+') END"
    of_words = let(
        words,
        "w",
        f"named_struct('n', CAST(size(w) AS BIGINT), 'stop', CAST(size(filter(w, x -> lower(rtrim('.,;:!?', x)) IN ({stop}))) AS BIGINT), "
        f"'repeats', {_repeated_words()})",
    )
    lines = let(
        f"filter(split({t}, '\\n'), x -> length(btrim(x, {ws})) > 0)",
        "x",
        "named_struct('n', CAST(size(x) AS BIGINT), 'dup', CAST(size(x) - size(array_distinct(x)) AS BIGINT))",
    )
    return (
        f"named_struct('w', {of_words}, 'l', {lines}, 'word_chars', CAST(length(translate({t}, {ws}, '')) AS BIGINT), "
        f"'n_symbols', CAST(length({t}) - length(translate({t}, '{SYMBOLS}', '')) AS BIGINT))"
    )


def rule_column(rule: Rule) -> Column:
    """The rule as a boolean column over the measures; true where it holds."""
    measure = F.col(rule.measure).cast("double")
    of = F.lit(1.0) if rule.denominator == "one" else F.col(rule.denominator).cast("double")
    held = F.lit(True)
    if rule.low is not None:
        held = held & (measure >= F.lit(rule.low) * of)
    if rule.high is not None:
        held = held & (measure <= F.lit(rule.high) * of)
    return held


def score(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, the first rule that fails (``failed_rule``) and ``kept``."""
    m = "_measures"
    out = docs.withColumn(m, F.expr(measures_sql(f"`{text}`")))
    columns = {
        "n_words": F.col(f"{m}.w.n"),
        "word_chars": F.col(f"{m}.word_chars"),
        "n_symbols": F.col(f"{m}.n_symbols"),
        "n_lines": F.col(f"{m}.l.n"),
        "n_dup_lines": F.col(f"{m}.l.dup"),
        "n_repeat_words": F.col(f"{m}.w.repeats"),
        "n_stop_words": F.col(f"{m}.w.stop"),
    }
    out = out.withColumns(columns).drop(m)
    first = F.coalesce(*[F.when(~rule_column(r), F.lit(r.name)) for r in rules])
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumns({"base_failed": base, "failed_rule": first})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines"
    )


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose verdict is ``kept`` stay, with their own columns."""
    return score(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text"))).filter("kept").select("_doc.*")


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln,
         row_number() OVER () AS rid
  FROM documents),
win AS (
  SELECT rid, i, row(w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS x
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 6)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
         (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?')) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)})))::BIGINT AS n_stop_words,
         len(ln)::BIGINT AS n_lines
  FROM d LEFT JOIN cov USING (rid)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT *, (NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 15.0 * n_words AND n_symbols <= 0.1 * n_words
           AND n_stop_words >= 0.02 * n_words AND n_dup_lines <= 0.5 * n_lines) AS kept
FROM b
"""
