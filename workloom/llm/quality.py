"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

``measures`` has the base counts and ratios of a text as columns, ``RULES`` the bounds they must keep, and
``quality_rules`` compiles any such table into one boolean column. No shuffle, no Python: each row is judged where it is
read, so the operator's cost is linear in the bytes of text and a hot source or group of copies changes nothing.

Defined results
    null text, empty text, text of white space only: no words, all counts 0, ``base_failed`` true, ``kept`` false.
    null doc_id: carried through. Repeated rows: each is judged alone. Empty table: no rows.
    Other columns of the input, whatever their names, are not read and not returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from workloom.llm.runtime import words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it was for on with as be by at this from are or an "
    "der die und das den von zu mit ist des im für auf eine ein dem nicht es "
    "le la les et des un une du en que qui est dans pour par sur au "
    "el los las y del que una por con no para se lo su"
).split()
# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
# What a bullet line starts with.
BULLETS = ("-", "*", "•")


@dataclass(frozen=True)
class Rule:
    """A measure that must lie between two bounds; None leaves that side open."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The production thresholds. Ratios are per word or per line.
RULES = (
    Rule("n_words", 50, 1_000_000),
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("marks_per_word", None, 0.5),
    Rule("stop_word_ratio", 0.01, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.3),
)


def _covered(places: Column) -> Column:
    """Words under windows of three that start at these places, sorted: three each, less what the one before covers."""
    return F.aggregate(
        F.sort_array(places),
        F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum"), p.alias("last")),
        lambda a: a["sum"],
    )


def _windows(w: Column) -> Column:
    """The windows of three as pairs of a 64-bit hash and a place, sorted."""
    starts = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
    return F.sort_array(F.transform(starts, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))))


def _repeat_words(windows: Column) -> Column:
    """Words in windows found twice or more: equal hashes stand together, so such a window equals a neighbour."""
    twice = F.filter(windows, lambda x, i: (x["h"] == F.get(windows, i - 1)["h"]) | (x["h"] == F.get(windows, i + 1)["h"]))
    return F.coalesce(_covered(F.transform(twice, lambda x: x["p"])), F.lit(0)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the contract's base counts and the ratios that RULES names."""
    text = F.coalesce("text", F.lit(""))
    bare = text
    for space in " \n\t\r\x0b\x0c":
        bare = F.replace(bare, F.lit(space), F.lit(""))
    with_words = docs.select(
        "doc_id",
        words(text).alias("_words"),
        F.char_length(bare).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace(text, r"[^!?]+", "")).alias("_marks"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    w = F.col("_words")
    counted = with_words.select(
        "*",
        F.size(w).cast("long").alias("n_words"),
        _windows(w).alias("_windows"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*sorted(set(STOP_WORDS))))).alias("_stop"),
        F.size("_lines").alias("_n_lines"),
        F.size(F.array_distinct("_lines")).alias("_n_distinct"),
    )
    per_word, per_line = F.greatest("n_words", F.lit(1)), F.greatest("_n_lines", F.lit(1))
    marked = lambda f: F.size(F.filter("_lines", f)) / per_line
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.col("_n_lines") - F.col("_n_distinct")).cast("long").alias("n_dup_lines"),
        # an id is never negative, but keeps Spark from copying all this into a filter on the result, once for each use
        F.when(F.monotonically_increasing_id() >= 0, _repeat_words(F.col("_windows"))).alias("n_repeat_words"),
        (F.col("word_chars") / per_word).alias("mean_word_chars"),
        (F.col("n_symbols") / per_word).alias("symbols_per_word"),
        (F.col("_marks") / per_word).alias("marks_per_word"),
        (F.col("_stop") / per_word).alias("stop_word_ratio"),
        ((F.col("_n_lines") - F.col("_n_distinct")) / per_line).alias("dup_line_ratio"),
        marked(lambda x: F.ltrim(x).substr(1, 1).isin(*BULLETS)).alias("bullet_line_ratio"),
        marked(lambda x: x.endswith("...") | x.endswith("…")).alias("ellipsis_line_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression: every rule of the table holds."""
    verdict = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            verdict = verdict & (F.col(rule.measure) >= rule.least)
        if rule.most is not None:
            verdict = verdict & (F.col(rule.measure) <= rule.most)
    return verdict


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All measures of each document, ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs).withColumns({"base_failed": base, "kept": ~base & compile_rules(rules)})


_STOP_LIST = ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))

#: DuckDB SQL for the query's rows.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS marks,
             len(list_filter(w, lambda x: lower(x) IN ({_STOP_LIST}))) AS stops, len(lines) AS n_lines,
             len(list_filter(lines, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) AS bullets,
             len(list_filter(lines, lambda x: regexp_matches(x, '([.][.][.]|…)$'))) AS ellipses
      FROM w LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             CAST(greatest(n_words, 1) AS DOUBLE) AS nw, CAST(greatest(n_lines, 1) AS DOUBLE) AS nl FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words BETWEEN 50 AND 1000000 AND word_chars / nw BETWEEN 2 AND 15 AND n_symbols / nw <= 0.25
       AND marks / nw <= 0.5 AND stops / nw >= 0.01 AND n_dup_lines / nl <= 0.5 AND bullets / nl <= 0.9 AND ellipses / nl <= 0.3 AS kept
FROM f
"""
