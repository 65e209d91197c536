"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it. Each rule's cost and rejection rate are
measured on a sample of rows, and rules run in the order of rejections per cost: one
CASE expression that stops at the first rejection. The order decides how much is
computed and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost.llm.exprs import NOT_SPACE, let, positions, words
from signpost.session import materialize

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
SAMPLE = 2000
REPEATS = 3


@dataclass(frozen=True)
class Rule:
    """``rejects(text, features)``: true for a text to drop; never null."""

    name: str
    rejects: Callable[[Column, Column], Column]


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_SPACE))


def repeated_words(tokens: Column) -> Column:
    """Words inside three-word windows that the text has twice or more, the first one included.

    Windows are sorted by hash with their place; equal neighbours are the repeats.
    The union of the windows' places is counted from the gaps between them.
    """

    def places(ordered: Column) -> Column:
        def repeated(x: Column, i: Column) -> Column:
            return (F.get(ordered, i - 1)["h"].eqNullSafe(x["h"])) | (
                F.get(ordered, i + 1)["h"].eqNullSafe(x["h"])
            )

        return F.sort_array(F.transform(F.filter(ordered, repeated), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def of(tokens: Column) -> Column:
        window = F.transform(
            positions(F.size(tokens) - 2),
            lambda i: F.struct(
                F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)).alias("h"),
                i.alias("i"),
            ),
        )
        return let(let(F.sort_array(window), places), covered)

    return let(tokens, of)


def features(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of a non-null text."""

    def of(tokens: Column) -> Column:
        return F.struct(
            F.size(tokens).cast("bigint").alias("n_words"),
            F.aggregate(tokens, F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)).alias("word_chars"),
            repeated_words(tokens).cast("bigint").alias("n_repeat_words"),
        )

    def lines(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("bigint").alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("bigint").alias("n_dup_lines"),
        )

    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return let(
        F.struct(
            let(words(text), of).alias("w"),
            let(lines_with_words(text), lines).alias("l"),
            symbols.cast("bigint").alias("n_symbols"),
        ),
        lambda f: F.struct(
            f["w"]["n_words"].alias("n_words"),
            f["w"]["word_chars"].alias("word_chars"),
            f["n_symbols"].alias("n_symbols"),
            f["l"]["n_dup_lines"].alias("n_dup_lines"),
            f["w"]["n_repeat_words"].alias("n_repeat_words"),
            f["l"]["n_lines"].alias("n_lines"),
        ),
    )


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def _share(text: Column, pattern: str, percent: int) -> Column:
    """More than ``percent`` % of the characters match ``pattern``."""
    return 100 * (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) > percent * F.length(text)


RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda t, f: 10 * f["n_symbols"] > f["n_words"]),
    Rule("repeated lines", lambda t, f: 10 * f["n_dup_lines"] > 4 * f["n_lines"]),
    Rule(
        "word length",
        lambda t, f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 20 * f["n_words"]),
    ),
    Rule(
        "shouted marks",
        lambda t, f: 10 * (F.length(t) - F.length(F.replace(t, F.lit("!!"), F.lit("!")))) > f["n_words"],
    ),
    Rule("capitals", lambda t, f: _share(t, r"\p{Lu}", 50)),
    Rule("digits", lambda t, f: _share(t, "[0-9]", 40)),
)


def measured(
    df: DataFrame,
    rules: Mapping[str, Rule],
    text_col: str = "text",
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    repeats: int = REPEATS,
) -> DataFrame:
    """``rule``, ``cost`` (seconds per row), ``rejected``, ``rows``, best first.

    The sample is about ``sample`` rows, taken by a hash of id and text, so that a text which very
    many rows share is in it as often as among all rows. Every rule runs alone
    over its written copy, ``repeats`` times; its cost is the least of these times less that of a
    run without a rule, over the rows. Costs differ between runs, which may change the
    order and never a verdict. An empty sample rejects nothing.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = max(1, df.count() // sample)
    some = materialize(
        df.select(F.col(id_col).cast("string").alias("i"), text.alias("t"))
        .filter(F.pmod(F.xxhash64("i", "t"), F.lit(whole)) == 0)
        .select("t", features(F.col("t")).alias("f"))
    )

    def timed(rejects: Column) -> tuple[float, int]:
        """Time of the quickest run, and the rows that the rule rejects; text and features are read in each."""
        read = F.count_if(rejects), F.max(F.length("t")), F.max("f.n_words")
        best = float("inf")
        for _ in range(repeats):
            start = time.perf_counter()
            found = some.agg(*read).first()[0]
            best = min(best, time.perf_counter() - start)
        return best, found

    n = some.count()
    nothing, _ = timed(F.lit(False))
    found = []
    for name, rule in rules.items():
        took, out = timed(rule.rejects(F.col("t"), F.col("f")))
        found.append((name, max(took - nothing, 1e-4) / max(1, n), out, n))
    found.sort(key=lambda r: (-(r[2] + 1) / r[1], r[0]))
    return spark.createDataFrame(found, "rule string, cost double, rejected bigint, rows bigint")


def cascade(rules: list[Rule], text: Column, f: Column) -> Column:
    """The first rule that rejects, in this order; null if none does."""
    out: Column = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects(text, f), F.lit(rule.name)).otherwise(out)
    return out


def judge(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    sample: int = SAMPLE,
) -> DataFrame:
    """Per row: id, the features, base_failed, rejected_by (null: no rule), kept.

    Null and empty texts have no words and fail the base test. A document that fails
    it is not tried further: ``rejected_by`` is "base". Rows with one id are judged
    each; columns other than id and text are not looked at; an empty table gives an
    empty result.
    """
    named = {r.name: r for r in rules}
    order = [named[r["rule"]] for r in measured(df, named, text_col, sample, id_col).collect()]
    rows = df.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")
    ).withColumn("_f", features(F.col("_t")))

    def verdict(f: Column) -> Column:
        by = F.when(base_failed(f), F.lit("base")).otherwise(cascade(order, F.col("_t"), f))
        return F.struct(f.alias("f"), by.alias("by"))

    judged = rows.select("_id", let(F.col("_f"), verdict).alias("v"))
    return judged.select(
        F.col("_id").alias(id_col),
        *[F.col(f"v.f.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(F.col("v.f")).alias("base_failed"),
        F.col("v.by").alias("rejected_by"),
        F.col("v.by").isNull().alias("kept"),
    )


# The same columns in DuckDB's SQL, written out.
JUDGE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM tri),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win),
hit AS (SELECT DISTINCT r, i + k AS p FROM twice, range(3) AS o(k) WHERE n > 1),
rep AS (SELECT r, count(*) AS n FROM hit GROUP BY r),
ls AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
ld AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM ls
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT w.doc_id, w.t, len(ws)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(ws, x -> length(x))), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(ld.dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        coalesce(ld.n_lines, 0) AS n_lines
      FROM w LEFT JOIN rep USING (r) LEFT JOIN ld USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 4 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 10 * (length(t) - length(replace(t, '!!', '!'))) > n_words
    OR 100 * (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g'))) > 50 * length(t)
    OR 100 * (length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) > 40 * length(t)) AS kept
FROM b
"""
