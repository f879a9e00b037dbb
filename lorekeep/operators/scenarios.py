"""Scores of solutions against scenarios, and of findings by themselves."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

c = F.col

# Weights and bounds of a scenario's score (UNIT is our own).
KEYWORDS, COMPLETENESS, DOMAIN = 0.4, 0.3, 0.3
EXPECTED, CONTEXT = 0.7, 0.3
PASSED = 0.7
UNIT = 1_000_000_000
WHOLE_BYTES = 100
WORD_BYTES = 3
DIFFICULTY = {"easy": 1.0, "medium": 1.5, "hard": 2.0}

# Words that mark a finding as specific.
SPECIFIC = ("specifically", "example", "such as", "e.g.", "i.e.", "because", "when", "where", "how")


def words(text: Column) -> Column:
    """Runs of letters and digits of three bytes or more, lower case, repeats included."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0), lambda w: F.octet_length(w) >= WORD_BYTES)


#: Rows whose words and text a worker holds as Python objects at once.
AT_ONCE = 16


@F.arrow_udf(ArrayType(LongType()))
def _present(lists: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """How many words of each list occur anywhere in the text: one automaton a row, so time grows with words plus text."""
    import ahocorasick

    for columns in lists:
        out = []
        for k in range(0, len(columns[0]), AT_ONCE):
            for a, b, text in zip(*(x.slice(k, AT_ONCE).to_pylist() for x in columns), strict=True):
                a, b = Counter(a), Counter(b)
                found: set[str] = set()
                if (a or b) and text:
                    automaton = ahocorasick.Automaton()
                    for w in a.keys() | b.keys():
                        automaton.add_word(w, w)
                    automaton.make_automaton()
                    found = {w for _, w in automaton.iter(text)}
                out.append([sum(n for w, n in x.items() if w in found) for x in (a, b)])
        yield pa.array(out, pa.list_(pa.int64()))


def evaluated(pairs: DataFrame) -> DataFrame:
    """Pairs of a solution (solution, domain) and a scenario (expected, context, asked_domain) with their scores.

    keyword: the share of the expected behaviour's words that the solution has as substrings, and of the context's; 0.5 for no
    words. completeness: bytes of the solution up to 100. domain_match: 1 for the same, 0.7 where one begins with the other.
    Nulls count as empty texts. Further columns are kept; those named here are replaced.
    """
    plain = lambda x: F.coalesce(c(x), F.lit(""))
    rows = pairs.withColumns({"_expected": words(plain("expected")), "_context": words(plain("context"))})
    rows = rows.withColumn("_hits", _present("_expected", "_context", F.lower(plain("solution"))))
    n, m = F.size("_expected"), F.size("_context")
    share = lambda k, size: F.when(size == 0, 0.5).otherwise(c("_hits")[k] / F.nullif(size, F.lit(0)))
    keyword = F.when(n == 0, 0.5).otherwise(share(0, n) * EXPECTED + share(1, m) * CONTEXT)
    mine, asked = F.lower(plain("domain")), F.lower(plain("asked_domain"))
    match = F.when(mine == asked, 1.0).when(F.startswith(mine, asked) | F.startswith(asked, mine), 0.7).otherwise(0.2)
    complete = F.least(F.octet_length(plain("solution")) / float(WHOLE_BYTES), F.lit(1.0))
    rows = rows.withColumns({"keyword": keyword, "completeness": complete, "domain_match": match})
    score = c("keyword") * KEYWORDS + c("completeness") * COMPLETENESS + c("domain_match") * DOMAIN
    # a score of 0.7 up to the last bits of its sum has passed
    return rows.withColumn("score", score).withColumn("passed", F.round("score", 9) >= PASSED).drop("_expected", "_context", "_hits")


def statistics(evaluations: DataFrame, *keys: str) -> DataFrame:
    """By keys: evaluations, those passed, mean score, mean score by difficulty's weight, share of the held-out ones passed (0 for none).

    Scores are added up as whole billionths, so that sums do not depend on the order of rows.
    """
    weight = F.create_map(*[F.lit(x) for kv in DIFFICULTY.items() for x in kv])[c("difficulty")]
    held = F.count_if("holdout")
    units = F.round(c("score") * UNIT).cast("long")
    mean = lambda x: F.sum(x) / (F.count("*") * UNIT)
    return evaluations.groupBy(*keys).agg(
        F.count("*").alias("evaluated"),
        F.count_if("passed").alias("n_passed"),
        mean(units).alias("avg_score"),
        mean(units * weight).alias("weighted_score"),
        held.alias("n_holdout"),
        F.coalesce(F.count_if(c("passed") & c("holdout")) / F.nullif(held, F.lit(0)), F.lit(0.0)).alias("holdout_rate"),
    )


def contrast(text: Column) -> Column:
    """How sure a finding's own words make it: 0.5, more for words that specify (0.2), code (0.2) and digits (0.1); null for null."""
    low = F.lower(text)
    specific = F.exists(F.array(*map(F.lit, SPECIFIC)), lambda m: F.contains(low, m))
    return F.when(text.isNotNull(), F.lit(0.5) + F.when(specific, 0.2).otherwise(0.0) + F.when(F.contains(text, F.lit("`")), 0.2).otherwise(0.0) + F.when(text.rlike("[0-9]"), 0.1).otherwise(0.0))
