"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed rule. A policy is a
named, versioned set of rules: applying one, comparing two, or asking what a rule alone rejects reads only the bits. The
query writes the ledger and takes all verdicts from the table.

Defined results: a null text is an empty text (no words; it fails the length rule). The caller's row is kept whole in the column
`row`, so null ids, repeated rows and further columns of any name pass through. Repeated windows are told apart by 64-bit
hashes within one text. Very long texts are measured whole. An empty table gives an empty ledger. Documents are judged alone, so ties and
order play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_of, written

#: Rules by bit: name and the condition on the measurements under which a document fails.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 10 * n_words"),
    ("duplicate_lines", "n_dup_lines > 3 AND 10 * n_dup_lines > 3 * n_lines"),
    ("capitals", "10 * n_capitals > 4 * word_chars"),
    ("few_letters", "10 * n_letter_words < 6 * n_words"),
    ("bullets", "n_lines > 3 AND 10 * n_bullet_lines > 9 * n_lines"),
    ("ellipses", "n_lines > 3 AND 10 * n_ellipsis_lines > 3 * n_lines"),
]
BASE = ("few_words", "repeated_windows")

#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "short_words", "long_words"),
    "v2": (*BASE, "symbols", "short_words", "long_words", "duplicate_lines", "capitals"),
    "v3": tuple(name for name, _ in RULES),
}
CURRENT = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_letter_words", "n_bullet_lines", "n_ellipsis_lines")


def mask(names: tuple[str, ...]) -> int:
    at = {name: k for k, (name, _) in enumerate(RULES)}
    return sum(1 << at[name] for name in names)


def _windows(words: Column) -> Column:
    """A hash of each 3-word window."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows as `row`, with the measurements of each text beside it (all long)."""
    a = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text_of(docs, text).alias("_t"))
    a = a.withColumn("_trim", F.regexp_replace("_t", rf"^{SPACE}|{SPACE}\z", ""))
    a = a.withColumn("_w", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", SPACE)))
    # Words in 3-word windows found twice or more: windows sorted by hash, each next to its equals, then the union of their
    # spans. Only a document whose windows are not all distinct pays for the sort.
    a = a.withColumn("_h", _windows(F.col("_w")))
    a = a.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ),
    )
    same = lambda i, e: F.coalesce(F.get(F.col("_s"), i)["h"] == e["h"], F.lit(False))
    a = a.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda e, i: same(i - 1, e) | same(i + 1, e)), lambda e: e["p"])))
    spans = F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("_p"), i + 1) - p, F.lit(3))))
    a = a.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0))
    lines = lambda pattern: F.size(F.filter("_l", lambda x: x.rlike(pattern))).cast("long")
    return a.select(
        "row",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(spans, F.lit(0), lambda x, y: x + y), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("_t", F.lit(r"\p{L}[^\x20\x09-\x0D]*+")).cast("long").alias("n_letter_words"),
        lines(r"^[\x20\x09-\x0D]*[-*\x{2022}\x{25E6}]").alias("n_bullet_lines"),
        lines(r"(?:\.\.\.|\x{2026})[\x20\x09-\x0D]*\z").alias("n_ellipsis_lines"),
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """measured() plus failures (long): bit k is set if rule k fails."""
    bits = None
    for k, (_, condition) in enumerate(RULES):
        bit = F.when(F.expr(condition), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    # A filter on the bits must not be moved below them: put in terms of the text, it would evaluate the measurements many
    # times over. The optimizer moves nothing past a row id, whose sign bit is 0.
    fixed = F.shiftrightunsigned(F.monotonically_increasing_id(), 63)
    return measured(docs, text).withColumn("failures", bits.bitwiseOR(fixed))


def passes(failures: Column, policy: str = CURRENT) -> Column:
    return failures.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with kept (boolean) under a policy."""
    return rows.withColumn("kept", passes(F.col("failures"), policy))


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that would be kept without it.

    One aggregation of the bits to at most 2^rules rows, whatever the number of documents.
    """
    m = mask(POLICIES[policy])
    sets = rows.groupBy(F.col("failures").bitwiseAND(F.lit(m).cast("long")).alias("f")).agg(F.count("*").alias("n"))
    bits = [(name, 1 << k) for k, (name, _) in enumerate(RULES) if m >> k & 1]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in bits]))
    x = sets.select("f", "n", each.alias("r"))
    return x.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("f").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("f") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("f").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def only_rule(failures: Column, policy: str = CURRENT) -> Column:
    """The rule of a policy that alone rejects a document, so that it would be kept without it; else null."""
    own = failures.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long"))
    names = [name for name, _ in RULES]
    return F.when((own != 0) & (F.bit_count(own) == 1), F.element_at(F.array(*map(F.lit, names)), (F.log2(own.cast("double")) + 1).cast("int")))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Per document: measurements, failure bits, verdicts of two policies, and the rule that alone rejects it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = written(ledger(docs).select(F.col("row.doc_id").alias("doc_id"), *MEASURES, "failures"), "ledger")
    bits = F.col("failures")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(bits, "base")).alias("base_failed"), passes(bits).alias("kept"), "failures", passes(bits, "v3").alias("kept_v3"), only_rule(bits).alias("only_rule"))
