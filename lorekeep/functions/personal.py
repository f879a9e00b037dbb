"""Personal data and secrets with their places: every kind, false positives left out, overlaps resolved; array expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kind, class (1 low to 4 critical), confidence and pattern of what is looked for, in order of precedence.
KINDS: list[tuple[str, int, float, str]] = [
    ("EMAIL", 2, 0.95, r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("PHONE", 2, 0.85, r"(?:\+1[-.\s]?)?\(?[2-9]\d{2}\)?[-.\s]?\d{3}[-.\s]?\d{4}"),
    ("PHONE", 2, 0.80, r"\+[1-9]\d{1,14}"),
    ("SSN", 4, 0.90, r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b"),
    ("CREDIT_CARD", 4, 0.95, r"\b4\d{3}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
    ("CREDIT_CARD", 4, 0.95, r"\b[52]\d{3}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
    ("CREDIT_CARD", 4, 0.95, r"\b3[47]\d{2}[-\s]?\d{6}[-\s]?\d{5}\b"),
    ("CREDIT_CARD", 4, 0.75, r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{1,7}\b"),
    ("IPV4", 1, 0.90, r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"),
    ("IPV6", 1, 0.90, r"(?i)\b(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\b"),
    ("AWS_KEY", 4, 0.99, r"(?:AKIA|ABIA|ACCA|ASIA)[0-9A-Z]{16}"),
    ("GITHUB_TOKEN", 4, 0.99, r"ghp_[a-zA-Z0-9]{36}"),
    ("GITHUB_TOKEN", 4, 0.99, r"github_pat_[a-zA-Z0-9]{22}_[a-zA-Z0-9]{59}"),
    ("JWT", 4, 0.95, r"eyJ[a-zA-Z0-9_-]*\.eyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*"),
    ("API_KEY", 4, 0.85, r"(?i)(?:api[_-]?key|secret|token|password|auth)\s*[:=]\s*['\x22][^'\x22]{8,}['\x22]"),
    ("API_KEY", 4, 0.80, r"(?i)(?:sk|pk|api)[-_][a-zA-Z0-9]{20,}"),
    ("PRIVATE_KEY", 4, 0.99, r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    ("PASSWORD", 4, 0.75, r"(?i)password\s*[:=]\s*['\x22]?[^'\x22<>\s]{4,}['\x22]?"),
]
# Matches that are no one's data.
HARMLESS = {"IPV4": ("127.0.0.1", "0.0.0.0", "255.255.255.255", "255.255.255.0"), "SSN": ("123-45-6789", "000-00-0000")}
TEST_CARD = "4111111111111111"


def _real(kind: str, m: Column) -> Column:
    if kind in HARMLESS:
        return ~m["text"].isin(*HARMLESS[kind])
    if kind == "CREDIT_CARD":
        return ~F.translate(m["text"], "- ", "").startswith(TEST_CARD)
    return F.lit(True)


NO_MATCH = "array<struct<from: bigint, rank: int, kind: string, class: bigint, upto: bigint, confidence: double, text: string>>"
#: The same matches in less time: a name before "@" is looked for where its run begins (or the last match ended), once.
FASTER = {0: r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"}


def _may_hold(text: Column) -> list[Column]:
    """For each kind what any of its matches holds, a few bytes or a short pattern: texts without it are not searched."""
    has = lambda *parts: reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in parts])
    digits = text.rlike("[0-9]{4}")
    sign = has(":", "=")
    return [
        has("@"),
        digits,
        has("+") & text.rlike(r"\+[1-9][0-9]"),
        *[digits] * 5,
        text.rlike(r"[0-9]\.[0-9]"),
        has(":") & text.rlike(":[0-9a-fA-F]{1,4}:"),
        has("AKIA", "ABIA", "ACCA", "ASIA"),
        has("ghp_"),
        has("github_pat_"),
        has("eyJ"),
        sign & has("'", '"') & text.rlike(r"[:=]\s*['\x22]"),
        has("-", "_") & text.rlike("[-_][a-zA-Z0-9]{20}"),
        has("-----BEGIN "),
        sign & text.rlike(r"[dD]\s*[:=]"),
    ]


def _found(text: Column, k: int) -> Column:
    """Matches of one pattern: from, rank, kind, class, upto (bytes), confidence, text. Where a match lies follows from the pieces between matches.

    Hits are bound as the variable of a one-element array, so they are made once; places are running sums over pieces and hits.
    """
    kind, cls, confidence, pattern = KINDS[k]
    pattern = FASTER.get(k, pattern)

    def places(hits: Column) -> Column:
        pieces = F.slice(F.split(text, pattern), F.lit(1), F.size(hits))
        sizes = F.zip_with(pieces, hits, lambda p, h: F.struct(F.octet_length(p).cast("long").alias("gap"), F.octet_length(h).cast("long").alias("own")))
        start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<long>").alias("ends"))
        ends = F.aggregate(sizes, start, lambda a, x: F.struct((a["end"] + x["gap"] + x["own"]).alias("end"), F.array_append(a["ends"], a["end"] + x["gap"] + x["own"]).alias("ends")))["ends"]
        one = lambda m, upto: F.struct(
            (upto - F.octet_length(m)).alias("from"),
            F.lit(k).alias("rank"),
            F.lit(kind).alias("kind"),
            F.lit(cls).cast("long").alias("class"),
            upto.alias("upto"),
            F.lit(confidence).alias("confidence"),
            m.alias("text"),
        )
        return F.when(F.size(hits) > 0, F.filter(F.zip_with(hits, ends, one), lambda m: _real(kind, m))).otherwise(F.array().cast(NO_MATCH))

    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), places), F.lit(0))


def matches(text: Column) -> Column:
    """All matches of all patterns, in order of place and then of pattern."""
    may = _may_hold(text)
    same = [next(i for i, x in enumerate(may) if x is m) for m in may]
    # What several kinds ask for is looked for once: the answers are bound as the variable of a one-element array.
    asked = F.array(F.struct(*[m.alias(f"m{k}") for k, m in enumerate(may) if same[k] == k]))
    none = F.array().cast(NO_MATCH)
    every = lambda a: F.array_sort(F.concat(*[F.when(a[f"m{same[k]}"], _found(text, k)).otherwise(none) for k in range(len(KINDS))]))
    return F.get(F.transform(asked, every), F.lit(0))


def spans(text: Column) -> Column:
    """matches() without overlaps: of two that overlap the higher class stays, else the first.

    Matches come by place, so one that ends before the next begins meets no later one: only the few still open are looked at.
    """

    def add(state: Column, m: Column) -> Column:
        kept = F.filter(state["open"], lambda e: e["upto"] > m["from"])
        done = F.concat(state["done"], F.filter(state["open"], lambda e: e["upto"] <= m["from"]))
        meets = lambda e: (m["from"] < e["upto"]) & (m["upto"] > e["from"])
        at = F.array_position(F.transform(kept, meets), True)
        replaced = F.transform(kept, lambda e, i: F.when((i + 1 == at) & (m["class"] > e["class"]), m).otherwise(e))
        return F.struct(done.alias("done"), F.when(at > 0, replaced).otherwise(F.concat(kept, F.array(m))).alias("open"))

    def fold(every: Column) -> Column:
        none = F.slice(every, 1, 0)
        return F.aggregate(every, F.struct(none.alias("done"), none.alias("open")), add, lambda s: F.array_sort(F.concat(s["done"], s["open"])))

    return F.get(F.transform(F.array(matches(text)), fold), F.lit(0))


def shown(text: Column) -> Column:
    """A match for a log: the first and last two characters, stars between; short ones stars only."""
    n = F.octet_length(text)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(text, 1, 2), F.repeat(F.lit("*"), n - 4), F.substring(text, -2, 2)))
