"""Text functions: tokens, overlaps, dotted domains, titles and summaries, personal data, query complexity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that count as negation and as affirmation.
NEGATION = ("don't", "dont", "never", "avoid", "not", "shouldn't", "shouldnt", "won't", "wont", "cannot", "can't", "cant", "no", "neither", "nor", "without", "exclude", "disable", "remove", "stop", "prevent", "reject", "refuse", "prohibit")
AFFIRMATION = ("always", "must", "use", "should", "require", "enable", "add", "include", "prefer", "recommend", "ensure", "do", "apply", "implement", "adopt", "embrace", "allow", "accept")

# Patterns of personal data, in order of replacement.
STRIP: list[tuple[str, str, str]] = [
    ("file_path", r"(?:/(?:home|Users|tmp|var|etc|opt|usr|root|data|mnt|proc|sys|dev|srv)/[\w./-]+)|(?:[A-Z]:\\[\w\\.-]+)", "[PATH_REDACTED]"),
    ("ip_address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP_REDACTED]"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL_REDACTED]"),
    ("api_key", r"(?i)(?:api[_-]?key|token|secret|password|auth)\s*[=:]\s*['\x22]?[\w/+=-]{16,}['\x22]?", "[API_KEY_REDACTED]"),
    ("aws_key", r"AKIA[0-9A-Z]{16}", "[AWS_KEY_REDACTED]"),
    ("ssh_key", r"-----BEGIN (?:RSA |DSA |EC |OPENSSH )?PRIVATE KEY-----", "[SSH_KEY_REDACTED]"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[JWT_REDACTED]"),
    ("connection_string", r"(?i)(?:postgres|mysql|mongodb|redis)://\S+", "[CONNECTION_STRING_REDACTED]"),
    ("phone", r"\b(?:\+1[-.]?)?\(?\d{3}\)?[-.]?\d{3}[-.]?\d{4}\b", "[PHONE_REDACTED]"),
    ("credit_card", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "[CC_REDACTED]"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[SSN_REDACTED]"),
]

#: Types found for classification: pattern and class (1 low to 4 critical).
DETECT: list[tuple[str, str, int]] = [
    ("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 2),
    ("PHONE", r"\(\d{3}\) \d{3}-\d{4}", 2),
    ("CREDIT_CARD", r"\b4\d{15}\b", 4),
    ("IP", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 1),
    ("SECRET", r"token = \"[0-9a-f]{32,}\"", 4),
]
CLASS_NAMES = ("NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def tokens(t: Column) -> Column:
    """Distinct lower-case words; letters, digits and apostrophes make a word."""
    return F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}']+"), F.lit(0)))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / n.cast("double"))


def listed(words: Column, which: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in which])))


def negation_distance(neg_a: Column, aff_a: Column, neg_b: Column, aff_b: Column) -> Column:
    share = lambda n, a: n / F.greatest(n + a, F.lit(1)).cast("double")
    return F.abs(share(neg_a, aff_a) - share(neg_b, aff_b))


def domain_matches(domain: Column, asked: str) -> Column:
    """Both ways: the same, a child or a parent of the asked one; '' matches all."""
    if not asked:
        return F.lit(True)
    return (domain == asked) | domain.startswith(asked + ".") | F.lit(asked).startswith(F.concat(domain, F.lit(".")))


def domain_within(domain: Column, asked: str) -> Column:
    return (domain == asked) | domain.startswith(asked + ".")


def domain_levels(domain: Column) -> Column:
    """The domain and all its ancestors, the root first."""
    parts = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def domain_parent(domain: Column) -> Column:
    n = F.size(F.split(domain, r"\."))
    return F.when(n > 1, F.array_join(F.slice(F.split(domain, r"\."), F.lit(1), n - 1), "."))


def domain_root(domain: Column) -> Column:
    return F.substring_index(domain, ".", 1)


def domain_depth(domain: Column) -> Column:
    return F.size(F.split(domain, r"\.")).cast("long")


def domain_similarity(a: Column, b: Column) -> Column:
    """Length of the common path over the longer path's length."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    same = F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")))["n"]
    return same / F.greatest(F.size(x), F.size(y)).cast("double")


def title(t: Column) -> Column:
    """The first ten words, less punctuation at the end."""
    return F.regexp_replace(F.array_join(F.slice(F.split(F.regexp_replace(F.trim(t), r"\s+", " "), " "), 1, 10), " "), r"[,;:\-.]+$", "")


def summary(t: Column, n: int = 50) -> Column:
    """The first paragraph, or its first line if that has 80 bytes or more, cut at n words."""
    whole = F.trim(t)
    paragraph = F.trim(F.split(whole, "\n\n").getItem(0))
    line = F.trim(F.split(paragraph, "\n").getItem(0))
    base = F.when((F.octet_length(line) >= 80) & (F.octet_length(line) < F.octet_length(paragraph)), line).otherwise(paragraph)
    words = F.split(F.regexp_replace(base, r"\s+", " "), " ")
    return F.when(whole == "", "(No solution provided)").otherwise(F.concat(F.array_join(F.slice(words, 1, n), " "), F.when(F.size(words) > n, "...").otherwise("")))


def truncated(t: Column, n: int) -> Column:
    return F.when(F.octet_length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 3), F.lit("...")))


#: What a text must contain for a pattern of STRIP to match it: a look at it spares the pattern.
NEEDS = {"file_path": r"/|:\\", "ip_address": r"\d\.\d", "email": "@", "api_key": "[=:]", "aws_key": "AKIA", "ssh_key": "PRIVATE KEY", "jwt": "eyJ", "connection_string": "://", "phone": r"\d{3}", "credit_card": r"\d{4}", "ssn": r"\d-\d"}


def stripped(t: Column) -> Column:
    # Each step is bound as a variable of a one-element array: written out, its text would stand three times in the next.
    x = F.array(t)
    for name, pattern, put in STRIP:
        x = F.transform(x, lambda y: F.when(y.rlike(NEEDS[name]), F.regexp_replace(y, pattern, put)).otherwise(y))  # noqa: B023
    return F.get(x, F.lit(0))


def personal_class(t: Column) -> Column:
    """The highest class of personal data found, 0 to 4."""
    return F.greatest(*[F.when(t.rlike(p), F.lit(c)).otherwise(F.lit(0)) for _, p, c in DETECT]).cast("long")


def redacted(t: Column) -> Column:
    for name, pattern, _ in DETECT:
        t = F.regexp_replace(t, pattern, f"[{name}]")
    return t


# Cues of reasoning demand in a query.
CUES = ("design", "architect", "prove", "proof", "derive", "trade-off", "tradeoff", "compare", "evaluate", "optimi", "analy", "refactor", "migrat", "debug", "diagnos", "investigat", "root cause", "why ", "strategy", "plan ", "step by step", "scal", "guarantee", "ensure", "without ", "must ", "constraint", "edge case", "benchmark", "threat model", "consisten", "fault", "concurren", "race condition", "deadlock", "distributed", "invariant", "formal", "complexity", "bottleneck", "rollout")


def reasoning_demand(t: Column) -> Column:
    q = F.concat(F.lit(" "), F.lower(t), F.lit(" "))
    hits = None
    for c in CUES:
        x = q.contains(c).cast("int")
        hits = x if hits is None else hits + x
    return F.lit(1.0) - F.exp(hits * F.lit(-0.45))


def complexity_level(score: Column) -> Column:
    return F.when(score < 0.3, "low").when(score < 0.5, "medium").when(score < 0.7, "high").otherwise("very_high")
