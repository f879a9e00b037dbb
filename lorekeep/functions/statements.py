"""Statements in plain words: goals, beliefs, subjects, explicit contradictions, structure of a question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for a condition of a goal, in order.
GOALS: list[tuple[str, tuple[str, ...]]] = [
    ("has_research_results", ("research", "learn about", "understand", "find out")),
    ("pattern_stored", ("store", "save", "remember", "document")),
    ("domain_improved", ("coverage", "improve", "increase", "better")),
    ("gaps_identified", ("gap", "missing", "find what", "identify")),
    ("patterns_consolidated", ("consolidate", "merge", "deduplicate", "clean")),
    ("quality_analyzed", ("quality", "review", "assess", "evaluate")),
    ("tests_executed", ("test", "verify", "validate", "check")),
    ("codebase_analyzed", ("analyze", "examine", "inspect", "investigate")),
    ("introspection_complete", ("health", "status", "introspect", "self")),
]
DEFAULT_GOAL = ("has_research_results", "pattern_stored")
URGENCY: list[tuple[int, tuple[str, ...]]] = [
    (10, ("urgent", "critical", "asap", "immediately")),
    (8, ("important", "high priority", "soon")),
    (3, ("when possible", "eventually", "low priority")),
]
GOAL_DOMAINS = (("rust", "rust"), ("python", "python"), ("javascript", "javascript"), ("typescript", "typescript"), ("go ", "go"), ("golang", "go"), ("java ", "java"), ("async", "async"), ("database", "database"), ("api", "api"), ("testing", "testing"), ("security", "security"), ("performance", "performance"), ("error handling", "error-handling"), ("logging", "logging"), ("authentication", "auth"), ("caching", "caching"))
# Statements that exclude each other, words that recommend, and words that are no subject.
OPPOSED = (("should", "should not"), ("always", "never"), ("use", "avoid"), ("enable", "disable"), ("prefer", "avoid"), ("recommended", "not recommended"), ("best practice", "anti-pattern"), ("do", "don't"), ("sync", "async"), ("blocking", "non-blocking"), ("mutable", "immutable"), ("safe", "unsafe"))
RECOMMENDS = ("use", "prefer", "choose", "implement", "apply", "recommend")
NO_SUBJECT = ("the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "for", "and", "but", "or", "nor", "so", "yet", "to", "of", "in", "on", "at", "by", "with", "from", "use", "prefer", "choose", "implement", "apply")
# Signs of code, and words that join several requests.
SYNTAX = ("::", "->", "()", "=>", "{", "};")
JOINING = (" and then ", " then ", " also ", " as well as ", " both ", " each ")
SPACES = " \t\n\r\x0b\x0c"


def has_any(low: Column, words: tuple[str, ...]) -> Column:
    out = low.contains(words[0])
    for w in words[1:]:
        out = out | low.contains(w)
    return out


def count_of(low: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur."""
    return sum((low.contains(w).cast("int") for w in words[1:]), low.contains(words[0]).cast("int"))


def goal_conditions(t: Column) -> Column:
    """The conditions that a goal in words asks for."""
    low = F.lower(t)
    found = F.array_compact(F.array(*[F.when(has_any(low, words), F.lit(name)) for name, words in GOALS]))
    return F.when(F.size(found) == 0, F.array(*map(F.lit, DEFAULT_GOAL))).otherwise(found)


def goal_priority(t: Column) -> Column:
    low, out = F.lower(t), F.lit(5)
    for p, words in reversed(URGENCY):
        out = F.when(has_any(low, words), p).otherwise(out)
    return out.cast("long")


def goal_domain(t: Column) -> Column:
    low = F.lower(t)
    return F.coalesce(*[F.when(low.contains(w), F.lit(d)) for w, d in GOAL_DOMAINS])


def beliefs(problem: Column, solution: Column) -> Column:
    """(n, statement, confidence): the problem, and of the solution's first five sentences those of more than ten bytes."""
    each = F.transform(F.slice(F.split(solution, r"\."), 1, 5), lambda s, i: F.struct((i + 1).cast("long").alias("n"), F.btrim(s, F.lit(SPACES)).alias("statement"), F.lit(0.8).alias("confidence")))
    first = F.array(F.struct(F.lit(0).cast("long").alias("n"), problem.alias("statement"), F.lit(0.7).alias("confidence")))
    return F.concat(first, F.filter(each, lambda e: F.octet_length(e["statement"]) > 10))


def subjects(t: Column) -> Column:
    """Distinct words of more than three bytes that say what a statement is about."""
    words = F.split(F.btrim(F.lower(t), F.lit(SPACES)), "[ \\t\\n\\r\\x0b\\x0c]+")
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) > 3) & ~w.isin(*NO_SUBJECT)))


def opposed(a: Column, b: Column) -> Column:
    """Whether one statement has a word and the other its opposite."""
    x, y = F.lower(a), F.lower(b)
    out = F.lit(False)
    for pos, neg in OPPOSED:
        out = out | (x.contains(pos) & y.contains(neg)) | (x.contains(neg) & y.contains(pos))
    return out


def conflict(a: Column, b: Column, similarity: Column, threshold: float = 0.6) -> Column:
    """major, moderate or minor where two statements of one domain contradict, else null."""
    x, y = F.lower(a), F.lower(b)
    apart = has_any(x, RECOMMENDS) & has_any(y, RECOMMENDS) & (F.size(subjects(a)) > 0) & (F.size(subjects(b)) > 0) & ~F.arrays_overlap(subjects(a), subjects(b))
    level = F.when(similarity > 0.7, "major").when(similarity > 0.5, "moderate").otherwise("minor")
    return F.when(opposed(a, b), level).when((similarity > threshold) & (similarity < 0.95) & apart, "minor")


#: Subjects of a statement that its traits hold: the first ones in order, so statements that share many are likely to share one of these.
FIRST_SUBJECTS = 8


def traits(t: Column) -> Column:
    """What conflict() asks of one statement, but for all its subjects: which of the opposed words it has, whether it recommends and has subjects, and the first of these."""
    low, s = F.lower(t), subjects(t)
    bits = lambda side: sum(((low.contains(w[side])).cast("int") * (1 << k) for k, w in enumerate(OPPOSED)), F.lit(0))
    return F.struct(bits(0).alias("pos"), bits(1).alias("neg"), (has_any(low, RECOMMENDS) & (F.size(s) > 0)).alias("advises"), F.slice(F.array_sort(s), 1, FIRST_SUBJECTS).alias("first"))


def conflict_by_traits(a: Column, b: Column, similarity: Column, threshold: float = 0.6) -> tuple[Column, Column]:
    """(severity, open): conflict() of two statements by their traits; open where it takes their texts to tell, as their first subjects differ."""
    level = F.when(similarity > 0.7, "major").when(similarity > 0.5, "moderate").otherwise("minor")
    against = (a["pos"].bitwiseAND(b["neg"]) != 0) | (a["neg"].bitwiseAND(b["pos"]) != 0)
    may = (similarity > threshold) & (similarity < 0.95) & a["advises"] & b["advises"]
    return F.when(against, level), ~against & may & ~F.arrays_overlap(a["first"], b["first"])


def length_feature(t: Column, most: int = 2000) -> Column:
    return F.least(F.log(F.length(t) + 1.0) / F.log(F.lit(most + 1.0)), F.lit(1.0))


def structure_feature(t: Column) -> Column:
    """Code, several questions or sentences, list items and joined requests, saturating."""
    n = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    blocks = F.floor(n("```") / 2)
    inline = F.greatest(n("`") - blocks * 6.0, F.lit(0.0)) / 2
    sentences = F.size(F.filter(F.split(t, r"[.?!;\n]"), lambda s: F.regexp_count(s, F.lit(r"[^ \t\n\r\x0b\x0c]+")) >= 3)).cast("double")
    items = F.size(F.filter(F.split(t, "\n"), lambda s: s.rlike(r"^[ \t\r\x0b\x0c]*(?:- |\* )") | (s.rlike(r"^[ \t\r\x0b\x0c]*[0-9]") & s.contains(". "))))
    raw = blocks * 0.8 + F.least(inline, F.lit(3.0)) * 0.3 + count_of(t, SYNTAX) * 0.25 + F.greatest(n(r"\?") - 1, F.lit(0.0)) * 0.25
    raw = raw + F.greatest(sentences - 1, F.lit(0.0)) * 0.2 + items * 0.3 + count_of(F.lower(t), JOINING) * 0.3
    return F.lit(1.0) - F.exp(-raw)


def specificity_feature(t: Column) -> Column:
    """How special the words are where none is a known term: their mean length, and signs of code."""
    words = F.filter(F.split(F.lower(t), "[ \\t\\n\\r\\x0b\\x0c]+"), lambda w: w != "")
    mean = F.aggregate(words, F.lit(0.0), lambda a, w: a + F.octet_length(w)) / F.size(words)
    code = F.when(has_any(t, ("::", "->", "()")), 0.3).otherwise(0.0)
    return F.when(F.size(words) == 0, 0.5).otherwise(F.least(F.least(mean / 10.0, F.lit(1.0)) * 0.5 + code + 0.2, F.lit(1.0)))


def complexity(length: Column, reasoning: Column, domain: Column, structure: Column, accuracy: Column) -> Column:
    """The weighted score in [0, 1]; the weights' sum is one."""
    score = length * 0.15 + reasoning * 0.15 + domain * 0.25 + structure * 0.25 + (F.lit(1.0) - accuracy) * 0.2
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
