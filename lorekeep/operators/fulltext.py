"""Full-text search: an inverted index as a table, BM25 ranking, snippets, Porter stems."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

K1, B = 1.2, 0.75
COLUMNS = frozenset({"problem", "solution", "context", "domain", "tags", "title", "summary", "text", "name", "content", "description", "query", "critique"})


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def index(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(term, key, tf, len): postings, one row for each term of a document."""
    if column not in COLUMNS:
        raise ValueError(f"{column} cannot be searched")
    d = docs.select(key, terms(F.col(column)).alias("_t")).select(key, F.size("_t").alias("len"), F.explode("_t").alias("term"))
    return d.groupBy("term", key, "len").agg(F.count("*").alias("tf"))


def _ranked(d: DataFrame, key: str, leaves: int) -> DataFrame:
    """(key, rank) of (key, len, tf0.., hit): BM25 over the counted leaves; rows that hit. The counts are a table, so texts are read once."""
    d = written(d, "counts")
    stats = d.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(leaves)])
    score = F.lit(0.0)
    for k in range(leaves):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + idf * tf * (K1 + 1) / (tf + (F.lit(1 - B) + F.col("len") / F.col("avg") * B) * K1)
    return d.join(F.broadcast(stats)).where("hit").select(key, F.round(-score, 6).alias("rank"))


def bm25(docs: DataFrame, key: str, column: str, words: list[str]) -> DataFrame:
    """(key, rank) of documents with any of the words; the rank is negated, lower is better.

    Only documents' lengths and the words' own counts are kept: the index of other terms is never made.
    """
    return matched(docs, key, " OR ".join(words), [column])


# Queries: words, prefix*, "a phrase", AND, OR, NOT, parentheses, and {columns}: before all. Words side by side are joined by AND.


def parsed(query: str):
    """(columns or None, tree): leaves are ("word" | "prefix", w) and ("phrase", [w, ...]), nodes ("and" | "or" | "not", a, b)."""
    columns = None
    scope = re.match(r"\s*\{([^}]*)\}\s*:(.*)", query, re.DOTALL) or re.match(r"\s*(\w+)\s*:(.*)", query, re.DOTALL)
    if scope:
        columns, query = scope[1].split(), scope[2]
    items = re.findall(r'"[^"]*"|[()]|[^\s()"]+', query)

    def leaf(x: str):
        if x.startswith('"'):
            return ("phrase", re.findall(r"[^\W_]+", x.lower()))
        low = "".join(re.findall(r"[^\W_]+", x.lower()))
        if not low:
            raise ValueError(f"no word in {x!r}")
        return ("prefix" if x.endswith("*") else "word", low)

    def unit():
        x = items.pop(0)
        if x == "(":
            out = level(0)
            if not items or items.pop(0) != ")":
                raise ValueError("a parenthesis is not closed")
            return out
        if x in (")", "AND", "OR", "NOT"):
            raise ValueError(f"{x} where a word should be")
        return leaf(x)

    def level(k: int):
        # NOT binds closer than AND, AND closer than OR.
        if k == 3:
            return unit()
        name = ("or", "and", "not")[k]
        out = level(k + 1)
        while items and items[0] != ")":
            if items[0] == name.upper():
                items.pop(0)
            elif not (name == "and" and items[0] not in ("OR", "NOT")):
                break
            out = (name, out, level(k + 1))
        return out

    if not items:
        raise ValueError("an empty query")
    tree = level(0)
    if items:
        raise ValueError(f"{items[0]} where the query should end")
    return columns, tree


def matched(docs: DataFrame, key: str, query: str, columns: list[str], least_rank: float | None = None) -> DataFrame:
    """(key, rank) of documents that a query matches in some columns, ranked by its words outside NOT; of those from a least rank on."""
    scope, tree = parsed(query)
    scope = scope or columns
    for name in scope:
        if name not in COLUMNS or name not in columns:
            raise ValueError(f"{name} cannot be searched")
    leaves: list[Column] = []

    def count(node) -> Column:
        kind, w = node
        if kind == "phrase":
            n = len(w)
            at = F.sequence(F.lit(1), F.greatest(F.size("_t") - n + 1, F.lit(1)))
            return F.size(F.filter(at, lambda i: F.slice(F.col("_t"), i, F.lit(n)) == F.array(*map(F.lit, w))))
        return F.size(F.filter("_t", lambda x: x == w if kind == "word" else x.startswith(w)))

    def condition(node, counted: bool) -> Column:
        if node[0] in ("word", "prefix", "phrase"):
            if counted:
                leaves.append(count(node))
                return F.col(f"tf{len(leaves) - 1}") > 0
            return count(node) > 0
        if node[0] == "not":
            return condition(node[1], counted) & ~condition(node[2], False)
        a, b = condition(node[1], counted), condition(node[2], counted)
        return a & b if node[0] == "and" else a | b

    hit = condition(tree, True)
    text = [terms(F.col(x)) for x in scope]
    d = docs.select(key, (text[0] if len(text) == 1 else F.concat(*text)).alias("_t"))
    d = d.select(key, "_t", F.size("_t").alias("len"), *[x.alias(f"tf{k}") for k, x in enumerate(leaves)])
    out = _ranked(d.withColumn("hit", hit).drop("_t"), key, len(leaves))
    return out if least_rank is None else out.where(F.col("rank") <= least_rank)


def snippet(text: Column, word: str, around: int = 30) -> Column:
    """The first occurrence of a word, marked, with some characters on both sides."""
    at = F.locate(word, F.lower(text))
    low = F.greatest(at - around, F.lit(1))
    cut = F.substring(text, low, F.lit(2 * around + len(word)))
    return F.when(at > 0, F.regexp_replace(cut, f"(?i)({word})", "<mark>$1</mark>"))


# Porter's stemmer in its published form, for one token at a time inside a vectorised function.

_VOWEL = "aeiou"


def _cons(w: str, i: int) -> bool:
    return w[i] not in _VOWEL and (w[i] != "y" or i == 0 or not _cons(w, i - 1))


def _measure(w: str) -> int:
    s = "".join("c" if _cons(w, i) else "v" for i in range(len(w)))
    return s.replace("c", " c").count("v c") if s else 0


def stem(w: str) -> str:
    """The Porter stem of a lower-case ASCII word."""
    if len(w) <= 2:
        return w
    has_vowel = lambda x: any(not _cons(x, i) for i in range(len(x)))
    double = lambda x: len(x) > 1 and x[-1] == x[-2] and _cons(x, len(x) - 1)
    cvc = lambda x: len(x) > 2 and _cons(x, len(x) - 1) and not _cons(x, len(x) - 2) and _cons(x, len(x) - 3) and x[-1] not in "wxy"
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # The suffix tables of steps 2, 3 and 4.
    step2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
    step3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    step4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
    for table in (step2, step3):
        end = max((e for e in table if w.endswith(e)), key=len, default=None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = max((e for e in step4 if w.endswith(e)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if double(w) and w.endswith("l") and _measure(w) > 1:
        w = w[:-1]
    return w


def stems(words: Column) -> Column:
    """Stems of an array of words; each distinct word of an Arrow batch is stemmed once."""

    @F.pandas_udf("array<string>")
    def f(rows: pd.Series) -> pd.Series:
        known = {w: stem(w) for w in {w for x in rows for w in x}}
        return rows.map(lambda x: [known[w] for w in x])

    return f(words)


def stemmed(docs: DataFrame, key: str, column: str, words: list[str]) -> DataFrame:
    """bm25() over stems: a document matches with any form of a word."""
    if column not in COLUMNS:
        raise ValueError(f"{column} cannot be searched")
    asked = [stem(w) for w in words]
    t = docs.select(key, stems(terms(F.col(column))).alias("_t"))

    def count(w: str) -> Column:
        return F.size(F.filter("_t", lambda x: x == w))

    counts = [count(w).alias(f"tf{k}") for k, w in enumerate(asked)]
    d = t.select(key, F.size("_t").alias("len"), *counts)
    hit = F.greatest(*[F.col(f"tf{k}") for k in range(len(asked))], F.lit(0)) > 0
    return _ranked(d.withColumn("hit", hit), key, len(asked))
