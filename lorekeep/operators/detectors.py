"""Code patterns in texts: one automaton over all literals of all detectors, and a pattern only where a literal of its own stands.

A detector is (name, domain, confidence, literals, pattern): no match of its pattern is without one of its literals, so a text is
read once by the automaton whatever the number of detectors, and most patterns are never tried on it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Detector(NamedTuple):
    name: str
    domain: str
    confidence: float
    literals: tuple[str, ...]
    pattern: str


# Domain, confidence and pattern of what is looked for in Rust sources; the literals follow from the patterns.
RUST = (
    Detector("custom_error", "rust.error_handling", 0.85, ("impl",), r"impl\s+(?:std::)?(?:error::)?Error\s+for\s+(\w+)"),
    Detector("derived_error", "rust.error_handling", 0.9, ("#[derive(",), r"#\[derive\([^\)]*Error[^\)]*\)\]"),
    Detector("map_err", "rust.error_handling", 0.75, (".map_err(",), r"\.map_err\(\|[^|]*\|\s*([^)]+)\)"),
    Detector("spawn", "rust.async", 0.8, ("tokio::spawn",), r"tokio::spawn\s*\("),
    Detector("select", "rust.async", 0.85, ("tokio::select!",), r"tokio::select!\s*\{"),
    Detector("channel", "rust.async", 0.8, ("::channel",), r"(mpsc|oneshot|broadcast|watch)::channel"),
    Detector("lock", "rust.async", 0.75, ("Mutex::new", "RwLock::new"), r"(?:tokio::sync::)?(?:Mutex|RwLock)::new"),
    Detector("route", "rust.api", 0.85, (".route",), r"\.route\s*\(\s*[\"']([^\"']+)[\"']"),
    Detector("method_route", "rust.api", 0.85, ("#[get", "#[post", "#[put", "#[delete", "#[patch"), r"#\[(?:get|post|put|delete|patch)\s*\(\s*[\"']([^\"']+)[\"']"),
    Detector("middleware", "rust.api", 0.75, (".layer",), r"\.layer\s*\(\s*(\w+)"),
    Detector("test", "rust.testing", 0.8, ("#[test]", "#[tokio::test]"), r"#\[(?:tokio::)?test\]"),
    Detector("mock", "rust.testing", 0.8, ("mock!", "Mock", "mockall"), r"(?:mock!|Mock\w+::new|mockall)"),
    Detector("property_test", "rust.testing", 0.9, ("proptest!",), r"proptest!\s*\{"),
    Detector("query", "rust.database", 0.8, ("sqlx::query",), r"sqlx::query(?:_as|_scalar)?\s*(?:!\s*)?\("),
    Detector("transaction", "rust.database", 0.85, (".begin",), r"\.begin\s*\(\s*\)"),
    Detector("pool", "rust.database", 0.8, ("Pool::connect",), r"(?:Pool|PgPool|SqlitePool|MySqlPool)::connect"),
)

#: What the pages of a crawl hold.
WEB = (
    Detector("script", "web.script", 0.9, ("<script",), r"<script[^>]*>"),
    Detector("inline_call", "web.script", 0.75, ("track(",), r"track\(\d+\)"),
    Detector("style", "web.style", 0.9, ("<style",), r"<style[^>]*>"),
    Detector("link", "web.navigation", 0.8, ("href=",), r"href=\"[^\"]*\""),
    Detector("list_item", "web.navigation", 0.75, ("<li",), r"<li>"),
    Detector("heading", "web.structure", 0.85, ("<h1", "<h2", "<h3"), r"<h[123]>[^<]*"),
    Detector("paragraph", "web.structure", 0.8, ("<p",), r"<p>"),
    Detector("comment", "web.structure", 0.75, ("<!--",), r"<!--[^>]*-->"),
    Detector("reference", "web.text", 0.75, ("&",), r"&[a-z]+;"),
)


def found(texts: DataFrame, key: str, text: str, detectors: tuple[Detector, ...]) -> DataFrame:
    """(key, name, domain, confidence, n, first, hit): of every text what each detector finds, how often, where first (characters from 0) and its first match.

    Null texts hold nothing.
    """
    kind = texts.schema[key].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        owners: dict[str, set[int]] = {}
        for k, d in enumerate(detectors):
            for w in d.literals:
                owners.setdefault(w, set()).add(k)
        for w, own in owners.items():
            automaton.add_word(w, own)
        automaton.make_automaton()
        patterns = [re.compile(d.pattern) for d in detectors]
        for batch in batches:
            keys, out = batch.column(0), []
            for row, t in enumerate(batch.column(1).to_pylist()):
                tried: set[int] = set()
                for _, own in automaton.iter(t or ""):
                    tried |= own
                    if len(tried) == len(detectors):
                        break
                for k in sorted(tried):
                    n, first = 0, None
                    for m in patterns[k].finditer(t):
                        n, first = n + 1, first or m
                    if n:
                        out.append((row, k, n, first.start(), first.group()))
            rows = [x[0] for x in out]
            of = [detectors[x[1]] for x in out]
            columns = [keys.take(pa.array(rows, pa.int64())), pa.array([d.name for d in of], pa.string()), pa.array([d.domain for d in of], pa.string()), pa.array([d.confidence for d in of], pa.float64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.int64()), pa.array([x[4] for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "name", "domain", "confidence", "n", "first", "hit"])

    return texts.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(look, f"{key} {kind}, name string, domain string, confidence double, n long, first long, hit string")


def learned(matches: DataFrame, key: str, least: float = 0.0) -> DataFrame:
    """(domain, name, texts, n, confidence, example): what a folder of texts teaches, one row for each detector that met anything.

    The example is the first match of the least key.
    """
    m = matches.where(F.col("confidence") >= least)
    return m.groupBy("domain", "name").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.max("confidence").alias("confidence"), F.min_by("hit", key).alias("example"))
