"""Queries that run the streaming operators over a finished folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..streaming import streams as S
from .registry import query


def _events(t):
    return S.source(t.spark, t.sf_dir, "events")


@query("stream_subscription", "SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'error')")
def stream_subscription(t):
    return S.finished(S.subscribed(_events(t), ["purchase", "error"]).select("event_id", "event_type"))


@query("stream_running_counts", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stream_running_counts(t):
    return S.finished(S.running_counts(_events(t), "event_type", "value"), "complete")


@query("stream_windows", "SELECT event_type, CAST(date_trunc('day', ts)::DATE AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(t):
    w = S.finished(S.windowed(S.with_time(_events(t)), "1 day"), "complete")
    return w.select("event_type", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


@query("stream_sessions", "WITH x AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR AS cut FROM events), s AS (SELECT user_id, sum(coalesce(cut, TRUE)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, count(DISTINCT k) AS sessions FROM s GROUP BY 1")
def stream_sessions(t):
    s = S.finished(S.sessions(S.with_time(_events(t)), "user_id", "6 hours"), "complete")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("stream_exact_dedup", "SELECT count(DISTINCT event_id) AS n FROM events")
def stream_exact_dedup(t):
    e = _events(t)
    twice = S.with_time(e.unionByName(e), late="60 days")
    return S.finished(S.unique_within(twice, ["event_id"]).select("event_id")).agg(F.count("*").alias("n"))


@query(
    "stream_near_dedup",
    """WITH RECURSIVE a AS (SELECT label % 4 AS key, vec_id, v, row_number() OVER (PARTITION BY label % 4 ORDER BY vec_id) AS k FROM vectors),
r(key, k, vec_id, kept) AS (SELECT key, k, vec_id, [{'i': vec_id, 'v': v}] FROM a WHERE k = 1
  UNION ALL SELECT a.key, a.k, a.vec_id, CASE WHEN len(list_filter(r.kept, lambda s: a.vec_id - s.i <= 30 AND list_cosine_similarity(s.v, a.v) >= 0.3)) = 0 THEN list_append(list_filter(r.kept, lambda s: a.vec_id - s.i <= 30), {'i': a.vec_id, 'v': a.v}) ELSE list_filter(r.kept, lambda s: a.vec_id - s.i <= 30) END FROM r JOIN a ON a.key = r.key AND a.k = r.k + 1)
SELECT key, vec_id AS id FROM r WHERE list_contains(list_transform(kept, lambda s: s.i), vec_id)""",
)
def stream_near_dedup(t):
    """A vector every ten seconds, in four micro-batches: those not near one kept in the last five minutes of their key."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("vec_id") * 10)
    rows = t.vectors.select((F.col("label") % 4).alias("key"), F.col("vec_id").alias("id"), at.alias("ts"), "v")
    return S.replay(rows, "ts", lambda s: S.near_unique(s, "key", 0.3))


_FIRED = "a AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY ts, event_id) AS k FROM hits), r(rule, k, last, id) AS (SELECT rule, 1::BIGINT, ts, event_id FROM a WHERE k = 1 UNION ALL SELECT r.rule, a.k, CASE WHEN a.ts >= r.last + INTERVAL 1 DAY THEN a.ts ELSE r.last END, CASE WHEN a.ts >= r.last + INTERVAL 1 DAY THEN a.event_id ELSE r.id END FROM r JOIN a ON a.rule = r.rule AND a.k = r.k + 1) SELECT DISTINCT rule, id FROM r"


def _rows(t, key: str, x):
    return t.events.select(key, F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), x.alias("x")).withColumnRenamed(key, "rule")


@query("stream_alerts", "WITH RECURSIVE a AS (SELECT event_type, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events WHERE value > 90), r(event_type, k, last) AS (SELECT event_type, 1::BIGINT, ts FROM a WHERE k = 1 UNION ALL SELECT r.event_type, a.k, CASE WHEN a.ts >= r.last + INTERVAL 1 DAY THEN a.ts ELSE r.last END FROM r JOIN a ON a.event_type = r.event_type AND a.k = r.k + 1) SELECT event_type AS rule, count(DISTINCT last) AS n FROM r GROUP BY 1")
def stream_alerts(t):
    return S.replay(_rows(t, "event_type", F.col("value")), "ts", lambda s: S.alerts(s, "rule", "x", 90.0, 86_400, "1 hour")).groupBy("rule").agg(F.count("*").alias("n"))


@query("stream_alerts_below", f"WITH RECURSIVE hits AS (SELECT event_type AS rule, ts, event_id FROM events WHERE value < 5), {_FIRED}")
def stream_alerts_below(t):
    return S.replay(_rows(t, "event_type", F.col("value")), "ts", lambda s: S.alerts(s, "rule", "x", None, 86_400, "1 hour", below=5.0))


@query("stream_error_rate", f"WITH RECURSIVE e AS (SELECT 'u' || user_id % 5 AS rule, ts, event_id, event_type = 'error' AS bad FROM events), w AS (SELECT *, avg(bad::INT) OVER (PARTITION BY rule ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) AS share FROM e), hits AS (SELECT rule, ts, event_id FROM w WHERE share > 0.25), {_FIRED}")
def stream_error_rate(t):
    """More than a quarter of a group's events of the last twelve hours are errors, at most once a day."""
    rows = t.events.withColumn("rule", F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")))
    rows = rows.select("rule", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("x"))
    return S.replay(rows, "ts", lambda s: S.alerts(s, "rule", "x", None, 86_400, "1 hour", rate=0.25, window_s=43_200))


_VERSIONS = """WITH c AS (SELECT *, seq * 1000000000 + change_id AS ord FROM client_changes WHERE client_id IS NOT NULL AND seq IS NOT NULL AND change_id IS NOT NULL),
e AS (SELECT *, coalesce(sum((op = 'D')::INT) OVER (PARTITION BY client_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM c),
p AS (SELECT *, last_value(source IGNORE NULLS) OVER w AS a, last_value(segment IGNORE NULLS) OVER w AS b, last_value(city IGNORE NULLS) OVER w AS d FROM e WINDOW w AS (PARTITION BY client_id, life ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, CASE WHEN op = 'D' THEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (d IS NOT NULL)::INT ELSE (source IS NOT NULL AND source IS DISTINCT FROM a)::INT + (segment IS NOT NULL AND segment IS DISTINCT FROM b)::INT + (city IS NOT NULL AND city IS DISTINCT FROM d)::INT END AS fields FROM p),
v AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY ord) AS version FROM n WHERE fields > 0)"""


def _changes(t):
    """The clients' changes as a stream in four parts: a deletion or fields, in the order of their numbers."""
    c = t.client_changes.where("client_id IS NOT NULL AND seq IS NOT NULL AND change_id IS NOT NULL")
    fields = F.create_map(*[x for k in ("source", "segment", "city") for x in (F.lit(k), F.col(k))])
    rows = c.select(F.col("client_id").alias("key"), (F.col("seq") * 1_000_000_000 + F.col("change_id")).alias("seq"), F.when(F.col("op") == "D", "delete").otherwise("set").alias("op"), fields.alias("fields"))
    return S.replay(rows, "seq", lambda s: S.versions(s, "key", 4))


@query("stream_versions", f"{_VERSIONS} SELECT client_id, version, change_id, fields::BIGINT AS fields, version % 4 = 0 AS snapshot FROM v")
def stream_versions(t):
    """The change log as a stream: a version for each change that changes something, a snapshot at every fourth."""
    log = _changes(t)
    return log.select(F.col("key").alias("client_id"), "version", (F.col("seq") % 1_000_000_000).alias("change_id"), (F.size("changed") + F.size("gone")).cast("long").alias("fields"), F.col("snapshot").isNotNull().alias("snapshot"))


@query("state_at_versions", f"{_VERSIONS} SELECT client_id, upto, max(version) AS version, arg_max(CASE WHEN op <> 'D' THEN struct_pack(x := coalesce(source, a)) ELSE struct_pack(x := NULL) END, version).x AS source, arg_max(CASE WHEN op <> 'D' THEN struct_pack(x := coalesce(segment, b)) ELSE struct_pack(x := NULL) END, version).x AS segment, arg_max(CASE WHEN op <> 'D' THEN struct_pack(x := coalesce(city, d)) ELSE struct_pack(x := NULL) END, version).x AS city FROM v, (VALUES (3::BIGINT), (8), (1000000)) AS u(upto) WHERE version <= upto GROUP BY 1, 2")
def state_at_versions(t):
    """The clients as they were at versions 3 and 8 and as they are, from snapshots and the changes after them; the log is compacted first for the last."""
    log = _changes(t)
    out = None
    for at in (3, 8, 1_000_000):
        state = S.at_version(S.compacted(log, at) if at == 1_000_000 else log, at)
        rows = state.select(F.col("key").alias("client_id"), F.lit(at).cast("long").alias("upto"), "version", *[F.col("fields")[k].alias(k) for k in ("source", "segment", "city")])
        out = rows if out is None else out.unionByName(rows)
    return out


@query("stream_privacy_gate", "SELECT count(*) AS n FROM conversations WHERE NOT (regexp_matches(text, '\\b4\\d{15}\\b') OR regexp_matches(text, 'token = \"[0-9a-f]{32,}\"'))")
def stream_privacy_gate(t):
    s = S.source(t.spark, t.sf_dir, "conversations")
    return S.finished(S.gated(s, "text", T.redacted(F.col("text")), T.personal_class(F.col("text")), 4, "reject").select("conv_id")).agg(F.count("*").alias("n"))
