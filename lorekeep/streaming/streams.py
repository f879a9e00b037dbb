"""Structured Streaming forms of the event operators.

Event time is `ts`; rows later than the watermark are dropped. State is kept per key; a custom state ends when event time has
gone past all that it could still touch. Rows of a key are taken in the order of event time within a micro-batch; a row that is older than
the key's newest earlier one but within the watermark is held against the state as it then is. Results go to a table in the shared folder,
never through the driver. A run over a finished folder (Trigger.AvailableNow) gives the same rows as the batch form, which is how the queries use them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources.scratch import folder

WATERMARK = "10 minutes"


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder as a stream: files as they come, event time as a timestamp."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # A table may be one file or a folder of files; a glob over its name serves both.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path + "*")


def with_time(stream: DataFrame, ts: str = "ts", late: str = WATERMARK) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def subscribed(stream: DataFrame, kinds: list[str]) -> DataFrame:
    """Filtered subscription."""
    return stream.where(F.col("event_type").isin(*kinds))


def running_counts(stream: DataFrame, key: str, x: str) -> DataFrame:
    """Counts and means by key, updated as rows come."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"))


def windowed(stream: DataFrame, every: str, slide: str | None = None) -> DataFrame:
    w = F.window("ts", every, slide) if slide else F.window("ts", every)
    return stream.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, key: str, gap: str) -> DataFrame:
    return stream.groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def unique_within(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Exact duplicates inside the watermark's reach are dropped."""
    return stream.dropDuplicatesWithinWatermark(keys)


class _Ageing(StatefulProcessor):
    """State of a key that one timer clears once event time is past all that it can still touch."""

    def init(self, handle) -> None:
        self._handle = handle
        self._due = handle.getValueState("due", "due long")

    def lives_until(self, micros: int) -> None:
        due = micros // 1000 + 1
        if self._due.exists():
            old = self._due.get()[0]
            if old == due:
                return
            self._handle.deleteTimer(old)
        self._handle.registerTimer(due)  # one that lies before the watermark fires at once and clears what is past anyway
        self._due.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        self._due.clear()
        self.forget()
        yield pd.DataFrame({})

    def close(self) -> None:
        pass


class _NearUnique(_Ageing):
    def __init__(self, threshold: float, age: int, most: int):
        self.threshold, self.age, self.most = threshold, age, most

    def init(self, handle) -> None:
        super().init(handle)
        self.kept = handle.getListState("kept", "at long, v array<double>")

    def forget(self) -> None:
        self.kept.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        rows = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "id"])
        vectors = np.stack([np.asarray(v, float) for v in rows["v"]])
        vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        before = list(self.kept.get()) if self.kept.exists() else []
        n, first, times = len(before), 0, [x[0] for x in before]
        store = np.empty((n + len(rows), vectors.shape[1]))
        if before:
            store[:n] = [x[1] for x in before]
        out = []
        for i, ts, v in zip(rows["id"], rows["ts"], vectors, strict=True):
            now = ts.value // 1000
            # Older ones than the age bound lie before this place: times rise but for late rows, which are looked at too.
            while first < n and (now - times[first] > self.age or n - first > self.most):
                first += 1
            if n == first or (store[first:n] @ v).max() < self.threshold:
                store[n] = v
                times.append(now)
                n += 1
                out.append((key[0], i))
        self.kept.put([(times[k], store[k].tolist()) for k in range(first, n)])
        self.lives_until(max(times[first:n]) + self.age)
        yield pd.DataFrame(out, columns=["key", "id"])


def near_unique(stream: DataFrame, key: str, threshold: float = 0.9, minutes: int = 5, most: int = 10_000, late: str = WATERMARK) -> DataFrame:
    """Rows (key, id, ts, v) whose vector is not near one kept in the last minutes of its key; state is bounded by age and number.

    Kept vectors lie in one matrix, so a row costs one product; a timer clears a key once event time is past its last vector's
    age. Rows later than the watermark are dropped; a late row within it is compared with what is kept when it comes.
    """
    return stream.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(_NearUnique(threshold, minutes * 60_000_000, most), "key long, id long", "Append", "EventTime")


class _Alerts(_Ageing):
    def __init__(self, column: str, above: float | None, below: float | None, rate: float | None, cooldown: int, window: int):
        self.column, self.above, self.below, self.rate, self.cooldown, self.window = column, above, below, rate, cooldown, window

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "last long")
        self.seen = handle.getListState("seen", "at long, bad boolean")

    def forget(self) -> None:
        self.last.clear()
        self.seen.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        rows = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "id"])
        last = self.last.get()[0] if self.last.exists() else None
        seen = list(self.seen.get()) if self.rate is not None and self.seen.exists() else []
        first, bad, out, newest = 0, sum(x[1] for x in seen), [], max([x[0] for x in seen], default=None)
        times, marks, taken = [ts.value // 1000 for ts in rows["ts"]], list(rows[self.column]), 0
        for i, now, x in zip(rows["id"], times, marks, strict=True):
            if self.rate is not None:
                # All rows of one time count before any of them is judged.
                while taken < len(times) and times[taken] == now:
                    seen.append((now, bool(marks[taken])))
                    bad += bool(marks[taken])
                    taken += 1
                while now - seen[first][0] > self.window:
                    bad -= seen[first][1]
                    first += 1
                newest = now if newest is None else max(now, newest)
                hit = bad > self.rate * (len(seen) - first)
            else:
                hit = (self.above is not None and x > self.above) or (self.below is not None and x < self.below)
            if hit and (last is None or now - last >= self.cooldown):
                last = now
                out.append((key[0], i))
        if last is not None:
            self.last.update((last,))
        if self.rate is not None:
            self.seen.put(seen[first:])
        if last is not None or newest is not None:
            self.lives_until(max(x for x in (None if last is None else last + self.cooldown, None if newest is None else newest + self.window) if x is not None))
        yield pd.DataFrame(out, columns=["rule", "id"])


def alerts(stream: DataFrame, rule: str, x: str, above: float | None = None, cooldown_s: int = 3600, late: str = WATERMARK, below: float | None = None, rate: float | None = None, window_s: int = 3600) -> DataFrame:
    """(rule, id) of rows at which a rule fires: a number above or below a bound, or more than a share of failures (a boolean) in the last while.

    Each rule is silent for its cooldown after it fires. A timer clears a rule's state when the cooldown and, for a share, the
    last row's while are past. Rows later than the watermark are dropped; a late row within it is judged by the state when it comes, and
    one older than the last alert is silent.
    """
    step = _Alerts(x, above, below, rate, cooldown_s * 1_000_000, window_s * 1_000_000)
    return stream.withWatermark("ts", late).groupBy(rule).transformWithStateInPandas(step, "rule string, id long", "Append", "EventTime")


VERSIONS = "key long, version long, seq long, changed map<string, string>, gone array<string>, snapshot map<string, string>"
#: Keys share so many states: each is read and put once a micro-batch, not once a key.
BUCKETS = 2048


def versions(stream: DataFrame, key: str, every: int = 10) -> DataFrame:
    """Rows (key, seq, op, fields) as VERSIONS: what each change changes, with the whole state every so many versions.

    A change that changes nothing makes no version. Changes of a key count in the order of seq within a micro-batch. The state of a
    bucket of keys is one value: version number and fields of each.
    """

    def change(_, batches: Iterator, held) -> Iterator:
        import json

        import pandas as pd

        rows = pd.concat(list(batches), ignore_index=True).sort_values(["key", "seq"])
        state = {k: (version, fields) for k, version, fields in json.loads(held.get[0])} if held.exists else {}
        out = []
        for k, seq, op, new in zip(rows["key"].tolist(), rows["seq"].tolist(), rows["op"], rows["fields"], strict=True):
            version, fields = state.get(k, (0, {}))
            # Null fields of a change say nothing; a deletion empties the state.
            new = {} if op == "delete" else {f: v for f, v in dict(new or {}).items() if v is not None}
            gone = sorted(fields) if op == "delete" else []
            changed = {f: v for f, v in new.items() if fields.get(f) != v}
            if not changed and not gone:
                continue
            version += 1
            fields = {} if op == "delete" else fields | changed
            state[k] = version, fields
            out.append((k, version, seq, changed, gone, fields if version % every == 0 else None))
        held.update((json.dumps([(k, *x) for k, x in state.items()]),))
        yield pd.DataFrame(out, columns=["key", "version", "seq", "changed", "gone", "snapshot"])

    rows = stream.select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket"), F.col(key).cast("long").alias("key"), "seq", "op", "fields")
    return rows.groupBy("bucket").applyInPandasWithState(change, VERSIONS, "state string", "append", GroupStateTimeout.NoTimeout)


def at_version(log: DataFrame, version: int) -> DataFrame:
    """(key, version, fields): the state of each key at a version, or its last one before; the nearest snapshot and the changes after it."""
    upto = log.where(F.col("version") <= version)
    base = upto.where("snapshot IS NOT NULL").groupBy("key").agg(F.max("version").alias("b"))
    rest = upto.join(base, "key", "left").where(F.col("b").isNull() | (F.col("version") >= F.col("b")))
    each = F.when(F.col("version") == F.col("b"), F.map_entries("snapshot")).otherwise(F.concat(F.map_entries("changed"), F.transform("gone", lambda k: F.struct(k.alias("key"), F.lit(None).cast("string").alias("value")))))
    field = rest.select("key", "version", F.explode(each).alias("e")).groupBy("key", F.col("e.key").alias("k")).agg(F.max_by(F.struct(F.col("e.value").alias("value")), "version").alias("v"))
    state = field.where("v.value IS NOT NULL").groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v.value")))).alias("fields"))
    last = upto.groupBy("key").agg(F.max("version").alias("version"))
    return last.join(state, "key", "left").select("key", "version", F.coalesce("fields", F.create_map().cast("map<string, string>")).alias("fields"))


def compacted(log: DataFrame, before: int) -> DataFrame:
    """The log without the changes before each key's last snapshot at or before a version; states from there on stay what they are."""
    base = log.where((F.col("version") <= before) & F.col("snapshot").isNotNull()).groupBy("key").agg(F.max("version").alias("_b"))
    return log.join(base, "key", "left").where(F.col("_b").isNull() | (F.col("version") >= F.col("_b"))).drop("_b")


def replay(table: DataFrame, order: str, form: Callable[[DataFrame], DataFrame], parts: int = 4) -> DataFrame:
    """Rows of a streaming form over a table that comes in micro-batches in the order of a column: parts of like size, one a micro-batch.

    A part is written when the one before it has been taken, so none is split or mixed with another, however many files it has.
    """
    spark = table.sparkSession
    path = f"{folder(spark)}/scratch-{spark.sparkContext.applicationId}/replay-{uuid.uuid4().hex}"
    numeric = dict(table.dtypes)[order] in ("int", "bigint", "double")
    x = (F.col(order) if numeric else F.col(order).cast("timestamp")).cast("double")
    cuts = table.select(x.alias("x")).approxQuantile("x", [k / parts for k in range(1, parts)], 0.01)
    edges = [None, *sorted(set(cuts)), None]

    def arrivals() -> Iterator[None]:
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            part = table if a is None else table.where(x >= a)
            (part if b is None else part.where(x < b)).write.parquet(f"{path}/part-{k}")
            yield

    return finished(form(spark.readStream.schema(table.schema).parquet(f"{path}/part-*")), arrivals=arrivals())


def gated(stream: DataFrame, text: str, redact: Column, found: Column, threshold: int, policy: str = "redact") -> DataFrame:
    """Ingest gate: rows with personal data of a class from the threshold on are rejected or redacted, others pass."""
    if policy == "reject":
        return stream.where(found < threshold)
    return stream.withColumn(text, F.when(found >= threshold, redact).otherwise(F.col(text)))


def finished(stream: DataFrame, mode: str = "append", arrivals: Iterable[None] = (None,)) -> DataFrame:
    """Runs a stream over all that is there into a table of the shared folder and gives its rows.

    In append mode each micro-batch adds its rows; in complete mode each overwrites the whole. A batch tried again overwrites its own folder.
    With arrivals it is run after each of them, from where it was.
    """
    spark = stream.sparkSession
    path = f"{folder(spark)}/scratch-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number if mode == 'append' else 0}")

    # Keyed state with timers needs the RocksDB store.
    store, given = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(store)
    spark.conf.set(store, given)
    w = stream.writeStream.foreachBatch(put).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint")
    try:
        for _ in arrivals:
            q = w.start()
            q.awaitTermination()
            if q.exception():
                raise q.exception()
    finally:
        spark.conf.set(store, before)
    try:
        return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)
    except AnalysisException:  # no batch had been there to write
        return spark.createDataFrame([], stream.schema)


def into(stream: DataFrame, path: str, checkpoint: str, also: Callable[[DataFrame], None] | None = None) -> None:
    """Appends a stream to a Parquet table, each micro-batch in a folder of its own, and hands it to a second sink.

    A batch tried again overwrites its own folder, so rows are there once.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if also:
            also(batch)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
