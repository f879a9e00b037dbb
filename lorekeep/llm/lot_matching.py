"""Return lot matching: which sold lot each returned unit came from, what it cost and what was refunded.

Reflected sums find the moments when the stock of a client's item is empty. Between two of them lies a busy period, which
knows nothing of the others. Periods are packed into tasks of like size, and each task works off its periods with sorted arrays.

A period of more than `limit` rows is split further, by rank of its lots: returns take the best lots first, so the stock of
the best k bands of lots is itself a reflected sum that worse lots cannot change. On a day's axis of returned units each band
thus serves one interval, [stock of the better bands, stock with its own), and each return is an interval too. Laying one over
the other tells what each return takes from each band, and bands are then worked off one by one. Bands and chunks of returns
are dealt by range and written, prefix sums are joined from them, so no task holds a hot period. Windows see at most the days
of a period, the bands of a day (one for `limit` lots) or the returns of a chunk.

Defined results: lots whose quantity is below one, or whose amount is not finite, hold nothing and are left out, like those
with a null the contract names; a null discount is none, a null line number comes before all others and counts as the empty
text in the checksum; repeated rows are lots and returns of their own; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, written

#: Rows of a task, and of a busy period that is not split into bands.
LIMIT = 20_000
#: Tasks that one window packs.
PACKED = 32
#: Stands for a null line number, below all others.
NO_LINE = -(1 << 40)

PERIOD = ["client_id", "item_id", "period"]
PIECES = "client_id long, item_id long, return_no long, piece_no long, return_day long, return_sale_id long, lot_sale_id long, lot_line_no long, units long, lot_left long, refund_cents long, margin_cents long"
_EVENT = ["client_id", "item_id", "day", "kind", "sale_id", "line_no", "q", "c", "d", "u", "uid"]


def lots(lines: DataFrame, sales: DataFrame) -> DataFrame:
    """One row a lot: client_id, item_id, day, sale_id, line_no, q, c, d, and for returned ones rday and u, else null."""
    whole = F.abs("amount") < F.lit(float("inf"))  # neither null, infinite nor not a number
    rows = lines.filter(whole & F.col("item_id").isNotNull() & F.col("shipped_at").isNotNull() & (F.col("quantity") > 0))
    rows = rows.select("sale_id", "line_no", "item_id", "quantity", "amount", "discount", "flag", "shipped_at").join(sales.filter("client_id is not null").select("sale_id", "client_id"), "sale_id")
    q = F.col("quantity").cast("long")
    h = F.crc32(F.concat(F.col("sale_id").cast("string"), F.lit(":"), F.coalesce(F.col("line_no").cast("string"), F.lit(""))).cast("binary"))
    day = F.unix_date(F.to_date("shipped_at")).cast("long")
    back = F.col("flag") == "returned"
    cents = lambda x: F.floor(100 * x + 0.5).cast("long")
    return rows.select(
        F.col("client_id").cast("long").alias("client_id"),
        F.col("item_id").cast("long").alias("item_id"),
        day.alias("day"),
        F.col("sale_id").cast("long").alias("sale_id"),
        F.coalesce(F.col("line_no").cast("long"), F.lit(NO_LINE)).alias("line_no"),
        q.alias("q"),
        cents(F.col("amount")).alias("c"),
        cents(F.coalesce("discount", F.lit(0.0))).alias("d"),
        F.when(back, day + 1 + h % 31).alias("rday"),
        F.when(back, 1 + h % (q + 30)).alias("u"),
    )


def with_returns(lines: DataFrame, sales: DataFrame) -> DataFrame:
    """Lots of the clients' items of which anything was returned, as events: kind 1 puts q units in, kind 0 takes u out."""
    # Written: a join that Spark may split where one client's item has a large share of the rows needs both sides as they are dealt.
    asked = written(lots(lines.filter("flag = 'returned'"), sales).select("client_id", "item_id").distinct(), "lots-asked")
    rows = lots(lines, sales).join(asked, ["client_id", "item_id"], "left_semi").withColumn("uid", F.monotonically_increasing_id())
    event = lambda kind, day: F.struct(F.lit(kind).alias("kind"), F.col(day).alias("at"))
    both = F.when(F.col("u").isNull(), F.array(event(1, "day"))).otherwise(F.array(event(1, "day"), event(0, "rday")))
    return rows.withColumn("e", F.explode(both)).withColumn("day", F.col("e.at")).withColumn("kind", F.col("e.kind")).select(*_EVENT)


def _reflected(free: str, over) -> Column:
    """A sum kept at or above zero: the free sum less the lowest that it has been, if that is below zero."""
    return F.col(free) - F.least(F.lit(0), F.min(free).over(over))


def busy_days(events: DataFrame) -> DataFrame:
    """(client_id, item_id, day, lots, returns, lot_period, return_period, before): the days of each client's item.

    A day's returns come before its lots. Where they leave no stock, a period ends with them and the next begins with the lots;
    `before` counts the returns of earlier days.
    """
    put, out = F.when(F.col("kind") == 1, F.col("q")).otherwise(0), F.when(F.col("kind") == 0, F.col("u")).otherwise(0)
    days = events.groupBy("client_id", "item_id", "day").agg(F.sum(put).alias("put"), F.sum(out).alias("out"), F.sum("kind").alias("lots"), F.sum(1 - F.col("kind")).alias("returns"))
    w = Window.partitionBy("client_id", "item_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("free", F.sum(F.col("put") - F.col("out")).over(w) - F.col("put")).withColumn("left", _reflected("free", w))
    empty = (F.col("left") == 0).cast("long")
    days = days.withColumn("before", F.sum("returns").over(w) - F.col("returns")).withColumn("lot_period", F.sum(empty).over(w))
    return days.select("client_id", "item_id", "day", "lots", "returns", "lot_period", (F.col("lot_period") - empty).alias("return_period"), "before")


def packed(days: DataFrame, rows: int, limit: int) -> DataFrame:
    """(client_id, item_id, period, slot): the periods with returns, packed so that a slot has some `limit` rows; null slot: larger than that."""
    sides = F.array(F.struct(F.col("lot_period").alias("period"), F.col("lots").alias("n"), F.lit(0).cast("long").alias("r")), F.struct(F.col("return_period").alias("period"), F.col("returns").alias("n"), F.col("returns").alias("r")))
    sizes = days.select("client_id", "item_id", F.explode(sides).alias("s")).groupBy("client_id", "item_id", F.col("s.period").alias("period")).agg(F.sum("s.n").alias("n"), F.sum("s.r").alias("r")).filter("r > 0")
    small = F.when(F.col("n") <= limit, F.col("n")).otherwise(0)
    shelf = F.pmod(F.xxhash64(*PERIOD), F.lit(rows // (PACKED * limit) + 1))
    w = Window.partitionBy("shelf").orderBy(*PERIOD).rowsBetween(Window.unboundedPreceding, 0)
    slot = F.when(F.col("n") <= limit, F.struct("shelf", F.floor(F.sum(small).over(w) / limit).alias("k")))
    return sizes.withColumn("shelf", shelf).withColumn("slot", slot).select(*PERIOD, "slot")


def _floats(c: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Price of a unit as whole cents and a fraction, exact enough to order any two lots of fewer than 2**26 units."""
    whole = c // q
    return whole, (c - whole * q) / q


def _worked_off(table: pa.Table, ranked: bool) -> pa.Table:
    """Pieces of whole periods (or of bands of one): open lots wait in a sorted array, the best at its end.

    Columns: client_id, item_id, period, band, day, kind, sale_id, line_no, q, c, d, u, number, at. `number` is the number of a
    return if ranked, else the count of returns on earlier days; `at` is how many units better bands have given the return.
    """
    col = {k: table.column(k).to_numpy() for k in table.column_names if k not in ("slot", "uid", "chunk")}
    unit = [col[k] for k in ("client_id", "item_id", "period", "band")]
    same = [col[k] for k in ("d", "c", "q", "line_no", "sale_id")]
    whole, part = _floats(col["c"], np.maximum(col["q"], 1))
    rank = np.empty(table.num_rows, np.int64)
    rank[np.lexsort([*same, col["day"], -part, -whole])] = np.arange(table.num_rows)
    order = np.lexsort([*same, col["number"] if ranked else np.zeros(table.num_rows), col["kind"], col["day"], *unit[::-1]])
    at_rank = np.empty(table.num_rows, np.int64)
    at_rank[rank] = np.arange(table.num_rows)
    new = np.ones(table.num_rows, bool)
    new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in unit])
    client, item, day, kind, sale, line, q, c, d, u, number, at = (col[k].tolist() for k in ("client_id", "item_id", "day", "kind", "sale_id", "line_no", "q", "c", "d", "u", "number", "at"))
    ranks, lot_of = rank.tolist(), at_rank.tolist()
    left, out = {}, []
    open_lots: list[int] = []
    today, count = None, 0
    for k, fresh in zip(order.tolist(), new.tolist(), strict=True):
        if fresh:
            open_lots, left, today = [], {}, None
        if kind[k]:
            insort(open_lots, -ranks[k])
            left[ranks[k]] = q[k]
            continue
        if day[k] != today:
            today, count = day[k], 0
        count += 1
        no, need, done, piece = number[k] if ranked else number[k] + count, u[k], at[k], 0
        price, div = c[k] * (100 - d[k]), 100 * q[k]
        while need:
            piece += 1
            if open_lots:
                r = -open_lots[-1]
                take, lot = min(need, left[r]), lot_of[r]
                used = q[lot] - left[r]
                left[r] -= take
                if not left[r]:
                    open_lots.pop()
                cost = (used + take) * c[lot] // q[lot] - used * c[lot] // q[lot]
                which, rest = (sale[lot], line[lot] if line[lot] != NO_LINE else None), left[r]
            else:
                take, cost, which, rest = need, None, (None, None), None
            refund = (done + take) * price // div - done * price // div
            out.append((client[k], item[k], no, done if ranked else piece, day[k], sale[k], *which, take, rest, refund, None if cost is None else refund - cost))
            need -= take
            done += take
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(len(names))], names=names)


def _of_periods(table: pa.Table) -> pa.Table:
    return _worked_off(table, ranked=False)


def _of_bands(table: pa.Table) -> pa.Table:
    return _worked_off(table, ranked=True)


def _last(name: str, over) -> Column:
    return F.last(name, ignorenulls=True).over(over).alias(name)


def _banded(events: DataFrame, limit: int) -> DataFrame:
    """Pieces of the periods that are too large for one task, band by band; see the head of this module."""
    key = ["sale_id", "line_no", "q", "c", "d", "uid"]
    parts = events.count() // limit + 1
    whole = F.floor(F.col("c") / F.col("q")).cast("long")
    ours = events.filter("kind = 1").withColumn("whole", whole).withColumn("whole", F.expr("whole - if(whole * q > c, 1, 0)")).withColumn("part", (F.col("c") - F.col("whole") * F.col("q")) / F.col("q"))
    ours = ours.repartitionByRange(parts, *PERIOD, F.desc("whole"), F.desc("part"), "day", *key)
    ours = written(ours.withColumn("band", F.spark_partition_id().cast("long")).drop("whole", "part"), "lot-bands")
    back = events.filter("kind = 0").repartitionByRange(parts, *PERIOD, "day", *key)
    back = written(back.withColumn("chunk", F.spark_partition_id().cast("long")), "return-chunks")

    of_day = [*PERIOD, "day"]
    upto = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    chunks = back.groupBy(*of_day, "chunk").agg(F.sum("u").alias("total"), F.count("*").alias("n"))
    w = upto(of_day, "chunk")
    chunks = chunks.withColumn("off", F.sum("total").over(w) - F.col("total")).withColumn("n_off", F.sum("n").over(w) - F.col("n"))

    # What is in stock when a day begins, in the best bands up to each.
    put, out = ours.groupBy(*PERIOD, "band", "day").agg(F.sum("q").alias("put")), chunks.groupBy(*of_day).agg(F.sum("total").alias("out"))
    days = put.select(*of_day).unionByName(out.select(*of_day)).distinct()
    grid = put.select(*PERIOD, "band").distinct().join(days, PERIOD).join(put, [*PERIOD, "band", "day"], "left").join(out, of_day, "left").fillna(0, ["put", "out"])
    grid = grid.withColumn("put", F.sum("put").over(upto(of_day, "band")))
    w = upto([*PERIOD, "band"], "day")
    grid = grid.withColumn("free", F.sum(F.col("put") - F.col("out")).over(w) - F.col("put")).withColumn("evening", _reflected("free", w) + F.col("put"))
    grid = grid.withColumn("hi", F.lag("evening", 1, 0).over(Window.partitionBy(*PERIOD, "band").orderBy("day"))).filter("out > 0")
    grid = grid.withColumn("lo", F.lag("hi", 1, 0).over(Window.partitionBy(*of_day).orderBy("band")))
    empty = out.join(grid.groupBy(*of_day).agg(F.max("hi").alias("lo")), of_day, "left").select(*of_day, F.lit(-1).cast("long").alias("band"), F.coalesce("lo", F.lit(0)).cast("long").alias("lo"))
    bands = grid.filter("hi > lo").select(*of_day, "band", "lo").unionByName(empty)

    # Two intervals that overlap do so from the start of one of them: bands over chunks first, then over the returns of a chunk.
    span = F.struct("chunk", "off", "total", "n_off").alias("of")
    marks = chunks.select(*of_day, F.col("off").alias("pos"), span, F.lit(None).cast("struct<band: long, lo: long>").alias("b"))
    marks = marks.unionByName(bands.select(*of_day, F.col("lo").alias("pos"), F.lit(None).cast(marks.schema["of"].dataType).alias("of"), F.struct("band", "lo").alias("b")))
    w = Window.partitionBy(*of_day).orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    pairs = marks.select(*of_day, "pos", _last("of", w), _last("b", w)).filter("of is not null and pos < of.off + of.total").distinct()
    w = Window.partitionBy(*of_day, "chunk").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    numbered = back.withColumn("pos", F.sum("u").over(w) - F.col("u")).withColumn("rn", F.row_number().over(w)).join(chunks.select(*of_day, "chunk", "off", "total", "n_off"), [*of_day, "chunk"])
    numbered = numbered.withColumn("pos", F.col("off") + F.col("pos")).withColumn("number", F.col("number") + F.col("n_off") + F.col("rn"))
    row = F.struct("sale_id", "line_no", "q", "c", "d", "u", "uid", "number", "pos").alias("r")
    marks = numbered.select(*of_day, "chunk", "pos", (F.col("off") + F.col("total")).alias("end"), row, F.lit(None).cast("long").alias("band"))
    marks = marks.unionByName(pairs.select(*of_day, F.col("of.chunk").alias("chunk"), F.greatest("pos", "of.off").alias("pos"), F.expr("of.off + of.total").alias("end"), F.lit(None).cast(marks.schema["r"].dataType).alias("r"), F.col("b.band").alias("band")))
    here = Window.partitionBy(*of_day, "chunk").orderBy("pos")
    w = here.rangeBetween(Window.unboundedPreceding, 0)
    cut = marks.select(*of_day, "chunk", "pos", F.coalesce(F.lead("pos").over(here), "end").alias("upto"), _last("r", w), _last("band", w)).filter("upto > pos")
    cut = cut.select(*of_day, "band", F.when(F.col("band") < 0, F.col("chunk")).alias("chunk"), F.lit(0).alias("kind"), "r.sale_id", "r.line_no", "r.q", "r.c", "r.d", (F.col("upto") - F.col("pos")).alias("u"), "r.number", (F.col("pos") - F.col("r.pos")).alias("at"))

    rows = cut.unionByName(ours.select(*PERIOD, "day", "band", F.lit(None).cast("long").alias("chunk"), "kind", "sale_id", "line_no", "q", "c", "d", "u", F.lit(0).cast("long").alias("number"), F.lit(0).cast("long").alias("at")))
    # What no lot gives needs no lots either: it stays dealt by chunks.
    pieces = rows.groupBy(*PERIOD, "band", "chunk").applyInArrow(_of_bands, PIECES)
    return pieces.withColumn("piece_no", F.row_number().over(Window.partitionBy("client_id", "item_id", "return_no").orderBy("piece_no")).cast("long"))


def matched(lines: DataFrame, sales: DataFrame, limit: int = LIMIT) -> DataFrame:
    """PIECES: one row for each piece of a return, that is for each lot it takes units from, and for units that no lot gave."""
    ready(lines.sparkSession)
    events = written(with_returns(lines, sales), "lot-events")
    days = busy_days(events)
    slots = packed(days, events.count(), limit)
    period = F.when(F.col("kind") == 1, F.col("lot_period")).otherwise(F.col("return_period"))
    placed = events.join(days.select("client_id", "item_id", "day", "lot_period", "return_period", "before"), ["client_id", "item_id", "day"]).withColumn("period", period)
    placed = placed.join(slots, PERIOD).select(*_EVENT, "period", "slot", F.col("before").alias("number"))
    placed = written(placed, "lot-periods")
    zero = F.lit(0).cast("long")
    usual = placed.filter("slot is not null").withColumn("u", F.coalesce("u", zero)).withColumn("band", zero).withColumn("at", zero)
    out = usual.groupBy("slot").applyInArrow(_of_periods, PIECES)
    large = placed.filter("slot is null")
    return out if large.isEmpty() else out.unionByName(_banded(large.withColumn("u", F.coalesce("u", zero)), limit))


def op12_lot_matching(spark, sf_dir: str) -> DataFrame:
    return matched(spark.read.parquet(f"{sf_dir}/sale_lines.parquet"), spark.read.parquet(f"{sf_dir}/sales.parquet"))
