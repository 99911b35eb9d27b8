"""Times written in many ways, brought to one clock by a sweep.

Texts are parsed with column functions. Wall times without an offset of their
own are sorted by zone and time together with markers of the zones' transitions,
over range partitions; each task hands the last marker's offset on to the times
behind it, and what a partition begins with comes from the partitions before.
Inside a change, from the first wall time that it skips or repeats to the last,
the offset before it holds and the time is marked as a gap or an overlap.
"""

from __future__ import annotations

import calendar
from collections.abc import Iterator
from datetime import UTC, datetime
from zoneinfo import ZoneInfo, available_timezones

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acyclica.llm.shared import stored
from acyclica.llm.workers import lean

# Fixed values of the formats: dates, months and what may follow a date.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
YEAR, TWO = "(20[0-9][0-9])", "([0-9][0-9])"
DATES = [f"{YEAR}-{TWO}-{TWO}", f"{YEAR}{TWO}{TWO}", f"{TWO}[.]{TWO}[.]{YEAR}", rf"{TWO}\x20({'|'.join(MONTHS)})\x20{YEAR}", f"{TWO}/{TWO}/{YEAR}"]
CLOCK = rf"(?:[T\x20]{TWO}:{TWO}(?::{TWO})?(?:\x20?([AP]M))?(?:\x20?(Z|[+-]{TWO}:?{TWO}))?)?"
STAMP = rf"^(?:{'|'.join(DATES)}){CLOCK}$"
EPOCH = r"^(?:[0-9]{10}|[0-9]{13})$"
BLANKS = " \t\n\x0b\x0c\r"
GROUPS = 22

SECOND = 1_000_000
DAY = 86_400 * SECOND
#: Years whose transitions are marked: those that a stamp can be of, and what lies a day about them.
FIRST, LAST = 2000, 2100
#: A source with more than this share (one in so many) of the votable stamps is a frequent one; there are at most so many.
FREQUENT = 200
#: Partitions whose carries one task adds up.
CARRY_BLOCK = 1_000
#: How a time lies to a change of its zone's offset.
PLAIN, GAP, OVERLAP = 0, 1, 2


def parse(stamps: DataFrame, raw: str, zone: str, source: str, id_col: str) -> DataFrame:
    """One row for each stamp: id, source, zone (a known one, else null), epoch_us, dm and md (the days since 1970 of the date and, for slashed ones, of its two readings), clock_us, own_us (its own offset); all null where the stamp is bad."""
    text = F.btrim(F.col(raw), F.lit(BLANKS))
    # $ also matches before a final line end, which no trimmed text has
    parts = F.split(F.regexp_replace(text, STAMP, "|".join(f"${i}" for i in range(1, GROUPS + 1))), r"\|")
    known = F.col(zone).isin(sorted(available_timezones()))
    rows = stamps.select(
        F.col(id_col).alias("id"),
        F.col(source).alias("source"),
        F.when(known, F.col(zone)).alias("zone"),
        F.when(text.rlike(EPOCH), text).alias("_epoch"),
        F.when(text.rlike(STAMP), parts).alias("_p"),
    )
    p = lambda i: F.nullif(F.get("_p", F.lit(i - 1)), F.lit(""))

    def days(y: Column, m: Column, d: Column) -> Column:
        return F.unix_date(F.concat_ws("-", y, m, d).try_cast("date"))

    def date(y: int, m: int, d: int, month: Column | None = None) -> Column:
        return F.when(p(y).isNotNull(), days(p(y), p(m) if month is None else month, p(d)))

    number = lambda i: F.coalesce(p(i).try_cast("int"), F.lit(0))
    named = F.lpad(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), p(11)).cast("string"), 2, "0")
    hour, half = number(16), p(19)
    on_clock = F.when(half.isNull(), hour.between(0, 23)).otherwise(hour.between(1, 12)) & number(17).between(0, 59) & number(18).between(0, 59)
    hour24 = F.when(half.isNull(), hour).otherwise(hour % 12 + F.when(half == "PM", 12).otherwise(0))
    offset_ok = p(21).isNull() | (number(21).between(0, 14) & number(22).between(0, 59))
    sign = F.when(F.substring(p(20), 1, 1) == "-", -1).otherwise(1)
    fixed = F.coalesce(date(1, 2, 3), date(4, 5, 6), date(9, 8, 7), date(12, 11, 10, named))
    rows = rows.select(
        "id",
        "source",
        "zone",
        (F.col("_epoch").cast("long") * F.when(F.length("_epoch") == 10, SECOND).otherwise(1000)).alias("epoch_us"),
        F.coalesce(fixed, date(15, 14, 13)).alias("dm"),
        F.coalesce(fixed, date(15, 13, 14)).alias("md"),
        F.when(on_clock & offset_ok, (hour24 * 3600 + number(17) * 60 + number(18)).cast("long") * SECOND).alias("clock_us"),
        F.when(p(20).isNotNull(), (sign * (number(21) * 3600 + number(22) * 60)).cast("long") * SECOND).alias("own_us"),
    )
    good = F.col("clock_us").isNotNull() & (F.col("own_us").isNotNull() | F.col("zone").isNotNull())
    return rows.select("id", "source", "zone", "epoch_us", *[F.when(good, F.col(c)).alias(c) for c in ("dm", "md")], "clock_us", "own_us")


def votes(parsed: DataFrame) -> DataFrame:
    """(source, open, winner): how many stamps of a source need an order, and the one (dm, md or null) that has over three times the other's votes."""
    one = lambda a, b: F.count_if(F.col(a).isNotNull() & F.col(b).isNull())
    both = F.count_if(F.col("dm") != F.col("md"))
    counts = parsed.filter(F.coalesce(F.col("dm") != F.col("md"), F.lit(True))).groupBy("source").agg(one("dm", "md").alias("dms"), one("md", "dm").alias("mds"), both.alias("open"))
    winner = F.when(F.col("dms") > 3 * F.col("mds"), "dm").when(F.col("mds") > 3 * F.col("dms"), "md")
    return counts.filter("open > 0").select("source", "open", winner.alias("winner"))


def ordered(parsed: DataFrame) -> DataFrame:
    """parsed with day (the date that holds) and rule; the frequent sources' votes are broadcast (at most FREQUENT rows by their definition), the others' joined by source."""
    by_source = stored(votes(parsed), "stamp-votes")
    total = by_source.agg(F.sum("open")).first()[0] or 0
    is_open = F.coalesce(F.col("dm") != F.col("md"), F.lit(False))
    often = F.col("open") * FREQUENT > total
    frequent = by_source.filter(often).select(F.col("source").alias("_s"), F.struct("winner").alias("_frequent"))
    rare = by_source.filter(~often).select(F.col("source").alias("_s"), "winner")
    rows = parsed.filter(is_open).join(F.broadcast(frequent), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    hot = rows.filter(F.col("_frequent").isNotNull()).withColumn("winner", F.col("_frequent.winner")).drop("_frequent")
    rest = rows.filter(F.col("_frequent").isNull()).drop("_frequent").hint("merge").join(rare, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    voted = hot.unionByName(rest).withColumn("day", F.when(F.col("winner") == "dm", F.col("dm")).otherwise(F.col("md"))).withColumn("rule", F.when(F.col("winner").isNull(), "default").otherwise("votes"))
    rule = F.when(F.col("epoch_us").isNotNull(), "epoch").when(F.col("day").isNull(), "bad").otherwise("plain")
    plain = parsed.filter(~is_open).withColumn("day", F.coalesce("dm", "md")).withColumn("rule", rule)
    return plain.unionByName(voted.drop("winner"))


def transitions(zone: str) -> list[tuple[int, int, int]]:
    """(instant, offset before, offset after) in seconds of each change of the zone's offset; the first is that the zone begins."""
    tz = ZoneInfo(zone)
    at = lambda t: int(datetime.fromtimestamp(t, tz).utcoffset().total_seconds())
    begin, end, step = (calendar.timegm(datetime(FIRST, 1, 1, tzinfo=UTC).timetuple()) - 172_800, calendar.timegm(datetime(LAST, 1, 1, tzinfo=UTC).timetuple()) + 172_800, 21_600)
    found, t, now = [(begin, at(begin), at(begin))], begin, at(begin)
    while t < end:
        if (new := at(t + step)) != now:
            low, high = t, t + step
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if at(mid) == now else (low, mid)
            found.append((high, now, new))
            now = new
        t += step
    return found


MARK = "zone string, wall long, offset long, kind int"


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for zone in b.column(0).to_pylist():
            for i, (t, before, after) in enumerate(transitions(zone)):
                if i:
                    rows.append((zone, (t + min(before, after)) * SECOND, before * SECOND, GAP if after > before else OVERLAP))
                rows.append((zone, (t + max(before, after)) * SECOND, after * SECOND, PLAIN))
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["zone", "wall", "offset", "kind"])


def markers(zones: DataFrame) -> DataFrame:
    """(zone, wall, offset, kind): from that wall time on the zone has that offset; each change has one marker where its gap or overlap begins and one where it ends."""
    return zones.select("zone").filter("zone is not null").distinct().mapInArrow(_marks, MARK)


FILLED = "pid int, id {kind}, rule string, wall long, offset long, kind int, last boolean"


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gives each stamp the offset of the last marker before it in this partition (none: null), and one last row the offset that the partition ends with."""
    pid = TaskContext.get().partitionId()
    offset, kind, seen, types = 0, PLAIN, False, None
    for b in batches:
        names = b.schema.names
        types = b.schema
        mark = b.column(names.index("stamp")).to_numpy(zero_copy_only=False) == 0
        at = np.maximum.accumulate(np.where(mark, np.arange(len(b)), -1))
        own = at >= 0
        offsets = np.where(own, b.column(names.index("offset")).fill_null(0).to_numpy()[at], offset)
        kinds = np.where(own, b.column(names.index("kind")).fill_null(0).to_numpy()[at], kind)
        filled = own | seen
        if len(b):
            offset, kind, seen = int(offsets[-1]), int(kinds[-1]), bool(filled[-1])
        keep = pa.array(~mark)
        out = [
            pa.array(np.full(len(b), pid, np.int32)),
            b.column(names.index("id")),
            b.column(names.index("rule")),
            b.column(names.index("wall")),
            pa.array(offsets, pa.int64(), mask=~filled),
            pa.array(kinds.astype(np.int32), pa.int32(), mask=~filled),
            pa.array(np.zeros(len(b), bool)),
        ]
        yield pa.RecordBatch.from_arrays(out, names=["pid", "id", "rule", "wall", "offset", "kind", "last"]).filter(keep)
    if types is not None:
        one = lambda v, t: pa.array([v], t)
        yield pa.RecordBatch.from_arrays(
            [one(pid, pa.int32()), pa.nulls(1, types.field("id").type), one(None, pa.string()), one(None, pa.int64()), one(offset if seen else None, pa.int64()), one(kind if seen else None, pa.int32()), one(True, pa.bool_())],
            names=["pid", "id", "rule", "wall", "offset", "kind", "last"],
        )


def carries(ends: DataFrame) -> DataFrame:
    """(pid, offset, kind) that each partition begins with: the last offset that a partition before it ends with, added up within blocks of partitions and over the blocks' ends."""
    state = F.when(F.col("offset").isNotNull(), F.struct("offset", "kind"))
    rows = ends.select("pid", state.alias("state"), F.floor(F.col("pid") / CARRY_BLOCK).alias("block"))
    before = (Window.unboundedPreceding, -1)
    blocks = rows.filter("state is not null").groupBy("block").agg(F.max_by("state", "pid").alias("state"))
    ahead = rows.select("block").distinct().join(blocks, "block", "left").select("block", F.last("state", True).over(Window.orderBy("block").rowsBetween(*before)).alias("ahead"))
    inside = rows.withColumn("inside", F.last("state", True).over(Window.partitionBy("block").orderBy("pid").rowsBetween(*before)))
    return inside.join(ahead, "block").select("pid", F.coalesce("inside", "ahead").alias("state")).select("pid", "state.offset", "state.kind")


def sweep(times: DataFrame) -> DataFrame:
    """(id, rule, wall, offset, kind) for rows (id, rule, zone, wall) of known zones.

    Rows and markers are dealt by ranges of (zone, wall, row), so one zone, one
    time or one repeated row may be all of the table. What partitions end with
    is one row each.
    """
    kind = times.schema["id"].dataType.simpleString()
    marks = markers(times).select("zone", "wall", F.lit(0).alias("stamp"), F.lit(0).cast("long").alias("row"), F.lit(None).cast(kind).alias("id"), F.lit(None).cast("string").alias("rule"), "offset", "kind")
    rows = times.select("zone", "wall", F.lit(1).alias("stamp"), F.monotonically_increasing_id().alias("row"), "id", "rule", F.lit(None).cast("long").alias("offset"), F.lit(None).cast("int").alias("kind"))
    order = ["zone", "wall", "stamp", "row"]
    # stored before it is dealt: ranges are found in a pass of their own, and numbers must be the same in both
    both = stored(rows.unionByName(marks), "stamp-times")
    dealt = both.repartitionByRange(*order).sortWithinPartitions(*order)
    filled = stored(dealt.mapInArrow(lean(_fill), FILLED.format(kind=kind)), "stamp-sweep")
    stamps = filled.filter("not last")
    begun = stamps.filter("offset is null").drop("offset", "kind").hint("merge").join(carries(filled.filter("last")), "pid")
    columns = ["id", "rule", "wall", "offset", "kind"]
    return stamps.filter("offset is not null").select(columns).unionByName(begun.select(columns))


def normalise(stamps: DataFrame, raw: str = "raw", zone: str = "zone", source: str = "source", id_col: str = "stamp_id") -> DataFrame:
    """One row for each row of stamps: id, utc_us (microseconds since 1970 in UTC), rule (bad, epoch, votes, default, plain), ambiguous, offset_us (the offset that was taken off; null for epochs and bad ones), change (gap or overlap: the wall time is skipped or repeated by a change of its zone's offset, else null).

    Stamps that are null, empty, of any length but another form, or of no
    possible time are bad, and so are those without an offset whose zone is null
    or unknown; bad ones don't vote. A null source is a source. Repeated rows
    each get their row, null ids stay null, other columns aren't looked at,
    whatever their names. An empty table gives an empty result.
    """
    parsed = stored(parse(stamps, raw, zone, source, id_col), "stamp-parsed")
    rows = ordered(parsed).withColumn("wall", F.col("day").cast("long") * DAY + F.col("clock_us"))
    known = F.col("own_us").isNotNull() | F.col("epoch_us").isNotNull() | (F.col("rule") == "bad")
    direct = rows.filter(known).select("id", "rule", F.coalesce("epoch_us", F.col("wall") - F.col("own_us")).alias("utc_us"), F.when(F.col("rule").isin("bad", "epoch"), None).otherwise(F.col("own_us")).alias("offset"), F.lit(PLAIN).alias("kind"))
    swept = sweep(rows.filter(~known).select("id", "rule", "zone", "wall")).select("id", "rule", (F.col("wall") - F.col("offset")).alias("utc_us"), "offset", "kind")
    return direct.unionByName(swept).select(
        F.col("id").alias(id_col),
        F.when(F.col("rule") != "bad", F.col("utc_us")).alias("utc_us"),
        "rule",
        (F.col("rule").isin("votes", "default") | (F.col("kind") != PLAIN)).alias("ambiguous"),
        F.col("offset").alias("offset_us"),
        F.when(F.col("kind") == GAP, "gap").when(F.col("kind") == OVERLAP, "overlap").alias("change"),
    )
