"""Times against a parser and zones of plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

import pytest

from acyclica.llm import timestamps

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
DATES = [r"(?P<y>20\d\d)-(?P<m>\d\d)-(?P<d>\d\d)", r"(?P<y>20\d\d)(?P<m>\d\d)(?P<d>\d\d)", r"(?P<d>\d\d)\.(?P<m>\d\d)\.(?P<y>20\d\d)", rf"(?P<d>\d\d) (?P<b>{'|'.join(MONTHS)}) (?P<y>20\d\d)", r"(?P<p>\d\d)/(?P<q>\d\d)/(?P<y>20\d\d)"]
CLOCK = r"(?:[T ](?P<h>\d\d):(?P<mi>\d\d)(?::(?P<s>\d\d))?(?: ?(?P<half>[AP]M))?(?: ?(?P<o>Z|[+-]\d\d:?\d\d))?)?"


def read(raw, zone):
    """None, an epoch in microseconds, or (readings by order, clock, own offset, zone)."""
    text = (raw or "").strip(" \t\n\x0b\x0c\r")
    if re.fullmatch(r"[0-9]{10}|[0-9]{13}", text, re.A):
        return int(text) * (1_000_000 if len(text) == 10 else 1000)
    m = next((m for d in DATES if (m := re.fullmatch(d + CLOCK, text, re.A))), None)
    if m is None:
        return None
    g = m.groupdict()
    month = MONTHS.index(g["b"]) + 1 if g.get("b") else None
    orders = [("dm", g["p"], g["q"]), ("md", g["q"], g["p"])] if g.get("p") else [("fixed", g["d"], month or g["m"])]
    dates = {}
    for name, d, mo in orders:
        try:
            dates[name] = datetime(int(g["y"]), int(mo), int(d))
        except ValueError:
            pass
    h, mi, s = (int(g[k] or 0) for k in ("h", "mi", "s"))
    if not dates or mi > 59 or s > 59 or not (1 <= h <= 12 if g["half"] else h <= 23):
        return None
    h = h % 12 + 12 * (g["half"] == "PM") if g["half"] else h
    own = None
    if g["o"]:
        digits = g["o"][1:].replace(":", "")
        hours, minutes = (int(digits[:2]), int(digits[2:])) if digits else (0, 0)
        if hours > 14 or minutes > 59:
            return None
        own = timedelta(minutes=(-1 if g["o"][0] == "-" else 1) * (hours * 60 + minutes))
    elif zone not in available_timezones():
        return None
    return dates, timedelta(hours=h, minutes=mi, seconds=s), own


def expected(rows):
    parsed = [(i, s, z, read(raw, z)) for i, s, z, raw in rows]
    votes = Counter((s, *p[0]) for _, s, _, p in parsed if isinstance(p, tuple) and len(p[0]) == 1 and "fixed" not in p[0])
    out = []
    for i, source, zone, p in parsed:
        if p is None or isinstance(p, int):
            out.append((i, p, "bad" if p is None else "epoch", False))
            continue
        dates, clock, own = p
        rule, day = "plain", next(iter(dates.values()))
        if len(set(dates.values())) == 2:
            dm, md = votes[source, "dm"], votes[source, "md"]
            rule, day = ("votes", dates["dm"]) if dm > 3 * md else ("votes", dates["md"]) if md > 3 * dm else ("default", dates["md"])
        wall, odd = day + clock, False
        if own is None:
            tz = ZoneInfo(zone)
            own, late = (wall.replace(tzinfo=tz, fold=f).utcoffset() for f in (0, 1))
            odd = own != late  # fold 0 has the offset before the change, for skipped and repeated times
        out.append((i, ((wall - own).replace(tzinfo=UTC) - EPOCH) // timedelta(microseconds=1), rule, rule in ("votes", "default") or odd))
    return out


def stamps(n: int, seed: int):
    draw = random.Random(seed)
    zones = ["UTC", "Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Lord_Howe", "Pacific/Apia", "Africa/Casablanca"]
    odd = ["2024-03-10 02:30", "2024-11-03T01:15:00", "2024-03-31 02:00", "2024-10-27 02:59:59", "2011-12-30 10:00", "2024-04-07 01:45", "2024-10-06 02:10", "2000-01-01", "2099-12-31 23:59:59"]
    bad = [None, "", "24:00", "2024-01-01 24:00", "2024-01-01 10:60", "2024-13-01", "31/02/2024", "30/02/2024 10:00", "1999-01-01", "2024-1-1", "2024-01-01 00:30 AM", "2024-01-01 13:00 PM", "2024-01-01 10:00 +15:00", "2024-01-01 10:00 +01:60", "01 jan 2024", "2024-01-01\x0010:00", "12345678901", "2024-01-01T", "x" * 100_000, "2024-01-01|10:00", "٢٠٢٤-01-01"]
    good = ["1714521600", "1714521600123", " 20240229T10:11Z ", "2024-02-29 12:00 AM", "2024-02-29 12:00PM -0330", "29 Feb 2024 01:02:03 PM +14:59", "\t05.06.2024\r\n", "07/07/2024", "03/04/2024 +01:00", "03/04/2024 10:00+01:00"]
    rows = []
    for _ in range(n):
        kind = draw.random()
        if kind < 0.4:
            raw = f"{draw.randint(1, 31):02}/{draw.randint(1, 14):02}/2024 {draw.randint(0, 23):02}:{draw.randint(0, 59):02}"
            raw = raw if draw.random() < 0.6 else f"{raw[3:5]}/{raw[:2]}{raw[5:]}"
        elif kind < 0.7:
            raw = draw.choice(odd)
        else:
            raw = draw.choice(bad + good)
        rows.append((draw.choice(["a", "a", "a", "b", "c", None, *map(str, range(20))]), draw.choice([*zones, *zones[:3], None, "Nowhere/None"]), raw))
    rows += [("hot", "Europe/Berlin", "2024-03-31 02:30")] * n
    return [(i if i % 50 else None if i % 100 else i, *r) for i, r in enumerate(rows)]


KIND = "stamp_id long, source string, zone string, raw string"
key = lambda r: (r[0] is None, r[0] or 0, str(r))


@pytest.mark.parametrize(("block", "frequent", "partitions"), [(1000, 200, 4), (2, 1, 23)])
def test_against_plain_python(spark, monkeypatch, block, frequent, partitions):
    monkeypatch.setattr(timestamps, "CARRY_BLOCK", block)
    monkeypatch.setattr(timestamps, "FREQUENT", frequent)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions < 10)
    try:
        rows = stamps(700, partitions)
        df = spark.createDataFrame(rows, KIND).withColumnRenamed("zone", "utc_us").withColumnRenamed("source", "rule").repartition(3)
        out = timestamps.normalise(df, zone="utc_us", source="rule")
        assert out.columns == ["stamp_id", "utc_us", "rule", "ambiguous", "offset_us", "change"]
        got = out.collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    want = expected(rows)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(want, key=key)
    assert {r["change"] for r in got} == {None, "gap", "overlap"}
    assert len({r[2] for r in want}) == 5


def test_transitions_of_a_zone():
    found = timestamps.transitions("Europe/Berlin")
    assert (1711846800, 3600, 7200) in found and (1729990800, 7200, 3600) in found and len(found) == 201
    assert timestamps.transitions("UTC")[1:] == []


def test_empty_table(spark):
    assert timestamps.normalise(spark.createDataFrame([], KIND)).collect() == []
