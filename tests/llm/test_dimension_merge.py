"""Versions against a plain replay of each client's changes."""

import random
import zlib
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from paperweave.llm.dimension_merge import Parts, merge_versions
from paperweave.llm.scratch import Scratch

SCHEMA = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double, CITY2 string"
START = datetime(2024, 1, 1)


def seconds(t):
    return (t - datetime(1970, 1, 1)) // timedelta(seconds=1)


def replay(rows, hours):
    low = lambda v: (v is not None, v if v is not None else 0)
    clients = {}
    for r in {tuple(r[:9]) for r in rows}:
        if r[4] is not None:
            early = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            at = seconds(r[4]) - (hours * 3600 if early else 0)
            clients.setdefault(r[1], []).append((*r[:4], at, *r[5:8], None if r[8] is None else int((100 * r[8] + 0.5) // 1)))
    out = []
    for client, changes in clients.items():
        rest = lambda c: tuple((x is not None, x if x is not None else "") for x in (c[3], *c[5:8])) + (low(c[8]),)
        by_seq, by_time = {}, {}
        for c in sorted((c for c in changes if c[3] in ("D", "I", "U")), key=lambda c: (low(c[0]), c[4], rest(c))):
            by_seq[c[2]] = c
        for c in sorted(by_seq.values(), key=lambda c: (low(c[2]), low(c[0]), rest(c))):
            by_time[c[4]] = c
        versions, state = [], None
        for at in sorted(by_time):
            c = by_time[at]
            new = (True, None, None, None, None) if c[3] == "D" else (False, *c[5:9])
            if c[3] == "U" and state is not None:
                new = (False, *[n if n is not None else o for n, o in zip(new[1:], state[1:], strict=True)])
            if new != state:
                versions.append((at, c[2], new))
            state = new
        for i, (at, seq, new) in enumerate(versions):
            to = versions[i + 1][0] if i + 1 < len(versions) else None
            n = len({c[0] for c in changes if c[0] is not None and c[4] >= at and (to is None or c[4] < to)})
            out.append((client, i + 1, at, to, new[0], *new[1:], seq, n))
    return out


def check(spark, rows, hours=240):
    got = [tuple(r) for r in merge_versions(spark.createDataFrame(rows, SCHEMA).repartition(3), hours).collect()]
    assert sorted(got, key=repr) == sorted(replay(rows, hours), key=repr)
    return got


def drawn(seed, n, clients):
    r = random.Random(seed)
    pick = lambda *v: r.choice(v)
    rows = []
    for i in range(n):
        client = 1 if r.random() < 0.4 else r.randrange(clients)
        at = None if r.random() < 0.03 else START + timedelta(hours=r.randrange(600))
        rows.append((i if r.random() < 0.95 else None, client if r.random() < 0.97 else None, r.randrange(n) if r.random() < 0.95 else None, pick("I", "U", "U", "U", "D", None, "X") if r.random() < 0.3 else "U", at, pick("a", "b", None), pick("x", None), pick("é", "f", None), pick(1.005, -2.5, None, 7.0), "extra"))
    return rows + r.sample(rows, n // 10)


@pytest.mark.parametrize("seed", range(2))
def test_drawn_changes(spark, seed):
    got = check(spark, drawn(seed, 400, 12))
    assert max(v[1] for v in got) > 20


def test_one_client_over_all_parts(spark):
    """Versions go on from part to part, and from parts that set only some attributes."""
    rows = [(i, 7, i, "I" if i == 0 else "D" if i in (301, 302) else "U", START + timedelta(hours=i), "a" if i == 0 else None, "s" if i in (0, 350) else None, None, float(i // 40) if i < 200 else None, "") for i in range(400)]
    got = check(spark, rows, hours=0)
    assert [g[2] for g in sorted(got, key=lambda g: g[1])] == [seconds(START + timedelta(hours=i)) for i in (0, 40, 80, 120, 160, 301, 303, 350)]


def test_rules(spark):
    at = lambda h: START + timedelta(hours=h)
    # equal seq: the largest change_id; equal times: the largest seq; nothing comes back from before a delete
    rows = [
        (10, 1, 1, "I", at(0), "a", "s", "c", 1.0, ""),
        (11, 1, 1, "I", at(1), "b", "s", None, 1.0, ""),
        (12, 1, 2, "U", at(5), None, None, "d", None, ""),
        (13, 1, 3, "U", at(5), None, "t", None, None, ""),
        (14, 1, 4, "D", at(6), "x", "x", "x", 9.0, ""),
        (15, 1, 5, "U", at(7), None, "u", None, None, ""),
        (16, 1, 6, "U", at(8), None, None, None, None, ""),
        (17, 1, 7, None, at(9), "q", "q", "q", 3.0, ""),
    ]
    got = sorted(check(spark, rows, hours=0))
    assert [(g[2] - seconds(START), g[4], *g[5:9]) for g in got] == [(3600, False, "b", "s", None, 100), (18000, False, "b", "t", None, 100), (21600, True, None, None, None, None), (25200, False, None, "u", None, None)]
    assert [g[-1] for g in got] == [1, 2, 1, 3]


def test_awkward_tables(spark):
    assert merge_versions(spark.createDataFrame([], SCHEMA)).count() == 0
    none = (None,) * 10
    assert merge_versions(spark.createDataFrame([none, none], SCHEMA)).count() == 0
    check(spark, [(1, None, None, "I", START, None, None, None, float("1"), None), (None, None, None, "U", START, "z", None, None, None, None)], 0)
    named = spark.createDataFrame([(1, 5, 1, "I", START, "a", "s", "c", 1.5, "", "w", 2)], SCHEMA + ", _who string, at int")
    assert [tuple(r) for r in merge_versions(named).collect()] == [(5, 1, seconds(START), None, False, "a", "s", "c", 150, 1, 1)]


def test_zones_do_not_matter(spark):
    """A time without a zone is UTC whatever the session's zone is, one with a zone is an instant; fractions count."""
    old = spark.conf.get("spark.sql.session.timeZone")
    rows = [(1, 5, 1, "I", datetime(2024, 3, 31, 2, 30, 0, 250_000), "a", None, None, None, ""), (2, 5, 2, "U", datetime(2024, 3, 31, 2, 30, 0, 750_000), "b", None, None, None, "")]
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = merge_versions(spark.createDataFrame(rows, SCHEMA)).orderBy("version").collect()
        assert [(g.valid_from, g.valid_to, g.source) for g in got] == [(seconds(rows[0][4]), seconds(rows[0][4]), "a"), (seconds(rows[0][4]), None, "b")]
        instant = datetime(2024, 3, 31, 2, 30, tzinfo=timezone.utc)
        zoned = spark.createDataFrame([(1, 5, 1, "I", instant, "a", None, None, None, "")], SCHEMA.replace("timestamp_ntz", "timestamp"))
        assert merge_versions(zoned).first().valid_from == int(instant.timestamp())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_no_part_holds_a_client(spark):
    scratch = Scratch(spark)
    parts = Parts(scratch, spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("t")), ["k"], ["t"])
    sizes = [r["count"] for r in parts.rows.groupBy("_part").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 3 * 20_000 / len(sizes)
    some = parts.rows.withColumn("v", F.when(F.col("t") % 5000 == 0, F.col("t")))
    got = parts.before(some, ["v"]).collect()
    assert all(r._before_v == (None if r.t == 0 else (r.t - 1) // 5000 * 5000) for r in got)
