"""Sessions of clicks against a plain walk over each client's clicks."""

import datetime
import hashlib
import math
import random
from collections import defaultdict

import pytest

from tracemill.llm import sessions

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, client string, us long"
START = datetime.datetime(2024, 1, 1)
M = 60_000_000


def row(click_id, us, client, late=0, kind="view", value=1.0):
    ts = None if us is None else START + datetime.timedelta(microseconds=us)
    return (click_id, ts, None if ts is None or late is None else ts + datetime.timedelta(microseconds=late), client, kind, value, "x", 5)


def us_of(ts):
    return (ts - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)


def plain(rows):
    once = {}
    for r in rows:
        if None not in (r[0], r[1], r[3]):
            once.setdefault(r[0], r)
    clients = defaultdict(list)
    for r in once.values():
        clients[r[3]].append(r)
    out = set()
    for client, all_of in clients.items():
        late = [us_of(r[1]) for r in all_of if r[2] is not None and us_of(r[2]) - us_of(r[1]) > 15 * M]
        timely = sorted((us_of(r[1]), r[0], r[4] in ("purchase", "signup") and r[5] is not None and r[5] >= 60, r[5]) for r in all_of if r[2] is None or us_of(r[2]) - us_of(r[1]) <= 15 * M)
        found, closed = [], []
        for us, i, final, value in timely:
            reason = None
            if found:
                last = found[-1][-1]
                reason = "end" if last[2] else "gap" if us - last[0] >= 15 * M else "length" if us - found[-1][0][0] > 60 * M else None
            if not found or reason:
                if found:
                    closed.append(reason)
                found.append([])
            found[-1].append((us, i, final, value))
        if found:
            closed.append("end" if found[-1][-1][2] else "none")
        for n, s in enumerate(found):
            until = found[n + 1][0][0] if n + 1 < len(found) else math.inf
            cents = sum(0 if v is None or not math.isfinite(v) else math.floor(100 * v + 0.5) for *_, v in s)
            out.add((client, s[0][1], s[0][0], s[-1][0], len(s), sum(s[0][0] <= x < until for x in late), cents, closed[n], hashlib.sha256(",".join(str(x[1]) for x in s).encode()).hexdigest()))
    return out


def got(df):
    found = df.select(*sessions.RESULT).collect()
    assert len({r.session_id for r in found}) == len(found)
    return {tuple(r) for r in found}


def awkward():
    rng = random.Random(5)
    rows, i = [], 0
    for client, n, most in ((1, 900, 3 * M), (2, 60, 40 * M), (3, 300, 14 * M), (-4, 30, 1), (5, 200, 15 * M)):
        us = 0
        for _ in range(n):
            us += rng.choice([0, 1, most // 2, most, most, 15 * M if rng.random() < 0.05 else most])
            kind, value = rng.choice([("view", 70.0), ("purchase", 60.0), ("signup", 59.99), (None, 80.0), ("purchase", None), ("click", -3.335)])
            rows.append(row(i, us, client, rng.choice([0, None, 15 * M, 15 * M + 1, 40 * M]) if rng.random() < 0.2 else 0, kind if rng.random() < 0.1 else "view", value))
            i += rng.choice([1, 1, 3])
    # a dense second, a steady stream of days, ties, exact limits, a client with late clicks alone
    rows += [row(10_000 + k, 5 * M + k % 3, 6) for k in range(700)]
    rows += [row(20_000 + k, k * 10 * M, 7, 0 if k % 9 else 20 * M) for k in range(800)]
    rows += [row(30_000, 0, 8), row(30_001, 15 * M - 1, 8), row(30_002, 30 * M - 1, 8), row(30_003, 44 * M, 8), row(30_004, 58 * M, 8), row(30_005, 60 * M, 8), row(30_006, 60 * M + 1, 8)]
    rows += [row(40_000, 7, 9, 16 * M), row(40_001, 9, 9, 16 * M)]
    rows += [row(50_000, 5, 10, kind="purchase", value=99.0), row(50_001, 5, 10), row(50_002, 5, 10, 30 * M), row(50_003, 4, 10, 30 * M)]
    rows += [row(60_000, 0, 11, value=float("nan")), row(60_001, 1, 11, value=float("inf")), row(60_002, None, 11), row(60_003, 5, None), row(None, 5, 11), row(60_004, -90 * M, 11, value=1.005)]
    rows += rng.sample([r for r in rows if r[0] is not None], 200)  # repeated rows
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions,chunk", [(1, 1 << 14), (7, 64), (23, 16)])
def test_sessions(spark, monkeypatch, partitions, chunk):
    rows = awkward()
    monkeypatch.setattr(sessions, "CHUNK", chunk)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", chunk)
    try:
        assert got(sessions.sessionise(spark.createDataFrame(rows, CLICKS).repartition(3))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before[1])


def test_no_clicks(spark):
    assert got(sessions.sessionise(spark.createDataFrame([], CLICKS))) == set()
    assert got(sessions.sessionise(spark.createDataFrame([row(1, 0, None), row(2, None, 5)], CLICKS))) == set()


def test_copies_that_differ(spark):
    """Of rows that share an id one is taken, whichever partition they come from."""
    rows = [row(1, 0, 5), row(1, 99 * M, 6), row(2, 1, 5)]
    found = {frozenset(got(sessions.sessionise(spark.createDataFrame(rows, CLICKS).repartition(k)))) for k in (1, 2, 3)}
    assert len(found) == 1
    assert frozenset(plain(rows)) in found or frozenset(plain(rows[1:])) in found


def test_times_with_a_zone(spark):
    rows = [row(1, 0, 5), row(2, 20 * M, 5)]
    zoned = spark.createDataFrame(rows, CLICKS).selectExpr("click_id", "cast(ts as timestamp) ts", "cast(arrived_at as timestamp) arrived_at", "client_id", "kind", "value")
    assert got(sessions.sessionise(zoned)) == plain(rows)
