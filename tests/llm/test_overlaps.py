"""Operator 12 against brute force over every pair."""

import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import duckdb
import pytest

from sitegrain.llm import overlaps
from sitegrain.llm.common import shared_dir

EPOCH = datetime(1970, 1, 1)
MICRO = timedelta(microseconds=1)
SALES, LINES, CLICKS = "sale_id bigint, client_id bigint, status string, sold_at timestamp_ntz", "sale_id bigint, shipped_at timestamp_ntz", "client_id bigint, ts timestamp_ntz, kind string"


def _relation(s, e, s2, e2):
    ends = 0 if e < e2 else 1 if e == e2 else 2
    return (("overlaps", "finished_by", "contains") if s < s2 else ("starts", "equals", "started_by") if s == s2 else ("during", "finishes", "overlapped_by"))[ends]


def _expected(sales, lines, clicks):
    slot = lambda t: (t - EPOCH) // timedelta(hours=6)
    times = defaultdict(list)
    for client, ts, kind in clicks:
        if client is not None and ts is not None:
            times[client].append((ts, kind))
    sessions = defaultdict(list)
    for client, rows in times.items():
        rows.sort(key=lambda r: r[0])
        first = last = rows[0][0]
        for ts, _ in [*rows[1:], (None, None)]:
            if ts is None or ts - last > timedelta(minutes=15):
                is_open = any(t == last and k == "error" for t, k in rows)
                sessions[client].append((slot(first), float("inf") if is_open else slot(last), zlib.crc32(b"%d" % ((first - EPOCH) // MICRO))))
                first = ts
            last = ts
    out = defaultdict(lambda: [0, None, 0])
    for sale, client, status, sold in sales:
        if client is None or sold is None:
            continue
        ends = [slot(sold), *(slot(t) for i, t in lines if i == sale and i is not None and t is not None)]
        s, e = slot(sold), float("inf") if status == "open" else max(ends)
        for s2, e2, crc in sessions[client]:
            if s2 <= e and s <= e2:
                row = out[sale, _relation(s, e, s2, e2)]
                shared = min(e, e2) - max(s, s2) + 1
                row[0] += 1
                row[1] = row[1] if shared == float("inf") else (row[1] or 0) + shared
                row[2] += crc
    return {k: tuple(v) for k, v in out.items()}


def _got(spark, sales, lines, clicks):
    frames = spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES), spark.createDataFrame(clicks, CLICKS)
    rows = overlaps.related_sales(*(f.selectExpr("*", "1 as key", "2 as s", "3 as c", "4 as granule") for f in frames)).collect()
    assert len({(r.sale_id, r.relation) for r in rows}) == len(rows)
    return {(r.sale_id, r.relation): (r.n_pairs, r.overlap_slots, r.sessions_crc) for r in rows}


def _random(draw, n, days):
    at = lambda: datetime(1969, 12, 20) + timedelta(microseconds=draw.randrange(days * 86_400_000_000))
    client = lambda: draw.choice([1, 1, 1, 1, 2, 3, 4, None])
    sales = [(draw.choice([i, i, i, i // 2, None]), client(), draw.choice(["open", "done", "done", None]), draw.choice([at(), at(), at(), None])) for i in range(n)]
    lines = [(draw.choice([draw.randrange(n), draw.randrange(n), None]), draw.choice([at(), at(), None])) for _ in range(2 * n)]
    clicks = []
    for _ in range(n):
        c, t = client(), at()
        for _ in range(draw.randrange(1, 6) if draw.random() < 0.9 else 400):
            clicks.append((c, draw.choice([t, t, t, t, None]), draw.choice(["view", "view", "error", None])))
            t += draw.choice([timedelta(minutes=15), timedelta(minutes=15, microseconds=1), timedelta(seconds=40), timedelta(0), timedelta(minutes=14)])
    return sales, lines, [*clicks, *clicks[:20]]


@pytest.mark.parametrize("seed, n, days, finest", [(1, 60, 30, 32), (2, 120, 900, 1), (3, 80, 6000, 4), (4, 150, 2, 2)])
def test_brute_force(spark, monkeypatch, seed, n, days, finest):
    monkeypatch.setattr(overlaps, "FINEST", finest)
    tables = _random(random.Random(seed), n, days)
    got, expected = _got(spark, *tables), _expected(*tables)
    assert got == expected and len({r for _, r in got}) >= (5 if days < 6000 else 3)


def test_sessions_reach_over_days(spark):
    start = datetime(2024, 1, 1, 22, 0, 0)
    clicks = [(1, start + timedelta(minutes=15 * i), "error" if i == 300 else "view") for i in range(301)] + [(2, start, "error"), (2, start, None), (2, start + timedelta(minutes=15, microseconds=1), "view")]
    rows = overlaps.sessions(spark.createDataFrame(clicks, CLICKS)).collect()
    micro = lambda t: (t - EPOCH) // MICRO
    assert sorted(map(tuple, rows)) == [
        (1, micro(start), micro(start + timedelta(minutes=4500)), True),
        (2, micro(start), micro(start), True),
        (2, micro(start + timedelta(minutes=15, microseconds=1)), micro(start + timedelta(minutes=15, microseconds=1)), False),
    ]


def test_edges(spark):
    t = datetime(2024, 3, 31, 2, 30)  # a time that many zones skip
    assert _got(spark, [], [], []) == {} and _got(spark, [(1, 1, "open", t)], [], []) == {} and _got(spark, [], [], [(1, t, "view")]) == {}
    sales, clicks = [(1, 1, "open", t), (1, 1, "open", t), (2, 1, "done", t), (3, None, "done", t), (4, 1, "done", None)], [(1, t, "error"), (1, t, "error"), (None, t, "view"), (1, None, "view")]
    got = _got(spark, sales, [(2, t - timedelta(days=9))], clicks)
    assert got == _expected(sales, [(2, t - timedelta(days=9))], clicks) and got[1, "equals"][:2] == (2, None)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert _got(spark, sales, [], clicks) == _expected(sales, [], clicks)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows = {(r.sale_id, r.relation): (r.n_pairs, r.overlap_slots, r.sessions_crc) for r in overlaps.op12_overlaps(spark, sf).collect()}
    con = duckdb.connect()
    read = lambda t, c: con.execute(f"select {c} from '{sf}/{t}.parquet'").fetchall()
    assert rows == _expected(read("sales", "sale_id, client_id, status, sold_at"), read("sale_lines", "sale_id, shipped_at"), read("clicks", "client_id, ts, kind"))
    for t in ("sales", "sale_lines", "clicks"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.execute(f"select sale_id, relation, n_pairs, overlap_slots, sessions_crc from ({overlaps.ORACLE})").fetchall()
    assert rows == {(a, b): (c, d, e) for a, b, c, d, e in found}


def test_empty_tables(spark):
    folder = f"{shared_dir(spark)}/none"
    for name, ddl in (("sales", SALES), ("sale_lines", LINES), ("clicks", CLICKS)):
        spark.createDataFrame([], ddl).write.parquet(f"{folder}/{name}.parquet")
    assert overlaps.op12_overlaps(spark, folder).collect() == []
