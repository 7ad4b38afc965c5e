"""Every registered query of the engine against its SQL at the smallest scale."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from eventweave import queries as q

DATA = "/root/testdata/sf0.001"


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else r[i] for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{DATA}/events.parquet'")
    return c


@pytest.mark.parametrize("name", list(q.Q))
def test_query(spark, db, name):
    df = q.Q[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in q.SQL:
        rel = db.execute(q.SQL[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, rel.fetchall())


@pytest.mark.parametrize("odd", ["order", "times", "repeated", "ids"])
def test_freeze_on_odd_rows(spark, tmp_path, odd):
    """Times out of the order of ids, missing times, repeated rows and missing ids of purchases, as the SQL has them."""
    rng = random.Random(odd)
    kept = 0
    for n in range(4):
        times = sorted(datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(4 * 1440)) for _ in range(80))
        data = [(i, t, rng.randrange(3), rng.choice(["signup", "purchase", "view"]), 1.0, "{}") for i, t in enumerate(times)]
        if odd == "order":
            data = [(i, *r[1:]) for i, r in enumerate(sorted(data, key=lambda r: r[1] + timedelta(minutes=rng.randrange(1440))))]
        elif odd == "times":
            data = [(r[0], None, *r[2:]) if rng.random() < 0.1 and r[0] > 20 else r for r in data]
        elif odd == "repeated":
            data = [r for r in data for _ in range(rng.choice([1, 1, 2]))]
        else:
            data = [(None, *r[1:]) if r[3] == "purchase" and rng.random() < 0.2 else r for r in data]
        spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/{n}/events.parquet")
        db = duckdb.connect()
        db.execute(f"create view events as select * from '{tmp_path}/{n}/events.parquet/*.parquet'")
        rel = db.execute(q.SQL["freeze"])
        df = q.Q["freeze"](spark, f"{tmp_path}/{n}")
        want = rows([d[0] for d in rel.description], rel.fetchall())
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
        kept += len(want) > 0
    assert kept
