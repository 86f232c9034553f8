import random

import __spark_entry__ as entry
from millrace.operators import frames


def test_queries_have_sql_or_are_listed(spark):
    assert entry.entry(spark).count() == 1
    from millrace.plans.catalogue import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES)


def test_segment_plans(spark):
    rows = [(0, i, t, c) for i, (t, c) in enumerate((t, 13 if t % 2 == 0 else 7) for t in range(1, 10))]
    demo = spark.createDataFrame(rows, "demo_id int, idx long, tick int, cmd int")
    tick = {i: t for _, i, t, _ in rows}
    plan = lambda n: [(r.start_idx and tick[r.start_idx], r.end_tick) for r in frames.segment_plan(demo, n).orderBy("seg").collect()]
    last = frames.LAST_TICK
    assert plan(1) == [(None, last)]
    assert plan(3) == [(None, 2), (2, 6), (6, last)]
    assert plan(8) == [(None, 2), (2, 4), (4, 6), (6, 8), (8, last)]


def test_lifecycle_equals_a_fold(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(5), rnd.choice("ULD")) for i in range(400)]
    state, want = {}, {}
    for i, slot, op in rows:
        now = state.get(slot, "absent")
        if op == "U":
            now = "active"
        elif now == "active":
            now = {"L": "dormant", "D": "absent"}[op]
        state[slot] = want[i] = now
    got = frames.lifecycle(spark.createDataFrame(rows, "seq int, slot int, op string"), "slot", ["seq"]).collect()
    assert {r.seq: r.st for r in got} == want
