import random
from collections import Counter
from datetime import datetime, timedelta

from evidelta.operators import references

CHILD, PARENT = "id bigint, k string, loaded_at timestamp, _key string", "k string, loaded_at timestamp, deleted_at timestamp, _live string"


def brute(children, parents):
    return [c for c in children if c[1] is not None and not any(p[0] == c[1] and p[2] is None and p[1] is not None and c[2] is not None and p[1] <= c[2] for p in parents)]


def test_against_brute_force(spark):
    r = random.Random(3)
    day = lambda: r.choice([None, *[datetime(2024, 1, 1) + timedelta(hours=r.randrange(4000)) for _ in range(9)]])
    keys = [None, "", "hot", "hot", "hot", "x" * 5000, "x" * 4999 + "y", *[f"k{i}" for i in range(60)]]
    children = [(i, r.choice(keys), day(), "z") for i in range(3000)] + [(7, "hot", datetime(2024, 2, 1), "z")] * 3
    parents = [(r.choice(keys), day(), r.choice([None, datetime(2024, 5, 5)]), "z") for _ in range(60)]
    for ps in (parents, []):
        c, p = spark.createDataFrame(children, CHILD), spark.createDataFrame(ps, PARENT)
        rows = references.orphan_rows(c, "id", "k", p, "k").collect()
        want = brute(children, ps)
        assert Counter(x.row_id for x in rows) == Counter(w[0] for w in want)
        counts = {x.period: (x.references_n, x.orphans) for x in references.orphan_counts(c, "id", "k", p, "k").collect()}
        month = lambda x: x[2] and x[2].strftime("%Y-%m")
        every, lost = Counter(month(x) for x in children if x[1] is not None), Counter(map(month, want))
        assert counts == {m: (n, lost[m]) for m, n in every.items()}
    assert references.orphan_rows(spark.createDataFrame([], CHILD), "id", "k", p, "k").collect() == []


def test_months_are_of_utc_in_any_zone(spark):
    df = spark.createDataFrame([(1, "a")], "id bigint, k string").selectExpr("*", "timestamp'2024-01-31 23:30:00 UTC' AS loaded_at")
    none = spark.createDataFrame([], PARENT)
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert [x.period for x in references.orphan_rows(df, "id", "k", none, "k").collect()] == ["2024-01"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_the_remaining_keys_go_through_an_anti_join(spark):
    c, p = spark.createDataFrame([(1, "a", datetime(2024, 1, 1), "z")], CHILD), spark.createDataFrame([], PARENT)
    plan = references.orphan_rows(c, "id", "k", p, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") >= 3
