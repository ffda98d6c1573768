import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from evidelta.functions.bitmap import Bitmap
from evidelta.functions.text import fold_value
from evidelta.operators.comparison import differences

SIDE = "id bigint, k string, at timestamp, v string, w string, key string"


def brute(left, right):
    def latest(rows):
        best = {}
        for r in rows:
            rank = (r[2] is not None, r[2] or 0, r[0] is not None, r[0] or 0)
            if r[1] is not None and (r[1] not in best or rank > best[r[1]][0]):
                best[r[1]] = (rank, [None if x is None else x.strip().lower().replace(" ", "_") for x in r[3:5]])
        return {k: ["unknown" if x is None else x for x in v] for k, (_, v) in best.items()}

    a, b = latest(left), latest(right)
    out = {(k, "missing_in_right") for k in a.keys() - b.keys()} | {(k, "missing_in_left") for k in b.keys() - a.keys()}
    return out | {(k, n) for k in a.keys() & b.keys() for n, x, y in zip("vw", a[k], b[k]) if x != y}


def test_against_brute_force(spark):
    r = random.Random(5)
    values = [None, "", " ", "unknown", " Good Law\u2003", "good_law", "x" * 3000]

    def side(n):
        keys = ["hot"] * 3 + [None, "", *[f"k{i}" for i in range(300)]]
        # ids differ, so that the row that counts is the same for both
        return [(i, r.choice(keys), r.choice([None, datetime(2024, 1, 1) + timedelta(days=r.randrange(5))]), r.choice(values), r.choice(values), "z") for i in range(n)]

    for left, right in ((side(900), side(700)), (side(50), []), ([], side(50)), ([], [])):
        a, b = spark.createDataFrame(left, SIDE), spark.createDataFrame(right, SIDE)
        rows = differences(a, b, "k", {"v": fold_value(F.col("v")), "w": fold_value(F.col("w"))}, ["at", "id"], "missing_in_left", "missing_in_right").collect()
        assert {tuple(x) for x in rows} == brute(left, right) and len(rows) == len(set(rows))


def test_bitmaps_as_sets():
    r = np.random.default_rng(1)
    for _ in range(30):
        a, b = (r.integers(0, 300_000, r.integers(0, 60_000)) for _ in range(2))
        x, y = Bitmap.of(a), Bitmap.of(b)
        assert x.ordinals().tolist() == sorted(set(a.tolist())) and len(x) == len(set(a.tolist()))
        assert x.and_not(y).ordinals().tolist() == sorted(set(a.tolist()) - set(b.tolist()))
        assert (x & y).ordinals().tolist() == sorted(set(a.tolist()) & set(b.tolist()))
