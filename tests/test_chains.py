"""Reload chains against brute force, and the pairs that they are chosen from."""

import datetime as dt
import random
import re

from loadlark.operators import market as M
from loadlark.operators import memory as R

FIELDS = "driver string, load_id long, rate long, pickup string, delivery string, total_miles long, pickup_date date, strong boolean, good boolean, in_target boolean, in_city boolean"


def rows_of(n):
    rng, day = random.Random(4), dt.date(2024, 1, 1)
    return [(rng.choice("ab"), i, rng.randrange(0, 900, 50), rng.choice("XY"), rng.choice("XY"), rng.randrange(50, 500), day + dt.timedelta(rng.randrange(5)), True, True, rng.random() < 0.5, False) for i in range(n)]


def test_chains_equal_brute_force_and_meet_few_reloads(spark, capsys):
    rows = rows_of(400)
    near = {("X", "X"): 0, ("X", "Y"): 120, ("Y", "Y"): 0, ("Y", "X"): 95}
    want = {}
    for a in rows:
        if not a[9] and a[2] > 0:
            pairs = [((a[2] + b[2]) // 100 - near[a[4], b[3]] // 10, a[2] + b[2], -b[1], a[5] + b[5] + near[a[4], b[3]]) for b in rows if b[0] == a[0] and b[9] and 1 <= (b[6] - a[6]).days <= 3]
            if pairs:
                want[a[1]] = (a[0], *max(pairs))
    df = spark.createDataFrame(rows, FIELDS)
    cities = spark.createDataFrame([(d, p, m) for (d, p), m in near.items()], "delivery string, pickup string, miles long")
    chains = M.reload_chains(df, "driver", cities, k=1000)
    assert {r.first_id: (r.driver, r.chain_score, r.gross, -r.reload_id, r.miles) for r in chains.collect()} == want
    # the reloads are one of each driver, city and day before they are joined
    chains.explain("formatted")
    plan = capsys.readouterr().out
    assert re.search(r"Keys \[3\]: \[driver#\d+, reload_pickup#\d+, reload_date#\d+\]", plan)


def test_loads_that_share_a_number_each_keep_their_chain(spark):
    day = dt.date(2024, 1, 1)
    first = [("a", 1, rate, "Z", "X", 500, day, True, True, False, False) for rate in (3000, 9000)]
    reload = [("a", 2, 700, "X", "Y", 100, day + dt.timedelta(1), False, True, True, False)]
    near = spark.createDataFrame([("X", "X", 0)], "delivery string, pickup string, miles long")
    chains = M.reload_chains(spark.createDataFrame(first + reload, FIELDS), "driver", near).orderBy("place").collect()
    assert [(r.first_id, r.gross, r.reload_id) for r in chains] == [(1, 9700, 2), (1, 3700, 2)]


def test_unsent_goes_by_each_rows_own_keys(spark):
    loads = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "b", "y"), (2, None, "z"), (3, "c", None), (4, None, None)], "load_id long, key_a string, key_b string")
    sent = spark.createDataFrame([("a",), ("z",), ("a",), (None,)], "key string")
    assert sorted((r.load_id, r.key_a or "", r.key_b or "") for r in R.unsent(loads, sent, ["key_a", "key_b"]).collect()) == [(1, "b", "y"), (1, "b", "y"), (3, "c", ""), (4, "", "")]
    assert R.unsent(loads, sent.limit(0), ["key_a"]).count() == 6


def test_only_the_best_first_loads_of_a_delivery_and_day_meet_reloads(spark, capsys):
    cities = spark.createDataFrame([("X", "X", 0), ("X", "Y", 120), ("Y", "Y", 0), ("Y", "X", 95)], "delivery string, pickup string, miles long")
    df = spark.createDataFrame(rows_of(2000), FIELDS)
    whole = [r for r in M.reload_chains(df, "driver", cities, k=10_000).collect() if r.place <= 3]
    few = M.reload_chains(df, "driver", cities, k=3)
    assert sorted(map(str, few.collect())) == sorted(map(str, whole))
    few.explain("formatted")
    assert "WindowGroupLimit" in capsys.readouterr().out.split("Generate")[0]
