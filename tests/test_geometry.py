"""Joins of items by place, against all pairs of a page looked at one by one."""

import random

import pytest

from loadlark.operators import geometry as G

ITEM = "doc long, page int, item int, x0 int, y0 int, x1 int, y1 int, band string"


@pytest.fixture(scope="module")
def boxes():
    dice = random.Random(7)
    rows = [(d, p, n, x := dice.randrange(400), y := dice.randrange(300), x + dice.randrange(120), y + dice.choice([0, 8, 12, 150]), "clash") for d in (1, 2) for p in (1, 2) for n in range(40)]
    return [*rows, (1, 1, 90, 10, 64, 50, 128, "edge"), (1, 1, 91, 60, 128, 90, 192, "edge"), (1, 1, 92, None, None, None, None, None)]


def share(a, b):
    return min(a[6], b[6]) - max(a[4], b[4])


RULES = {
    "words_in_boxes": lambda a, b: b[3] >= a[3] and b[5] <= a[5] and b[4] >= a[4] and b[6] <= a[6],
    "lines_near": lambda a, b: abs((a[4] + a[6]) / 2 - (b[4] + b[6]) / 2) <= 30,
    "same_row": lambda a, b: share(a, b) > 0 and share(a, b) / ((a[6] - a[4]) or 1) >= 0.35,
    "right_of": lambda a, b: share(a, b) > 0 and share(a, b) / ((a[6] - a[4]) or 1) >= 0.35 and 0 <= b[3] - a[5] <= 240,
    "below": lambda a, b: 0 <= b[4] - a[6] <= 80 and min(a[5], b[5]) > max(a[3], b[3]),
}


@pytest.mark.parametrize("name", RULES)
def test_join_equals_all_pairs(name, spark, boxes):
    items = spark.createDataFrame(boxes, ITEM).drop("band")
    got = sorted((r.doc, r.page, r.anchor, r.item) for r in getattr(G, name)(items, items, "doc").collect())
    full = [b for b in boxes if b[3] is not None]
    assert got == sorted((a[0], a[1], a[2], b[2]) for a in full for b in full if a[:2] == b[:2] and a[2] != b[2] and RULES[name](a, b))
    assert getattr(G, name)(items.limit(0), items, "doc").count() == 0


def test_items_met_in_bands_are_those_of_the_joins_and_shuffle_once(spark, capsys):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    boxes = [(d, 1, i, x, y, x + rng.randrange(60), y + rng.randrange(12)) for d in (1, 2) for i in range(60) for x, y in [(rng.randrange(400), rng.randrange(300))]]
    items = spark.createDataFrame(boxes, "id long, page int, item long, x0 int, y0 int, x1 int, y1 int")
    met = G.met(items, "id", F.col("item") % 2 == 0, 36, 86)
    held = {"same_row": (G.same_row, G.is_beside), "right": (G.right_of, G.is_right), "below": (G.below, G.is_below), "near": (G.lines_near, G.is_near)}
    for joined, holds in held.values():
        got = met.select("id", F.col("a.item").alias("anchor"), F.explode(F.filter("others", lambda b: holds(F.col("a"), b))).alias("b")).select("id", "anchor", "b.item")
        want = joined(items.where("item % 2 = 0"), items, "id").select("id", "anchor", "item")
        assert want.count() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    met.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1


def test_documents_that_share_an_id_have_one_value_for_each_label(spark):
    from loadlark.operators import extract as X
    from loadlark.operators import layout as Y

    docs = spark.createDataFrame([(1, "Rate: $5\nDate: x"), (1, "Rate: $5\nDate: x"), (2, "Rate: $7")], "id long, text string")
    got = Y.label_values(Y.cells(X.lines(docs, "id", docs.text), "id"), "id")
    assert sorted(map(tuple, got.collect())) == [(1, "Date", "x", 92), (1, "Rate", "$5", 92), (2, "Rate", "$7", 92)]


def test_batches_of_texts_read_like_lines(spark):
    """document_values and document_amounts against the operators on lines, on texts of odd lines."""
    import random

    from pyspark.sql import functions as F

    from loadlark.operators import extract as X
    from loadlark.operators import layout as Y

    r = random.Random(5)
    parts = ["a: b", ": x", "Total: $1,200.50 and $3.25", "RATE", "TERMS of: $9.00", "", "fee: $40.00: late", "a: ", "no label", "PICKUP: here", "Line haul: $7.10", "Fuel: $-3.00", "ключ: $5.00", "a: " + "w" * 50]
    texts = [(i, "\n".join(r.choice(parts) for _ in range(r.randrange(30)))) for i in range(60)]
    docs = spark.createDataFrame(texts, "id long, text string")
    lines = X.lines(docs, "id", F.col("text"))
    wanted = ["a", "Total", "fee", "", "ключ"]
    ours = docs.select("id", F.explode(Y.document_values(F.array("text"), wanted)).alias("v")).select("id", "v.*")
    theirs = Y.label_values(Y.cells(lines, "id"), "id").where(F.col("label").isin(wanted)).select("id", "label", "value", "score")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, theirs.collect()))
    ours = docs.select("id", F.explode(X.document_amounts(F.array("text"))).alias("v")).select("id", "v.*")
    theirs = X.abstain(X.money_candidates(X.carry_section(lines, "id")), "id").select("id", "kind", "amount", "capped")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, theirs.collect()))
