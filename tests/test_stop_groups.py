"""Stop groups against a plain chain written by hand, and stops against gold labels on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from loadlark.operators import gold as C
from loadlark.operators import stop_groups as S

TEXTS = ["group_id", "source_type", "page", "section", "stop_type", "sequence", "table_id", "row_index", "grouping_key"]


def group(group_id, fields="", source="section", **rest):
    """fields: `location:c1:0.9 date:c2:0.4`."""
    held = [dict(zip(("field", "candidate", "confidence"), (*f.split(":")[:2], float(f.split(":")[2])), strict=True)) for f in fields.split()]
    return dict.fromkeys(TEXTS, "") | {"group_id": group_id, "source_type": source, "page": "1", "fields": held, "tokens": []} | rest


def line(group_id, fields, section, kind, **rest):
    return group(group_id, fields, "single_line", section=section, stop_type=kind, **rest)


def cell(group_id, fields, kind="", table="t", row="1", **rest):
    return group(group_id, fields, "table_cell", stop_type=kind, table_id=table, row_index=row, section="STOP_TABLE", **rest)


P, D, M = "PICKUP_SECTION", "DELIVERY_SECTION", "MULTI_STOP_SECTION"
LOC, DATE, TIME = "location:a:0.9", "date:b:0.9", "time:c:0.9"
# groups; per stop: id, type, sequence, how it is found, sources, location, date, time; then noise and repeats
CASES = [
    ([line("a", LOC, P, "pickup"), line("b", DATE, P, "pickup")], [("line_cluster_1_pickup_section_pickup_2", "pickup", 1, "layout", 2, "resolved", "resolved", "missing")], 0, 0),
    ([line("a", LOC, P, "pickup"), line("b", LOC, D, "delivery")], [("a", "pickup", 1, "layout", 1, "resolved", "missing", "missing"), ("b", "delivery", 2, "layout", 1, "resolved", "missing", "missing")], 0, 0),
    ([line("a", LOC, P, "pickup", page="1"), line("b", DATE, P, "pickup", page="2")], [("a", "pickup", 1, "layout", 1, "resolved", "missing", "missing"), ("b", "pickup", 2, "layout", 1, "missing", "resolved", "missing")], 0, 0),
    ([line("a", LOC, P, "pickup", sequence="2"), line("b", LOC, P, "pickup", sequence="1")], [("b", "pickup", 1, "explicit", 1, "resolved", "missing", "missing"), ("a", "pickup", 2, "explicit", 1, "resolved", "missing", "missing")], 0, 0),
    ([line("a", LOC, "", "stop"), line("b", DATE, "", "stop")], [("line_cluster_1_unscoped_stop_2", "stop", 1, "layout", 2, "resolved", "resolved", "missing")], 0, 0),
    ([line("a", LOC, "", ""), line("b", DATE, "", "")], [("a", "unknown", 1, "layout", 1, "resolved", "missing", "missing"), ("b", "unknown", 2, "layout", 1, "missing", "resolved", "missing")], 0, 0),
    ([line("a", LOC, "", "", grouping_key="1|x|7"), line("b", DATE, "", "", grouping_key="1|x|8")], [("line_cluster_1_unscoped_unknown_2", "unknown", 1, "layout", 2, "resolved", "resolved", "missing")], 0, 0),
    ([cell("a", LOC, "pickup"), cell("b", DATE), cell("c", TIME)], [("t_row_1", "pickup", 1, "row", 3, "resolved", "resolved", "resolved")], 0, 0),
    ([cell("a", LOC, "pickup"), cell("b", DATE, "delivery")], [("t_row_1", "unknown", 1, "row", 2, "resolved", "resolved", "missing")], 0, 0),
    ([cell("a", LOC, "pickup", row="3"), cell("b", LOC, "delivery", row="2")], [("b", "delivery", 2, "row", 1, "resolved", "missing", "missing"), ("a", "pickup", 3, "row", 1, "resolved", "missing", "missing")], 0, 0),
    ([group("a", LOC, section=P, stop_type="pickup"), group("b", DATE, section=P, stop_type="pickup")], [("section_1_PICKUP_SECTION_pickup_section", "pickup", 1, "layout", 2, "resolved", "resolved", "missing")], 0, 0),
    ([group("a", LOC, section=P, stop_type=""), group("b", DATE, section=P, stop_type="unknown")], [("section_1_PICKUP_SECTION_unknown_section", "pickup", 1, "layout", 2, "resolved", "resolved", "missing")], 0, 0),
    ([group("a", LOC, section=M, stop_type="stop", sequence="1"), group("b", DATE, section=M, stop_type="stop", sequence="1")], [("section_1_MULTI_STOP_SECTION_stop_1", "unknown", 1, "explicit", 2, "resolved", "resolved", "missing")], 0, 0),
    ([group("a", LOC, section=M, stop_type="stop"), group("b", DATE, section=M, stop_type="stop")], [("a", "unknown", 1, "layout", 1, "resolved", "missing", "missing"), ("b", "unknown", 2, "layout", 1, "missing", "resolved", "missing")], 0, 0),
    ([group("a", LOC, section=M, stop_type="pickup", tokens=["Generic_Stop_Label"])], [("a", "unknown", 1, "layout", 1, "resolved", "missing", "missing")], 0, 0),
    ([group("a", DATE, section="LEGAL_TERMS"), group("b", f"{LOC} {DATE}", section="LEGAL_TERMS"), group("c", LOC, section="SIGNATURE_BLOCK"), group("d", "", section=D)], [("b", "unknown", 1, "layout", 1, "resolved", "resolved", "missing")], 3, 0),
    ([group("a", LOC, tokens=["Footer"]), group("b", "note:x:0.9"), group("c", "note:x:0.9", "table_row")], [("c", "unknown", 1, "layout", 1, "missing", "missing", "missing")], 2, 0),
    ([group("a", LOC, grouping_key="k"), group("b", LOC, grouping_key="k"), group("c", DATE, grouping_key="k"), group("d", LOC, grouping_key="j")], [("a", "unknown", 1, "layout", 1, "resolved", "missing", "missing"), ("c", "unknown", 2, "layout", 1, "missing", "resolved", "missing"), ("d", "unknown", 3, "layout", 1, "resolved", "missing", "missing")], 0, 1),
    ([cell("a", LOC, "pickup", page="1"), cell("b", LOC, "pickup", page="2"), cell("c", DATE, "pickup", page="3")], [("a", "pickup", 1, "row", 1, "resolved", "missing", "missing"), ("c", "pickup", 1, "row", 1, "missing", "resolved", "missing")], 0, 1),
    ([group("a", LOC, stop_type="pickup", sequence="1"), group("b", LOC, stop_type="pickup", sequence="1"), group("c", LOC, stop_type="unknown", sequence="1")], [("a", "pickup", 1, "explicit", 1, "resolved", "missing", "missing"), ("c", "unknown", 1, "explicit", 1, "resolved", "missing", "missing")], 0, 1),
    ([line("a", LOC, P, "pickup"), line("b", "location:z:0.8 date:b:0.3", P, "pickup")], [("line_cluster_1_pickup_section_pickup_2", "pickup", 1, "layout", 2, "conflict", "low_confidence", "missing")], 0, 0),
    ([line("a", LOC, P, "pickup"), line("b", "location:a:0.2", P, "pickup")], [("line_cluster_1_pickup_section_pickup_2", "pickup", 1, "layout", 2, "resolved", "missing", "missing")], 0, 0),
    ([group("a", DATE, section="LEGAL_TERMS")], [], 1, 0),
]


@pytest.fixture(scope="module")
def stops(spark):
    rows = [tuple([i, place, *(g[t] for t in TEXTS), g["tokens"], [tuple(f.values()) for f in g["fields"]]]) for i, (groups, *_) in enumerate(CASES) for place, g in enumerate(groups)]
    out = {}
    for r in S.normalize_stops(spark.createDataFrame(rows, S.GROUP)).collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_chain_on_hand_written_cases(i, stops):
    _, want, n_noise, n_repeats = CASES[i]
    got = sorted(stops.get(i, []), key=lambda r: r.stop)
    assert [(r.stop_id, r.stop_type, r.sequence, r.sequence_by, r.n_sources, r.location_status, r.date_status, r.time_status) for r in got] == want
    assert all((r.n_noise, r.n_repeats) == (n_noise, n_repeats) for r in got)
    for r in got:
        states = [r.location_status, r.date_status, r.time_status]
        assert r.n_resolved == states.count("resolved") and r.review_required == (r.n_resolved < 3 or r.stop_type == "unknown")


def test_null_texts_and_arrays_are_empty(spark):
    rows = spark.createDataFrame([(1, 0, "a", *[None] * 10), (2, 0, "b", "table_row", *[None] * 9)], S.GROUP)
    assert [(r.doc_id, r.stop_id, r.stop_type, r.location_status) for r in S.normalize_stops(rows).collect()] == [(2, "b", "unknown", "missing")]
    assert S.normalize_stops(rows.limit(0)).count() == 0


def test_one_shuffle_carries_the_chain(spark, capsys):
    rows = spark.createDataFrame([(1, 0, *[""] * 9, [], [])], S.GROUP)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        S.normalize_stops(rows).explain()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert capsys.readouterr().out.count("Exchange") == 1


NORMAL = [
    (C.normal_money, {"$1,250.5": "1250.50", " 7 ": "7.00", "abc": "", None: "", "2.345": "2.34", "-3": "-3.00"}),
    (C.normal_name, {"Acme Freight, LLC": "acme freight", "The Co. Company Inc": "the", "A&B  Logistics": "a b logistics", None: ""}),
    (C.normal_date, {"1/2/24": "2024-01-02", "11-05-2023": "2023-11-05", "2024-01-02": "2024-01-02", "Jan 3": "jan 3", None: ""}),
    (C.normal_time, {"8:00 AM": "08:00", "0800": "08:00", "800 pm": "20:00", "12:30 am": "00:30", "Appt 8:00 - 15:30": "08:00-15:30", "FCFS": "fcfs", "FCFS 7 am": "fcfs", "Noon ish": "noonish", "9999": "9999", None: "", "8:00–17:00": "08:00-17:00"}),
    (C.normal_place, {" St. Louis ": "st  louis", "MO": "mo", None: ""}),
]


@pytest.mark.parametrize("normal, cases", NORMAL, ids=[f.__name__ for f, _ in NORMAL])
def test_normal_forms(normal, cases, spark):
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in rows.select("t", normal(F.col("t")).alias("n")).collect()} == cases


def stop(**parts):
    return tuple(parts.get(p) for p in [*C.PARTS, "appointment_window"])


A, B = stop(city="Gary", state="IN", date="1/2/2024"), stop(city="Reno", state="NV")
COMPARED = [
    ([A], None, ("unlabeled", ["unlabeled"], 0, 0)),
    ([A], [stop(), None], ("unlabeled", ["unlabeled"], 0, 0)),
    (None, [A], ("missing", ["missing_stop"], 0, 0)),
    ([], [A], ("missing", ["missing_stop"], 0, 0)),
    ([stop(city="GARY.", state="in", date="2024-01-02")], [A], ("normalized_match", [], 1, 0)),
    ([B, A], [A, B], ("normalized_match", [], 2, 0)),
    ([A], [A, A], ("normalized_match", [], 2, 0)),
    ([A], [A, B], ("partial_match", ["missing_stop"], 1, 0)),
    ([B], [A], ("wrong_value", ["missing_stop"], 0, 0)),
    ([stop(city="Gary", state="OH")], [A], ("partial_match", ["missing_date", "wrong_state"], 0, 1)),
    ([stop(city="Gary"), stop(state="IN", city="x")], [A], ("partial_match", ["missing_date", "missing_state"], 0, 1)),
    ([stop(state="IN", city="x"), stop(city="Gary")], [A], ("partial_match", ["missing_date", "wrong_city"], 0, 1)),
    ([stop(time="8:00")], [stop(appointment_window="0800")], ("normalized_match", [], 1, 0)),
    ([A], [stop(facility="!!!")], ("wrong_value", ["missing_stop"], 0, 0)),
    ([None, A], [A], ("normalized_match", [], 1, 0)),
]


def test_stops_against_gold(spark):
    rows = spark.createDataFrame([(i, p, g) for i, (p, g, _) in enumerate(COMPARED)], f"i int, p array<{C.STOP}>, g array<{C.STOP}>")
    for r in rows.select("i", C.compare_stops(F.col("p"), F.col("g")).alias("c")).collect():
        assert (r.c.status, r.c.issues, r.c.n_exact, r.c.n_partial) == COMPARED[r.i][2], COMPARED[r.i]


ODD = ["", "  ", "\t", " Gary, IN. ", "St.  Louis", "İstanbul", "1/2/24\n", "1/2/24\r\n", "1/2/024", "12-31-2024", "1/2/2024 x", "815 pm", "\t8:00\n am", "12:30 am", "24:10", "appt 0800 - 9:75", "Time FCFS", "FC FS\xa0x",
       "é8:00", "8:00é", "é8:00", "–8:00", "\xbd8:00", "٣800", "\U000104008:00", "\U00010400́8:00", "_0800", "0800appt", "windoK 7:05", "8:00–17:00", None]


def test_forms_of_single_texts_equal_columns(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string")
    columns = {"city": C.normal_place, "date": C.normal_date, "time": C.normal_time}
    for r in rows.select("t", *(normal(F.col("t")).alias(p) for p, normal in columns.items())).collect():
        assert {p: C.FORMS[p]((r.t or "").strip(" ")) for p in columns} == {p: r[p] for p in columns}, repr(r.t)


def test_each_distinct_text_of_a_batch_is_read_once():
    import pyarrow as pa

    kind = pa.list_(pa.struct([(p, pa.string()) for p in [*C.PARTS, "appointment_window"]]))
    said = {"city": "Gary", "date": "2024-01-02"}
    wanted = [{"city": c, "date": "1/2/2024", "appointment_window": w} for c, w in (("GARY.", None), ("Reno", "0800"))]
    for form in C.FORMS.values():
        form.cache_clear()
    got = C._compare(pa.array([[said], [said], [], [None, said]] * 1000, kind), pa.array([wanted[:1], wanted, wanted, []] * 1000, kind)).to_pylist()
    assert [tuple(r.values()) for r in got] == [("normalized_match", [], 1, 0), ("partial_match", ["missing_time", "wrong_city"], 1, 1), ("missing", ["missing_stop"], 0, 0), ("unlabeled", ["unlabeled"], 0, 0)] * 1000
    read = {p: form.cache_info() for p, form in C.FORMS.items()}
    assert {p: r.hits + r.misses for p, r in read.items() if r.misses} == {"city": 3, "date": 2, "time": 1}


def test_comparison_runs_in_arrow_batches(spark, sf_dir, capsys):
    from loadlark.queries.documents import stop_comparison

    stop_comparison(spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan
