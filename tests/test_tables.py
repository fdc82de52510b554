"""Roles, headers and kinds of tables and the stops in them, on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from loadlark.operators import tables as B

CELL = "doc long, page int, table_id int, row int, col int, header boolean, text string, extra int"


def cells(spark, *tables, headers=()):
    """Tables as lists of rows of texts; header rows may be named."""
    return spark.createDataFrame([(1, 1, t, r, c, (r in headers) if headers else None, text, 0) for t, rows in enumerate(tables) for r, row in enumerate(rows) for c, text in enumerate(row)], CELL)


@pytest.mark.parametrize(
    ("text", "role"),
    [
        ("Load #", "load_identity"), ("Rate Confirmation #", "load_identity"), ("Carrier Pay", "rate"), ("PO #", "reference"), ("BOL", "reference"), ("Pickup_Date", "stop_role"), ("Appt", "date"), ("Window", "time"),
        ("Facility", "location"), ("10/02", "date"), ("8:30 PM", "time"), ("12 Main St", "location"), ("Gary, IN 46402", "location"), ("$1,200.00", "rate"), ("gary, in", "unknown"), ("", "unknown"), (None, "unknown"), ("x" * 100_000, "unknown"),
    ],
)
def test_cell_roles(spark, text, role):
    assert spark.createDataFrame([(text,)], "text string").select(B.cell_role(F.col("text"))).first()[0] == role


def test_header_kind_and_confidence(spark):
    got = B.table_semantics(cells(spark, [["Schedule"], ["Pickup Location", "Ship Date", "Time"]], [["Order no", "PO"], ["7", None]], [["Item", "Pay"], ["a", "12.50"]], [["a", "b"]], [[""], [""], [""], ["Stop"]]), "doc")
    told = {r.table_id: (r.header_row, r.header_roles, r.header_labels, r.kind, r.confidence, r.row_count, r.column_count) for r in got.collect()}
    assert told == {
        0: (1, "0:stop_role,1:date,2:time", "0:stop_role,1:date,2:time", "stop", 65, 2, 3),
        1: (0, "0:load_identity,1:reference", "0:order_number,1:reference_number", "load", 50, 2, 2),
        2: (1, "1:rate", "1:rate", "rate", 35, 2, 2),
        3: (None, "", "", "unrecognized", 0, 1, 2),
        4: (None, "", "", "stop", 0, 4, 1),  # a header stands in the first three rows
    }


def test_term_across_cells_and_repeated_cells(spark):
    rows = cells(spark, [["carrier", "pay"]])
    assert [(r.kind, r.column_count) for r in B.table_semantics(rows.unionAll(rows), "doc").collect()] == [("rate", 2)]


def stops(df):
    return [(r.table_id, r.row, r.sequence, r.stop_type, r.confidence, ",".join(f"{f.field}:{f.candidate}:{f.confidence}" for f in r.fields)) for r in df.orderBy("table_id", "row").collect()]


def test_stops_of_rows(spark):
    plain = cells(spark, [["Stop #", "Type", "Location", "Date"], ["3", "Pickup", "Gary, IN", "2024-01-02"], ["", "Drop", "Reno, NV", ""], ["9", "", "", ""]], headers=(0,))
    assert stops(B.table_stops(plain, "doc")) == [(0, 1, 3, "pickup", 90, "date:r1c3_date:90,location:r1c2_location:90"), (0, 2, 2, "delivery", 90, "location:r2c2_location:90")]


def test_dates_and_times_within_cells(spark):
    """In columns of other kinds before columns without a kind; never after an earlier one of the row."""
    rows = cells(spark, [["When", "Location", "Ref"], ["1/2/2024 8:00", "Gary 1/3/2024", "fcfs"]])
    assert stops(B.table_stops(rows, "doc")) == [(0, 1, 1, "stop", 55, "date:r1c1_date:82,location:r1c1_location:90,reference:r1c2_reference:90,time:r1c2_time:82")]
    rows = cells(spark, [["Location", "When"], ["Gary", "Jan 2, 2024 at 8:00"]])
    assert stops(B.table_stops(rows, "doc")) == [(0, 1, 1, "stop", 55, "date:r1c1_date:72,location:r1c0_location:90,time:r1c1_time:72")]


def test_tables_that_hold_no_stops(spark):
    one_kind = [["Location", "Who"], ["Gary", "x"]]
    money = [["Item", "Amount"], ["a", "1/2/2024"]]
    assert stops(B.table_stops(cells(spark, one_kind, money), "doc")) == []
    assert stops(B.table_stops(cells(spark), "doc")) == [] and B.table_semantics(cells(spark), "doc").count() == 0


def test_places_run_over_a_documents_tables(spark):
    t = [["Location", "Date"], ["Gary", "x"], ["Reno", "y"]]
    assert [s[:3] for s in stops(B.table_stops(cells(spark, t, t), "doc"))] == [(0, 1, 1), (0, 2, 2), (1, 1, 3), (1, 2, 4)]


def test_one_shuffle_of_cells(spark, capsys):
    """Cells are dealt out by table once; only the places among a document's stops need another shuffle."""
    B.table_semantics(cells(spark, [["Stop"]]), "doc").explain()
    assert capsys.readouterr().out.count("Exchange") == 1
    B.table_stops(cells(spark, [["Stop"]]), "doc").explain()
    assert capsys.readouterr().out.count("Exchange") == 2
