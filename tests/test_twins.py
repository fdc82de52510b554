"""Queries over documents where loads share their id: each has its own document, and the SQL says what becomes of them together."""

import duckdb
import pytest

from loadlark.queries import ORACLES, QUERIES
from loadlark.sources.views import LOADS_SQL

from .conftest import DATA, TABLES, same_rows


@pytest.fixture(scope="module")
def twin_dir(tmp_path_factory):
    """A few orders, whose line items come twice: half of them with another price and date, which the id doesn't hold."""
    folder, con = str(tmp_path_factory.mktemp("twins")), duckdb.connect()
    for t in TABLES:
        rows = f"SELECT * FROM '{DATA}/{t}.parquet'"
        if t == "lineitem":
            rows = f"WITH l AS ({rows} WHERE l_orderkey < 40) SELECT * FROM l UNION ALL SELECT * FROM l WHERE l_orderkey % 2 = 0"
            rows += " UNION ALL SELECT * REPLACE (l_extendedprice + 1000 AS l_extendedprice, l_shipdate + INTERVAL 1 DAY AS l_shipdate) FROM l WHERE l_orderkey % 4 = 1"
        con.execute(f"COPY ({rows}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return folder


@pytest.fixture(scope="module")
def odd_dir(tmp_path_factory):
    """A few orders, of which each two that follow each other have loads of one id: line 10 of the first is line 0 of the second."""
    folder, con = str(tmp_path_factory.mktemp("odd")), duckdb.connect()
    for t in TABLES:
        rows = f"SELECT * FROM '{DATA}/{t}.parquet'"
        if t == "lineitem":
            rows = f"WITH l AS ({rows} WHERE l_orderkey < 20) SELECT * FROM l UNION ALL SELECT * REPLACE (10 AS l_linenumber) FROM l UNION ALL SELECT * REPLACE (l_orderkey + 1 AS l_orderkey, 0 AS l_linenumber) FROM l"
        con.execute(f"COPY ({rows}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return folder


def equals_sql(name, spark, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    same_rows(QUERIES[name](spark, folder), con.sql(ORACLES[name]))


@pytest.mark.parametrize("name", ["table_semantics", "candidate_fusion", "layout_neighbours", "table_stops"])
def test_ids_that_do_not_tell_their_order_equal_sql(name, spark, odd_dir):
    equals_sql(name, spark, odd_dir)


@pytest.mark.parametrize("name", ["table_semantics", "candidate_fusion", "layout_neighbours", "table_stops"])
def test_only_loads_are_dealt_out(name, spark, sf_dir):
    """Lines meet their order once; what is read from a load stays where the load is."""
    few = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10000")  # suppliers, but not line items
    try:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", few)
    assert "hashpartitioning(l_orderkey" in plan and "hashpartitioning(load_id" not in plan and "hashpartitioning(order_no" not in plan


@pytest.mark.parametrize("name", ["candidate_fusion", "gold_metrics", "loss_boundaries", "normalized_stops", "pasted_fields", "repair_target", "stop_spans", "layout_neighbours", "resolve_rates", "rate_equivalence", "money_candidates", "identity_candidates", "table_semantics", "table_stops"])
def test_loads_that_share_an_id_equal_sql(name, spark, twin_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{twin_dir}/{t}.parquet'")
    same_rows(QUERIES[name](spark, twin_dir), con.sql(ORACLES[name]))


def test_equal_amounts_are_counted_in_each_document(spark, twin_dir):
    """Documents that share a load id have rows of their own, as many as their own amounts differ."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{twin_dir}/{t}.parquet'")
    amounts = "list_filter([rate - empty_miles, empty_miles, rate, weight // 100], lambda x: x >= 0)"
    wanted = con.execute(f"WITH {LOADS_SQL} SELECT sum(len(list_distinct({amounts}))), sum(len({amounts})) FROM loads").fetchone()
    assert QUERIES["rate_equivalence"](spark, twin_dir).selectExpr("count(*)", "sum(n)").first() == wanted


def test_each_document_has_its_own_stops(spark, twin_dir):
    """A pickup and a delivery for each line item, also where documents share a load id."""
    lines = spark.read.parquet(f"{twin_dir}/lineitem.parquet").count()
    assert QUERIES["stop_spans"](spark, twin_dir).count() == 2 * lines
