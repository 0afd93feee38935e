"""Queries against their SQL on tables whose keys the driver's smallest ones don't have."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry_point
from loomline.functions import fixed


def differing(spark, folder, name, **tables):
    """Rows that only the query has, and rows that only its SQL has."""
    connection = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(pa.table(rows) if isinstance(rows, dict) else rows, f"{folder}/{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    found = entry_point.queries()[name](spark, str(folder))
    result = connection.execute(f"SELECT {', '.join(found.columns)} FROM ({entry_point.oracle_sql()[name]})").fetchall()
    rows = [tuple(r) for r in found.collect()]
    assert rows
    return sorted(set(rows) - set(result)), sorted(set(result) - set(rows)), len(rows) - len(result)


@pytest.fixture(scope="module")
def orders():
    """Orders of customers whose keys are listed subjects' ids, in the season that pages ask for."""
    customers = [*fixed.FOREIGN_SUBJECTS, *fixed.NON_TV_SUBJECTS, *fixed.REVIEWED_SUBJECTS]
    return duckdb.sql(
        f"SELECT k AS o_orderkey, {customers}[k % {len(customers)} + 1]::BIGINT AS o_custkey, ['F', 'O', 'P'][k % 3 + 1] AS o_orderstatus, 150000.0::DOUBLE AS o_totalprice, TIMESTAMP '1998-04-01' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(100::BIGINT) t(k)"
    ).to_arrow_table()


@pytest.mark.parametrize("name", ["eligibility_rules", "page_of_current_season", "page_of_past_season", "update_summary", "audit_report", "rule_signals"])
def test_customers_are_on_no_list(spark, tmp_path, orders, name):
    assert differing(spark, tmp_path, name, orders=orders) == ([], [], 0)


def test_first_of_another_brand(spark, tmp_path):
    """Common words make no pairs; what is not known, meets nothing."""
    brands = ["a", "a", "b", None, "c", "b"]
    part = {
        "p_partkey": pa.array(range(1, 121), pa.int64()), "p_name": ["red ring" if k % 7 else "old ring red" for k in range(120)], "p_brand": [brands[k % 6] for k in range(120)],
        "p_size": pa.array([None if k % 11 == 0 else k % 5 for k in range(120)], pa.int32()),
    }
    assert differing(spark, tmp_path, "title_overlap_first_match", part=part) == ([], [], 0)
    plan = entry_point.queries()["title_overlap_first_match"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT (p_brand" not in plan  # no pairs that differ in it


@pytest.mark.parametrize("name", ["match_top1_margin", "match_confidence", "fuzzy_pairs"])
def test_pairs_of_parts(spark, tmp_path, monkeypatch, name):
    """Null names, kinds and prices, blocks larger than what a task holds at a time, and no join of pairs."""
    from loomline.plans import part_pairs

    monkeypatch.setattr(part_pairs, "CELLS", 100)
    names = ["red ring", "red rings", None, "old anvil", "red rink", ""]
    part = {
        "p_partkey": pa.array([7 * k % 97 for k in range(97)], pa.int64()), "p_name": [names[k % 6] for k in range(97)], "p_brand": [None if k == 5 else "ab"[k % 2] for k in range(97)],
        "p_type": [("x", None, "y")[k % 3] for k in range(97)], "p_size": pa.array([k % 3 if k else 9 for k in range(97)], pa.int32()), "p_retailprice": [None if k % 10 == 0 else float(k * k) for k in range(97)],
    }
    assert differing(spark, tmp_path, name, part=part) == ([], [], 0)
    assert "Join" not in entry_point.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["subject_candidates", "subject_matches"])
def test_parts_of_later_eras(spark, tmp_path, name):
    """Parts whose seasons are past the year 9999 meet those of their own season only."""
    keys = [*range(40), *range(256_000, 256_040), *range(1_199_960, 1_200_000)]
    part = {"p_partkey": pa.array(keys, pa.int64()), "p_name": ["red ring" if k % 3 else "old anvil" for k in keys], "p_brand": [f"b{k % 2}" for k in keys]}
    assert differing(spark, tmp_path, name, part=part) == ([], [], 0)
