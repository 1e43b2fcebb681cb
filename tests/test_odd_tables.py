"""Queries over tables that lack what their reports count, against the same SQL."""

import duckdb
import pytest

from cellbasis.plans import queries, reports
from cellbasis.plans.registry import QUERIES, SQL


def rows(table):
    names = sorted(table.schema.names)
    return names, sorted(map(repr, zip(*[table.column(c).to_pylist() for c in names], strict=True)))


def agree(spark, folder, name):
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got, told = rows(QUERIES[name](spark, str(folder)).toArrow()), rows(con.sql(SQL[name]).to_arrow_table())
    assert got == told
    return got[1]


@pytest.fixture
def flat(tmp_path):
    """Ground, crowns and roofs on one terrace, so no step; every cell with a roof has ground too."""
    duckdb.sql(f"""COPY (SELECT CAST(i AS BIGINT) AS l_orderkey, CAST(i % 12 AS BIGINT) AS l_partkey, CAST(8 * f AS BIGINT) AS l_suppkey, CAST(1 AS INT) AS l_linenumber, CAST(1 AS DOUBLE) AS l_quantity,
        CASE f WHEN 0 THEN 'N' WHEN 1 THEN 'A' ELSE 'R' END AS l_returnflag, 'F' AS l_linestatus, TIMESTAMP '1996-01-01' AS l_shipdate FROM range(120) r(i), range(3) q(f)) TO '{tmp_path}/lineitem.parquet'""")
    return tmp_path


def test_report_of_no_step(spark, flat):
    assert agree(spark, flat, "sharp_report") == ["(0, nan, 0, None, None, None, None, None, 0)"]


def test_subsets_of_no_step(spark, flat):
    assert len(agree(spark, flat, "confounded_steps")) == 6


def test_checks_of_no_cell(spark, flat):
    got = agree(spark, flat, "filter_checks")
    assert sum("None, " in r for r in got) == 2


def test_a_catalogue_of_which_one_sortie_covers_the_area_is_not_refused(spark, tmp_path):
    """Ten tiles a footprint, two on each of five days: the selection is of one sortie."""
    duckdb.sql(f"COPY (SELECT CAST(i AS BIGINT) AS s_suppkey, CAST((i // 100) % 5 * 5 AS INT) AS s_nationkey FROM range(1000) r(i)) TO '{tmp_path}/supplier.parquet'")
    told = reports.triage(queries._tiles(spark, str(tmp_path)), queries.AOI)
    assert len(told["days"]) == 5 and told["refused"] is None and told["coverage"] == 1.0
