"""Schedules are built from one sort by file, and headers are looked for once."""

import pytest
from conftest import SF_SMALL

from bomspark.operators.layout import file_header
from bomspark.sources.tables import odd_schedules, schedule_grids


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("made, aggregates", [(schedule_grids, 2), (odd_schedules, 1)])
def test_files_are_gathered_from_one_sort(spark, made, aggregates):
    text = plan(made(spark, SF_SMALL))
    assert text.count("SortAggregate(") == aggregates and text.count("Sort [") == 1, text
    assert "HashAggregate(" not in text


def test_headers_are_looked_for_once(spark):
    found = file_header(schedule_grids(spark, SF_SMALL))
    assert "Filter isnotnull(CASE" not in plan(found)
    assert found.columns == ["project_id", "file_id", "layout", "header_idx", "level_pos", "panel_pos", "type_pos"]


def test_lines_of_one_number_are_in_the_order_of_their_cells(spark, tmp_path):
    rows = [(8, p, s, 1, q, f) for s in (2, 3) for p in (1, 2, 3) for q, f in ((9.0, "A"), (10.0, "N"))]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string"
                          ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "b", "x"), (2, "a", "y"), (3, None, "z")], "p_partkey bigint, p_name string, p_brand string").write.parquet(
        str(tmp_path / "part.parquet"))
    grids = {r.project_id: [tuple(x.cells) for x in r.rows] for r in schedule_grids(spark, str(tmp_path)).collect()}
    first = lambda t: tuple((x is not None, x or "") for x in t)
    revit, gurtz = grids[2][4:10], grids[3][5:11]
    assert revit == sorted(revit, key=first) and len(set(revit)) == 6 and revit[0][0] is None and revit[-1] == (" b", "x", "P-1", "Basement B1 ", "9")
    assert gurtz == sorted(gurtz, key=first) and gurtz[0] == ("Basement B1", "Elec Rm", "MLO", "P-1", "100", "x")
