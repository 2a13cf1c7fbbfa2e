"""Derived schedules: the head on its own, and lines and rejects stored in one pass."""

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from bomspark.fixed_values import HEADER_SEARCH_ROWS
from bomspark.operators.clean import StoredSchedules, clean_schedules
from bomspark.sources import csv_records
from bomspark.sources.tables import odd_schedules, schedule_grids


@pytest.mark.parametrize("made", [schedule_grids, odd_schedules])
def test_head_is_the_start_of_the_rows(spark, made):
    grids = made(spark, SF_SMALL)
    assert grids.filter(~F.col("head").eqNullSafe(F.slice("rows", 1, HEADER_SEARCH_ROWS))).isEmpty()


def test_subtotals_follow_the_lines_of_a_revit_file(spark, tmp_path):
    spark.createDataFrame([(1, 1, 2, 1, 5.0, "N"), (2, 1, 2, 1, 6.0, "N"), (3, 2, 2, 1, 7.0, "N"), (3, 2, 3, 1, 7.0, "N")],
                          "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string"
                          ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "b", "x"), (2, "a", "y")], "p_partkey bigint, p_name string, p_brand string").write.parquet(
        str(tmp_path / "part.parquet"))
    grids = {r.project_id: r.rows for r in schedule_grids(spark, str(tmp_path)).collect()}
    assert [r.cells[0] for r in grids[2]][-6:] == [" b", " b", " a", "a", "b", "n/a family"]
    assert [r.cells[4] for r in grids[2]][-6:-1] == ["5", "6", "7", "7", "11"]
    assert len(grids[3]) == 1 + 3 + 1 + 1 + 2 and [r.row_idx for r in grids[3]] == list(range(8))


GRID = "project_id string, file_id string, block_no int, head array<struct<row_idx:int,cells:array<string>>>, " \
       "rows array<struct<row_idx:int,cells:array<string>>>, error string"


def test_stored_schedules_equal_the_lazy_ones(spark):
    head = [(0, ["Family", "Type", "Panel Name", "Level", "Count"])]
    line = ["fan", "t", "p", "L1", "2"]
    grids = spark.createDataFrame([
        ("a", "1", 0, head, head + [(1, line), (2, ["sum", "", "", "", "2"])], None), ("a", "1", 1, head, [(3, line)], None),
        ("a", "2", 0, [(0, ["x"])], [(0, ["x"])], None), ("b", "3", 0, None, None, "CSV parse error: x"),
        ("c", "4", 0, head, head, None), (None, "5", 0, [], [], None)], GRID)
    lazy, stored = clean_schedules(grids), StoredSchedules(grids)
    assert stored.bom_lines.columns == lazy.bom_lines.columns and stored.rejects.columns == lazy.rejects.columns
    for a, b in ((lazy.bom_lines, stored.bom_lines), (lazy.rejects, stored.rejects)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert stored.bom_lines.count() == 2 and stored.rejects.count() == 3
    assert {r.project_id for r in stored.projects.collect()} == {"a", "b", "c", None}
    assert not any("array" in t for _, t in stored.bom_lines.dtypes)


def test_a_file_of_one_block_is_read_once(monkeypatch):
    calls, records = [], csv_records.records
    monkeypatch.setattr(csv_records, "records", lambda text: calls.append(1) or records(text))
    assert [len(b[2]) for b in csv_records.parse_blocks("a\nb\n", 2)] == [2] and len(calls) == 1
    assert [len(b[2]) for b in csv_records.parse_blocks("a\nb\nc\n", 2)] == [2, 1] and len(calls) == 3
    assert list(csv_records.parse_blocks("", 2)) == [(0, [], [], None)]
