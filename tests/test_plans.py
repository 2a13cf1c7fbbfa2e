"""Scale checks on the physical plans (no execution needed).

* no Cartesian product / nested-loop join anywhere (the keyword lookup is a
  hash join on exploded substrings);
* Python runs only in the CSV reader (MapInArrow), never as a row UDF;
* cleaning a schedule file adds no shuffle beyond producing the file rows;
* the delivery window is partitioned by project (never a single partition).
"""

import pytest

from conftest import SF_SMALL

import __spark_entry__ as entry


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    from bomspark.plans import queries
    return {name: plan_text(fn(spark, SF_SMALL)) for name, fn in queries.queries().items()
            if name not in WRITING}


# These write files or intermediate tables while they are built.
WRITING = ("write_tables", "stream_ingest", "written_documents", "write_by_project", "upload_audit", "all_projects_kpis",
           "all_projects_documents", "run_instant")
THROUGH_THE_READER = ("ingest_rows", "odd_ingest_rows", "odd_header_locate", "odd_file_rejects", "odd_clean_bom")


def test_no_cartesian_or_nested_loop(plans):
    for name, p in plans.items():
        assert "CartesianProduct" not in p, name
        assert "NestedLoopJoin" not in p, name


def test_python_only_in_reader(plans):
    for name, p in plans.items():
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name
        assert ("MapInArrow" in p) == (name in THROUGH_THE_READER), name


def test_cleaning_adds_no_shuffle(plans):
    # raw_rows = the file rows themselves; cleaning them must not add exchanges
    assert plans["clean_bom"].count("Exchange") == plans["raw_rows"].count("Exchange")
    assert plans["layout_detect"].count("Exchange") == plans["raw_rows"].count("Exchange")


def test_lookup_joins_are_hash_or_merge_joins(spark, monkeypatch):
    """Beyond the CASE chain the lookup is an equi-join on the keyword."""
    from bomspark.operators import lookup
    from bomspark.sources.catalogue import default_catalogue
    monkeypatch.setattr(lookup, "INLINE_MAX_ROWS", 0)
    names = spark.createDataFrame([("Fan",), (None,)], "family string")
    p = plan_text(lookup.match_keywords(names, default_catalogue(spark)))
    assert "_kw" in p and ("BroadcastHashJoin" in p or "SortMergeJoin" in p)
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_tiny_catalogue_needs_no_join(plans):
    lookup_part = plans["catalogue_match"].split("MapInArrow")[0]
    assert "_kw" not in lookup_part


def test_window_partitioned_by_project(spark):
    df = entry.queries()["delivery_sequence"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" in p
    assert "SinglePartition" not in p


def test_parquet_scan_prunes_columns(spark):
    df = entry.queries()["summary_by_family"](spark, SF_SMALL)
    p = plan_text(df)
    assert "l_extendedprice" not in p and "l_shipdate" not in p
    assert "p_retailprice" not in p


def test_clean_files_from_reader_has_no_shuffle(spark, tmp_path):
    from conftest import write_file

    from bomspark.plans.procurement import clean_files
    write_file(str(tmp_path / "p1"), "a.csv", "Family,Type,Panel Name,Level,Count\nFan,T,P,L,1\n")
    p = plan_text(clean_files(spark, str(tmp_path)).bom_lines)
    assert "Exchange" not in p
