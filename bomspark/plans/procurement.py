"""End-to-end composition: schedule files -> every procurement table.

``analyse_files`` reads a folder of schedules for many projects;
``analyse_bom`` starts from an already clean BOM.  Building an analysis runs a
few jobs: the parsed files, the rollup of the lines and the looked-up summary
are written once to the shared folder (``materialise``), so no table repeats
those steps and the lineage is cut (a lost executor then recomputes from the
written files, not from the raw schedules).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomspark.operators import lookup, planning, summary
from bomspark.operators.clean import StoredSchedules, clean_schedules
from bomspark.operators.lookup import DEFAULT_PROFILE
from bomspark.operators.quality import issue_log, with_issues
from bomspark.operators.timing import fixed_as_of, run_info
from bomspark.session import materialise  # noqa: F401  (re-exported)
from bomspark.sources.catalogue import default_catalogue
from bomspark.sources.csv_records import parse_grids
from bomspark.sources.files import CSV_GLOB, decode_content, list_files, read_schedule_files, unlisted_files

OUTCOME_READ = "read"


@dataclass
class Analysis:
    bom_lines: DataFrame
    summary: DataFrame
    issues: DataFrame
    enriched: DataFrame
    lead_times: DataFrame
    critical_items: DataFrame
    delivery: DataFrame
    spend: DataFrame
    total_spend: DataFrame
    kpis: DataFrame
    rejects: DataFrame | None = None
    # the project list of the run (None: the projects of the lines) and its instant
    projects: DataFrame | None = None
    run: DataFrame | None = None
    # rows of the largest project in the rollup: bounds every per-project
    # table (pass as ``bound`` to the report builders); None if not measured
    group_bound: int | None = None
    extra: dict = field(default_factory=dict)


def analyse_bom(bom: DataFrame, catalogue: DataFrame | None = None, project_start=None,
                as_of=None, gurtz_key: str = "level", profile=None,
                persist_rollup: bool = True, projects: DataFrame | None = None) -> Analysis:
    """bom: project_id, family, type, panel_name, level, count [, layout, ...].

    project_start: Column, DataFrame(project_id, project_start), a literal,
    or None (midnight of as_of + 20 weeks).  as_of: literal or None (now).
    persist_rollup writes the per-(project, key, level) rollup once (one
    pass over the lines) so summary, delivery and KPIs never rescan them, and
    the looked-up summary once, so the keyword lookup runs once.
    projects: DataFrame(project_id), the spine of the run: a project of it without any
    line still has its KPI row, total, prompt, report and page, with the fallback texts.
    """
    if catalogue is None:
        catalogue = default_catalogue(bom.sparkSession)
        profile = DEFAULT_PROFILE
    as_of = fixed_as_of(bom.sparkSession, as_of)
    b = with_issues(bom)
    # One pass over the lines feeds every per-project table.
    r = summary.line_rollup(b, gurtz_key)
    bound = None
    if persist_rollup:
        r = materialise(r, "rollup")
        bound = summary.project_rows_bound(r)
    s = summary.summary_from_rollup(r)
    if persist_rollup:
        # the keyword lookup runs once, per distinct name of the written
        # rollup; summary, lead, spend and KPIs all read this copy
        e = materialise(lookup.enrich_by_name(s, r.filter("kept"), catalogue, "family", profile), "enriched")
        s = e.select("project_id", "family", "count")
    else:
        e = lookup.enrich(s, catalogue, "family", profile)
    lead = planning.lead_times(e, project_start, as_of)
    spend = planning.spend_estimation(e)
    return Analysis(
        bom_lines=b,
        summary=s,
        issues=issue_log(b),
        enriched=e,
        lead_times=lead,
        critical_items=planning.critical_items(lead),
        delivery=planning.delivery_sequence(b, summary.level_totals_from_rollup(r), bound),
        spend=spend,
        total_spend=planning.total_spend(e, projects),
        kpis=summary.kpis_from(summary.totals_from_rollup(r), e, project_start, as_of, projects),
        projects=projects,
        run=run_info(bom.sparkSession, as_of),
        group_bound=bound,
        extra={"rollup": r},
    )


def clean_files(spark: SparkSession, path: str, glob: str = CSV_GLOB):
    return clean_schedules(parse_grids(decode_content(read_schedule_files(spark, path, glob))))


def analyse_files(spark: SparkSession, path: str, catalogue: DataFrame | None = None,
                  project_start=None, as_of=None, gurtz_key: str = "level", glob: str = CSV_GLOB,
                  persist_bom: bool = True, profile=None, persist_rollup: bool = True) -> Analysis:
    """``persist_bom``: the files are parsed and cleaned once, and lines and rejects
    both come from what was written then; otherwise each table parses the files again.
    Files that Spark's listing leaves out are among the rejects.  The projects of all
    files, read or not, are the spine of the run."""
    listed = materialise(list_files(spark, path, glob), "listing")
    grids = parse_grids(decode_content(read_schedule_files(spark, path, glob)))
    cleaned = StoredSchedules(grids) if persist_bom else clean_schedules(grids)
    a = analyse_bom(cleaned.bom_lines, catalogue, project_start, as_of, gurtz_key, profile, persist_rollup,
                    listed.select("project_id").distinct())
    a.rejects = cleaned.rejects.unionByName(unlisted_files(listed))
    return a


def file_outcomes(headed: DataFrame, lines: DataFrame, listed: DataFrame) -> DataFrame:
    """project_id, file_id, outcome, lines — what became of every listed file: "read" with its
    number of lines, or the reason it was rejected for.  A file is in the result once."""
    from bomspark.operators.layout import rejects
    return outcomes_of(rejects(headed), lines, listed)


def outcomes_of(rejected: DataFrame, lines: DataFrame, listed: DataFrame) -> DataFrame:
    """``file_outcomes`` from the rejects (project_id, file_id, reason) of the files read."""
    told = rejected.unionByName(unlisted_files(listed)).select("file_id", "reason")
    counted = lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("lines"))
    return (listed.select("project_id", "file_id").join(told, "file_id", "left").join(counted, "file_id", "left")
            .select("project_id", "file_id", F.coalesce("reason", F.lit(OUTCOME_READ)).alias("outcome"),
                    F.coalesce("lines", F.lit(0)).cast("bigint").alias("lines")))
