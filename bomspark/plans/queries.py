"""Registered queries: (spark, sf_dir) -> DataFrame, one per operator group.

Each reads the driver tables in full and composes library operators; the
DuckDB statement of the same query lives in ``bomspark.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomspark.operators import layout, lookup, planning, quality, report, summary
from bomspark.operators.clean import StoredSchedules, clean_schedules
from bomspark.operators.lookup import match_keywords
from bomspark.operators.ranking import row_number_in_group
from bomspark.operators.timing import as_of_col
from bomspark.sources.catalogue import catalogue_from_entries, default_catalogue
from bomspark.sinks.csv_text import grids_to_files
from bomspark.sources.csv_records import parse_grids
from bomspark.sources.files import decode_content
from bomspark.sources.tables import (AS_OF, TEST_CATALOGUE, bom_view, file_encoding, file_eol,
                                     flat_cells, odd_encoding, odd_schedules, project_start_expr, raw_rows_of, read_table,
                                     schedule_grids)

TEST_PROFILE = (len(TEST_CATALOGUE), sorted({len(k) for k, *_ in TEST_CATALOGUE}), True)


def _catalogue(spark: SparkSession) -> DataFrame:
    return catalogue_from_entries(spark, TEST_CATALOGUE)


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summary.summarise(bom_view(spark, sf_dir))
    return lookup.enrich(s, _catalogue(spark), "family", TEST_PROFILE)


def _lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.lead_times(_enriched(spark, sf_dir), project_start_expr(), AS_OF)


def q_summary_by_family(spark, sf_dir):
    return summary.summarise(bom_view(spark, sf_dir))


def q_summary_by_level(spark, sf_dir):
    return summary.summarise_by_level(bom_view(spark, sf_dir))


def q_project_totals(spark, sf_dir):
    return summary.project_totals(bom_view(spark, sf_dir))


def q_issue_audit(spark, sf_dir):
    return quality.with_issues(bom_view(spark, sf_dir))


def q_issue_log(spark, sf_dir):
    return quality.issue_log(bom_view(spark, sf_dir))


def q_catalogue_match(spark, sf_dir):
    fams = bom_view(spark, sf_dir).select("family").distinct()
    return match_keywords(fams, _catalogue(spark), "family", TEST_PROFILE)


# Equipment words a part may be named after; some contain several keywords.
EQUIPMENT = ["Dry Type Transformer", "Main Switchboard", "Panelboard 208V", "Heat Pump Fan", "Disconnector", "Parameter",
             "Pull Box", "PV Inverter", "UPS Battery", "Flats", "Unbalanced Power", "Air Handler", "VAV Box", "Lighting Fixture",
             "Cooling Tower", "Default Item", "Boiler Pump"]


def q_catalogue_match_default(spark, sf_dir):
    """The built-in catalogue on names made of an equipment word and the brand."""
    part = read_table(spark, sf_dir, "part")
    word = F.element_at(F.array(*[F.lit(w) for w in EQUIPMENT]), (F.col("p_partkey") % len(EQUIPMENT) + 1).cast("int"))
    return match_keywords(part.select(F.concat_ws(" ", word, "p_brand").alias("family")), default_catalogue(spark))


def q_catalogue_match_large(spark, sf_dir):
    """A catalogue of all part names and brands, beyond the CASE chain and of many keyword
    lengths, and attached to every part: equal rows stay."""
    part = read_table(spark, sf_dir, "part")
    words = part.select(F.explode(F.array(F.lower("p_name"), F.lower("p_brand"))).alias("keyword")).distinct()
    n = F.length("keyword")
    words = row_number_in_group(words.withColumn("all", F.lit(0)), ["all"], ["keyword"], "priority")
    cat = words.select(F.col("priority").cast("int").alias("priority"), "keyword",
                       n.alias("min_weeks"), (n + 4).alias("max_weeks"), (n * 100).cast("bigint").alias("unit_cost"))
    rows = part.select("p_size", F.when(F.col("p_partkey") % 7 != 0, F.concat_ws(" ", "p_brand", "p_name")).alias("family"))
    return lookup.enrich(rows, cat)


def q_lead_times(spark, sf_dir):
    return _lead(spark, sf_dir)


def q_lead_times_default_start(spark, sf_dir):
    """A start table without every third project: those start 20 weeks after as_of."""
    starts = (read_table(spark, sf_dir, "supplier").filter("s_suppkey % 3 != 0")
              .select(F.col("s_suppkey").cast("bigint").alias("project_id"))
              .withColumn("project_start", project_start_expr()))
    return planning.lead_times(_enriched(spark, sf_dir), starts, AS_OF)


def q_critical_items(spark, sf_dir):
    return planning.critical_items(_lead(spark, sf_dir)).select(
        "project_id", "family", "lead_max_weeks", "order_by_date", "status")


def q_critical_count(spark, sf_dir):
    return planning.critical_count(_lead(spark, sf_dir))


def q_delivery_sequence(spark, sf_dir):
    return planning.delivery_sequence(bom_view(spark, sf_dir))


def q_spend_estimation(spark, sf_dir):
    return planning.spend_estimation(_enriched(spark, sf_dir))


def q_spend_formatted(spark, sf_dir):
    return planning.spend_formatted(planning.spend_estimation(_enriched(spark, sf_dir)))


def q_total_spend(spark, sf_dir):
    return planning.total_spend(_enriched(spark, sf_dir))


def q_project_kpis(spark, sf_dir):
    return summary.project_kpis(bom_view(spark, sf_dir), _catalogue(spark), project_start_expr(),
                                AS_OF, profile=TEST_PROFILE, persist_rollup=True)


def _cleaned(spark, sf_dir):
    return clean_schedules(schedule_grids(spark, sf_dir))


def q_raw_rows(spark, sf_dir):
    return flat_cells(raw_rows_of(schedule_grids(spark, sf_dir)))


def ingested_grids(spark, sf_dir):
    """The derived schedules written as CSV bytes (three encodings, LF and
    CRLF) and read back through the decoder and the CSV reader."""
    grids = schedule_grids(spark, sf_dir)
    files = grids_to_files(grids, file_encoding(F.col("file_id")), file_eol(F.col("file_id")))
    return parse_grids(decode_content(files))


def q_ingest_rows(spark, sf_dir):
    return flat_cells(raw_rows_of(ingested_grids(spark, sf_dir)), na=True)


def odd_grids(spark, sf_dir):
    """The odd schedules written as CSV bytes and read back."""
    files = grids_to_files(odd_schedules(spark, sf_dir), odd_encoding(F.col("file_id")), file_eol(F.col("file_id")))
    return parse_grids(decode_content(files))


def q_odd_ingest_rows(spark, sf_dir):
    return flat_cells(raw_rows_of(odd_grids(spark, sf_dir)), na=True)


def q_odd_header_locate(spark, sf_dir):
    return layout.file_header(odd_grids(spark, sf_dir))


def q_odd_file_rejects(spark, sf_dir):
    return clean_schedules(odd_grids(spark, sf_dir)).rejects


def q_odd_clean_bom(spark, sf_dir):
    return clean_schedules(odd_grids(spark, sf_dir)).bom_lines


def q_layout_detect(spark, sf_dir):
    return layout.layouts(schedule_grids(spark, sf_dir))


def q_header_locate(spark, sf_dir):
    return layout.file_header(schedule_grids(spark, sf_dir))


def q_file_rejects(spark, sf_dir):
    return _cleaned(spark, sf_dir).rejects


def q_clean_revit(spark, sf_dir):
    return _cleaned(spark, sf_dir).bom_lines.filter(F.col("layout") == "revit")


def q_clean_gurtz(spark, sf_dir):
    return _cleaned(spark, sf_dir).bom_lines.filter(F.col("layout") == "gurtz")


def q_clean_bom(spark, sf_dir):
    return _cleaned(spark, sf_dir).bom_lines


def q_summary_by_layout(spark, sf_dir):
    return summary.summarise(_cleaned(spark, sf_dir).bom_lines)


class _Tables:
    """The analytic tables over the driver-table BOM, built once per query."""

    def __init__(self, spark, sf_dir):
        from bomspark.plans.procurement import materialise
        self.bom = bom_view(spark, sf_dir)
        # written once to the shared folder: every table below reads the rollup,
        # none rescans the lines
        rollup = materialise(summary.line_rollup(self.bom), "rollup")
        # one measured bound for every per-project numbering below
        self.bound = summary.project_rows_bound(rollup)
        # the lookup runs once per distinct name of the written rollup;
        # summary, lead, spend and KPIs read this copy
        self.enriched = materialise(lookup.enrich_by_name(summary.summary_from_rollup(rollup),
                                                          rollup.filter("kept"), _catalogue(spark),
                                                          "family", TEST_PROFILE), "enriched")
        self.summary = self.enriched.select("project_id", "family", "count")
        self.lead = planning.lead_times(self.enriched, project_start_expr(), AS_OF)
        self.spend = planning.spend_estimation(self.enriched)
        self.delivery = planning.delivery_sequence(self.bom, summary.level_totals_from_rollup(rollup), self.bound)
        self.kpis = summary.kpis_from(summary.totals_from_rollup(rollup), self.enriched,
                                      project_start_expr(), AS_OF)


def q_report_lines(spark, sf_dir):
    t = _Tables(spark, sf_dir)
    return report.report_lines(t.kpis, t.lead, t.delivery, t.spend, t.summary, t.bom, AS_OF, bound=t.bound)


def q_html_fragments(spark, sf_dir):
    t = _Tables(spark, sf_dir)
    return report.html_fragments(t.lead, t.delivery, t.spend, t.summary, bound=t.bound)


def q_html_documents(spark, sf_dir):
    t = _Tables(spark, sf_dir)
    frags = report.html_fragments(t.lead, t.delivery, t.spend, t.summary, bound=t.bound)
    return report.html_documents(t.kpis, frags, AS_OF, report.html_cards(quality.with_issues(t.bom)))


def q_project_prompts(spark, sf_dir):
    t = _Tables(spark, sf_dir)
    return report.project_prompts(t.kpis, t.summary, t.lead, t.delivery, bound=t.bound)


def q_written_documents(spark, sf_dir):
    """Pages, prompts and reports written as files, one folder per project, and read back:
    size and digest of what storage holds, and whether it equals what was built."""
    from bomspark.session import materialise, shared_dir
    from bomspark.sinks import documents as d
    t = _Tables(spark, sf_dir)
    frags = report.html_fragments(t.lead, t.delivery, t.spend, t.summary, bound=t.bound)
    pages = report.html_documents(t.kpis, frags, AS_OF, report.html_cards(quality.with_issues(t.bom)))
    prompts = report.project_prompts(t.kpis, t.summary, t.lead, t.delivery, bound=t.bound)
    lines = d.with_line_ends(report.report_lines(t.kpis, t.lead, t.delivery, t.spend, t.summary, t.bom, AS_OF, bound=t.bound))
    out = None
    for name, parts, value, order, end in (("page", pages, "html", d.PART_ORDER, d.TAG_END),
                                           ("prompt", prompts, "prompt", d.PART_ORDER, d.LINE_END),
                                           ("report", lines, "line", d.REPORT_ORDER, d.LINE_END)):
        parts = materialise(parts, name)
        path = d.write_documents(parts, shared_dir(spark, name + "s"), value, order, end=end)
        stored = d.file_digests(spark, path, parts.schema["project_id"].dataType.simpleString(), end)
        built = d.part_digests(parts, value, order, end).withColumnsRenamed(
            {"pieces": "_pieces", "bytes": "_bytes", "digest": "_digest"})
        same = F.coalesce((F.col("pieces") == F.col("_pieces")) & (F.col("bytes") == F.col("_bytes"))
                          & (F.col("digest") == F.col("_digest")), F.lit(False))
        found = stored.join(built, "project_id", "full").select(
            "project_id", F.lit(name).alias("document"), "pieces", "bytes", "digest", same.alias("same"))
        out = found if out is None else out.unionByName(found)
    return out


def q_html_items(spark, sf_dir):
    return report.html_items(quality.with_issues(bom_view(spark, sf_dir)))


def q_write_tables(spark, sf_dir):
    """Clean the derived schedule files, analyse them, write the result tables
    and the rejects to the shared folder, and digest the rows that read back."""
    from bomspark.plans.procurement import analyse_bom
    from bomspark.session import shared_dir
    from bomspark.sinks.tables import read_tables, result_tables, table_digests, write_tables
    # Lines and rejects are written once, in one pass over the grids.
    cleaned = StoredSchedules(schedule_grids(spark, sf_dir))
    a = analyse_bom(cleaned.bom_lines, _catalogue(spark), project_start_expr(), AS_OF, profile=TEST_PROFILE)
    a.rejects = cleaned.rejects
    paths = write_tables(result_tables(a), shared_dir(spark, "tables"))
    return table_digests(read_tables(spark, paths))


def _odd_analysis(spark, sf_dir):
    """An analysis of the odd schedules whose spine is the project list of all files."""
    from bomspark.plans.procurement import analyse_bom
    cleaned = StoredSchedules(odd_grids(spark, sf_dir))
    return analyse_bom(cleaned.bom_lines, _catalogue(spark), project_start_expr(), AS_OF, profile=TEST_PROFILE,
                       projects=cleaned.projects)


def q_all_projects_kpis(spark, sf_dir):
    """KPI rows of every project that sent files, also of those none of whose files could be read."""
    return _odd_analysis(spark, sf_dir).kpis


def q_all_projects_documents(spark, sf_dir):
    """The parts of every such project's page and prompt, with the fallback texts."""
    a = _odd_analysis(spark, sf_dir)
    frags = report.html_fragments(a.lead_times, a.delivery, a.spend, a.summary, bound=a.group_bound)
    pages = report.html_documents(a.kpis, frags, AS_OF, report.html_cards(a.bom_lines, a.projects))
    prompts = report.project_prompts(a.kpis, a.summary, a.lead_times, a.delivery, bound=a.group_bound)
    parts = ["project_id", "part_no", "chunk_no"]
    return (pages.select(F.lit("page").alias("document"), *parts, F.col("html").alias("text"))
            .unionByName(prompts.select(F.lit("prompt").alias("document"), *parts, F.col("prompt").alias("text"))))


def q_run_instant(spark, sf_dir):
    """An analysis as of now.  Its instant cannot be known beforehand, but every table must agree with the
    one instant recorded with the run: the KPI row with the lead table, start dates with the default
    start, and the page with the minute it was made."""
    from bomspark.plans.procurement import analyse_bom
    a = analyse_bom(bom_view(spark, sf_dir), _catalogue(spark), profile=TEST_PROFILE)
    run = a.run.first()  # one row
    as_of, start = as_of_col(run.as_of), as_of_col(run.default_start)
    deadline = planning.order_by_ts(start, F.col("lead_max_weeks"))
    lead = a.lead_times.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("families"), F.count_if(planning.is_critical(F.col("status"))).alias("critical"),
        F.bool_and((F.col("order_by_date") == deadline.cast("date"))
                   & (F.col("days_until_deadline") == planning.days_until(deadline, as_of))).alias("start_same"))
    frags = report.html_fragments(a.lead_times, a.delivery, a.spend, a.summary, bound=a.group_bound)
    made = report.html_documents(a.kpis, frags, run.as_of).filter("part_no = 0").select(
        "project_id", F.col("html").contains(F.concat(F.lit("Generated: "), F.date_format(as_of, "yyyy-MM-dd HH:mm"), F.lit("<")))
        .alias("page_same"))
    return (a.kpis.select("project_id", "critical_items").join(lead, "project_id").join(made, "project_id")
            .select("project_id", "families", (F.col("critical_items") == F.col("critical")).alias("critical_same"),
                    "start_same", "page_same"))


QUERY_FILE_ROWS = 200


def q_write_by_project(spark, sf_dir):
    """The tables of the odd schedules written with a folder per project, in files of few rows: rows
    and digest of what reads back, and whether the files are no more than one a project and one
    for every QUERY_FILE_ROWS rows."""
    from bomspark.session import shared_dir
    from bomspark.sinks.tables import clustered_tables, count_files, read_tables, stored_files, table_digests, write_by_project
    paths = write_by_project(clustered_tables(_odd_analysis(spark, sf_dir)), shared_dir(spark, "by-project"),
                             file_rows=QUERY_FILE_ROWS)
    read = read_tables(spark, paths)
    stored = stored_files(read)  # every file is opened once
    held = stored.groupBy("table_name").agg(F.count_distinct("project_id").alias("projects"), F.sum("rows").alias("n"))
    bound = F.coalesce("projects", F.lit(0)) + F.ceil(F.coalesce("n", F.lit(0)) / QUERY_FILE_ROWS)
    files = count_files(paths, spark, read=read, stored=stored).join(held, "table_name", "left").select(
        "table_name", (F.col("files") <= bound).alias("files_bounded"))
    return table_digests(read, stored).join(files, "table_name")


def q_upload_audit(spark, sf_dir):
    """The odd schedules land as files, some in folders that Spark passes over (``_old``, ``.hid``) and some in one
    that only looks like it (``_v=2``); every file is accounted for once."""
    from bomspark.plans.procurement import materialise, outcomes_of
    from bomspark.session import shared_dir
    from bomspark.sinks.csv_text import csv_text
    from bomspark.sinks.landing import write_landing
    from bomspark.sources.files import list_files, read_schedule_files
    landing = shared_dir(spark, "uploads")
    texts = materialise(odd_schedules(spark, sf_dir).select(
        F.col("project_id").alias("project"), F.col("file_id").alias("file"), csv_text(F.col("rows")).alias("value")), "texts")
    for folder, chosen in UPLOAD_FOLDERS.items():
        some = texts.filter(F.pmod("file", F.lit(5)).isin(chosen))
        write_landing(some, f"{landing}/{folder}", some.count())
    listed = materialise(list_files(spark, landing, "*.txt"), "listing")
    cleaned = StoredSchedules(parse_grids(decode_content(read_schedule_files(spark, landing, "*.txt"))))
    return outcomes_of(cleaned.rejects, cleaned.bom_lines, listed).select(
        F.col("project_id").cast("bigint").alias("project_id"),
        F.regexp_extract("file_id", r"/file=([0-9]+)/", 1).cast("bigint").alias("file_id"), "outcome", "lines")


UPLOAD_FOLDERS = {"_old": [0], ".hid": [1], "_v=2": [2], "in": [3, 4]}


def q_stream_ingest(spark, sf_dir):
    """The derived schedules land as CSV files (project=<id>/file=<id>/...);
    a Structured Streaming file source cleans them batch by batch into the
    shared folder; the result is the appended BOM."""
    from bomspark.session import materialise, shared_dir
    from bomspark.sinks.csv_text import csv_text
    from bomspark.sinks.landing import write_landing
    from bomspark.streaming.uploads import ingested_bom, start_upload_ingest
    landing, out = shared_dir(spark, "landing"), shared_dir(spark, "ingested")
    grids = schedule_grids(spark, sf_dir)
    texts = materialise(grids.select(F.col("project_id").alias("project"), F.col("file_id").alias("file"),
                                     csv_text(F.col("rows")).alias("value")), "texts")
    write_landing(texts, landing, texts.count())
    q = start_upload_ingest(spark, landing, out, available_now=True, glob="*.txt")
    q.awaitTermination()
    bom = ingested_bom(spark, out)
    return bom.select(
        F.col("project_id").cast("bigint").alias("project_id"),
        F.regexp_extract("file_id", r"/file=([0-9]+)/", 1).cast("bigint").alias("file_id"),
        "layout", "row_idx", "family", "type", "panel_name", "level", "count", "issues")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "raw_rows": q_raw_rows,
        "ingest_rows": q_ingest_rows,
        "odd_ingest_rows": q_odd_ingest_rows,
        "odd_header_locate": q_odd_header_locate,
        "odd_file_rejects": q_odd_file_rejects,
        "odd_clean_bom": q_odd_clean_bom,
        "layout_detect": q_layout_detect,
        "header_locate": q_header_locate,
        "file_rejects": q_file_rejects,
        "clean_revit": q_clean_revit,
        "clean_gurtz": q_clean_gurtz,
        "clean_bom": q_clean_bom,
        "summary_by_layout": q_summary_by_layout,
        "summary_by_family": q_summary_by_family,
        "summary_by_level": q_summary_by_level,
        "project_totals": q_project_totals,
        "issue_audit": q_issue_audit,
        "issue_log": q_issue_log,
        "catalogue_match": q_catalogue_match,
        "lead_times": q_lead_times,
        "lead_times_default_start": q_lead_times_default_start,
        "catalogue_match_default": q_catalogue_match_default,
        "catalogue_match_large": q_catalogue_match_large,
        "critical_items": q_critical_items,
        "critical_count": q_critical_count,
        "delivery_sequence": q_delivery_sequence,
        "spend_estimation": q_spend_estimation,
        "spend_formatted": q_spend_formatted,
        "total_spend": q_total_spend,
        "project_kpis": q_project_kpis,
        "report_lines": q_report_lines,
        "html_fragments": q_html_fragments,
        "html_documents": q_html_documents,
        "project_prompts": q_project_prompts,
        "written_documents": q_written_documents,
        "html_items": q_html_items,
        "all_projects_kpis": q_all_projects_kpis,
        "all_projects_documents": q_all_projects_documents,
        "run_instant": q_run_instant,
        "upload_audit": q_upload_audit,
        "write_by_project": q_write_by_project,
        "write_tables": q_write_tables,
        "stream_ingest": q_stream_ingest,
    }
