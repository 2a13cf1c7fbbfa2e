"""Report outputs.

* ``report_lines`` — the text report as long-form rows
  (project_id, section_no, file_id, line_no, line); the BOM detail section
  stays one row per BOM line, keyed by the line's own file and position, so
  no project is ever gathered into one task.
* ``html_fragments`` — ordered string aggregation over aggregated tables
  (one row per family or level of a project), never over BOM lines, in
  chunks of at most ``CHUNK_LINES`` lines: a project with millions of
  families yields many bounded strings, never one unbounded value.
* ``html_cards`` — the line-grain cards of the page in the same kind of chunks,
  numbered across a project's files by an offset table of one row per file.
* ``html_documents`` / ``project_prompts`` — each document as ordered parts
  (project_id, part_no, chunk_no, text); concatenating a project's parts in
  (part_no, chunk_no) order gives the page / prompt.  Fixed parts come from
  the KPI row, table parts are the chunks above.

Numbering inside a project (report line numbers, chunk positions) uses
``row_number_in_group``: a window when the largest project is checked to fit
one task, an exact range-sorted numbering beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomspark import fixed_values as fv
from bomspark.functions.planning import is_critical
from bomspark.functions.text import html_escape, money, thousands
from bomspark.operators.ranking import ONE_TASK_ROWS, largest_group, row_number_in_group, sum_before_in_group
from bomspark.operators.timing import as_of_col

EN_DASH = "–"
EM_DASH = "—"
NL = "\n"
# Lines gathered into one text value at most (one chunk of a fragment/part).
CHUNK_LINES = 10_000


def _s(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("string")


def _ranked(df: DataFrame, order: list, bound: int | None, one_task_rows: int) -> DataFrame:
    """df + _rank (1..n per project in ``order``)."""
    return row_number_in_group(df, ["project_id"], order, "_rank", bound, one_task_rows)


def _const_sections(kpis: DataFrame, lines: list[tuple[int, int, Column]]) -> DataFrame:
    """(section, line_no, text) lines computed from each project's KPI row."""
    arr = F.array(*[F.struct(F.lit(sec).alias("section_no"), F.lit(n).cast("bigint").alias("line_no"),
                             txt.alias("line")) for sec, n, txt in lines])
    return kpis.select("project_id", F.explode(arr).alias("c")).select(
        "project_id", F.col("c.section_no").alias("section_no"), F.lit(None).cast("string").alias("file_id"),
        F.col("c.line_no").alias("line_no"), F.col("c.line").alias("line"))


def _rows(df: DataFrame, section: int, line_no: Column, line: Column, file_id: Column | None = None) -> DataFrame:
    return df.select("project_id", F.lit(section).alias("section_no"),
                     (file_id.cast("string") if file_id is not None else F.lit(None).cast("string")).alias("file_id"),
                     line_no.cast("bigint").alias("line_no"), line.alias("line"))


def lead_line(status, family, lo, hi, order_by) -> Column:
    return F.concat(_s(status), F.lit(" "), _s(family), F.lit(f" {EM_DASH} Lead time: "), _s(lo), F.lit(EN_DASH),
                    _s(hi), F.lit(f" wks {EM_DASH} Order by: "), _s(order_by))


def report_lines(kpis: DataFrame, lead: DataFrame, delivery: DataFrame, spend: DataFrame,
                 summary: DataFrame, bom: DataFrame, as_of=None,
                 detail_order: tuple[str, str] | None = None, bound: int | None = None,
                 one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """kpis: project_kpis rows; detail_order: (file column, position column)
    of the BOM, default file_id + line_no (or row_idx).  lead and spend hold
    one row per summary row, so the largest project of the summary decides
    how all three are numbered: pass ``bound`` (e.g. ``Analysis.group_bound``)
    or the summary is written once and measured."""
    if bound is None:
        from bomspark.session import materialise
        summary = materialise(summary, "summary")
        bound = largest_group(summary, ["project_id"])
    h = fv.REPORT_HEADINGS
    gen = F.concat(F.lit("Generated: "), F.date_format(as_of_col(as_of), "yyyy-MM-dd HH:mm"))
    money_total = money(F.col("total_spend"))
    # every per-project fixed line of every section, from one pass over kpis
    const = _const_sections(kpis, [
        (0, 0, F.lit(fv.REPORT_TITLE)), (0, 1, gen),
        (1, 0, F.lit(h[1])),
        (1, 1, F.concat(F.lit("Total equipment units: "), _s("total_units"))),
        (1, 2, F.concat(F.lit("Order lines (BOM rows): "), _s("bom_lines"))),
        (1, 3, F.concat(F.lit("Data quality issues: "), _s("issues"))),
        (1, 4, F.concat(F.lit("Estimated procurement spend: "), money_total, F.lit(" USD"))),
        (3, 0, F.lit(h[3])), (3, 1, F.lit(fv.REPORT_LEAD_INTRO)),
        (4, 0, F.lit(h[4])),
        (5, 0, F.lit(h[5])),
        (5, 1, F.concat(F.lit("Total estimated procurement value: "), money_total, F.lit(" USD (indicative)"))),
        (6, 0, F.lit(h[6])),
        (7, 0, F.lit(h[7])),
    ])
    lead_r = _ranked(lead, ["days_until_deadline", "family"], bound, one_task_rows)
    s3 = _rows(lead_r, 3, F.col("_rank") + 1,
               lead_line("status", "family", "lead_min_weeks", "lead_max_weeks", "order_by_date"))
    s4 = _rows(delivery, 4, F.col("delivery_phase"),
               F.concat(F.lit("Phase "), _s("delivery_phase"), F.lit(": "), _s("level"), F.lit(f" {EM_DASH} "),
                        _s("total_units"), F.lit(f" units {EM_DASH} "), _s("recommended_action")))
    spend_r = _ranked(spend, [F.col("estimated_total").desc(), "family"], bound, one_task_rows)
    s5 = _rows(spend_r, 5, F.col("_rank") + 1,
               F.concat(_s("spend_tier"), F.lit("  "), _s("family"), F.lit(": "), _s("count"), F.lit(" units × "),
                        money(F.col("unit_cost")), F.lit(" = "), money(F.col("estimated_total"))))
    summary_r = _ranked(summary, [F.col("count").desc(), "family"], bound, one_task_rows)
    s6 = _rows(summary_r, 6, F.col("_rank"),
               F.concat(_s("family"), F.lit(": "), _s("count"), F.lit(" units")))
    if detail_order is None:
        detail_order = ("file_id", "line_no" if "line_no" in bom.columns else "row_idx")
    fcol, pcol = detail_order
    s7 = _rows(bom, 7, F.col(pcol) + 1,
               F.concat(_s("family"), F.lit(" | Type: "), _s("type"), F.lit(" | Panel: "), _s("panel_name"),
                        F.lit(" | Level: "), _s("level"), F.lit(" | Qty: "), _s("count")),
               F.col(fcol))
    out = const
    for part in (s3, s4, s5, s6, s7):
        out = out.unionByName(part)
    return out


def ordered_text(lines: DataFrame, keys: list[str], order: list[Column], text: Column, sep: str = "",
                 first_prefix: Column | str = "", chunk_lines: int = CHUNK_LINES, bound: int | None = None,
                 one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Keys, chunk_no, ``text`` — the lines of each key group in ``order`` (ascending
    columns, total within a group), each followed by ``sep``, at most
    ``chunk_lines`` lines per chunk.  Chunk 0 starts with ``first_prefix``
    (a literal or an expression over the keys), so the chunks concatenated in order
    are the whole text, and every chunk ends with ``sep``."""
    sel = lines.select(*keys, *[c.alias(f"_o{i}") for i, c in enumerate(order)], text.alias("_t"))
    okeys = [f"_o{i}" for i in range(len(order))]
    if bound is None:
        from bomspark.session import materialise
        sel = materialise(sel, "ordered_lines")      # measured and gathered from one copy
        bound = largest_group(sel, keys)
    if bound <= chunk_lines:
        # every group is one chunk (measured): a single ordered aggregate
        grouped = (sel.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*okeys, "_t"))).alias("_l"))
                   .withColumn("chunk_no", F.lit(0).cast("bigint")))
    else:
        ranked = row_number_in_group(sel, keys, okeys, "_rank", bound, one_task_rows)
        chunk = F.expr(f"(_rank - 1) div {int(chunk_lines)}").cast("bigint")
        grouped = (ranked.withColumn("chunk_no", chunk)
                   .groupBy(*keys, "chunk_no")
                   .agg(F.array_sort(F.collect_list(F.struct("_rank", "_t"))).alias("_l")))
    prefix = F.lit(first_prefix) if isinstance(first_prefix, str) else first_prefix
    return grouped.select(
        *keys, "chunk_no",
        F.concat(F.when(F.col("chunk_no") == 0, prefix).otherwise(F.lit("")),
                 F.array_join(F.transform("_l", lambda x: x["_t"]), sep), F.lit(sep)).alias("text"))


def _e(c) -> Column:
    return html_escape(_s(c))


def html_fragments(lead: DataFrame, delivery: DataFrame, spend: DataFrame, summary: DataFrame,
                   chunk_lines: int = CHUNK_LINES, bound: int | None = None,
                   one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """project_id, fragment, chunk_no, html — table rows / list items per
    project, in chunks of at most ``chunk_lines`` rows."""
    def part(df, name, k_num, k_str, html):
        return df.select("project_id", F.lit(name).alias("fragment"), k_num.cast("bigint").alias("k1"),
                         _s(k_str).alias("k2"), html.alias("html"))
    td = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    lead_p = part(lead, "lead_rows", F.col("days_until_deadline"), F.col("family"), F.concat(
        F.lit("<tr>"), td(_e("status")), td(_e("family")),
        td(F.concat(_s("lead_min_weeks"), F.lit(EN_DASH), _s("lead_max_weeks"), F.lit(" wks"))),
        td(_s("order_by_date")), F.lit("</tr>")))
    seq_p = part(delivery, "seq_rows", F.col("delivery_phase"), F.lit(""), F.concat(
        F.lit("<tr>"), td(_s("delivery_phase")), td(_e("level")), td(_s("total_units")),
        td(_e("recommended_action")), F.lit("</tr>")))
    spend_p = part(spend, "spend_rows", -F.col("estimated_total"), F.col("family"), F.concat(
        F.lit("<tr>"), td(_e("spend_tier")), td(_e("family")), td(_s("count")),
        td(money(F.col("unit_cost"))), td(money(F.col("estimated_total"))), F.lit("</tr>")))
    fam_p = part(summary, "family_list", -F.col("count"), F.col("family"), F.concat(
        F.lit("<li><strong>"), _e("family"), F.lit("</strong>: "), _s("count"), F.lit(" units</li>")))
    u = lead_p.unionByName(seq_p).unionByName(spend_p).unionByName(fam_p)
    return ordered_text(u, ["project_id", "fragment"], [F.col("k1"), F.col("k2"), F.col("html")],
                        F.col("html"), chunk_lines=chunk_lines, bound=bound,
                        one_task_rows=one_task_rows).withColumnRenamed("text", "html")


def _fixed_parts(kpis: DataFrame, parts: list[tuple[int, Column]], name: str) -> DataFrame:
    """(part_no, text) parts computed from each project's KPI row, chunk 0."""
    arr = F.array(*[F.struct(F.lit(n).alias("part_no"), t.alias("t")) for n, t in parts])
    return kpis.select("project_id", F.explode(arr).alias("p")).select(
        "project_id", F.col("p.part_no").alias("part_no"), F.lit(0).cast("bigint").alias("chunk_no"),
        F.col("p.t").alias(name))


def _part_no(col: str, numbers: dict[str, int]) -> Column:
    out = None
    for k, n in numbers.items():
        out = F.when(F.col(col) == k, F.lit(n)) if out is None else out.when(F.col(col) == k, F.lit(n))
    return out


DOCUMENT_FRAGMENT_PARTS = {"lead_rows": 1, "seq_rows": 3, "spend_rows": 5, "family_list": 7,
                           "issue_list": 9, "item_list": 11}
# What stands before the first row of a table.
TABLE_INDENT = "\n  "


def _table_head(names: list[str]) -> Column:
    return F.lit("<table><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>")


def html_documents(kpis: DataFrame, fragments: DataFrame, as_of=None, cards: DataFrame | None = None) -> DataFrame:
    """project_id, part_no, chunk_no, html — one dashboard page per project
    (stat cards, lead, delivery, spend, family summary, data-quality issues and every
    BOM line) as ordered parts: the page is the concatenation of a project's
    parts in (part_no, chunk_no) order.  Even parts are the fixed markup around the
    cards, from the KPI row; odd parts are the chunks of ``fragments``
    (``html_fragments``) and of ``cards`` (``html_cards``; without them the page ends
    after the families).  Every part ends with ``>``, so the sink can write the page
    byte for byte."""
    gen = F.date_format(as_of_col(as_of), "yyyy-MM-dd HH:mm")
    stats = [_s("total_units"), _s("bom_lines"), _s("issues"), F.concat(F.lit("$"), thousands(F.col("total_spend")))]
    stat_cards = [x for name, value in zip(fv.PAGE_STATS, stats) for x in (
        F.lit("  <div class=\"stat\"><h2>"), value, F.lit(f"</h2><p>{name}</p></div>\n"))]

    def indent(rows: str) -> Column:  # a table without rows has no chunk to carry it
        return F.when(F.col(rows) == 0, F.lit(TABLE_INDENT)).otherwise(F.lit(""))

    line_cards = [] if cards is None else [
        (8, F.lit("</ul>\n" + fv.PAGE_CARD + fv.PAGE_ISSUES + "\n  <ul>")),
        (10, F.concat(F.lit("</ul>\n" + fv.PAGE_CARD + fv.PAGE_BOM), _s("bom_lines"), F.lit(fv.PAGE_BOM_LINES + "\n  <div>")))]
    fixed = _fixed_parts(kpis, [
        (0, F.concat(F.lit(fv.PAGE_HEAD), gen, F.lit("</p>\n<div class=\"stat-grid\">\n"), *stat_cards,
                     F.lit(fv.PAGE_CARD + fv.PAGE_LEAD + "\n  "), _table_head(fv.PAGE_LEAD_COLUMNS))),
        (2, F.concat(indent("families"), F.lit("</table>\n" + fv.PAGE_CARD + fv.PAGE_SEQUENCE + "\n  "),
                     _table_head(fv.PAGE_SEQUENCE_COLUMNS))),
        (4, F.concat(indent("bom_lines"), F.lit("</table>\n" + fv.PAGE_CARD + fv.PAGE_SPEND + "\n  <p><strong>"
                                                + fv.PAGE_SPEND_TOTAL), money(F.col("total_spend")),
                     F.lit(" USD</strong></p>\n  "), _table_head(fv.PAGE_SPEND_COLUMNS))),
        (6, F.concat(indent("families"), F.lit("</table>\n" + fv.PAGE_CARD + fv.PAGE_FAMILIES + "\n  <ul>"))),
        *line_cards,
        (12, F.lit(("</ul>" if cards is None else "</div>") + fv.PAGE_END)),
    ], "html")
    table = F.col("fragment").isin("lead_rows", "seq_rows", "spend_rows") & (F.col("chunk_no") == 0)
    rows = fragments if cards is None else fragments.unionByName(cards)
    chunks = rows.select(
        "project_id", _part_no("fragment", DOCUMENT_FRAGMENT_PARTS).alias("part_no"),
        F.col("chunk_no").cast("bigint").alias("chunk_no"),
        F.concat(F.when(table, F.lit(TABLE_INDENT)).otherwise(F.lit("")), "html").alias("html"))
    return fixed.unionByName(chunks)


PROMPT_TABLE_PARTS = {"family": 1, "critical": 3, "sequence": 5}
PROMPT_TABLE_HEADERS = {"family": "Family | Count",
                        "critical": "Family | Lead Time Max (wks) | Order By Date",
                        "sequence": "Level | Total Units | Recommended Action"}


def project_prompts(kpis: DataFrame, summary: DataFrame, lead: DataFrame, delivery: DataFrame,
                    chunk_lines: int = CHUNK_LINES, bound: int | None = None,
                    one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """project_id, part_no, chunk_no, prompt — the procurement brief as
    ordered parts (tables as ' | ' lines); concatenated in (part_no,
    chunk_no) order per project they are the whole prompt.  A table without
    rows (a project of ``kpis`` without critical items, or without any line) is the
    line "None identified.".  Every part ends with a line end."""
    def part(df, name, k_num, k_str, line):
        return df.select("project_id", F.lit(name).alias("part"), k_num.cast("bigint").alias("k1"),
                         _s(k_str).alias("k2"), line.alias("line"))
    crit = lead.filter(is_critical(F.col("status")))
    u = (part(summary, "family", -F.col("count"), F.col("family"),
              F.concat(_s("family"), F.lit(" | "), _s("count")))
         .unionByName(part(crit, "critical", F.col("days_until_deadline"), F.col("family"),
                           F.concat(_s("family"), F.lit(" | "), _s("lead_max_weeks"), F.lit(" | "),
                                    _s("order_by_date"))))
         .unionByName(part(delivery, "sequence", F.col("delivery_phase"), F.lit(""),
                           F.concat(_s("level"), F.lit(" | "), _s("total_units"), F.lit(" | "),
                                    _s("recommended_action")))))
    header = None
    for k, h in PROMPT_TABLE_HEADERS.items():
        header = (F.when(F.col("part") == k, F.lit(h + NL)) if header is None
                  else header.when(F.col("part") == k, F.lit(h + NL)))
    texts = ordered_text(u, ["project_id", "part"], [F.col("k1"), F.col("k2"), F.col("line")], F.col("line"),
                         NL, header, chunk_lines, bound, one_task_rows)
    tables = texts.select("project_id", _part_no("part", PROMPT_TABLE_PARTS).alias("part_no"),
                          "chunk_no", F.col("text").alias("prompt"))
    fixed = _fixed_parts(kpis, [
        (0, F.concat(
            F.lit(fv.PROMPT_HEAD + NL),
            F.lit("- Total units: "), _s("total_units"), F.lit(NL),
            F.lit("- BOM line items: "), _s("bom_lines"), F.lit(NL),
            F.lit("- Data quality issues: "), _s("issues"), F.lit(NL),
            F.lit("- Estimated total procurement spend: "), money(F.col("total_spend")),
            F.lit(" USD (indicative, for planning purposes only)" + NL + NL + fv.PROMPT_INVENTORY + NL))),
        (2, F.lit(NL + fv.PROMPT_CRITICAL + NL)),
        (4, F.lit(NL + fv.PROMPT_SEQUENCE + NL)),
        (6, F.lit(NL + fv.PROMPT_TASKS)),
    ], "prompt")
    # the KPI row says which tables of a project have rows: no join
    empty = F.filter(F.array(
        F.when(F.col("families") == 0, F.lit(PROMPT_TABLE_PARTS["family"])),
        F.when(F.col("critical_items") == 0, F.lit(PROMPT_TABLE_PARTS["critical"])),
        F.when(F.col("bom_lines") == 0, F.lit(PROMPT_TABLE_PARTS["sequence"]))), lambda n: n.isNotNull())
    none = kpis.select("project_id", F.explode(empty).alias("part_no"), F.lit(0).cast("bigint").alias("chunk_no"),
                       F.lit(fv.NONE_IDENTIFIED + NL).alias("prompt"))
    return fixed.unionByName(tables).unionByName(none)


def assemble(parts: DataFrame, text_col: str) -> DataFrame:
    """project_id, ``text_col`` — the parts of each project concatenated in
    (part_no, chunk_no) order.  One value per project: for previews and
    tests on small outputs only; at scale write the parts in order instead."""
    o = F.struct("part_no", "chunk_no", text_col)
    return (parts.groupBy("project_id").agg(F.array_sort(F.collect_list(o)).alias("_l"))
            .select("project_id", F.array_join(F.transform("_l", lambda x: x[text_col]), "").alias(text_col)))


def _item_html() -> Column:
    return F.concat(
        F.lit("<div class='item-row'><strong>"), _e("family"), F.lit(f"</strong> {EM_DASH} "), _e("type"),
        F.lit("<br><small>Panel: "), _e("panel_name"), F.lit(" | Level: "), _e("level"),
        F.lit(" | Qty: "), _s("count"), F.lit("</small></div>"))


def _issue_html() -> Column:
    """Null for a line without issues."""
    return F.when(F.col("issues") != "", F.concat(
        F.lit("<li>"), _e("family"), F.lit(" ("), _e("type"), F.lit("): "), _e("issues"), F.lit("</li>")))


def _position(bom: DataFrame) -> Column:
    return F.col("line_no" if "line_no" in bom.columns else "row_idx").cast("bigint")


def html_items(bom: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Long-form HTML for the per-line cards: one row per BOM line
    (kind 'item') and per line with issues (kind 'issue'), keyed by the line's
    file and position; a project without issues gets the single fallback item.
    Never gathered into one string per project.  Item and issue rows come
    from one pass over the lines (each line yields one or two rows); the
    fallback needs the per-project issue count (a partial aggregate).

    bom: project_id, file_id, line_no (or row_idx), family, type, panel_name,
    level, count, issues.  projects: project_id list for the fallback rows
    (default: the projects of the BOM)."""
    item = F.struct(F.lit("item").alias("kind"), _item_html().alias("html"))
    issue = F.when(F.col("issues") != "", F.struct(F.lit("issue").alias("kind"), _issue_html().alias("html")))
    rows = bom.select("project_id", _s("file_id").alias("file_id"), _position(bom).alias("line_no"),
                      F.explode(F.array(item, issue)).alias("r"))
    per_line = rows.filter(F.col("r").isNotNull()).select(
        "project_id", F.col("r.kind").alias("kind"), "file_id", "line_no", F.col("r.html").alias("html"))
    per_project = bom.groupBy("project_id").agg(F.count_if(F.col("issues") != "").alias("_n"))
    if projects is not None:
        per_project = projects.select("project_id").join(per_project, "project_id", "left")
    fallback = per_project.filter(F.coalesce(F.col("_n"), F.lit(0)) == 0).select(
        "project_id", F.lit("issue").alias("kind"), F.lit(None).cast("string").alias("file_id"),
        F.lit(0).cast("bigint").alias("line_no"), F.lit(fv.NO_ISSUES_ITEM).alias("html"))
    return per_line.unionByName(fallback)


def html_cards(bom: DataFrame, projects: DataFrame | None = None, chunk_lines: int = CHUNK_LINES,
               bound: int | None = None, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """project_id, fragment, chunk_no, html — the two cards of the page at line grain:
    ``item_list`` holds every line, ``issue_list`` every line with issues (the "No issues found."
    item if a project has none), in the order of file and position, at most
    ``chunk_lines`` lines per chunk.

    No project is gathered to number its lines.  One aggregate counts the lines and issues
    of each file; sums over that small table (``sum_before_in_group``) say how many
    lines of the project lie in earlier files; inside its file a line is numbered by a
    window.  The number divided by ``chunk_lines`` is the chunk, which alone is gathered.

    bom as in ``html_items``; ``projects``: the project list (default: those of the BOM);
    ``bound``: files of the largest project, if known."""
    b = bom.select("project_id", F.coalesce(_s("file_id"), F.lit("")).alias("_file"), _position(bom).alias("_pos"),
                   _item_html().alias("_item"), _issue_html().alias("_issue"))
    files = bom.groupBy("project_id", F.coalesce(_s("file_id"), F.lit("")).alias("_file")).agg(
        F.count(F.lit(1)).alias("_lines"), F.count_if(F.col("issues") != "").alias("_issues"))
    before = sum_before_in_group(files, ["project_id"], ["_file"], {"_lines": "_items_before", "_issues": "_issues_before"},
                                 bound, one_task_rows)
    inside = Window.partitionBy("project_id", "_file").orderBy("_pos", "_item", "_issue")
    numbered = b.select(
        "project_id", "_file", "_item", "_issue", F.row_number().over(inside).alias("_i"),
        F.count("_issue").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_k"))
    placed = numbered.join(before.select("project_id", "_file", "_items_before", "_issues_before"), ["project_id", "_file"])

    def entry(name: str, n: Column, html: str) -> Column:
        return F.struct(F.lit(name).alias("fragment"), n.alias("n"), F.col(html).alias("html"))

    rows = placed.select("project_id", F.explode(F.array(
        entry("item_list", F.col("_items_before") + F.col("_i"), "_item"),
        F.when(F.col("_issue").isNotNull(), entry("issue_list", F.col("_issues_before") + F.col("_k"), "_issue")))).alias("e"))
    chunks = (rows.filter(F.col("e").isNotNull())
              .groupBy("project_id", F.col("e.fragment").alias("fragment"),
                       F.expr(f"(e.n - 1) div {int(chunk_lines)}").cast("bigint").alias("chunk_no"))
              .agg(F.array_sort(F.collect_list(F.struct("e.n", "e.html"))).alias("_l"))
              .select("project_id", "fragment", "chunk_no", F.array_join(F.transform("_l", lambda x: x["html"]), "").alias("html")))
    issues = files.groupBy("project_id").agg(F.sum("_issues").alias("_n"))
    if projects is not None:
        issues = projects.select("project_id").join(issues, "project_id", "left")
    fallback = issues.filter(F.coalesce(F.col("_n"), F.lit(0)) == 0).select(
        "project_id", F.lit("issue_list").alias("fragment"), F.lit(0).cast("bigint").alias("chunk_no"),
        F.lit(fv.NO_ISSUES_ITEM).alias("html"))
    return chunks.unionByName(fallback)
