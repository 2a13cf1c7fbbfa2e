"""DuckDB SQL for every registered query: an independent statement of the
same semantics, run by the correctness check on the same parquet tables
(views lineitem, part, ... are pre-registered)."""

from __future__ import annotations

from bomspark import fixed_values as fv
from bomspark.operators.report import CHUNK_LINES
from bomspark.sources.tables import (AS_OF, FILE_ID_STRIDE, FILE_ORDERKEY_SPAN, PROJECT_START_BASE,
                                     TEST_CATALOGUE)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


# Stated here on their own, so that an error in the library's constants shows.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
NUMBER = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def strip_sql(x: str) -> str:
    return f"trim({x}, {q(WHITE)})"


def clean_sql(x: str) -> str:
    return strip_sql(f"coalesce({x}, '')")


BOM = f"""bom AS (
  SELECT l_suppkey AS project_id,
         l_suppkey * {FILE_ID_STRIDE} + l_orderkey // {FILE_ORDERKEY_SPAN} AS file_id,
         l_orderkey * 8 + l_linenumber AS line_no,
         p_name AS family,
         CASE WHEN l_returnflag = 'N' AND l_linenumber = 3 THEN '' ELSE p_brand END AS type,
         CASE WHEN l_partkey % 10 = 0 THEN '' ELSE concat('P-', CAST(l_partkey AS VARCHAR)) END AS panel_name,
         CASE l_linenumber WHEN 1 THEN 'Basement B1' WHEN 2 THEN 'B2' WHEN 3 THEN 'Level 3'
              WHEN 4 THEN 'Level 12' WHEN 5 THEN 'Mezzanine' WHEN 6 THEN 'Roof' ELSE '' END AS level,
         CAST(l_quantity AS BIGINT) AS "count"
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

CATALOGUE = "cat(priority, keyword, min_weeks, max_weeks, unit_cost) AS (VALUES " + ", ".join(
    f"({i + 1}, {q(k)}, {lo}, {hi}, {cost})" for i, (k, lo, hi, cost) in enumerate(TEST_CATALOGUE)) + ")"

AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"


def start_sql(pid: str = "project_id") -> str:
    return f"(TIMESTAMP '{PROJECT_START_BASE}' + to_days(CAST(7 * ({pid} % 40) AS INTEGER)))"


def issues_sql(t="type", p="panel_name", lv="level") -> str:
    return (f"concat_ws('; ', CASE WHEN {strip_sql(t)} = '' THEN {q(fv.ISSUE_TYPE)} END, "
            f"CASE WHEN {strip_sql(p)} = '' THEN {q(fv.ISSUE_PANEL)} END, "
            f"CASE WHEN {strip_sql(lv)} = '' THEN {q(fv.ISSUE_LEVEL)} END)")


def lookup_ctes(src: str = "summary", key: str = "family") -> str:
    """CTE `lookup(family, keyword, lead_min_weeks, lead_max_weeks, unit_cost)`
    over the distinct keys of `src`."""
    d_kw, d_lo, d_hi, d_cost = fv.DEFAULT_LEAD
    return f"""{CATALOGUE},
keys AS (SELECT DISTINCT {key} AS family FROM {src}),
hits AS (
  SELECT k.family, arg_min(c.keyword, c.priority) AS kw, arg_min(c.min_weeks, c.priority) AS mn,
         arg_min(c.max_weeks, c.priority) AS mx, arg_min(c.unit_cost, c.priority) AS uc
  FROM keys k LEFT JOIN cat c ON contains(lower(k.family), c.keyword)
  GROUP BY k.family),
lookup AS (
  SELECT family, coalesce(kw, {q(d_kw)}) AS keyword,
         CAST(coalesce(mn, {d_lo}) AS INTEGER) AS lead_min_weeks,
         CAST(coalesce(mx, {d_hi}) AS INTEGER) AS lead_max_weeks,
         CAST(coalesce(uc, {d_cost}) AS BIGINT) AS unit_cost
  FROM hits)"""


SUMMARY = """summary AS (
  SELECT project_id, family, CAST(SUM("count") AS BIGINT) AS "count" FROM bom GROUP BY project_id, family)"""

ENRICHED = """enriched AS (SELECT s.*, l.keyword, l.lead_min_weeks, l.lead_max_weeks, l.unit_cost
  FROM summary s LEFT JOIN lookup l USING (family))"""


def lead_cte(src: str = "enriched") -> str:
    deadline = f"({start_sql()} - to_days(CAST(7 * lead_max_weeks AS INTEGER)))"
    days = f"CAST(floor((epoch_us({deadline}) - epoch_us({AS_OF_SQL})) / 86400000000.0) AS BIGINT)"
    return f"""lead0 AS (
  SELECT project_id, family, "count", lead_min_weeks, lead_max_weeks,
         CAST({deadline} AS DATE) AS order_by_date, {days} AS days_until_deadline FROM {src}),
lead AS (
  SELECT *, CASE WHEN days_until_deadline < 0 THEN {q(fv.STATUS_OVERDUE)}
                 WHEN days_until_deadline < {fv.CRITICAL_DAYS} THEN {q(fv.STATUS_CRITICAL)}
                 WHEN days_until_deadline < {fv.WARNING_DAYS} THEN {q(fv.STATUS_WARNING)}
                 ELSE {q(fv.STATUS_OK)} END AS status FROM lead0)"""


def _any_contains(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def sort_key_sql(level: str = "level") -> str:
    lv = f"lower({level})"
    digits = f"regexp_extract({lv}, '([0-9]+)', 1)"
    return (f"CASE WHEN {_any_contains(lv, fv.SORT_BASEMENT_WORDS)} THEN {fv.SORT_BASEMENT} "
            f"WHEN {_any_contains(lv, fv.SORT_ROOF_WORDS)} THEN {fv.SORT_ROOF} "
            f"WHEN {digits} = '' THEN {fv.SORT_NO_NUMBER} "
            f"ELSE coalesce(TRY_CAST({digits} AS BIGINT), 9223372036854775807) END")


def action_sql(level: str = "level") -> str:
    lv = f"lower({level})"
    return (f"CASE WHEN {_any_contains(lv, fv.ACTION_MAIN_WORDS)} THEN {q(fv.ACTION_MAIN)} "
            f"WHEN {_any_contains(lv, fv.ACTION_ROOF_WORDS)} THEN {q(fv.ACTION_ROOF)} "
            f"ELSE {q(fv.ACTION_STANDARD)} END")


def delivery_cte(src: str = "bom") -> str:
    return f"""lvl AS (SELECT project_id, level, CAST(SUM("count") AS BIGINT) AS total_units FROM {src} GROUP BY project_id, level),
delivery AS (
  SELECT project_id,
         CAST(row_number() OVER (PARTITION BY project_id ORDER BY {sort_key_sql()}, level) AS INTEGER) AS delivery_phase,
         level, total_units, {action_sql()} AS recommended_action
  FROM lvl)"""


def tier_sql(x: str) -> str:
    return (f"CASE WHEN {x} > {fv.TIER_HIGH_ABOVE} THEN {q(fv.TIER_HIGH)} "
            f"WHEN {x} > {fv.TIER_MEDIUM_ABOVE} THEN {q(fv.TIER_MEDIUM)} ELSE {q(fv.TIER_LOW)} END")


def money_sql(x: str) -> str:
    return f"('$' || format('{{:,}}', {x}))"


def thousands_sql(x: str) -> str:
    return f"(CAST(CAST(round_even({x} / 1000.0, 0) AS BIGINT) AS VARCHAR) || 'k')"


SPEND = f"""spend AS (
  SELECT project_id, family, "count", unit_cost, CAST(unit_cost * "count" AS BIGINT) AS estimated_total,
         {tier_sql('unit_cost * "count"')} AS spend_tier FROM enriched)"""


def bom_analytics(*extra: str) -> str:
    """WITH bom, summary, lookup, enriched [, extra CTEs]"""
    parts = [BOM, SUMMARY, lookup_ctes(), ENRICHED, *extra]
    return "WITH " + ",\n".join(parts) + "\n"


def kpis_cte(src: str = "bom", spine: str = "lines_k") -> str:
    deadline = f"({start_sql()} - to_days(CAST(7 * lead_max_weeks AS INTEGER)))"
    days = f"floor((epoch_us({deadline}) - epoch_us({AS_OF_SQL})) / 86400000000.0)"
    return f"""lines_k AS (
  SELECT project_id, CAST(SUM("count") AS BIGINT) AS total_units, COUNT(*) AS bom_lines,
         COUNT(*) FILTER (WHERE {issues_sql()} <> '') AS issues FROM {src} GROUP BY project_id),
fam_k AS (
  SELECT project_id, COUNT(*) AS families, CAST(SUM(unit_cost * "count") AS BIGINT) AS total_spend,
         COUNT(*) FILTER (WHERE {days} < {fv.CRITICAL_DAYS}) AS critical_items
  FROM enriched GROUP BY project_id),
kpis AS (
  SELECT p.project_id, coalesce(l.total_units, 0) AS total_units, coalesce(l.bom_lines, 0) AS bom_lines,
         coalesce(l.issues, 0) AS issues, CAST(coalesce(f.families, 0) AS BIGINT) AS families,
         CAST(coalesce(f.total_spend, 0) AS BIGINT) AS total_spend,
         CAST(coalesce(f.critical_items, 0) AS BIGINT) AS critical_items
  FROM (SELECT DISTINCT project_id FROM {spine}) p LEFT JOIN lines_k l USING (project_id)
  LEFT JOIN fam_k f USING (project_id))"""


def kpis_sql() -> str:
    return bom_analytics(kpis_cte()) + "SELECT * FROM kpis"


# --- reports ----------------------------------------------------------------

def vc(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def esc_sql(x: str) -> str:
    out = vc(x)
    for ch, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = f"replace({out}, {q(ch)}, {q(ent)})"
    return out


def _const(section: int, lines: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT project_id, {section} AS section_no, CAST(NULL AS VARCHAR) AS file_id, "
        f"CAST({i} AS BIGINT) AS line_no, {ln} AS line FROM kpis" for i, ln in enumerate(lines))


def report_select() -> str:
    """The report lines, from kpis, lead, delivery, spend, summary and bom."""
    h = fv.REPORT_HEADINGS
    gen = f"'Generated: ' || strftime({AS_OF_SQL}, '%Y-%m-%d %H:%M')"
    rn = "row_number() OVER (PARTITION BY project_id ORDER BY {})"
    parts = [
        _const(0, [q(fv.REPORT_TITLE), gen]),
        _const(1, [q(h[1]), "'Total equipment units: ' || " + vc("total_units"),
                   "'Order lines (BOM rows): ' || " + vc("bom_lines"),
                   "'Data quality issues: ' || " + vc("issues"),
                   "'Estimated procurement spend: ' || " + money_sql("total_spend") + " || ' USD'"]),
        _const(3, [q(h[3]), q(fv.REPORT_LEAD_INTRO)]),
        f"""SELECT project_id, 3, NULL, 1 + {rn.format('days_until_deadline, family')},
  status || ' ' || family || ' — Lead time: ' || {vc('lead_min_weeks')} || '–' || {vc('lead_max_weeks')}
  || ' wks — Order by: ' || {vc('order_by_date')} FROM lead""",
        _const(4, [q(h[4])]),
        f"""SELECT project_id, 4, NULL, delivery_phase, 'Phase ' || {vc('delivery_phase')} || ': ' || level
  || ' — ' || {vc('total_units')} || ' units — ' || recommended_action FROM delivery""",
        _const(5, [q(h[5]), "'Total estimated procurement value: ' || " + money_sql("total_spend")
                   + " || ' USD (indicative)'"]),
        f"""SELECT project_id, 5, NULL, 1 + {rn.format('estimated_total DESC, family')},
  spend_tier || '  ' || family || ': ' || {vc('"count"')} || ' units × ' || {money_sql('unit_cost')}
  || ' = ' || {money_sql('estimated_total')} FROM spend""",
        _const(6, [q(h[6])]),
        f"""SELECT project_id, 6, NULL, {rn.format('"count" DESC, family')},
  family || ': ' || {vc('"count"')} || ' units' FROM summary""",
        _const(7, [q(h[7])]),
        f"""SELECT project_id, 7, {vc('file_id')}, line_no + 1, family || ' | Type: ' || type || ' | Panel: '
  || panel_name || ' | Level: ' || level || ' | Qty: ' || {vc('"count"')} FROM bom""",
    ]
    return "\nUNION ALL ".join(parts)


def report_sql() -> str:
    return bom_analytics(lead_cte(), delivery_cte(), SPEND, kpis_cte()) + report_select()


def fragments_cte() -> str:
    def td(x):
        return f"'<td>' || {x} || '</td>'"
    return f"""frag_rows AS (
  SELECT project_id, 'lead_rows' AS fragment, CAST(days_until_deadline AS BIGINT) AS k1, family AS k2,
    '<tr>' || {td(esc_sql('status'))} || {td(esc_sql('family'))}
    || {td(vc('lead_min_weeks') + " || '–' || " + vc('lead_max_weeks') + " || ' wks'")}
    || {td(vc('order_by_date'))} || '</tr>' AS html FROM lead
  UNION ALL
  SELECT project_id, 'seq_rows', CAST(delivery_phase AS BIGINT), '',
    '<tr>' || {td(vc('delivery_phase'))} || {td(esc_sql('level'))} || {td(vc('total_units'))}
    || {td(esc_sql('recommended_action'))} || '</tr>' FROM delivery
  UNION ALL
  SELECT project_id, 'spend_rows', -estimated_total, family,
    '<tr>' || {td(esc_sql('spend_tier'))} || {td(esc_sql('family'))} || {td(vc('"count"'))}
    || {td(money_sql('unit_cost'))} || {td(money_sql('estimated_total'))} || '</tr>' FROM spend
  UNION ALL
  SELECT project_id, 'family_list', -"count", family,
    '<li><strong>' || {esc_sql('family')} || '</strong>: ' || {vc('"count"')} || ' units</li>' FROM summary),
frag_num AS (
  SELECT project_id, fragment, html,
         (row_number() OVER (PARTITION BY project_id, fragment ORDER BY k1, k2, html) - 1) AS rn0
  FROM frag_rows),
fragments AS (
  SELECT project_id, fragment, CAST(rn0 // {CHUNK_LINES} AS BIGINT) AS chunk_no,
         string_agg(html, '' ORDER BY rn0) AS html
  FROM frag_num GROUP BY project_id, fragment, rn0 // {CHUNK_LINES})"""


def fragments_sql() -> str:
    return bom_analytics(lead_cte(), delivery_cte(), SPEND, fragments_cte()) + "SELECT * FROM fragments"


def _fixed_part_rows(parts: list[tuple[int, str]], name: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT project_id, CAST({n} AS INTEGER) AS part_no, CAST(0 AS BIGINT) AS chunk_no, {t} AS {name} "
        "FROM kpis" for n, t in parts)


ITEM_SQL = (f"'<div class=''item-row''><strong>' || {esc_sql('family')} || '</strong> — ' || {esc_sql('type')}"
            f" || '<br><small>Panel: ' || {esc_sql('panel_name')} || ' | Level: ' || {esc_sql('level')}"
            f" || ' | Qty: ' || {vc('"count"')} || '</small></div>'")
ISSUE_SQL = f"'<li>' || {esc_sql('family')} || ' (' || {esc_sql('type')} || '): ' || {esc_sql('issues')} || '</li>'"


def cards_cte(src: str, position: str) -> str:
    """cards(project_id, fragment, chunk_no, html) of the lines of ``src`` and the projects of ``kpis``."""
    return f"""card_rows AS (
  SELECT project_id, 'item_list' AS fragment, {vc('file_id')} AS f, {position} AS p, {ITEM_SQL} AS html FROM {src}
  UNION ALL
  SELECT project_id, 'issue_list', {vc('file_id')}, {position}, {ISSUE_SQL} FROM {src} WHERE issues <> ''),
card_num AS (
  SELECT project_id, fragment, html,
         row_number() OVER (PARTITION BY project_id, fragment ORDER BY f, p, html) - 1 AS rn0 FROM card_rows),
cards AS (
  SELECT project_id, fragment, CAST(rn0 // {CHUNK_LINES} AS BIGINT) AS chunk_no, string_agg(html, '' ORDER BY rn0) AS html
  FROM card_num GROUP BY project_id, fragment, rn0 // {CHUNK_LINES}
  UNION ALL
  SELECT project_id, 'issue_list', CAST(0 AS BIGINT), {q(fv.NO_ISSUES_ITEM)} FROM kpis
  WHERE project_id NOT IN (SELECT project_id FROM {src} WHERE issues <> ''))"""


def pages_select() -> str:
    """The parts of every page, from kpis, fragments and cards."""
    gen = f"strftime({AS_OF_SQL}, '%Y-%m-%d %H:%M')"
    t = fv.HTML_TITLE

    def head(*names):
        return "<table><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>"

    def indent(rows):
        return f"CASE WHEN {rows} = 0 THEN {q(chr(10) + '  ')} ELSE '' END || "

    card = '</div>\n<div class="card">\n  '
    first = " || ".join([
        q(f"<!DOCTYPE html>\n<html><head><meta charset='UTF-8'>\n<title>{t}</title>\n</head>\n<body>\n"
          f"<h1>⚡ {t}</h1>\n<p>Generated: "), gen, q("</p>\n<div class=\"stat-grid\">\n"),
        q('  <div class="stat"><h2>'), vc("total_units"), q("</h2><p>Total Units</p></div>\n"),
        q('  <div class="stat"><h2>'), vc("bom_lines"), q("</h2><p>BOM Lines</p></div>\n"),
        q('  <div class="stat"><h2>'), vc("issues"), q("</h2><p>Issues</p></div>\n"),
        q('  <div class="stat"><h2>$'), thousands_sql("total_spend"), q("</h2><p>Est. Spend</p></div>\n"),
        q(card + "<h2>⏱️ Lead Time Estimator</h2>\n  " + head("Status", "Family", "Lead Time", "Order By"))])
    fixed = _fixed_part_rows([
        (0, first),
        (2, indent("families") + q("</table>\n" + card + "<h2>🚚 Delivery Sequence by Floor</h2>\n  "
                                   + head("Phase", "Level", "Units", "Recommended Action"))),
        (4, indent("bom_lines") + q("</table>\n" + card + "<h2>💰 Spend Estimation (Indicative)</h2>\n"
                                    "  <p><strong>Total estimated procurement value: ") + " || "
            + money_sql("total_spend") + " || " + q(" USD</strong></p>\n  " + head("Tier", "Family", "Qty", "Unit Cost", "Total"))),
        (6, indent("families") + q("</table>\n" + card + "<h2>📦 Summary by Family</h2>\n  <ul>")),
        (8, q("</ul>\n" + card + "<h2>⚠️ Data Quality Issues</h2>\n  <ul>")),
        (10, q("</ul>\n" + card + "<h2>📋 Detailed BOM (") + " || " + vc("bom_lines") + " || " + q(" lines)</h2>\n  <div>")),
        (12, q("</div>\n</div>\n</body></html>")),
    ], "html")
    part = ("CAST(CASE fragment WHEN 'lead_rows' THEN 1 WHEN 'seq_rows' THEN 3 WHEN 'spend_rows' THEN 5 "
            "WHEN 'family_list' THEN 7 WHEN 'issue_list' THEN 9 WHEN 'item_list' THEN 11 END AS INTEGER)")
    before = f"CASE WHEN chunk_no = 0 AND contains(fragment, '_rows') THEN {q(chr(10) + '  ')} ELSE '' END"
    return (fixed + f"\nUNION ALL SELECT project_id, {part}, chunk_no, {before} || html FROM "
            "(SELECT * FROM fragments UNION ALL SELECT * FROM cards)")


def documents_sql() -> str:
    lines = f"card_lines AS (SELECT *, {issues_sql()} AS issues FROM bom)"
    return bom_analytics(lead_cte(), delivery_cte(), SPEND, kpis_cte(), fragments_cte(), lines,
                         cards_cte("card_lines", "line_no")) + pages_select()


def prompts_select() -> str:
    """The parts of every prompt, from kpis and pt."""
    nl = "chr(10)"
    head = " || ".join([
        q(fv.PROMPT_HEAD + "\n"),
        "'- Total units: '", vc("total_units"), nl,
        "'- BOM line items: '", vc("bom_lines"), nl,
        "'- Data quality issues: '", vc("issues"), nl,
        "'- Estimated total procurement spend: '", money_sql("total_spend"),
        q(" USD (indicative, for planning purposes only)\n\n" + fv.PROMPT_INVENTORY + "\n"),
    ])
    fixed = _fixed_part_rows([
        (0, head),
        (2, q("\n" + fv.PROMPT_CRITICAL + "\n")),
        (4, q("\n" + fv.PROMPT_SEQUENCE + "\n")),
        (6, q("\n" + fv.PROMPT_TASKS)),
    ], "prompt")
    header = ("CASE part WHEN 'family' THEN 'Family | Count' "
              "WHEN 'critical' THEN 'Family | Lead Time Max (wks) | Order By Date' "
              "ELSE 'Level | Total Units | Recommended Action' END")
    part = "CAST(CASE part WHEN 'family' THEN 1 WHEN 'critical' THEN 3 ELSE 5 END AS INTEGER)"
    none = "\n".join(
        f"""UNION ALL SELECT project_id, CAST({n} AS INTEGER), CAST(0 AS BIGINT), {q(fv.NONE_IDENTIFIED)} || {nl} FROM kpis
  WHERE project_id NOT IN (SELECT project_id FROM pt WHERE part = '{name}')"""
        for n, name in ((1, "family"), (3, "critical"), (5, "sequence")))
    return fixed + f"""
UNION ALL SELECT project_id, {part}, chunk_no,
  CASE WHEN chunk_no = 0 THEN {header} || {nl} ELSE '' END || txt || {nl} FROM pt
{none}"""


def prompts_cte() -> str:
    return f"""pl AS (
  SELECT project_id, 'family' AS part, -"count" AS k1, family AS k2, family || ' | ' || {vc('"count"')} AS line FROM summary
  UNION ALL
  SELECT project_id, 'critical', days_until_deadline, family,
         family || ' | ' || {vc('lead_max_weeks')} || ' | ' || {vc('order_by_date')} FROM lead
  WHERE regexp_matches(status, {q(fv.CRITICAL_PATTERN)})
  UNION ALL
  SELECT project_id, 'sequence', delivery_phase, '',
         level || ' | ' || {vc('total_units')} || ' | ' || recommended_action FROM delivery),
pn AS (SELECT project_id, part, line,
              (row_number() OVER (PARTITION BY project_id, part ORDER BY k1, k2, line) - 1) AS rn0 FROM pl),
pt AS (SELECT project_id, part, CAST(rn0 // {CHUNK_LINES} AS BIGINT) AS chunk_no,
              string_agg(line, chr(10) ORDER BY rn0) AS txt FROM pn GROUP BY project_id, part, rn0 // {CHUNK_LINES})"""


def prompts_sql() -> str:
    return bom_analytics(lead_cte(), delivery_cte(), kpis_cte(), prompts_cte()) + prompts_select()


def html_items_sql() -> str:
    return f"""WITH {BOM},
b AS (SELECT *, {issues_sql()} AS issues FROM bom)
SELECT project_id, 'item' AS kind, {vc('file_id')} AS file_id, line_no, {ITEM_SQL} AS html FROM b
UNION ALL
SELECT project_id, 'issue', {vc('file_id')}, line_no, {ISSUE_SQL} FROM b WHERE issues <> ''
UNION ALL
SELECT project_id, 'issue', CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), {q(fv.NO_ISSUES_ITEM)}
FROM b GROUP BY project_id HAVING COUNT(*) FILTER (WHERE issues <> '') = 0"""


def digest_ctes() -> str:
    """digests(project_id, document, pieces, bytes, digest) of texts(project_id, document, mark, doc): the sum of
    md5 numbers of the pieces times rising powers of 1000003 modulo 2^31 - 1."""
    return """pieces AS (
  SELECT project_id, document, unnest(list_slice(string_split(doc, mark), 1, -2)) AS piece,
         unnest(range(len(string_split(doc, mark)) - 1)) AS j FROM texts),
squares AS (
  SELECT list_transform(range(24), lambda i: list_reduce(range(i), lambda a, k: a * a % 2147483647, CAST(1000003 AS BIGINT))) AS sq),
terms AS (
  SELECT project_id, document, CAST('0x' || substr(md5(piece), 1, 7) AS BIGINT) * list_reduce(
           list_transform(range(24), lambda i: CASE WHEN (j >> i) & 1 = 1 THEN sq[i + 1] ELSE 1 END),
           lambda a, x: a * x % 2147483647) % 2147483647 AS term
  FROM pieces, squares),
digests AS (
  SELECT t.project_id, t.document, n AS pieces, bytes, digest FROM
    (SELECT project_id, document, COUNT(*) AS n, CAST(SUM(term) % 2147483647 AS BIGINT) AS digest FROM terms GROUP BY ALL) t
  JOIN (SELECT project_id, document, CAST(strlen(doc) AS BIGINT) AS bytes FROM texts) USING (project_id, document))"""


def written_sql() -> str:
    lines = f"card_lines AS (SELECT *, {issues_sql()} AS issues FROM bom)"
    ctes = bom_analytics(lead_cte(), delivery_cte(), SPEND, kpis_cte(), fragments_cte(), lines,
                         cards_cte("card_lines", "line_no"), prompts_cte(),
                         f"page_parts AS ({pages_select()})", f"prompt_parts AS ({prompts_select()})",
                         f"report_lines AS ({report_select()})", """texts AS MATERIALIZED (
  SELECT project_id, 'page' AS document, '>' AS mark, string_agg(html, '' ORDER BY part_no, chunk_no) AS doc
  FROM page_parts GROUP BY project_id
  UNION ALL
  SELECT project_id, 'prompt', chr(10), string_agg(prompt, '' ORDER BY part_no, chunk_no) FROM prompt_parts GROUP BY project_id
  UNION ALL
  SELECT project_id, 'report', chr(10),
         string_agg(line || chr(10), '' ORDER BY section_no, file_id NULLS FIRST, line_no, line)
  FROM report_lines GROUP BY project_id)""", digest_ctes())
    return ctes + "SELECT *, true AS same FROM digests"


def report_queries() -> dict[str, str]:
    return {
        "written_documents": written_sql(),
        "html_items": html_items_sql(),
        "report_lines": report_sql(),
        "html_fragments": fragments_sql(),
        "html_documents": documents_sql(),
        "project_prompts": prompts_sql(),
    }


def bom_queries() -> dict[str, str]:
    w = bom_analytics
    return {
        "summary_by_family": f"WITH {BOM},\n{SUMMARY}\nSELECT * FROM summary",
        "summary_by_level": f"""WITH {BOM}
SELECT project_id, level, CAST(SUM("count") AS BIGINT) AS "count" FROM bom
WHERE {strip_sql('level')} <> '' GROUP BY project_id, level""",
        "project_totals": f"""WITH {BOM}
SELECT project_id, CAST(SUM("count") AS BIGINT) AS total_units, COUNT(*) AS bom_lines,
       COUNT(*) FILTER (WHERE {issues_sql()} <> '') AS issues FROM bom GROUP BY project_id""",
        "issue_audit": f"WITH {BOM}\nSELECT *, {issues_sql()} AS issues FROM bom",
        "issue_log": f"WITH {BOM}\nSELECT * FROM (SELECT *, {issues_sql()} AS issues FROM bom) WHERE issues <> ''",
        "catalogue_match": f"WITH {BOM},\n{lookup_ctes('bom')}\nSELECT * FROM lookup",
        "lead_times": w(lead_cte()) + "SELECT * FROM lead",
        "critical_items": w(lead_cte()) + f"""SELECT project_id, family, lead_max_weeks, order_by_date, status
FROM lead WHERE regexp_matches(status, {q(fv.CRITICAL_PATTERN)})""",
        "critical_count": w(lead_cte()) + f"""SELECT project_id,
  CAST(COUNT(*) FILTER (WHERE regexp_matches(status, {q(fv.CRITICAL_PATTERN)})) AS BIGINT) AS critical_items
FROM lead GROUP BY project_id""",
        "delivery_sequence": f"WITH {BOM},\n{delivery_cte()}\nSELECT * FROM delivery",
        "spend_estimation": w(SPEND) + "SELECT * FROM spend",
        "spend_formatted": w(SPEND) + f"""SELECT project_id, family, "count", spend_tier,
  {money_sql('unit_cost')} AS unit_cost_usd, {money_sql('estimated_total')} AS estimated_total_usd FROM spend""",
        "total_spend": w() + f"""SELECT project_id, total_spend, {money_sql('total_spend')} AS total_spend_usd,
  {thousands_sql('total_spend')} AS total_spend_k
FROM (SELECT project_id, CAST(SUM(unit_cost * "count") AS BIGINT) AS total_spend FROM enriched GROUP BY project_id)""",
        "project_kpis": kpis_sql(),
    }


# --- raw schedule files and the cleaning path --------------------------------

def _arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def raw_ctes() -> str:
    """bom, files, body, raw(project_id, file_id, row_idx, cells)."""
    from bomspark.sources import tables as t
    m = t.NOTE_ROWS_MODULUS
    rv = "project_id % 2 = 0"
    note = ("CASE WHEN " + rv + " THEN ['Note ' || k, '', '', '', ''] "
            "ELSE ['Note ' || k, '', '', '', '', ''] END")
    return f"""{BOM},
files AS (SELECT DISTINCT project_id, file_id FROM bom),
body AS (
  SELECT file_id, 1 AS part_no, line_no AS k1, '' AS k2,
         CASE WHEN {rv} THEN [' ' || family, type, panel_name, level || ' ', CAST("count" AS VARCHAR)]
              ELSE [level, 'Elec Rm', 'MLO', panel_name, '100', type] END AS cells FROM bom
  UNION ALL
  SELECT file_id, 2, 0, family, [family, '', '', '', CAST(SUM("count") AS VARCHAR)]
  FROM bom WHERE {rv} GROUP BY file_id, family),
nbody AS (SELECT file_id, COUNT(*) AS n FROM body GROUP BY file_id),
raw AS MATERIALIZED (
  SELECT project_id, file_id, CAST(0 AS INTEGER) AS row_idx,
         CASE WHEN {rv} THEN {_arr(t.REVIT_TITLE)} ELSE {_arr(t.GURTZ_TITLE)} END AS cells FROM files
  UNION ALL
  SELECT project_id, file_id, CAST(k AS INTEGER), {note}
  FROM (SELECT project_id, file_id, unnest(range(1, project_id % {m} + 1)) AS k FROM files)
  UNION ALL
  SELECT project_id, file_id, CAST(project_id % {m} + 1 AS INTEGER),
         CASE WHEN {rv} THEN {_arr(t.REVIT_HEADER)} ELSE {_arr(t.GURTZ_HEADER)} END FROM files
  UNION ALL
  SELECT f.project_id, b.file_id,
         CAST(f.project_id % {m} + 1 + row_number() OVER (PARTITION BY b.file_id ORDER BY part_no, k1, k2, b.cells) AS INTEGER),
         b.cells
  FROM body b JOIN files f USING (file_id)
  UNION ALL
  SELECT project_id, file_id, CAST(project_id % {m} + 2 + n AS INTEGER),
         CASE WHEN {rv} THEN {_arr(t.REVIT_JUNK)} ELSE {_arr(t.GURTZ_HEADER)} END
  FROM files JOIN nbody USING (file_id)
  UNION ALL
  SELECT project_id, file_id, CAST(project_id % {m} + 3 + n AS INTEGER), {_arr(t.GURTZ_BLANK)}
  FROM files JOIN nbody USING (file_id) WHERE NOT ({rv}))"""


def odd_raw_ctes() -> str:
    """files, raw(project_id, file_id, row_idx, cells) of the odd schedules."""
    rv = "(project_id + file_id % 4) % 2 = 0"
    nb, em = "chr(160)", "chr(8195)"
    gurtz = "['Level', 'Location', 'Mains', 'Panel Name', 'Bus', 'Type']"
    return f"""odd AS (
  SELECT l_suppkey AS project_id, l_suppkey * 4 + l_orderkey % 3 AS file_id, l_orderkey * 8 + l_linenumber AS k,
    l_linenumber AS ln, l_partkey AS pk, l_suppkey % 13 = 0 AS clean,
    CASE l_partkey % 11 WHEN 0 THEN 'NA' WHEN 1 THEN ' N/A' WHEN 2 THEN {em} || p_name || {nb}
         WHEN 3 THEN 'Big' || chr(10) || p_name WHEN 4 THEN '"A", ' || p_name WHEN 5 THEN '  ' ELSE p_name END AS fam,
    CASE WHEN l_suppkey % 13 = 0 THEN p_brand WHEN l_partkey % 7 = 0 THEN 'nan' WHEN l_partkey % 7 = 1 THEN 'null'
         WHEN l_partkey % 7 = 2 THEN {nb} ELSE p_brand END AS typ,
    CASE WHEN l_suppkey % 13 <> 0 AND l_partkey % 5 = 0 THEN '#N/A' ELSE 'P-' || l_partkey END AS pan,
    CASE l_linenumber WHEN 1 THEN 'Basement B1' WHEN 2 THEN 'B2' WHEN 3 THEN 'Level 3' WHEN 4 THEN 'Level 12'
         WHEN 5 THEN 'Mezzanine' WHEN 6 THEN 'Roof' ELSE CASE WHEN l_suppkey % 13 = 0 THEN 'Level 9' ELSE '' END END AS lvl,
    CASE (l_orderkey + l_linenumber) % 16 WHEN 0 THEN '1e3' WHEN 1 THEN '2.7' WHEN 2 THEN '-3' WHEN 3 THEN '1,000'
         WHEN 4 THEN {nb} || '12' || {nb} WHEN 5 THEN '' WHEN 6 THEN 'inf' WHEN 7 THEN '.5'
         ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS cnt
  FROM lineitem JOIN part ON l_partkey = p_partkey),
files AS (SELECT DISTINCT project_id, file_id FROM odd),
heads AS (
  SELECT project_id, file_id, CASE
    WHEN project_id % 17 = 0 THEN [['Item', 'Kind', 'Board', 'Floor', 'Qty']]
    WHEN {rv} AND file_id % 6 % 2 = 0 THEN [['Family', 'Type', 'Panel Name', 'Level', 'Count']]
    WHEN {rv} THEN [[{nb} || 'FAMILY ', 'Type', 'Panel Name', 'Level', 'Count']]
    ELSE CASE file_id % 6 WHEN 1 THEN [['Type', 'Level', 'Location', 'Panel Name', 'Bus', 'Type']]
      WHEN 2 THEN [['Level', 'Location', 'Mains', 'Panel Name', 'Bus', 'Kind']]
      WHEN 3 THEN [['Level', '', '', '', '', ''], {gurtz}]
      WHEN 4 THEN [[{nb} || 'LEVEL ', 'Location', 'Mains', ' PANEL NAME' || {em}, 'Bus', 'TYPE']]
      WHEN 5 THEN [['Level', 'Location', 'Level', 'Panel Name', 'Bus', 'Type']]
      ELSE [{gurtz}] END END AS h
  FROM files),
body AS (
  SELECT project_id, file_id, k, CASE
    WHEN {rv} THEN CASE WHEN ln = 6 AND pk % 3 = 0 THEN [fam, typ, pan, lvl]
                        WHEN pk % 8 = 7 THEN [fam, typ, pan, lvl, cnt, 'x'] ELSE [fam, typ, pan, lvl, cnt] END
    WHEN file_id % 6 = 1 THEN ['old', lvl, 'Elec Rm', pan, '100', typ]
    WHEN file_id % 6 = 5 THEN ['x', 'Elec Rm', lvl, pan, '100', typ]
    ELSE [lvl, 'Elec Rm', 'MLO', pan, '100', typ] END AS cells FROM odd),
raw AS MATERIALIZED (
  SELECT project_id, file_id, CAST(0 AS INTEGER) AS row_idx,
    CASE WHEN {rv} THEN ['Electrical Equipment Schedule', '', '', '', 'Révision A']
         ELSE ['', '', '', 'PANELBOARD SCHEDULE', '', 'Révision A'] END AS cells FROM files
  UNION ALL
  SELECT project_id, file_id, CAST(unnest(range(1, len(h) + 1)) AS INTEGER), unnest(h) FROM heads
  UNION ALL
  SELECT b.project_id, b.file_id,
    CAST(len(h) + row_number() OVER (PARTITION BY b.file_id ORDER BY k, cells) AS INTEGER), cells
  FROM body b JOIN heads USING (file_id))"""


def na_sql(c: str) -> str:
    return f"CASE WHEN {c} IN {_in_list(fv.NA_TOKENS)} THEN NULL ELSE {c} END"


def flat_sql(src: str, width: int = 6) -> str:
    cells = ", ".join(f"cells[{i + 1}] AS cell_{i}" for i in range(width))
    return f"SELECT project_id, file_id, row_idx, CAST(len(cells) AS INTEGER) AS n_cells, {cells} FROM {src}"


def header_ctes() -> str:
    """na, norm, hdr, header(project_id, file_id, layout, header_idx, level_pos, panel_pos, type_pos)."""
    fam = f"n[1] = {q(fv.REVIT_HEADER_CELL)}"
    gz = f"(list_contains(n, {q(fv.GURTZ_LEVEL)}) AND list_contains(n, {q(fv.GURTZ_PANEL)}))"
    lvl = f"list_contains(n, {q(fv.GURTZ_LEVEL)})"
    d = fv.GURTZ_DEFAULT_POSITIONS

    def pos(name):
        return (f"CAST(CASE WHEN layout = 'gurtz' THEN coalesce(len(gn) - list_position(list_reverse(gn), {q(name)}), "
                f"{d[name]}) END AS INTEGER)")
    return f"""na AS (
  SELECT project_id, file_id, row_idx, list_transform(cells, lambda c: {na_sql('c')}) AS cells FROM raw),
norm AS (
  SELECT file_id, row_idx, list_transform(cells, lambda c: lower({clean_sql('c')})) AS n
  FROM na WHERE row_idx < {fv.HEADER_SEARCH_ROWS}),
hdr AS (
  SELECT f.project_id, f.file_id,
    coalesce(arg_min(CASE WHEN {fam} THEN 'revit' ELSE 'gurtz' END, row_idx) FILTER (WHERE {fam} OR {gz}), 'revit') AS layout,
    min(row_idx) FILTER (WHERE {fam}) AS revit_idx,
    min(row_idx) FILTER (WHERE {lvl}) AS gurtz_idx,
    arg_min(n, row_idx) FILTER (WHERE {lvl}) AS gn
  FROM files f LEFT JOIN norm USING (file_id) GROUP BY f.project_id, f.file_id),
header AS MATERIALIZED (
  SELECT project_id, file_id, layout,
    CAST(CASE WHEN layout = 'gurtz' THEN gurtz_idx ELSE revit_idx END AS INTEGER) AS header_idx,
    {pos(fv.GURTZ_LEVEL)} AS level_pos, {pos(fv.GURTZ_PANEL)} AS panel_pos, {pos(fv.GURTZ_TYPE)} AS type_pos
  FROM hdr)"""


def count_sql(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, {q(NUMBER)}) THEN "
            f"CASE WHEN regexp_matches({x}, '^[+-]?[0-9]+$') THEN TRY_CAST({x} AS BIGINT) "
            f"ELSE TRY_CAST(trunc(TRY_CAST({x} AS DOUBLE)) AS BIGINT) END END")


def bom_lines_ctes() -> str:
    """... lines(project_id, file_id, layout, row_idx, family, type, panel_name, level, count, issues)."""
    def cell(revit_pos, pos_col):
        return f"r.cells[CASE WHEN layout = 'gurtz' THEN {pos_col} ELSE {revit_pos} END + 1]"

    def text(c):
        return clean_sql(na_sql(c))

    def issue(c, said):
        return f"CASE WHEN {c} = '' THEN {q(said)} END"
    keep_g = (f"NOT (lower(level) IN {_in_list(fv.GURTZ_SKIP_LEVELS)} OR (panel_name = '' AND type = ''))")
    keep_r = """"count" IS NOT NULL AND NOT (type = '' AND panel_name = '' AND level = '') AND family <> ''"""
    # the five cells of a record are picked, cleaned and counted once each
    return f"""picked AS MATERIALIZED (
  SELECT h.project_id, h.file_id, h.layout, r.row_idx, r.cells[1] AS c0, {cell(1, 'type_pos')} AS c1,
    {cell(2, 'panel_pos')} AS c2, {cell(3, 'level_pos')} AS c3, r.cells[5] AS c4
  FROM header h JOIN raw r USING (file_id)
  WHERE h.header_idx IS NOT NULL AND r.row_idx > h.header_idx),
texts AS MATERIALIZED (
  SELECT project_id, file_id, layout, row_idx,
    CASE WHEN layout = 'gurtz' THEN {q(fv.GURTZ_FAMILY)} ELSE {text('c0')} END AS family,
    {text('c1')} AS type, {text('c2')} AS panel_name, {text('c3')} AS level, {text('c4')} AS number
  FROM picked),
lines0 AS MATERIALIZED (
  SELECT project_id, file_id, layout, row_idx, family, type, panel_name, level,
    CASE WHEN layout = 'gurtz' THEN CAST(1 AS BIGINT) ELSE {count_sql('number')} END AS "count"
  FROM texts),
lines AS (
  SELECT *, concat_ws('; ', {issue('type', fv.ISSUE_TYPE)}, {issue('panel_name', fv.ISSUE_PANEL)},
    {issue('level', fv.ISSUE_LEVEL)}) AS issues FROM lines0
  WHERE CASE WHEN layout = 'gurtz' THEN {keep_g} ELSE {keep_r} END)"""


REJECTS_SQL = f"""SELECT project_id, file_id, CASE WHEN layout = 'gurtz' THEN {q(fv.REJECT_NO_LEVEL)} ELSE {q(fv.REJECT_NO_FAMILY)} END AS reason
FROM header WHERE header_idx IS NULL"""


LAYOUT_SUMMARY = """summary AS MATERIALIZED (
  SELECT project_id, CASE WHEN layout = 'gurtz' THEN level ELSE family END AS family, CAST(SUM("count") AS BIGINT) AS "count"
  FROM lines WHERE NOT (layout = 'gurtz' AND level = '') GROUP BY ALL)"""


def odd_queries() -> dict[str, str]:
    hdr = "WITH " + odd_raw_ctes() + ",\n" + header_ctes()
    tables = ",\n".join([hdr, bom_lines_ctes().replace("\nlines AS (", "\nlines AS MATERIALIZED ("), LAYOUT_SUMMARY,
                         lookup_ctes(), ENRICHED, lead_cte(), SPEND, delivery_cte("lines"), kpis_cte("lines", "files")])
    parts = ",\n".join([tables, fragments_cte(), cards_cte("lines", "row_idx"), prompts_cte(),
                        f"page_parts AS ({pages_select()})", f"prompt_parts AS ({prompts_select()})"])
    digests = "\nUNION ALL ".join(
        digest_sql(name, src, columns).replace(" AS digest FROM", " AS digest, true AS files_bounded FROM")
        for name, (src, columns) in table_columns().items() if name in PROJECT_TABLES)
    return {
        "all_projects_kpis": tables + "\nSELECT * FROM kpis",
        "write_by_project": tables + "\n" + digests,
        "all_projects_documents": parts + """
SELECT 'page' AS document, project_id, part_no, chunk_no, html AS text FROM page_parts
UNION ALL SELECT 'prompt', project_id, part_no, chunk_no, prompt FROM prompt_parts""",
        "upload_audit": hdr + ",\n" + bom_lines_ctes() + f"""
SELECT h.project_id, h.file_id, CASE
    WHEN h.file_id % 5 IN (0, 1) THEN 'Files and folders whose name starts with _ or . are not read'
    WHEN header_idx IS NOT NULL THEN 'read' WHEN layout = 'gurtz' THEN {q(fv.REJECT_NO_LEVEL)}
    ELSE {q(fv.REJECT_NO_FAMILY)} END AS outcome,
  CASE WHEN h.file_id % 5 IN (0, 1) THEN 0 ELSE coalesce(n, 0) END AS lines
FROM header h LEFT JOIN (SELECT file_id, COUNT(*) AS n FROM lines GROUP BY file_id) USING (file_id)""",
        "odd_ingest_rows": hdr + "\n" + flat_sql("na"),
        "odd_header_locate": hdr + "\nSELECT * FROM header WHERE header_idx IS NOT NULL",
        "odd_file_rejects": hdr + "\n" + REJECTS_SQL,
        "odd_clean_bom": hdr + ",\n" + bom_lines_ctes() + "\nSELECT * FROM lines",
    }


def clean_queries() -> dict[str, str]:
    raw = "WITH " + raw_ctes()
    hdr = raw + ",\n" + header_ctes()
    lines = hdr + ",\n" + bom_lines_ctes()
    return {
        "raw_rows": raw + "\n" + flat_sql("raw"),
        "ingest_rows": hdr + "\n" + flat_sql("na"),
        "layout_detect": hdr + "\nSELECT project_id, file_id, layout, CASE layout " + " ".join(
            f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.LAYOUT_LABELS.items()) + " END AS layout_label FROM header",
        "header_locate": hdr + "\nSELECT * FROM header WHERE header_idx IS NOT NULL",
        "file_rejects": hdr + f"""
SELECT project_id, file_id, CASE WHEN layout = 'gurtz' THEN {q(fv.REJECT_NO_LEVEL)} ELSE {q(fv.REJECT_NO_FAMILY)} END AS reason
FROM header WHERE header_idx IS NULL""",
        "clean_revit": lines + "\nSELECT * FROM lines WHERE layout = 'revit'",
        "clean_gurtz": lines + "\nSELECT * FROM lines WHERE layout = 'gurtz'",
        "clean_bom": lines + "\nSELECT * FROM lines",
        "summary_by_layout": lines + """
SELECT project_id, CASE WHEN layout = 'gurtz' THEN level ELSE family END AS family, CAST(SUM("count") AS BIGINT) AS "count"
FROM lines WHERE NOT (layout = 'gurtz' AND level = '') GROUP BY ALL""",
    }


PROJECT_TABLES = ["Clean_BOM", "Summary_by_Family", "Data_Quality_Log", "Lead_Time_Estimator", "Delivery_Sequence",
                  "Spend_Estimation"]


def table_columns() -> dict[str, tuple[str, list[str]]]:
    """Result table -> (where its rows are, its columns in the order of their names)."""
    line = ["count", "family", "file_id", "layout", "level", "panel_name", "project_id", "row_idx", "type"]
    return {
        "Clean_BOM": ("lines", line),
        "Summary_by_Family": ("summary", ["count", "family", "project_id"]),
        "Data_Quality_Log": ("lines WHERE issues <> ''", sorted([*line, "issues"])),
        "Lead_Time_Estimator": ("lead", ["count", "days_until_deadline", "family", "lead_max_weeks", "lead_min_weeks",
                                         "order_by_date", "project_id", "status"]),
        "Delivery_Sequence": ("delivery", ["delivery_phase", "level", "project_id", "recommended_action", "total_units"]),
        "Spend_Estimation": ("spend", ["count", "estimated_total", "family", "project_id", "spend_tier", "unit_cost"]),
        "Rejected_Files": (f"({REJECTS_SQL})", ["file_id", "project_id", "reason"]),
        "Run": (f"(SELECT {AS_OF_SQL} AS as_of, CAST(CAST({AS_OF_SQL} + to_days(140) AS DATE) AS TIMESTAMP) AS default_start)",
                ["as_of", "default_start"]),
    }


def digest_sql(name: str, src: str, columns: list[str]) -> str:
    row = "concat_ws('|', " + ", ".join(f"coalesce(CAST(\"{c}\" AS VARCHAR), '~')" for c in columns) + ")"
    return (f"SELECT {q(name)} AS table_name, COUNT(*) AS \"rows\", "
            f"CAST(coalesce(SUM(CAST('0x' || substr(md5({row}), 1, 10) AS BIGINT)), 0) AS VARCHAR) AS digest FROM {src}")


def write_tables_sql() -> str:
    """Rows and digest of each table that an analysis of the files writes."""
    parts = [raw_ctes(), header_ctes(), bom_lines_ctes().replace("\nlines AS (", "\nlines AS MATERIALIZED ("), LAYOUT_SUMMARY,
             lookup_ctes(), ENRICHED, lead_cte(), SPEND, delivery_cte("lines")]
    return "WITH " + ",\n".join(parts) + "\n" + "\nUNION ALL ".join(
        digest_sql(name, src, columns) for name, (src, columns) in table_columns().items())


# The built-in catalogue, spelled out: (keyword, weeks from, weeks to, USD), in order.
BUILT_IN = """transformer 16 24 18000; switchboard 14 20 35000; switchgear 20 30 55000; panelboard 8 14 3500; panel 8 14 3500;
disconnect 4 8 800; meter 6 10 1200; pull box 2 4 350; photovoltaic 12 18 4500; pv 12 18 4500; inverter 10 16 6000;
battery 14 20 22000; ups 8 14 8000; generator 16 26 45000; ats 10 16 5500; unbalanced power 6 10 1800; connector 3 6 250;
air handler 12 20 28000; vav 6 10 1400; fan 6 12 3200; chiller 20 30 85000; boiler 16 24 42000; pump 8 14 4500;
cooling tower 14 22 38000; default 6 12 1500"""


def catalogue_queries() -> dict[str, str]:
    entries = [e.strip().rsplit(" ", 3) for e in BUILT_IN.replace("\n", " ").split(";")]
    values = ", ".join(f"({i}, {q(k)}, {lo}, {hi}, {usd})" for i, (k, lo, hi, usd) in enumerate(entries))
    words = ("['Dry Type Transformer', 'Main Switchboard', 'Panelboard 208V', 'Heat Pump Fan', 'Disconnector', 'Parameter', "
             "'Pull Box', 'PV Inverter', 'UPS Battery', 'Flats', 'Unbalanced Power', 'Air Handler', 'VAV Box', "
             "'Lighting Fixture', 'Cooling Tower', 'Default Item', 'Boiler Pump']")
    found = """hit AS (SELECT n.family, arg_min(struct_pack(k := keyword, lo := lo, hi := hi, usd := usd), priority) AS m
  FROM (SELECT DISTINCT family FROM names) n LEFT JOIN cat ON contains(lower(n.family), cat.keyword) GROUP BY n.family)"""
    columns = """coalesce(m.k, 'default') AS keyword, CAST(coalesce(m.lo, 6) AS INTEGER) AS lead_min_weeks,
  CAST(coalesce(m.hi, 12) AS INTEGER) AS lead_max_weeks, CAST(coalesce(m.usd, 1500) AS BIGINT) AS unit_cost"""
    start = ("CASE WHEN project_id % 3 <> 0 THEN " + start_sql()
             + f" ELSE CAST(CAST({AS_OF_SQL} + to_days(140) AS DATE) AS TIMESTAMP) END")
    return {
        "catalogue_match_default": f"""WITH cat(priority, keyword, lo, hi, usd) AS (VALUES {values}),
names AS (SELECT {words}[p_partkey % 17 + 1] || ' ' || p_brand AS family FROM part),
{found} SELECT family, {columns} FROM hit""",
        "catalogue_match_large": f"""WITH words AS (
  SELECT lower(p_name) AS keyword FROM part UNION SELECT lower(p_brand) FROM part),
cat AS (SELECT row_number() OVER (ORDER BY keyword) AS priority, keyword, length(keyword) AS lo,
               length(keyword) + 4 AS hi, length(keyword) * 100 AS usd FROM words),
names AS (SELECT p_size, CASE WHEN p_partkey % 7 <> 0 THEN p_brand || ' ' || p_name END AS family FROM part),
{found} SELECT names.p_size, names.family, {columns}
FROM names LEFT JOIN hit ON names.family IS NOT DISTINCT FROM hit.family""",
        "lead_times_default_start": bom_analytics(lead_cte().replace(start_sql(), f"({start})")) + "SELECT * FROM lead",
    }


def oracle_sql() -> dict[str, str]:
    out = {}
    out.update(bom_queries())
    out.update(clean_queries())
    out.update(report_queries())
    out.update(catalogue_queries())
    out.update(odd_queries())
    out["write_tables"] = write_tables_sql()
    out["run_instant"] = f"""WITH {BOM},\n{SUMMARY}
SELECT project_id, COUNT(*) AS families, true AS critical_same, true AS start_same, true AS page_same
FROM summary GROUP BY project_id"""
    out["stream_ingest"] = out["clean_bom"]
    return out
