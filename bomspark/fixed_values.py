"""Fixed values.

Everything in this module must equal the behaviour being reproduced for the
results to match: the lead-time catalogue, the NA tokens a headerless
all-string CSV read turns into nulls, the header names, the status / tier /
action texts and the level keywords.  They are stated here once, in their
natural order, and used by reference everywhere else.
"""

from __future__ import annotations

# --- FIXED VALUES: lead-time catalogue, in priority order -------------------
# (keyword, min weeks, max weeks, unit cost in USD).  The first keyword that is
# a substring of the lower-cased family name wins; "default" is the fallback.
LEAD_TIME_CATALOGUE: list[tuple[str, int, int, int]] = [
    ("transformer", 16, 24, 18000),
    ("switchboard", 14, 20, 35000),
    ("switchgear", 20, 30, 55000),
    ("panelboard", 8, 14, 3500),
    ("panel", 8, 14, 3500),
    ("disconnect", 4, 8, 800),
    ("meter", 6, 10, 1200),
    ("pull box", 2, 4, 350),
    ("photovoltaic", 12, 18, 4500),
    ("pv", 12, 18, 4500),
    ("inverter", 10, 16, 6000),
    ("battery", 14, 20, 22000),
    ("ups", 8, 14, 8000),
    ("generator", 16, 26, 45000),
    ("ats", 10, 16, 5500),
    ("unbalanced power", 6, 10, 1800),
    ("connector", 3, 6, 250),
    ("air handler", 12, 20, 28000),
    ("vav", 6, 10, 1400),
    ("fan", 6, 12, 3200),
    ("chiller", 20, 30, 85000),
    ("boiler", 16, 24, 42000),
    ("pump", 8, 14, 4500),
    ("cooling tower", 14, 22, 38000),
    ("default", 6, 12, 1500),
]
DEFAULT_KEYWORD = "default"
DEFAULT_LEAD = ("default", 6, 12, 1500)

# --- FIXED VALUES: tokens read as null (exact match, before any trimming) ---
NA_TOKENS: list[str] = [
    "", "NA", "N/A", "n/a", "#N/A", "#N/A N/A", "#NA", "<NA>", "NULL", "null",
    "None", "NaN", "nan", "-NaN", "-nan", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
]

# --- FIXED VALUES: layouts, header names, defaults --------------------------
LAYOUT_REVIT = "revit"
LAYOUT_GURTZ = "gurtz"
LAYOUT_LABELS = {
    "revit": "Revit Electrical Equipment Schedule",
    "gurtz": "Gurtz/NECA Panelboard Schedule",
}
HEADER_SEARCH_ROWS = 20
REVIT_HEADER_CELL = "family"
GURTZ_LEVEL = "level"
GURTZ_PANEL = "panel name"
GURTZ_TYPE = "type"
GURTZ_DEFAULT_POSITIONS = {"level": 0, "panel name": 3, "type": 5}
GURTZ_FAMILY = "Panelboard"
GURTZ_SKIP_LEVELS = ["level", "nan"]
REJECT_NO_FAMILY = "❌ Could not find 'Family' header row in first 20 rows."
REJECT_NO_LEVEL = "❌ Could not find 'Level' header row in Gurtz-format CSV."

# --- FIXED VALUES: data-quality issue texts, in audit order -----------------
ISSUE_TYPE = "Type undefined"
ISSUE_PANEL = "Panel not assigned"
ISSUE_LEVEL = "Level missing"
ISSUE_SEPARATOR = "; "

# --- FIXED VALUES: lead-time status bands (days until order deadline) -------
STATUS_OVERDUE = "🔴 OVERDUE"      # days < 0
STATUS_CRITICAL = "🟠 CRITICAL"    # days < 14
STATUS_WARNING = "🟡 WARNING"      # days < 30
STATUS_OK = "🟢 OK"                # otherwise
CRITICAL_PATTERN = "OVERDUE|CRITICAL"
CRITICAL_DAYS = 14
WARNING_DAYS = 30

# --- FIXED VALUES: spend tiers (estimated total in USD) ---------------------
TIER_HIGH = "🔴 High Value (>$100k)"          # total > 100000
TIER_MEDIUM = "🟡 Medium Value ($20k–$100k)"  # total > 20000
TIER_LOW = "🟢 Low Value (<$20k)"             # otherwise
TIER_HIGH_ABOVE = 100000
TIER_MEDIUM_ABOVE = 20000

# --- FIXED VALUES: delivery sequencing --------------------------------------
# Sort key: 0 when any basement word is a substring, 99 when any roof word is,
# else the first run of digits, else 50.
SORT_BASEMENT_WORDS = ["park", "basement", "b1", "b2", "ground"]
SORT_ROOF_WORDS = ["roof", "r1", "r2"]
SORT_BASEMENT = 0
SORT_ROOF = 99
SORT_NO_NUMBER = 50
# Action text: note that "b2" is not among the main-distribution words.
ACTION_MAIN_WORDS = ["park", "basement", "b1", "ground"]
ACTION_ROOF_WORDS = ["roof", "r1", "r2"]
ACTION_MAIN = "Main distribution equipment — schedule first delivery"
ACTION_ROOF = "Rooftop/PV equipment — schedule final delivery, coordinate crane access"
ACTION_STANDARD = "Standard floor delivery — coordinate with installation sequence"

# --- FIXED VALUES: run parameters --------------------------------------------
DEFAULT_START_WEEKS_AHEAD = 20

# --- FIXED VALUES: report texts ----------------------------------------------
REPORT_TITLE = "Procurement Engineering Report"
REPORT_HEADINGS = {
    1: "1. Executive Summary",
    3: "3. Lead Time Estimator",
    4: "4. Delivery Sequence by Floor",
    5: "5. Spend Estimation",
    6: "6. Summary by Equipment Family",
    7: "7. Detailed BOM Line Items",
}
REPORT_LEAD_INTRO = "Items sorted by order urgency. Dates based on project start date entered."
NONE_IDENTIFIED = "None identified."
NO_ISSUES_ITEM = "<li>No issues found.</li>"
HTML_TITLE = "Procurement Dashboard"

# --- FIXED VALUES: page headings and table heads, in page order ---------------
PAGE_HEAD = """<!DOCTYPE html>
<html><head><meta charset='UTF-8'>
<title>Procurement Dashboard</title>
</head>
<body>
<h1>⚡ Procurement Dashboard</h1>
<p>Generated: """
PAGE_STATS = ["Total Units", "BOM Lines", "Issues", "Est. Spend"]
PAGE_CARD = "</div>\n<div class=\"card\">\n  "
PAGE_LEAD = "<h2>⏱️ Lead Time Estimator</h2>"
PAGE_LEAD_COLUMNS = ["Status", "Family", "Lead Time", "Order By"]
PAGE_SEQUENCE = "<h2>🚚 Delivery Sequence by Floor</h2>"
PAGE_SEQUENCE_COLUMNS = ["Phase", "Level", "Units", "Recommended Action"]
PAGE_SPEND = "<h2>💰 Spend Estimation (Indicative)</h2>"
PAGE_SPEND_TOTAL = "Total estimated procurement value: "
PAGE_SPEND_COLUMNS = ["Tier", "Family", "Qty", "Unit Cost", "Total"]
PAGE_FAMILIES = "<h2>📦 Summary by Family</h2>"
PAGE_ISSUES = "<h2>⚠️ Data Quality Issues</h2>"
PAGE_BOM = "<h2>📋 Detailed BOM ("
PAGE_BOM_LINES = " lines)</h2>"
PAGE_END = "\n</div>\n</body></html>"

# --- FIXED VALUES: procurement prompt text ------------------------------------
PROMPT_HEAD = """You are an office-based Senior Procurement Engineer on an MEP/Electrical project.
You have received a validated BOM exported from Autodesk Revit via a Python pipeline.

VALIDATED DATA - do not recalculate, use exactly as provided:"""
PROMPT_TASKS = """TASKS:

1. RFQ LOTS - Group equipment into logical procurement batches based on supplier specialisation.
   CRITICAL RULES:
   (a) MUTUALLY EXCLUSIVE: assign each equipment family to ONE AND ONLY ONE lot.
   (b) EXACT QUANTITIES: list exact quantity per item as provided. Do not calculate totals or subtotals.
   (c) FLAG any items with critical lead times in their lot description.

2. 4-WEEK ACTION PLAN - Office-based procurement milestones only:
   - Week 1: Issue RFQs for CRITICAL lead time items immediately; shortlist suppliers
   - Week 2: Issue remaining RFQs; follow up on critical items
   - Week 3: Quotation analysis and negotiation
   - Week 4: Purchase order placement; confirm delivery schedule by floor level
   Note: if data quality issues exist, escalate Data Quality Log to BIM Manager. Do NOT suggest site visits.

3. TOP 3 RISKS - Prioritise lead time risk, spend concentration risk, and BIM data gaps.
   Include one mitigation per risk.

RULES: Do not recalculate quantities. Do not suggest site visits. No tables. Bullet points only. Professional tone.
"""
PROMPT_INVENTORY = "Equipment inventory (exact quantities - do not modify):"
PROMPT_CRITICAL = "CRITICAL LEAD TIME ITEMS (must order immediately):"
PROMPT_SEQUENCE = "Recommended delivery sequence by floor:"
