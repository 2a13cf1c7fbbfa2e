"""Schedules derived from the driver's TPC-H-like tables.

``bom_view`` is a cleaned bill of materials (one line per lineitem);
``project_start_expr`` / ``AS_OF`` are the run parameters used with it; and
``TEST_CATALOGUE`` is a five-entry catalogue whose keywords do occur in the
part names (with shadowing: "large ring" before "ring").

Projects are suppliers.  Each project's lines are split into schedule *files*
by order-key range (``l_orderkey DIV 50000``), so a file holds at most
7 x 50000 lines however large a project grows; every per-file step is then
bounded by the file, never by the project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bomspark.fixed_values import HEADER_SEARCH_ROWS

AS_OF = "1998-06-01 09:30:00"
PROJECT_START_BASE = "1998-06-01 00:00:00"
FILE_ORDERKEY_SPAN = 50000
FILE_ID_STRIDE = 100_000_000

# Test catalogue (priority, keyword, min_weeks, max_weeks, unit_cost); the
# default entry stays (default, 6, 12, 1500).
TEST_CATALOGUE = [
    ("large ring", 16, 24, 18000),
    ("ring", 8, 14, 3500),
    ("rod", 6, 10, 1200),
    ("old", 20, 30, 55000),
    ("gear", 2, 4, 350),
]

LEVELS_BY_LINENUMBER = {1: "Basement B1", 2: "B2", 3: "Level 3", 4: "Level 12",
                        5: "Mezzanine", 6: "Roof"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project_start_expr(project_id: Column | None = None) -> Column:
    """Project start = 1998-06-01 + (project_id % 40) weeks, timestamp_ntz."""
    pid = project_id if project_id is not None else F.col("project_id")
    return (F.lit(PROJECT_START_BASE).cast("timestamp_ntz")
            + F.make_dt_interval(days=(F.pmod(pid, F.lit(40)) * 7).cast("int")))


def _level(linenumber: Column) -> Column:
    out = None
    for n, name in LEVELS_BY_LINENUMBER.items():
        out = F.when(linenumber == n, F.lit(name)) if out is None else out.when(linenumber == n, F.lit(name))
    return out.otherwise(F.lit(""))


def _is_revit() -> Column:
    return F.pmod(F.col("project_id"), F.lit(2)) == 0


def bom_view(spark: SparkSession, sf_dir: str, by_file: bool = False) -> DataFrame:
    """project_id, file_id, line_no, family, type, panel_name, level, count.  With ``by_file`` the rows of a file are
    in one task, sorted by project, file and ``group``, a further column: the family in a revit file, else null."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    j = li.join(part, li["l_partkey"] == part["p_partkey"]).withColumns({
        "project_id": F.col("l_suppkey"),
        "file_id": (F.col("l_suppkey") * FILE_ID_STRIDE + F.expr(f"l_orderkey div {FILE_ORDERKEY_SPAN}")).cast("bigint")})
    bom = j.select(
        "project_id", "file_id",
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("line_no"),
        F.col("p_name").alias("family"),
        F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 3), F.lit(""))
         .otherwise(F.col("p_brand")).alias("type"),
        F.when(F.col("l_partkey") % 10 == 0, F.lit(""))
         .otherwise(F.concat(F.lit("P-"), F.col("l_partkey").cast("string"))).alias("panel_name"),
        _level(F.col("l_linenumber")).alias("level"),
        F.col("l_quantity").cast("bigint").alias("count"),
    )
    if not by_file:
        return bom
    dealt = bom.repartition("project_id", "file_id").withColumn("group", F.when(_is_revit(), F.col("family")))
    return dealt.sortWithinPartitions("project_id", "file_id", "group")


# --- Raw schedule files derived from the BOM --------------------------------
# Even projects export the "revit" layout (title, notes, Family/Type/Panel
# Name/Level/Count header, padded cells, per-family subtotal rows, one row with
# a non-numeric count); odd projects export the "gurtz" panelboard layout
# (title, notes, Level/Location/Mains/Panel Name/Bus/Type header, a repeated
# header and a blank separator row at the end).  Each file carries
# project_id % 23 note rows before its header, so files of projects with 19 or
# more notes have no header within the first 20 rows and are rejected.
NOTE_ROWS_MODULUS = 23
REVIT_TITLE = ["Electrical Equipment Schedule", "", "", "", "Révision A"]
GURTZ_TITLE = ["", "", "", "PANELBOARD SCHEDULE", "", "Révision A"]
REVIT_HEADER = ["Family", "Type", "Panel Name", "Level", "Count"]
GURTZ_HEADER = ["Level", "Location", "Mains", "Panel Name", "Bus", "Type"]
REVIT_JUNK = ["n/a family", "x", "y", "z", "1,000"]
GURTZ_BLANK = ["", "", "", "", "", ""]

GRID_ROW_DDL = "struct<row_idx:int,cells:array<string>>"


def streamed_groups(spark: SparkSession) -> None:
    """Let aggregates over rows that are sorted by their groups take each group as it comes.  Spark would
    gather ordered lists in a hash map of 128 groups, then sort all rows anew by the group, twice for
    each aggregate.  The setting stays on the session, as results are lazy; it changes no result."""
    spark.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _note_cells(width: int):
    return lambda k: F.array(F.concat(F.lit("Note "), k.cast("string")),
                             *[F.lit("") for _ in range(width - 1)])


def schedule_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per schedule file: project_id, file_id, rows array<struct<row_idx int,
    cells array<string>>> and ``head``, the first of them.

    Built with one aggregate per file (bounded by the file), never per
    project; row numbers are array positions, so no window is needed.
    """
    streamed_groups(spark)
    is_revit = _is_revit()
    # The varying cells of a line in their order, which decides between lines of one number.
    line = F.struct(F.col("line_no").alias("k1"), *[F.when(is_revit, r).otherwise(g).alias(c) for c, r, g in (
        ("a", F.col("family"), F.col("level")), ("b", F.col("type"), F.col("panel_name")), ("c", F.col("panel_name"), F.col("type")),
        ("d", F.col("level"), F.lit(None)), ("e", F.col("count").cast("string"), F.lit(None)))])
    # Dealt by file and sorted once, as narrow rows: both aggregates then take their groups as they come, and no
    # task gathers parts of files before they meet.  Only revit lines are grouped by family.
    groups = ["project_id", "file_id", "group"]
    families = (bom_view(spark, sf_dir, by_file=True).groupBy(*groups)
                .agg(F.collect_list(line).alias("lines"), F.sum("count").cast("bigint").alias("units")))
    subtotal = F.struct(F.col("group").alias("k2"), F.array(
        F.col("group"), F.lit(""), F.lit(""), F.lit(""), F.col("units").cast("string")).alias("cells"))
    files = (families.sortWithinPartitions("project_id", "file_id").groupBy("project_id", "file_id")  # sorted already: no sort is left
             .agg(F.sort_array(F.flatten(F.collect_list("lines"))).alias("lines"),
                  F.sort_array(F.collect_list(F.when(is_revit, subtotal))).alias("subtotals")))
    notes = F.pmod(F.col("project_id"), F.lit(NOTE_ROWS_MODULUS)).cast("int")
    empty = F.array().cast("array<array<string>>")
    note_rows = F.when(notes > 0, F.when(
        is_revit, F.transform(F.sequence(F.lit(1), notes), _note_cells(5))
    ).otherwise(F.transform(F.sequence(F.lit(1), notes), _note_cells(6)))).otherwise(empty)
    head = F.when(is_revit, F.array(_lit_array(REVIT_TITLE))).otherwise(F.array(_lit_array(GURTZ_TITLE)))
    header = F.when(is_revit, F.array(_lit_array(REVIT_HEADER))).otherwise(F.array(_lit_array(GURTZ_HEADER)))
    tail = F.when(is_revit, F.array(_lit_array(REVIT_JUNK))).otherwise(
        F.array(_lit_array(GURTZ_HEADER), _lit_array(GURTZ_BLANK)))

    def line_cells(lines) -> Column:
        return F.when(is_revit, F.transform(lines, lambda x: F.array(
            F.concat(F.lit(" "), x["a"]), x["b"], x["c"], F.concat(x["d"], F.lit(" ")), x["e"]))).otherwise(
            F.transform(lines, lambda x: F.array(x["a"], F.lit("Elec Rm"), F.lit("MLO"), x["b"], F.lit("100"), x["c"])))

    cells = F.concat(head, note_rows, header, line_cells(F.col("lines")), _cells_of("subtotals"), tail)
    # the first records on their own: looking for a header needs no others
    first = F.concat(head, note_rows, header, line_cells(F.slice("lines", 1, HEADER_SEARCH_ROWS)),
                     _cells_of(F.slice("subtotals", 1, HEADER_SEARCH_ROWS)), tail)
    return files.select("project_id", "file_id", _numbered(cells).alias("rows"),
                        _numbered(F.slice(first, 1, HEADER_SEARCH_ROWS)).alias("head"))


def _cells_of(records) -> Column:
    return F.transform(records, lambda x: x["cells"])


def _numbered(cells: Column) -> Column:
    """Cells as records; row numbers are array positions."""
    return F.transform(cells, lambda c, i: F.struct(i.cast("int").alias("row_idx"), c.alias("cells")))


# --- Schedules as people export them ------------------------------------------
# Three files a project (order key modulo 3), both layouts within one project.  Cells hold
# NA tokens, non-breaking and em spaces, quotes, line ends, numbers in every notation;
# headers are repeated, incomplete, in capitals or announced by an earlier "Level" row.
# Files of projects divisible by 17 have no header, so such a project has no line at all;
# projects divisible by 13 have no blank cells, so no issues.
ODD_FILES = 3
NBSP, EM_SPACE = "\u00a0", "\u2003"
ODD_NO_HEADER = ["Item", "Kind", "Board", "Floor", "Qty"]
ODD_REVIT_HEADERS = [REVIT_HEADER, [NBSP + "FAMILY ", "Type", "Panel Name", "Level", "Count"]]
ODD_GURTZ_HEADERS = [
    [GURTZ_HEADER],
    [["Type", "Level", "Location", "Panel Name", "Bus", "Type"]],
    [["Level", "Location", "Mains", "Panel Name", "Bus", "Kind"]],
    [["Level", "", "", "", "", ""], GURTZ_HEADER],
    [[NBSP + "LEVEL ", "Location", "Mains", " PANEL NAME" + EM_SPACE, "Bus", "TYPE"]],
    [["Level", "Location", "Level", "Panel Name", "Bus", "Type"]],
]
ODD_COUNTS = ["1e3", "2.7", "-3", "1,000", NBSP + "12" + NBSP, "", "inf", ".5"]


def odd_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like ``schedule_grids``, of the odd schedules above."""
    streamed_groups(spark)
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    project, file_no = F.col("l_suppkey"), F.pmod(F.col("l_orderkey"), F.lit(ODD_FILES))
    key, name, brand = F.col("l_partkey"), F.col("p_name"), F.col("p_brand")
    clean = project % 13 == 0
    board = F.concat(F.lit("P-"), key.cast("string"))
    family = (F.when(key % 11 == 0, F.lit("NA")).when(key % 11 == 1, F.lit(" N/A"))
              .when(key % 11 == 2, F.concat(F.lit(EM_SPACE), name, F.lit(NBSP)))
              .when(key % 11 == 3, F.concat(F.lit("Big\n"), name)).when(key % 11 == 4, F.concat(F.lit('"A", '), name))
              .when(key % 11 == 5, F.lit("  ")).otherwise(name))
    type_ = (F.when(clean, brand).when(key % 7 == 0, F.lit("nan")).when(key % 7 == 1, F.lit("null"))
             .when(key % 7 == 2, F.lit(NBSP)).otherwise(brand))
    panel = F.when(~clean & (key % 5 == 0), F.lit("#N/A")).otherwise(board)
    level = F.when(clean & (F.col("l_linenumber") == 7), F.lit("Level 9")).otherwise(_level(F.col("l_linenumber")))
    notation = (F.col("l_orderkey") + F.col("l_linenumber")) % 16
    count = F.when(notation < len(ODD_COUNTS), F.get(_lit_array(ODD_COUNTS), notation.cast("int"))).otherwise(
        F.col("l_quantity").cast("bigint").cast("string"))
    revit = F.pmod(project + file_no, F.lit(2)) == 0
    variant = F.pmod(project * 4 + file_no, F.lit(len(ODD_GURTZ_HEADERS)))
    room, mains, bus = F.lit("Elec Rm"), F.lit("MLO"), F.lit("100")
    short = F.when((F.col("l_linenumber") == 6) & (key % 3 == 0), F.array(family, type_, panel, level))
    revit_cells = F.coalesce(short, F.when(key % 8 == 7, F.array(family, type_, panel, level, count, F.lit("x"))),
                             F.array(family, type_, panel, level, count))
    gurtz_cells = (F.when(variant == 1, F.array(F.lit("old"), level, room, panel, bus, type_))
                   .when(variant == 5, F.array(F.lit("x"), room, level, panel, bus, type_))
                   .otherwise(F.array(level, room, mains, panel, bus, type_)))
    body = (li.join(part, li["l_partkey"] == part["p_partkey"])
            .select(project.alias("project_id"), (project * 4 + file_no).cast("bigint").alias("file_id"),
                    revit.alias("revit"), variant.cast("int").alias("variant"),
                    F.struct((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("k"),
                             F.when(revit, revit_cells).otherwise(gurtz_cells).alias("cells")).alias("r"))
            .repartition("project_id", "file_id").sortWithinPartitions("project_id", "file_id", "revit", "variant")
            .groupBy("project_id", "file_id", "revit", "variant").agg(F.sort_array(F.collect_list("r")).alias("body")))
    revit_headers = F.array(*[F.array(_lit_array(h)) for h in ODD_REVIT_HEADERS])
    gurtz_headers = F.array(*[F.array(*[_lit_array(r) for r in h]) for h in ODD_GURTZ_HEADERS])
    header = (F.when(F.col("project_id") % 17 == 0, F.array(_lit_array(ODD_NO_HEADER)))
              .when(F.col("revit"), F.get(revit_headers, F.col("variant") % 2)).otherwise(F.get(gurtz_headers, F.col("variant"))))
    title = F.when(F.col("revit"), F.array(_lit_array(REVIT_TITLE))).otherwise(F.array(_lit_array(GURTZ_TITLE)))
    first = F.slice(F.concat(title, header, _cells_of(F.slice("body", 1, HEADER_SEARCH_ROWS))), 1, HEADER_SEARCH_ROWS)
    return body.select("project_id", "file_id", _numbered(F.concat(title, header, _cells_of("body"))).alias("rows"),
                       _numbered(first).alias("head"))


def odd_encoding(file_id: Column) -> Column:
    """Spaces beyond Latin-1 occur, so UTF-8 with or without a byte-order mark."""
    return F.when(F.pmod(file_id, F.lit(2)) == 0, F.lit("utf-8-sig")).otherwise(F.lit("utf-8"))


def file_encoding(file_id: Column) -> Column:
    """How each derived file is stored: UTF-8 with a byte-order mark, UTF-8
    with CRLF line ends, or Latin-1 (the titles hold an e-acute, so the
    Latin-1 files are not valid UTF-8)."""
    k = F.pmod(file_id, F.lit(3))
    return F.when(k == 0, F.lit("utf-8-sig")).when(k == 1, F.lit("utf-8")).otherwise(F.lit("latin-1"))


def file_eol(file_id: Column) -> Column:
    return F.when(F.pmod(file_id, F.lit(3)) == 1, F.lit("\r\n")).otherwise(F.lit("\n"))


def raw_rows_of(grids: DataFrame) -> DataFrame:
    """Long form: project_id, file_id, row_idx, cells."""
    return grids.select("project_id", "file_id", F.explode("rows").alias("r")).select(
        "project_id", "file_id", F.col("r.row_idx").alias("row_idx"), F.col("r.cells").alias("cells"))


def flat_cells(raw: DataFrame, width: int = 6, na: bool = False) -> DataFrame:
    """raw rows with cells spread into cell_0..cell_{width-1} plus n_cells;
    na=True maps NA tokens to null."""
    from bomspark.functions.text import na_to_null

    def cell(i):
        c = F.get(F.col("cells"), i)
        return na_to_null(c) if na else c
    return raw.select("project_id", "file_id", "row_idx",
                      F.size("cells").alias("n_cells"),
                      *[cell(i).alias(f"cell_{i}") for i in range(width)])
