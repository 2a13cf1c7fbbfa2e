"""Per-file layout detection and header location.

Input is one row per file with ``rows: array<struct<row_idx, cells>>``, dense and
in order, or one row per block of a file (as the CSV reader makes them), each with
the file's first records in ``head``.
Every step here is a per-row expression over that array: no aggregate, no
join back to the lines, no shuffle.  Only the first 20 records are ever
inspected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomspark import fixed_values as fv
from bomspark.functions.text import na_to_null, norm_cell

HEADER_COLUMNS = ["layout", "header_idx", "level_pos", "panel_pos", "type_pos"]


def normalise_na(grids: DataFrame) -> DataFrame:
    """Exact NA tokens -> null in every cell (idempotent)."""
    def nulled(rows):
        return F.transform(rows, lambda r: F.struct(
            r["row_idx"].alias("row_idx"),
            F.transform(r["cells"], na_to_null).alias("cells")))
    return grids.withColumns({c: nulled(c) for c in ("rows", "head") if c in grids.columns})


def _last_position(n: Column, name: str) -> Column:
    """0-based index of the last cell equal to name (null if absent)."""
    return F.when(F.array_contains(n, name),
                  (F.size(n) - F.array_position(F.reverse(n), name)).cast("int"))


def with_header(grids: DataFrame) -> DataFrame:
    """Adds layout, header_idx, level_pos, panel_pos, type_pos.

    layout: the first of the first 20 records whose first cell is "family"
    (revit) or which holds both "level" and "panel name" (gurtz); revit if
    none.  Revit header: first such "family" record.  Gurtz header: the first
    record holding "level" (it may precede the detection record); positions
    are the last matching cell, defaulting to 0 / 3 / 5.  header_idx is null
    when the layout's header is missing (the file is rejected).
    """
    head = F.col("head") if "head" in grids.columns else F.slice("rows", 1, fv.HEADER_SEARCH_ROWS)
    normed = F.transform(head, lambda r: F.struct(
        r["row_idx"].alias("row_idx"),
        F.transform(r["cells"], norm_cell).alias("n")))
    g = grids.withColumn("_norm", normed)

    def verdict(r):
        n = r["n"]
        return (F.when(F.get(n, 0) == fv.REVIT_HEADER_CELL, F.lit(fv.LAYOUT_REVIT))
                .when(F.array_contains(n, fv.GURTZ_LEVEL) & F.array_contains(n, fv.GURTZ_PANEL),
                      F.lit(fv.LAYOUT_GURTZ)))

    verdicts = F.filter(F.transform("_norm", verdict), lambda v: v.isNotNull())
    layout = F.coalesce(F.get(verdicts, 0), F.lit(fv.LAYOUT_REVIT))
    revit_hdr = F.get(F.filter("_norm", lambda r: F.get(r["n"], 0) == fv.REVIT_HEADER_CELL), 0)
    gurtz_hdr = F.get(F.filter("_norm", lambda r: F.array_contains(r["n"], fv.GURTZ_LEVEL)), 0)
    g = g.select(*grids.columns, layout.alias("layout"),
                 revit_hdr["row_idx"].alias("_revit_idx"), gurtz_hdr.alias("_gurtz"))
    is_gurtz = F.col("layout") == fv.LAYOUT_GURTZ
    gn = F.col("_gurtz")["n"]
    d = fv.GURTZ_DEFAULT_POSITIONS

    def pos(name: str) -> Column:
        return F.when(is_gurtz, F.coalesce(_last_position(gn, name), F.lit(d[name])))

    return g.select(
        *grids.columns, "layout",
        F.when(is_gurtz, F.col("_gurtz")["row_idx"]).otherwise(F.col("_revit_idx")).alias("header_idx"),
        pos(fv.GURTZ_LEVEL).alias("level_pos"),
        pos(fv.GURTZ_PANEL).alias("panel_pos"),
        pos(fv.GURTZ_TYPE).alias("type_pos"),
    )


def first_blocks(grids: DataFrame) -> DataFrame:
    """One row per file: a file read in blocks keeps its first."""
    return grids.filter(F.col("block_no") == 0) if "block_no" in grids.columns else grids


def file_header(grids: DataFrame) -> DataFrame:
    """project_id, file_id, layout, header_idx, level_pos, panel_pos, type_pos
    for every file whose header was found."""
    h = with_header(first_blocks(grids))
    # a generator instead of a filter, which Catalyst would push below the header search and so search twice
    found = F.filter(F.array(F.struct(*HEADER_COLUMNS)), lambda x: x["header_idx"].isNotNull())
    return h.select("project_id", "file_id", F.inline(found))


def layout_label(layout: Column) -> Column:
    out = None
    for k, label in fv.LAYOUT_LABELS.items():
        out = F.when(layout == k, F.lit(label)) if out is None else out.when(layout == k, F.lit(label))
    return out


def layouts(grids: DataFrame) -> DataFrame:
    """project_id, file_id, layout, layout_label."""
    h = with_header(first_blocks(grids))
    return h.select("project_id", "file_id", "layout", layout_label(F.col("layout")).alias("layout_label"))


def reject_reason(headed: DataFrame) -> Column:
    """Why a file cannot be cleaned: a read error, or no header for the detected layout; else null."""
    err = F.col("error") if "error" in headed.columns else F.lit(None).cast("string")
    return F.coalesce(
        err,
        F.when(F.col("header_idx").isNull(),
               F.when(F.col("layout") == fv.LAYOUT_GURTZ, F.lit(fv.REJECT_NO_LEVEL))
               .otherwise(F.lit(fv.REJECT_NO_FAMILY))))


def rejects(headed: DataFrame) -> DataFrame:
    """project_id, file_id, reason for files that cannot be cleaned (``reject_reason``)."""
    return first_blocks(headed).select("project_id", "file_id", reject_reason(headed).alias("reason")).filter(
        F.col("reason").isNotNull())
