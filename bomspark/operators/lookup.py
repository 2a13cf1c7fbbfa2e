"""Ordered keyword lookup (J1) and its single reuse for every table.

"First catalogue keyword, in priority order, that is a substring of the
lower-cased name" is a theta join.  Instead of a nested-loop join we turn it
into an equi-join: every name is expanded into its substrings of exactly the
lengths that occur among the keywords, and those candidates are joined to the
catalogue on ``keyword``.  The expansion is exact (a keyword of length k is a
substring iff it equals one of the length-k substrings), costs
O(len(name) x distinct keyword lengths) per *distinct* name, and the join is
left to the planner: broadcast when the measured size allows, shuffled otherwise.

A catalogue of more than ``MAX_LENGTHS`` keyword lengths is matched through a seed index
instead: a keyword's seed is its first q characters, q being the shortest keyword's length.
A name makes one candidate per position, its q characters there; a join on the seed finds the
keywords that may start at that position, and only those that do are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomspark.fixed_values import DEFAULT_LEAD, LEAD_TIME_CATALOGUE

# A catalogue of at most this many rows is matched by one CASE WHEN chain in
# order of priority, then keyword: no candidate explosion, no join, no
# aggregate.  Its entries reach the driver only after the row count has proven
# them this few; they then travel inside the plan, like a broadcast.
INLINE_MAX_ROWS = 64

# Beyond this many distinct keyword lengths names are matched by seeds.
MAX_LENGTHS = 8

# (rows, distinct keyword lengths, priorities unique)
DEFAULT_PROFILE = (
    len(LEAD_TIME_CATALOGUE),
    sorted({len(k) for k, *_ in LEAD_TIME_CATALOGUE}),
    True,
)

LOOKUP_COLUMNS = ["keyword", "lead_min_weeks", "lead_max_weeks", "unit_cost"]


def catalogue_profile(catalogue: DataFrame) -> tuple[int, list[int], bool]:
    """(row count, distinct keyword lengths, priorities unique) in one small
    aggregate."""
    r = catalogue.agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_set(F.length("keyword"))).alias("lens"),
        F.count_distinct("priority").alias("np"),
    ).first()
    return int(r["n"]), [int(x) for x in (r["lens"] or []) if x is not None], r["np"] == r["n"]


def _profile(catalogue: DataFrame, profile) -> tuple[int, list[int], bool]:
    if profile is None:
        return catalogue_profile(catalogue)
    if len(profile) == 2:          # (rows, lengths) of a catalogue built in order
        return profile[0], profile[1], True
    return profile


def _first_match(cand: DataFrame, key: str, catalogue: DataFrame, unique_priority: bool) -> DataFrame:
    """key + _m (struct keyword, min_weeks, max_weeks, unit_cost or null).

    With unique priorities the winner is min(priority), an integer hash
    aggregate, and its entry is fetched by a second join on the priority;
    otherwise the least (priority, keyword) wins.  Whether a side is broadcast
    is left to the planner, which measures bytes."""
    hit = F.struct("keyword", "min_weeks", "max_weeks", "unit_cost")
    if unique_priority:
        kw = catalogue.select(F.col("keyword").alias("_kw"), F.col("priority").alias("_p"))
        best = cand.join(kw, "_kw", "left").groupBy(key).agg(F.min("_p").alias("_p"))
        by_p = catalogue.select(F.col("priority").alias("_p"), hit.alias("_m"))
        return best.join(by_p, "_p", "left").select(key, "_m")
    kw = catalogue.select(F.col("keyword").alias("_kw"), F.struct("priority", "keyword", hit.alias("m")).alias("_e"))
    best = cand.join(kw, "_kw", "left").groupBy(key).agg(F.min("_e").alias("_e"))
    return best.select(key, F.col("_e.m").alias("_m"))


def _substring_of_length(name: Column, k: int):
    # transform() inspects the lambda's arity, so k must not be a parameter.
    return lambda p: F.substr(name, p, F.lit(k))


def _candidates(name: Column, lengths: list[int]) -> Column:
    n = F.length(name)
    empty = F.array().cast("array<string>")
    parts = []
    for k in lengths:
        if k <= 0:
            parts.append(F.when(name.isNotNull(), F.array(F.lit(""))).otherwise(empty))
            continue
        subs = F.transform(F.sequence(F.lit(1), n - k + 1), _substring_of_length(name, k))
        parts.append(F.when(n >= k, subs).otherwise(empty))
    if not parts:
        return empty
    return F.array_distinct(F.flatten(F.array(*parts)))


def _seed_matches(names: DataFrame, key: str, catalogue: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, _kw): the keywords that each name contains, null for none, by the seed index.
    Empty keywords are contained in every name."""
    q = min(k for k in lengths if k > 0)
    lname = F.lower(F.col(key))
    spots = F.when(F.length(lname) >= q, F.transform(F.sequence(F.lit(1), F.length(lname) - q + 1), lambda p: F.struct(
        F.substr(lname, p, F.lit(q)).alias("seed"), p.alias("at"))))
    if 0 in lengths:
        start = F.array(F.struct(F.lit("").alias("seed"), F.lit(1).alias("at")))
        spots = F.when(F.col(key).isNotNull(), F.when(F.length(lname) >= q, F.concat(start, spots)).otherwise(start))
    cand = names.select(F.col(key), F.explode(spots).alias("_s")).select(key, "_s.seed", "_s.at")
    seeds = catalogue.select(F.col("keyword").alias("_kw"), F.substr(F.col("keyword"), F.lit(1), F.lit(q)).alias("seed"))
    starts = F.substr(F.lower(F.col(key)), F.col("at"), F.length("_kw")) == F.col("_kw")
    found = cand.join(seeds, "seed").filter(starts).select(key, "_kw").distinct()
    return names.select(key).join(found.withColumnRenamed(key, "_n"), F.col(key).eqNullSafe(F.col("_n")), "left").select(key, "_kw")


def _inline_entries(catalogue: DataFrame, rows: int) -> list | None:
    """The entries in order if there are at most INLINE_MAX_ROWS, else None.
    ``rows`` may come from a caller, so the collect has its own bound."""
    if rows > INLINE_MAX_ROWS:
        return None
    entries = (catalogue.orderBy("priority", "keyword").select("keyword", "min_weeks", "max_weeks", "unit_cost")
               .limit(INLINE_MAX_ROWS + 1).collect())
    return entries if len(entries) <= INLINE_MAX_ROWS else None


def inline_match(name: Column, entries: list) -> Column:
    """struct(keyword, min_weeks, max_weeks, unit_cost) of the first of
    ``entries`` whose keyword is contained in lower(name); null when none is."""
    lname = F.lower(name)
    out = None
    for kw, lo, hi, cost in entries:
        hit = F.struct(F.lit(kw).alias("keyword"), F.lit(lo).cast("int").alias("min_weeks"),
                       F.lit(hi).cast("int").alias("max_weeks"), F.lit(cost).cast("bigint").alias("unit_cost"))
        out = F.when(lname.contains(kw), hit) if out is None else out.when(lname.contains(kw), hit)
    if out is None:
        return F.lit(None).cast("struct<keyword:string,min_weeks:int,max_weeks:int,unit_cost:bigint>")
    return out


def default_lead_struct(default=DEFAULT_LEAD) -> Column:
    kw, lo, hi, cost = default
    return F.struct(
        F.lit(kw).alias("keyword"),
        F.lit(lo).cast("int").alias("min_weeks"),
        F.lit(hi).cast("int").alias("max_weeks"),
        F.lit(cost).cast("bigint").alias("unit_cost"),
    )


def match_keywords(names: DataFrame, catalogue: DataFrame, name_col: str = "family",
                   profile: tuple[int, list[int]] | None = None,
                   default=DEFAULT_LEAD) -> DataFrame:
    """One row per distinct ``name_col``: keyword, lead_min_weeks,
    lead_max_weeks, unit_cost of the first matching keyword (or the default)."""
    rows, lengths, unique = _profile(catalogue, profile)
    entries = _inline_entries(catalogue, rows)
    if entries is not None:
        best = names.select(name_col).distinct().select(
            name_col, inline_match(F.col(name_col), entries).alias("_m"))
    else:
        lname = F.lower(F.col(name_col))
        if len(lengths) > MAX_LENGTHS:
            cand = _seed_matches(names.select(name_col).distinct(), name_col, catalogue, lengths)
        else:
            cand = names.select(F.col(name_col), F.explode_outer(_candidates(lname, lengths)).alias("_kw"))
        best = _first_match(cand, name_col, catalogue, unique)
    m = F.coalesce(F.col("_m"), default_lead_struct(default))
    return best.select(
        F.col(name_col),
        m["keyword"].alias("keyword"),
        m["min_weeks"].alias("lead_min_weeks"),
        m["max_weeks"].alias("lead_max_weeks"),
        m["unit_cost"].alias("unit_cost"),
    )


def enrich(summary: DataFrame, catalogue: DataFrame, key: str = "family",
           profile: tuple[int, list[int]] | None = None) -> DataFrame:
    """Attach the lookup (keyword, lead_min_weeks, lead_max_weeks, unit_cost)
    to every row, after the row's own columns.

    The result does not depend on the size of the catalogue: a null name gets the
    default entry, equal rows stay as many as they are.  A catalogue of at most
    ``INLINE_MAX_ROWS`` is one CASE WHEN chain per row; a larger one is matched
    once per distinct name and joined back on the name."""
    return enrich_by_name(summary, summary, catalogue, key, profile)


def enrich_by_name(summary: DataFrame, names: DataFrame, catalogue: DataFrame, key: str = "family",
                   profile: tuple[int, list[int]] | None = None) -> DataFrame:
    """``enrich`` with the names taken from ``names`` (a column ``key`` that holds
    every name of ``summary``).  Taken from a written table, e.g. the line rollup,
    they cost a scan of that table, not of the lines.  Names repeat across
    projects, so the substring candidates shrink by that factor; the lookup is
    joined back on the name (AQE broadcasts it when its measured size is small,
    and splits a hot name's partition otherwise)."""
    rows, lengths, unique = _profile(catalogue, profile)
    entries = _inline_entries(catalogue, rows)
    if entries is not None:
        m = F.coalesce(inline_match(F.col(key), entries), default_lead_struct())
        return summary.select(*summary.columns, m["keyword"].alias("keyword"), m["min_weeks"].alias("lead_min_weeks"),
                              m["max_weeks"].alias("lead_max_weeks"), m["unit_cost"].alias("unit_cost"))
    found = match_keywords(names.select(key).distinct(), catalogue, key,
                           (rows, lengths, unique)).withColumnRenamed(key, "_name")
    return (summary.join(found, summary[key].eqNullSafe(found["_name"]), "left")
            .select(*summary.columns, *LOOKUP_COLUMNS))
