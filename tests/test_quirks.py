"""One test per behaviour that must be kept exactly."""

import pytest
from pyspark.sql import functions as F

from bomspark import fixed_values as fv
from bomspark.functions import planning as P
from bomspark.functions import text as T
from bomspark.operators.lookup import DEFAULT_PROFILE, match_keywords
from bomspark.operators.quality import issues_expr
from bomspark.sources.catalogue import default_catalogue


def one_col(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_strip_unicode_whitespace(spark):
    vals = ["  A 　", "\tB\x1c", " C ", "\x85D ", " E F "]
    assert one_col(spark, vals, T.strip) == [v.strip() for v in vals]


def test_na_tokens_exact_match(spark):
    vals = ["NA", " NA", "N/A", "n/a", "null", "None", "", "-nan", "1.#QNAN", "na", "nil"]
    got = one_col(spark, vals, T.na_to_null)
    assert got == [None if v in fv.NA_TOKENS else v for v in vals]
    assert got[1] == " NA" and got[9] == "na"


@pytest.mark.parametrize("raw,expected", [
    ("2.7", 2), ("1e3", 1000), ("-3", -3), ("0", 0), ("+5", 5), (".5", 0), ("5.", 5), ("-2.7", -2),
    ("1,000", None), ("1d", None), ("inf", None), ("abc", None), ("", None), ("99999999999999999999", None),
])
def test_count_coercion(spark, raw, expected):
    assert one_col(spark, [raw], T.parse_count) == [expected]


def test_issue_order_and_separator(spark):
    df = spark.createDataFrame([("", "", ""), ("x", "", "y"), ("x", "y", "z"), (" ", "p", "")],
                               "t string, p string, l string")
    got = [r[0] for r in df.select(issues_expr(F.col("t"), F.col("p"), F.col("l"))).collect()]
    assert got == ["Type undefined; Panel not assigned; Level missing", "Panel not assigned", "",
                   "Type undefined; Level missing"]


@pytest.mark.parametrize("level,key", [
    ("Basement B1", 0), ("B2", 0), ("Parking", 0), ("Playground", 0), ("B12", 0), ("Ground", 0),
    ("Roof", 99), ("Floor2", 99), ("Tower1", 99), ("Level -1", 1), ("Level 0", 0), ("Level 120", 120),
    ("B3", 3), ("Mezzanine", 50), ("", 50), ("Level 007", 7),
])
def test_level_sort_key(spark, level, key):
    assert one_col(spark, [level], P.level_sort_key) == [key]


@pytest.mark.parametrize("level,action", [
    ("B2", fv.ACTION_STANDARD), ("Basement B1", fv.ACTION_MAIN), ("Parking P1", fv.ACTION_MAIN),
    ("Roof", fv.ACTION_ROOF), ("Tower1", fv.ACTION_ROOF), ("Level 3", fv.ACTION_STANDARD),
    ("Groundfloor", fv.ACTION_MAIN),
])
def test_recommended_action(spark, level, action):
    assert one_col(spark, [level], P.recommended_action) == [action]


@pytest.mark.parametrize("deadline,as_of,days", [
    ("2026-02-23 00:00:00", "2026-02-12 09:00:00", 10),
    ("2026-02-12 00:00:00", "2026-02-12 09:00:00", -1),
    ("2026-02-12 00:00:00", "2026-02-12 00:00:00", 0),
    ("2025-12-15 00:00:00", "2026-02-12 09:00:00", -60),
    ("2026-03-09 00:00:00", "2026-02-12 09:00:00", 24),
])
def test_days_until_floors(spark, deadline, as_of, days):
    df = spark.createDataFrame([(deadline, as_of)], "d string, a string")
    got = df.select(P.days_until(F.col("d").cast("timestamp_ntz"), F.col("a").cast("timestamp_ntz"))).first()[0]
    assert got == days


@pytest.mark.parametrize("days,status", [
    (-1, fv.STATUS_OVERDUE), (0, fv.STATUS_CRITICAL), (13, fv.STATUS_CRITICAL), (14, fv.STATUS_WARNING),
    (29, fv.STATUS_WARNING), (30, fv.STATUS_OK)])
def test_status_bands(spark, days, status):
    assert one_col(spark, [days], P.lead_status, "bigint") == [status]


@pytest.mark.parametrize("total,tier", [
    (100001, fv.TIER_HIGH), (100000, fv.TIER_MEDIUM), (20001, fv.TIER_MEDIUM), (20000, fv.TIER_LOW),
    (0, fv.TIER_LOW)])
def test_spend_tiers(spark, total, tier):
    assert one_col(spark, [total], P.spend_tier, "bigint") == [tier]


def test_money_and_thousands(spark):
    vals = [0, 1234, -1500, 78000, 2500, 3500, 1234567, 999]
    assert one_col(spark, vals, T.money, "bigint") == ["$" + f"{v:,.0f}" for v in vals]
    assert one_col(spark, vals, T.thousands, "bigint") == [f"{v / 1000:.0f}k" for v in vals]


def test_html_escape(spark):
    assert one_col(spark, ["a<b>&\"c'"], T.html_escape) == ["a&lt;b&gt;&amp;&quot;c&#x27;"]


@pytest.mark.parametrize("name,keyword", [
    ("Heat Pump Fan", "fan"), ("Disconnector", "disconnect"), ("Parameter", "meter"), ("Groups", "ups"),
    ("Flats", "ats"), ("Main Switchboard MSB", "switchboard"), ("Panelboard 208V", "panelboard"),
    ("PV Inverter", "pv"), ("Lighting Fixture", "default"), ("Cooling Tower CT-1", "cooling tower"),
    ("Defaults", "default"), ("", "default"),
])
def test_keyword_first_match(spark, name, keyword):
    names = spark.createDataFrame([(name,)], "family string")
    r = match_keywords(names, default_catalogue(spark), "family", DEFAULT_PROFILE).first()
    assert r["keyword"] == keyword
    py = next((k for k, *_ in fv.LEAD_TIME_CATALOGUE if k in name.lower()), "default")
    assert r["keyword"] == py


@pytest.mark.parametrize("entries", [25, 100])
def test_lookup_does_not_depend_on_the_strategy(spark, monkeypatch, entries):
    """CASE chain and join, over null, empty and repeated names, equal rows and
    clashing order: same rows, same columns, same order of columns."""
    from bomspark.operators import lookup as L
    from bomspark.sources.catalogue import catalogue_from_entries
    listed = list(fv.LEAD_TIME_CATALOGUE) + [(f"item{i:03d}", i, i + 1, 10 * i) for i in range(entries - 25)]
    cat = catalogue_from_entries(spark, listed)
    names = ["Heat Pump Fan", "Flats", "Widget", None, "", "Heat Pump Fan", "ITEM004x", None]
    rows = [(i // 2, n, 1) for i, n in enumerate(names)] + [(9, "Fan", 5)] * 3
    s = spark.createDataFrame(rows, "project_id long, family string, count long")
    found = {}
    for limit in (0, 64, 1000):
        monkeypatch.setattr(L, "INLINE_MAX_ROWS", limit)
        e, m = L.enrich(s, cat), L.match_keywords(s.select("family"), cat)
        assert e.columns == s.columns + L.LOOKUP_COLUMNS
        found[limit] = (sorted(map(str, e.collect())), sorted(map(str, m.collect())))
        assert e.filter("family IS NULL AND keyword = 'default'").count() == 2
        assert e.filter("family = 'Fan'").count() == 3
        assert e.filter("lead_min_weeks IS NULL OR unit_cost IS NULL").count() == 0
    assert found[0] == found[64] == found[1000]
    # a profile that understates the catalogue must not change the answer
    monkeypatch.setattr(L, "INLINE_MAX_ROWS", 30)
    wrong = L.enrich(s, cat, "family", (1, sorted({len(k) for k, *_ in listed}), True))
    assert sorted(map(str, wrong.collect())) == found[0][0]


def test_duplicate_priorities_use_min_by_path(spark):
    from bomspark.operators.lookup import catalogue_profile
    from bomspark.sources.catalogue import CATALOGUE_SCHEMA
    cat = spark.createDataFrame([(1, "fan", 1, 2, 10), (1, "box", 3, 4, 20), (2, "pull", 5, 6, 30)],
                                CATALOGUE_SCHEMA)
    rows, lengths, unique = catalogue_profile(cat)
    assert (rows, lengths, unique) == (3, [3, 4], False)
    names = spark.createDataFrame([("Pull Box",), ("Fan",), ("Pump",)], "family string")
    got = {r["family"]: r["keyword"] for r in match_keywords(names, cat, "family").collect()}
    assert got == {"Pull Box": "box", "Fan": "fan", "Pump": "default"}


def test_lookup_by_distinct_name_equals_inline(spark):
    from bomspark.operators.lookup import DEFAULT_PROFILE, enrich, enrich_by_name
    from bomspark.sources.catalogue import default_catalogue
    s = spark.createDataFrame([("a", "Heat Pump Fan", 2), ("b", "Heat Pump Fan", 1), ("b", "Widget", 4),
                               ("c", None, 1), ("c", "Dry Type Transformer", 3)],
                              "project_id string, family string, count bigint")
    cat = default_catalogue(spark)
    inline = enrich(s, cat, "family", DEFAULT_PROFILE)
    by_name = enrich_by_name(s, s, cat, "family", DEFAULT_PROFILE)
    assert sorted(map(str, inline.collect())) == sorted(map(str, by_name.collect()))
    assert by_name.filter("family IS NULL").first()["keyword"] == "default"


def test_case_chain_equals_candidate_join(spark, monkeypatch):
    """The CASE chain used for tiny catalogues and the substring-candidate
    join (broadcast) give the same lookup on the driver's BOM, for the default
    catalogue and for the test catalogue with its shadowing keywords."""
    from conftest import SF_SMALL

    from bomspark.operators import lookup as L
    from bomspark.operators.summary import summarise
    from bomspark.sources.catalogue import catalogue_from_entries
    from bomspark.sources.tables import TEST_CATALOGUE, bom_view
    s = summarise(bom_view(spark, SF_SMALL))
    extra = spark.createDataFrame([(0, "Heat Pump Fan", 1), (0, "Flats", 1), (0, None, 1), (0, "", 1)],
                                  "project_id bigint, family string, count bigint")
    s = s.unionByName(extra)
    for cat in (default_catalogue(spark), catalogue_from_entries(spark, TEST_CATALOGUE)):
        case = sorted(map(str, L.enrich(s, cat).collect()))
        case_names = sorted(map(str, L.match_keywords(s.select("family"), cat).collect()))
        monkeypatch.setattr(L, "INLINE_MAX_ROWS", 0)
        join = sorted(map(str, L.enrich(s, cat).collect()))
        join_names = sorted(map(str, L.match_keywords(s.select("family"), cat).collect()))
        monkeypatch.setattr(L, "INLINE_MAX_ROWS", 64)
        assert case == join and case_names == join_names


def test_empty_catalogue_gives_default(spark):
    from bomspark.operators.lookup import enrich, match_keywords
    from bomspark.sources.catalogue import catalogue_from_entries
    empty = catalogue_from_entries(spark, [])
    names = spark.createDataFrame([("Heat Pump Fan",), (None,)], "family string")
    assert {r["keyword"] for r in match_keywords(names, empty, "family").collect()} == {"default"}
    s = spark.createDataFrame([("a", "Fan", 1)], "project_id string, family string, count bigint")
    assert enrich(s, empty).first()["unit_cost"] == 1500


def test_project_start_defaults(spark):
    """No start given, a project missing from the table and a null start all mean 20
    weeks after as_of; a project listed twice does not repeat its rows."""
    from bomspark.operators.planning import lead_times
    from bomspark.operators.lookup import enrich
    s = spark.createDataFrame([("a", "Fan", 1), ("b", "Fan", 1), ("c", "Fan", 1)],
                              "project_id string, family string, count bigint")
    e = enrich(s, default_catalogue(spark))
    starts = spark.createDataFrame([("a", "2020-03-02 00:00:00"), ("a", "2020-03-01 00:00:00"), ("b", None)],
                                   "project_id string, project_start string")
    by_default = {r.project_id: (r.order_by_date, r.status) for r in lead_times(e, None, "2020-01-01").collect()}
    listed = {r.project_id: (r.order_by_date, r.status) for r in lead_times(e, starts, "2020-01-01").collect()}
    assert len(listed) == 3
    assert listed["b"] == by_default["b"] and listed["c"] == by_default["c"]
    assert listed["a"] != by_default["a"]
    assert by_default["a"][0].year == 2020


def test_unknown_days_have_no_status(spark):
    from pyspark.sql import functions as F
    from bomspark.functions.planning import lead_status
    assert spark.range(1).select(lead_status(F.lit(None).cast("bigint")).alias("s")).first().s is None
