"""Ice-chart risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import classify_rio
from ..operators import risk as op
from ..sources import policy as p
from ..sources import tables as t
from .registry import query
from .sql import define, using

CLASS = "PC6"
_RIV = p.riv_map(CLASS)


def _values(rows) -> str:
    fmt = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(fmt(v) for v in r) + ")" for r in rows) + ")"


define("stage", "SELECT * FROM " + _values([(k, c, o, _RIV[c], _RIV[o]) for k, (c, o) in p.STAGES.items()])
       + " s(code, cons, opt, cons_riv, opt_riv)")
define("ctc", "SELECT * FROM " + _values([(k, a, b) for k, (a, b) in p.CT_CODES.items()]) + " s(code, low, high)")
define("partial", "SELECT * FROM " + _values(list(p.PARTIALS.items())) + " s(code, tenths)")
define("riv", "SELECT * FROM " + _values([(c, p.CATEGORY[c], ty, float(v)) for c, vs in p.RIV_STANDARD.items()
                                          for ty, v in zip(p.ICE_TYPES, vs)]) + " s(ice_class, category, ice_type, riv)")
define("slots", """SELECT polygon_id, slot, stage, tenths, POLY_TYPE, SA = '98' AS conv FROM (
    SELECT polygon_id, POLY_TYPE, SA, 'SA' AS slot, SA AS stage, CA AS conc FROM polygons UNION ALL
    SELECT polygon_id, POLY_TYPE, SA, 'SB', SB, CB FROM polygons UNION ALL
    SELECT polygon_id, POLY_TYPE, SA, 'SC', SC, CC FROM polygons) LEFT JOIN partial ON code = conc
    WHERE POLY_TYPE = 'I' AND stage <> '-9'""", ["polygons", "partial"])
define("sea", """SELECT s.*, st.cons, st.opt, st.cons_riv, st.opt_riv FROM slots s LEFT JOIN stage st ON st.code = s.stage
    WHERE NOT (slot = 'SA' AND conv)""", ["slots", "stage"])
define("seen", """SELECT polygon_id, count(*) AS n_sea, count(*) FILTER (WHERE cons IS NULL) AS unlisted,
    count(*) FILTER (WHERE stage <> '00' AND cons IS NOT NULL) > 0 AS sensitive, sum(tenths) AS named,
    sum(tenths * cons_riv) AS cons_sum, sum(tenths * opt_riv) AS opt_sum,
    min(cons_riv) FILTER (WHERE tenths IS NOT NULL) AS cons_min, min(opt_riv) FILTER (WHERE tenths IS NOT NULL) AS opt_min,
    min(cons_riv) AS cons_any, min(opt_riv) AS opt_any FROM sea GROUP BY polygon_id""", ["sea"])
define("chart", """SELECT q.*, CASE WHEN POLY_TYPE = 'W' THEN 'resolved' WHEN POLY_TYPE <> 'I' THEN 'unknown'
      WHEN ct_low IS NULL OR unlisted > 0 OR n_sea = 0 THEN 'unknown'
      WHEN bare AND n_sea = 1 THEN 'partials_absent' WHEN bare THEN 'unknown'
      WHEN ct_low = ct_high THEN 'resolved' ELSE 'interval' END AS state FROM (
    SELECT g.polygon_id, POLY_TYPE, POLY_TYPE = 'W' AS is_water, SA = '98' AND POLY_TYPE = 'I' AS convention,
      c.low AS ct_low, c.high AS ct_high, coalesce(n_sea, 0) AS n_sea, coalesce(unlisted, 0) AS unlisted,
      coalesce(sensitive, FALSE) AS mapping_sensitive, CA = '-9' AND CB = '-9' AND CC = '-9' AS bare,
      CASE WHEN SA = '98' AND POLY_TYPE = 'I' THEN b.tenths END AS iceberg_tenths, SO = '98' AS iceberg_trace,
      coalesce(named, 0) AS named, coalesce(cons_sum, 0) AS cons_sum, coalesce(opt_sum, 0) AS opt_sum, cons_min, opt_min, cons_any, opt_any
    FROM polygons g LEFT JOIN seen USING (polygon_id) LEFT JOIN ctc c ON c.code = CT LEFT JOIN partial b ON b.code = CA) q""",
       ["polygons", "seen", "ctc", "partial"])


def _ends(kind: str) -> str:
    """Closed form: with exact partials only the iceberg bound moves the sum."""
    berg = "coalesce(iceberg_tenths, 0)"
    base = f"{kind}_sum + (10 - named - {berg}) * 3"
    fits = f"named + {berg} <= least(ct_high, 10)"
    a, b = f"ct_low * {kind}_any + (10 - ct_low) * 3", f"ct_high * {kind}_any + (10 - ct_high) * 3"
    absent = "state = 'partials_absent'"
    return (f"CASE WHEN state = 'unknown' THEN NULL WHEN {absent} THEN least({a}, {b}) WHEN {fits} THEN {base} + {berg} * coalesce({kind}_min, 3) END AS {kind}_low, "
            f"CASE WHEN state = 'unknown' THEN NULL WHEN {absent} THEN greatest({a}, {b}) WHEN {fits} THEN {base} + {berg} * 3 END AS {kind}_high")


def _band(x: str, category: str = "'polar_class'") -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} >= 0 THEN 'normal_operation' WHEN {x} >= -10 AND {category} = 'polar_class' "
            "THEN 'elevated_operational_risk' ELSE 'operation_subject_to_special_consideration' END")


def _verdict(kind: str) -> str:
    lo, hi = _band(f"{kind}_low"), _band(f"{kind}_high")
    return f"CASE WHEN {kind}_low IS NULL THEN 'unknown' WHEN {lo} = {hi} THEN {lo} ELSE 'indeterminate' END"


define("scored", f"""SELECT *, {_verdict('cons')} AS cons_class, {_verdict('opt')} AS opt_class
    FROM (SELECT *, {_ends('cons')}, {_ends('opt')} FROM chart)""", ["chart"])


def scored(spark, sf, ice_class=CLASS):
    return op.rio_interval(op.interpret(t.polygons(spark, sf)), ice_class)


@query("polygon_states", using("chart", """SELECT polygon_id, state, is_water, convention, CAST(n_sea AS INTEGER) AS n_sea,
    ct_low, ct_high, iceberg_tenths, iceberg_trace, mapping_sensitive FROM chart"""))
def polygon_states(spark, sf):
    return op.interpret(t.polygons(spark, sf)).select(
        "polygon_id", "state", "is_water", "convention", "n_sea", "ct_low", "ct_high", "iceberg_tenths", "iceberg_trace",
        "mapping_sensitive")


@query("polygon_components", using("slots stage", """SELECT polygon_id, slot, CASE WHEN slot = 'SA' AND conv THEN 'iceberg' ELSE 'sea_ice' END AS role,
    stage, tenths, CASE WHEN NOT (slot = 'SA' AND conv) THEN cons END AS conservative,
    CASE WHEN NOT (slot = 'SA' AND conv) THEN opt END AS optimistic FROM slots LEFT JOIN stage ON code = stage.code AND slots.stage = stage.code"""))
def polygon_components(spark, sf):
    return op.components(op.interpret(t.polygons(spark, sf)))


@query("stage_lookup", using("slots stage", """SELECT slots.stage AS stage, coalesce(any_value(cons), 'unknown') AS conservative,
    count(*) AS slots, count(tenths) AS with_tenths FROM slots LEFT JOIN stage ON slots.stage = stage.code GROUP BY 1"""))
def stage_lookup(spark, sf):
    """Stage codes against the policy dimension; an unlisted code reads 'unknown'."""
    dim = p.dimension(spark, [(k, c) for k, (c, _) in p.STAGES.items()], "stage, conservative")
    parts = op.components(op.interpret(t.polygons(spark, sf))).select("stage", "tenths")
    return (parts.join(F.broadcast(dim), "stage", "left")
            .groupBy("stage", F.coalesce("conservative", F.lit("unknown")).alias("conservative"))
            .agg(F.count(F.lit(1)).alias("slots"), F.count("tenths").alias("with_tenths")))


# a regime per part: three ice types whose tenths usually, not always, total ten
_REGIME = [(0, "p % 4"), (3, "1 + p % 3"), (8, "10 - p % 4 - (1 + p % 3) + CASE WHEN p % 17 = 0 THEN 1 ELSE 0 END")]
define("regimes", " UNION ALL ".join(
    f"SELECT CAST(p_partkey AS INTEGER) AS polygon_id, '{p.ICE_TYPES[i]}' AS ice_type, CAST({e.replace('p %', 'p_partkey %')} AS INTEGER) AS tenths FROM part"
    for i, e in _REGIME))


def regimes(spark, sf):
    part = t.read(spark, sf, "part").selectExpr("p_partkey AS p")
    items = [F.struct(F.lit(p.ICE_TYPES[i]).alias("ice_type"), F.expr(e).cast("int").alias("tenths")) for i, e in _REGIME]
    return part.select(F.col("p").cast("int").alias("polygon_id"), F.explode(F.array(*items)).alias("x")).select("polygon_id", "x.*")


def _riv(spark):
    return p.riv_rows(spark).where("riv_table = 'standard'").drop("riv_table")


_POINTS = """SELECT polygon_id, ice_class, category, sum(tenths) AS tenths, CASE WHEN sum(tenths) = 10 THEN sum(tenths * riv) END AS rio
    FROM regimes JOIN riv USING (ice_type) GROUP BY ALL"""
define("points", _POINTS, ["regimes", "riv"])


@query("rio_point", using("points", f"SELECT polygon_id, CAST(tenths AS BIGINT) AS tenths, rio FROM points WHERE ice_class = '{CLASS}'"))
def rio_point(spark, sf):
    riv = _riv(spark).where(F.col("ice_class") == CLASS)
    return op.rio_points(regimes(spark, sf), riv).select("polygon_id", "tenths", "rio")


@query("rio_bands", using("points", f"""SELECT ice_class, coalesce({_band('rio', 'category')}, 'refused') AS outcome, count(*) AS regimes,
    min(rio) AS lowest, max(rio) AS highest FROM points GROUP BY 1, 2"""))
def rio_bands(spark, sf):
    pts = op.rio_points(regimes(spark, sf), _riv(spark))
    outcome = F.when(F.col("category") == "polar_class", classify_rio(F.col("rio"))).otherwise(
        classify_rio(F.col("rio"), "below_polar_class"))
    return pts.groupBy("ice_class", F.coalesce(outcome, F.lit("refused")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("regimes"), F.min("rio").alias("lowest"), F.max("rio").alias("highest"))


@query("riv_long", using("regimes riv", """SELECT ice_class, ice_type, riv, count(*) AS regimes, CAST(sum(tenths) AS BIGINT) AS tenths
    FROM regimes JOIN riv USING (ice_type) GROUP BY ALL"""))
def riv_long(spark, sf):
    """The long risk table, with the chart tenths each of its rows is applied to."""
    used = regimes(spark, sf).groupBy("ice_type").agg(F.count(F.lit(1)).alias("regimes"), F.sum("tenths").alias("tenths"))
    return used.join(F.broadcast(_riv(spark)), "ice_type").select("ice_class", "ice_type", "riv", "regimes", "tenths")


@query("policy_dims", using("polygons ctc partial", """SELECT 'ct' AS field, CT AS code, any_value(low) AS low, any_value(high) AS high,
    count(*) AS polygons FROM polygons LEFT JOIN ctc ON code = CT GROUP BY CT UNION ALL
    SELECT 'partial', CA, any_value(tenths), any_value(tenths), count(*) FROM polygons LEFT JOIN partial ON code = CA GROUP BY CA"""))
def policy_dims(spark, sf):
    """Code dimensions joined to the codes charts really use; unlisted codes stay NULL."""
    rows = [("ct", k, a, b) for k, (a, b) in p.CT_CODES.items()] + [("partial", k, v, v) for k, v in p.PARTIALS.items()]
    dim = p.dimension(spark, rows, "field, code, low, high")
    codes = F.array(F.struct(F.lit("ct").alias("field"), F.col("CT").alias("code")),
                    F.struct(F.lit("partial").alias("field"), F.col("CA").alias("code")))
    used = (t.polygons(spark, sf).select(F.explode(codes).alias("x")).select("x.*")
            .groupBy("field", "code").agg(F.count(F.lit(1)).alias("polygons")))
    return used.join(F.broadcast(dim), ["field", "code"], "left")


@query("rio_interval", using("scored", """SELECT polygon_id, state, cons_low::DOUBLE AS conservative_low, cons_high::DOUBLE AS conservative_high,
    opt_low::DOUBLE AS optimistic_low, opt_high::DOUBLE AS optimistic_high, cons_class AS conservative_class, opt_class AS optimistic_class
    FROM scored"""))
def rio_interval(spark, sf):
    return scored(spark, sf).select("polygon_id", "state", "conservative_low", "conservative_high", "optimistic_low", "optimistic_high",
                                    "conservative_class", "optimistic_class")


def _pen(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in p.PENALTIES.items()) + " END"


define("pens", f"""SELECT polygon_id, {_pen('cons_class')} AS conservative, {_pen('opt_class')} AS optimistic,
    {_pen("coalesce(" + _band('cons_low') + ", 'unknown')")} AS worst, {_pen("coalesce(" + _band('cons_high') + ", 'unknown')")} AS best,
    cons_class AS classification, cons_low IS NOT NULL AS has_rio, is_water, mapping_sensitive,
    cons_class = 'indeterminate' OR opt_class = 'indeterminate' AS indeterminate FROM scored""", ["scored"])


def penalty_records(spark, sf):
    """One record per polygon, as the composition layer reads it."""
    out = op.penalties(scored(spark, sf))
    return out.select("polygon_id", F.col("conservative_penalty").alias("conservative"), F.col("optimistic_penalty").alias("optimistic"),
                      F.col("conservative_penalty_worst").alias("worst"), F.col("conservative_penalty_best").alias("best"),
                      F.col("conservative_class").alias("classification"), "has_rio", "is_water", "mapping_sensitive",
                      F.col("straddles").alias("indeterminate"))


@query("risk_penalties", using("pens", "SELECT * FROM pens"))
def risk_penalties(spark, sf):
    return penalty_records(spark, sf)


@query("chart_summary", using("scored", """SELECT conservative_class, optimistic_class, state, count(*) AS polygons,
    count(*) FILTER (WHERE cons_low IS NOT NULL) AS with_rio, count(*) FILTER (WHERE mapping_sensitive) AS sensitive,
    count(*) FILTER (WHERE cons_low IS NOT NULL AND opt_low IS NOT NULL AND conservative_class <> optimistic_class) AS differing,
    count(*) FILTER (WHERE conservative_class = 'indeterminate' OR optimistic_class = 'indeterminate') AS straddling,
    count(*) FILTER (WHERE iceberg_tenths > 0) AS iceberg_bearing, count(*) FILTER (WHERE iceberg_trace) AS iceberg_traces
    FROM (SELECT *, cons_class AS conservative_class, opt_class AS optimistic_class FROM scored)
    GROUP BY CUBE (conservative_class, optimistic_class, state)"""))
def chart_summary(spark, sf):
    return scored(spark, sf).cube("conservative_class", "optimistic_class", "state").agg(
        F.count(F.lit(1)).alias("polygons"), F.count_if("has_rio").alias("with_rio"), F.count_if("mapping_sensitive").alias("sensitive"),
        F.count_if("class_differs").alias("differing"), F.count_if("straddles").alias("straddling"),
        F.count_if(F.col("iceberg_tenths") > 0).alias("iceberg_bearing"), F.count_if("iceberg_trace").alias("iceberg_traces"))


define("dominant", """SELECT zone, r, c, polygon_id, area_share AS dominant_fraction, total_share, contributors,
    CASE WHEN total_share > 1 + 1e-9 THEN 'source_overlap' WHEN contributors >= 2 THEN 'adjacent' ELSE 'single' END AS kind
    FROM (SELECT *, row_number() OVER w AS rn, sum(area_share) OVER (PARTITION BY zone, r, c) AS total_share,
          count(*) OVER (PARTITION BY zone, r, c) AS contributors FROM cell_polygon_area
          WINDOW w AS (PARTITION BY zone, r, c ORDER BY area_share DESC, polygon_id)) WHERE rn = 1""", ["cell_polygon_area"])


@query("dominant_polygon", using("dominant", """SELECT zone, r, c, polygon_id, round(dominant_fraction, 6) AS dominant_fraction,
    round(total_share, 6) AS total_share, contributors, kind FROM dominant"""))
def dominant_polygon(spark, sf):
    return (op.dominant_polygons(t.cell_polygon_area(spark, sf))
            .withColumn("dominant_fraction", F.round("dominant_fraction", 6)).withColumn("total_share", F.round("total_share", 6)))


@query("polygon_quality", using("dominant", """SELECT polygon_id, count(*) AS cells, count(*) FILTER (WHERE dominant_fraction >= 1) AS full,
    count(*) FILTER (WHERE dominant_fraction < 1) AS partial, count(*) FILTER (WHERE dominant_fraction < 1 AND contributors >= 2) AS mixed
    FROM dominant GROUP BY polygon_id""").replace(" AS full,", ' AS "full",'))
def polygon_quality(spark, sf):
    return op.polygon_quality(op.dominant_polygons(t.cell_polygon_area(spark, sf)))
