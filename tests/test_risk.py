"""Risk intervals against full enumeration; dominance ties; readers of the policy documents."""

import itertools
import json

from floeframe.operators import risk as op
from floeframe.sources import policy as p

COLUMNS = "polygon_id int, POLY_TYPE string, CT string, CA string, CB string, CC string, SA string, SB string, SC string, SO string"


def enumerate_rio(rec, pick, riv):
    """All feasible endpoint sums, written out."""
    sea = [(rec["SB"], rec["CB"]), (rec["SC"], rec["CC"])]
    if rec["SA"] != "98":
        sea.insert(0, (rec["SA"], rec["CA"]))
    sea = [(s, c) for s, c in sea if s != "-9"]
    berg = p.PARTIALS.get(rec["CA"], 0) if rec["SA"] == "98" else 0
    absent = rec["CA"] == rec["CB"] == rec["CC"] == "-9"
    found = []
    for ct in set(p.CT_CODES[rec["CT"]]):
        parts = [(riv[p.STAGES[s][pick]], ct if absent else p.PARTIALS[c]) for s, c in sea if absent or c in p.PARTIALS]
        named = sum(t for _, t in parts) + berg
        if named > ct or named > 10:
            continue
        for bound in {min([v for v, _ in parts] or [3.0]), 3.0}:
            found.append(sum(v * t for v, t in parts) + berg * bound + (10 - named) * 3.0)
    return (min(found), max(found)) if found else (None, None)


def test_intervals_match_enumeration(spark):
    recs = []
    for ct, ca, cb, cc, sa, sb, sc in itertools.product(["92", "46", "81", "13"], ["10", "40", "-9"], ["20", "-9"], ["-9"],
                                                        ["86", "98", "95"], ["87", "-9"], ["-9"]):
        recs.append((len(recs), "I", ct, ca, cb, cc, sa, sb, sc, "-9"))
    df = spark.createDataFrame(recs, COLUMNS)
    for cls in ("PC6", "IC"):
        riv = p.riv_map(cls)
        for r in op.rio_interval(op.interpret(df), cls).collect():
            rec = r.asDict()
            if r["state"] == "unknown":
                assert r["conservative_low"] is None
                continue
            assert (r["conservative_low"], r["conservative_high"]) == enumerate_rio(rec, 0, riv), rec
            assert (r["optimistic_low"], r["optimistic_high"]) == enumerate_rio(rec, 1, riv), rec


def test_states_fail_closed(spark):
    rows = [(1, "W", "00", "-9", "-9", "-9", "-9", "-9", "-9", "-9"), (2, "L", "92", "-9", "-9", "-9", "86", "-9", "-9", "-9"),
            (3, "I", "92", "10", "-9", "-9", "98", "-9", "-9", "-9"), (4, "I", "92", "-9", "-9", "-9", "91", "-9", "-9", "-9"),
            (5, "I", "92", "-9", "-9", "-9", "86", "-9", "-9", "98"), (6, "I", "46", "20", "20", "-9", "86", "87", "-9", "-9"),
            (7, "I", "92", "10", "90", "-9", "98", "95", "-9", "-9"), (8, "I", "77", "10", "-9", "-9", "86", "-9", "-9", "-9")]
    got = {r["polygon_id"]: r for r in op.interpret(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert [got[i]["state"] for i in range(1, 9)] == ["resolved", "unknown", "unknown", "unknown", "partials_absent", "interval", "resolved", "unknown"]
    assert got[7]["convention"] and got[7]["iceberg_tenths"] == 1 and got[7]["stage1"] is None
    assert got[5]["iceberg_trace"] and not got[6]["iceberg_trace"]
    pens = {r["polygon_id"]: r["conservative_penalty"] for r in
            op.penalties(op.rio_interval(op.interpret(spark.createDataFrame(rows, COLUMNS)), "PC6")).collect()}
    assert pens[3] == 100.0 and pens[1] == 0.0


def test_dominant_polygon_ties_and_overlap(spark):
    rows = [(0, 1, 0.25), (0, 2, 0.75), (1, 5, 0.5), (1, 4, 0.5), (2, 7, 1.0), (2, 8, 0.5), (3, 9, 0.3)]
    areas = spark.createDataFrame([(0, 0, c, i, a) for c, i, a in rows], "zone int, r int, c int, polygon_id int, area_share double")
    got = {r["c"]: (r["polygon_id"], r["kind"], r["contributors"]) for r in op.dominant_polygons(areas).collect()}
    assert got == {0: (2, "adjacent", 2), 1: (4, "adjacent", 2), 2: (7, "source_overlap", 2), 3: (9, "single", 1)}


def test_policy_documents(spark, tmp_path):
    doc = {"ice_classes": {"PC6": "polar_class"}, "riv": {"PC6": {"Ice-Free": 3, "New Ice": 2}},
           "rio_bands": {"polar_class": [{"min_rio": 0, "category": "normal_operation"}, {"min_rio": "-inf", "category": "special"}]},
           "stage_mapping": {"83": {"conservative": "Grey White Ice", "optimistic": "Grey Ice", "mapping_sensitive": True}},
           "concentration": {"ct_codes": {"46": [4, 6]}, "partial_codes": {"10": [1, 1]}}}
    path = str(tmp_path / "policy.json")
    (tmp_path / "policy.json").write_text(json.dumps(doc))
    assert {(r["ice_type"], r["riv"]) for r in p.read_riv(spark, path).collect()} == {("Ice-Free", 3.0), ("New Ice", 2.0)}
    assert [r["min_rio"] for r in p.read_bands(spark, path).orderBy("ord").collect()] == [0.0, float("-inf")]
    assert p.read_stage_policy(spark, path).first()["mapping_sensitive"] is True
    assert {(r["field"], r["low"], r["high"]) for r in p.read_concentrations(spark, path).collect()} == {("ct", 4, 6), ("partial", 1, 1)}


def test_classes_are_scored_inside_the_row(spark):
    """Polygons are shuffled once, not once per ice class."""
    regimes = spark.createDataFrame([(1, "a", 4), (1, "b", 6), (2, "a", 10), (3, "b", 3)], "polygon_id int, ice_type string, tenths int")
    riv = spark.createDataFrame([(k, "polar_class", x, v) for k, vs in {"P": (1.0, -2.0), "Q": (3.0, 0.5)}.items() for x, v in zip("ab", vs)],
                                "ice_class string, category string, ice_type string, riv double")
    from floeframe.operators import risk
    out = risk.rio_points(regimes, riv)
    assert {(r["polygon_id"], r["ice_class"]): (r["tenths"], r["rio"]) for r in out.collect()} == {
        (1, "P"): (10, -8.0), (1, "Q"): (10, 15.0), (2, "P"): (10, 10.0), (2, "Q"): (10, 30.0), (3, "P"): (3, None), (3, "Q"): (3, None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate [polygon_id" in x and "ice_class" in x]
