"""Track reading, melting, steps and sampling on literal tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from floeframe.functions import expressions as ex
from floeframe.operators import tracks as op
from floeframe.sources.tracks_csv import HeaderError, read_rejects, read_tracks, resolve_header


@pytest.mark.parametrize("bad, word", [
    (["radar_1", "radar_2"], "date"), (["date", "radar_2", "radar_3"], "radar_1"), (["date", "radar_1", "radar_2", "size_2"], "size_1"),
    (["date", "iceberg_id", "size_1", "size_2"], "sensor"), (["date", "radar_1", "radar_2", "remark"], "remark"),
    (["date", "radar_1", "radar_2", "date"], "date"), (["date", "radar_1", "radar_2", "lidar_9"], "lidar"), ([""], "date")])
def test_headers_that_break_the_rule(bad, word):
    with pytest.raises(HeaderError, match=word):
        resolve_header(bad)


def test_family_does_not_depend_on_column_order():
    names = ["date", "nic_1", "nic_2", "nic_3", "sass_1", "sass_2", "size_1", "size_2"]
    assert resolve_header(names)["family"] == resolve_header(names[::-1])["family"] == "nic+sass+size"
    assert resolve_header(names)["flagged"] == ["nic"]


def test_directory_of_mixed_files(spark, tmp_path):
    (tmp_path / "a03.csv").write_text("date,nic_1,nic_2,nic_3,size_1,size_2\n1979035,-58.3,-43.9,1,10,0\n1979063,0,0,1,0,0\n")
    (tmp_path / "a68.csv").write_text("ascat_1,ascat_2,date\n-60.0,190.0,2017001\n")
    (tmp_path / "bad.csv").write_text("date,radar_1,radar_2,remark\n1979035,-58.3,-43.9,x\n")
    seen, refused = read_tracks(spark, str(tmp_path))
    rows = {r["iceberg_id"]: r for r in seen.collect()}
    assert set(rows) == {"a03", "a68"} and len(refused) == 1 and "remark" in next(iter(refused.values()))
    assert rows["a03"]["size_major_km"] == pytest.approx(18.52) and rows["a03"]["size_minor_km"] is None
    assert rows["a68"]["flag"] is None and rows["a68"]["is_interpolated"] is None and rows["a68"]["lon"] == -170.0


def test_every_file_is_read_or_refused(spark, tmp_path):
    files = {"quoted": '"date","radar_1","radar_2"\n2001001,-61,10\n', "extra": "date,radar_1,radar_2,radar_12\n2001002,-62,11,as it was\n",
             "text": "date,radar_1,radar_2\nabandoned,near,shore\n2001003,-63,12\n2001004,,\n2001005,-64,east\n", "blank": "\n\ndate,radar_1,radar_2\n2001006,-65,13\n",
             "headless": "2001007,-66,14\n2001008,-67,15\n", "remark": "# seen from a ship\ndate,radar_1,radar_2\n2001009,-68,16\n", "nothing": "", "heading": "date,radar_1,radar_2\n"}
    for name, body in files.items():
        (tmp_path / f"{name}.csv").write_text(body)
    seen, refused = read_tracks(spark, str(tmp_path))
    got = {(r["source_file"], r["source_row"], r["date"], r["lat"], r["schema_family"]) for r in seen.collect()}
    assert got == {("quoted.csv", 1, "2001001", -61.0, "radar"), ("extra.csv", 1, "2001002", -62.0, "radar+radar_12"),
                   ("text.csv", 2, "2001003", -63.0, "radar"), ("blank.csv", 1, "2001006", -65.0, "radar")}
    assert seen.where("source_file = 'extra.csv'").first()["source_fields"] == {"radar_12": "as it was"}
    assert {f.rpartition("/")[2] for f in refused} == {"headless.csv", "remark.csv", "nothing.csv"}
    assert {tuple(r) for r in read_rejects(spark, str(tmp_path)).collect()} == {("text.csv", "radar", 2)}


def test_records_keep_their_place_across_blocks(spark, tmp_path):
    (tmp_path / "long.csv").write_text("date,radar_1,radar_2\n" + "".join(f"{2001001 + i},-60,{i % 90 + 1}\n" for i in range(300)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        seen, _ = read_tracks(spark, str(tmp_path))
        assert sorted((r["source_row"], int(r["date"])) for r in seen.collect()) == [(i + 1, 2001001 + i) for i in range(300)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_date_codes(spark):
    codes = {"2024366": dt.date(2024, 12, 31), "2023366": None, "2023000": None, "202301": None, "1979035": dt.date(1979, 2, 4), "abcdefg": None}
    df = spark.createDataFrame([(c,) for c in codes], "c string").withColumn("d", ex.date_from_yyyyddd(F.col("c")))
    assert {r["c"]: r["d"] for r in df.collect()} == codes


def sightings(spark, rows):
    base = [(i, s, dt.date.fromisoformat(d), lat, lon, flag, n) for n, (i, s, d, lat, lon, flag) in enumerate(rows)]
    df = spark.createDataFrame(base, "iceberg_id string, sensor string, day date, lat double, lon double, flag int, src long")
    for c in op.ENV:
        df = df.withColumn(c, F.lit(0.1))
    return df


def test_steps_keep_gaps_and_never_cross_sensors(spark):
    rows = [("a", "nic", "2025-01-01", -64.0, 10.0, 1), ("a", "nic", "2025-01-29", -64.2, 10.0, 1),
            ("a", "sass", "2025-01-02", -64.1, 10.0, 1), ("b", "nic", "2025-01-02", -64.0, 179.9, 1),
            ("b", "nic", "2025-01-02", -64.1, 179.9, 1), ("b", "nic", "2025-01-03", -64.1, -179.9, 0)]
    s = sightings(spark, rows)
    got = {r["iceberg_id"]: r for r in op.steps(s).collect()}
    assert set(got) == {"a", "b"} and got["a"]["gap"] == "gap_28d" and got["a"]["elapsed_s"] == 28 * 86400.0
    assert got["b"]["interpolated"] is True and got["b"]["displacement_m"] < 12_000      # dateline hop
    audit = {r["sensor"]: r["zero_elapsed_pairs"] for r in op.step_audit(s).collect()}
    assert audit == {"nic": 1, "sass": 0}


def test_advect_is_the_inverse_of_displacement(spark):
    df = spark.createDataFrame([(-65.0, 179.9, 0.3, -0.2, 86400.0)], "lat double, lon double, e double, n double, s double")
    lat, lon = ex.advect(F.col("lat"), F.col("lon"), F.col("e"), F.col("n"), F.col("s"))
    df = df.withColumn("lat1", lat).withColumn("lon1", lon)
    de, dn = ex.displacement(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1"))
    r = df.select(de.alias("de"), dn.alias("dn"), "lon1").first()
    assert r["de"] == pytest.approx(0.3 * 86400) and r["dn"] == pytest.approx(-0.2 * 86400) and r["lon1"] < 0


def test_bilinear_is_exact_on_a_linear_field_and_refuses_holes(spark):
    day = dt.date(2025, 1, 1)
    nodes = [(day, i, j, 100.0 * (-60 + i * 0.25) + j * 0.25, -3.0 * (-60 + i * 0.25) + 2 * j * 0.25)
             for i in range(5) for j in range(5) if (i, j) != (4, 4)]
    lattice = spark.createDataFrame(nodes, "day date, lat_i int, lon_i int, u double, v double")
    pts = spark.createDataFrame([(1, day, -59.9, 0.1), (2, day, -59.05, 0.9), (3, day, -58.0, 0.1)], "id int, day date, lat double, lon double")
    out = {r["id"]: r for r in op.bilinear(pts, op.lattice_corners(lattice, None), -60.0, 0.25, 0.0, 0.25, None).collect()}
    assert out[1]["sample_u"] == pytest.approx(100 * -59.9 + 0.1) and out[1]["sample_v"] == pytest.approx(179.7 + 0.2)
    assert out[2]["sample_u"] is None and out[2]["reason"] == "corner_missing" and out[3]["sample_u"] is None


def test_longitude_axis_wraps_only_when_global(spark):
    day = dt.date(2025, 1, 1)
    nodes = [(day, i, j, float(j), 0.0) for i in (0, 1) for j in range(4)]
    lattice = spark.createDataFrame(nodes, "day date, lat_i int, lon_i int, u double, v double")
    pts = spark.createDataFrame([(day, -79.5, 135.0)], "day date, lat double, lon double")
    wrapped = op.bilinear(pts, op.lattice_corners(lattice, 4), -80.0, 1.0, -180.0, 90.0, 4).first()
    cut = op.bilinear(pts, op.lattice_corners(lattice, None), -80.0, 1.0, -180.0, 90.0, None).first()
    assert wrapped["sample_u"] == pytest.approx(1.5) and cut["sample_u"] is None


def test_true_scale_latitude_has_unit_scale(spark):
    r = spark.range(1).select(ex.local_scale(F.lit(-70.0)).alias("k70"), ex.local_scale(F.lit(-60.0)).alias("k60"),
                              ex.polar_xy(F.lit(-70.0), F.lit(90.0))[0].alias("x"), ex.polar_xy(F.lit(-70.0), F.lit(90.0))[1].alias("y")).first()
    assert r["k70"] == pytest.approx(1.0, abs=1e-9) and 1.03 < r["k60"] < 1.05
    assert r["x"] > 2.1e6 and math.isclose(r["y"], 0.0, abs_tol=1e-6)
