"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.functions import scalars as S
from voxlake.operators.catalog import uid_name
from voxlake.plans.registry import query
from voxlake.sources.fixtures import fixture, instances


@query(r"SELECT file_id, region_no, CAST(x0 AS DOUBLE) + 0.5 AS v0, delta_x AS v1, CAST(x1 AS DOUBLE) AS v2, CASE WHEN region_no % 3 = 0 THEN NULL ELSE CAST(x0 AS INTEGER) END AS i0 FROM fx_us_regions")
def f1_parse_numbers(spark, sf_dir):
    regions = fixture(spark, sf_dir, "fx_us_regions")
    text = F.concat_ws("\\", F.concat("x0", F.lit(",5")), F.lit(""), F.col("delta_x").cast("string"), F.concat(F.lit(" "), "x1", F.lit(" ")))
    whole = F.when(F.col("region_no") % 3 == 0, F.concat("x0", F.lit("\\bad"))).otherwise(F.concat("x0", F.lit("\\7")))
    numbers = regions.select("file_id", "region_no", S.parse_ds(text).alias("v"), S.parse_is(whole).alias("i"))
    return numbers.select("file_id", "region_no", *[F.col("v")[i].alias(f"v{i}") for i in range(3)], F.col("i")[0].alias("i0"))


@query("SELECT file_id, region_no, delta_x AS sx, CASE WHEN region_no % 2 = 0 THEN delta_x ELSE delta_y * 2 END AS sy, region_no % 4 <> 3 AS has_position FROM fx_us_regions")
def f2_parse_geometry(spark, sf_dir):
    regions = fixture(spark, sf_dir, "fx_us_regions")
    one = F.col("delta_x").cast("string")
    spacing = S.parse_spacing(F.when(F.col("region_no") % 2 == 0, one).otherwise(F.concat_ws("\\", one, (F.col("delta_y") * 2).cast("string"))))
    position = S.parse_position(F.when(F.col("region_no") % 4 == 3, F.lit("1\\2")).otherwise(F.lit("1\\2\\3")))
    return regions.select("file_id", "region_no", spacing[0].alias("sx"), spacing[1].alias("sy"), position.isNotNull().alias("has_position"))


@query("SELECT patient_id, concat(split_part(patient_name, '^', 2), ' ', split_part(patient_name, '^', 3), ' ', split_part(patient_name, '^', 1)) AS shown FROM fx_patients")
def f3_format_pn(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_patients").select("patient_id", S.format_pn(F.col("patient_name")).alias("shown"))


@query("SELECT file_id, strftime(strptime(acq_date, '%Y%m%d'), '%-d %b %Y') AS shown FROM fx_instances")
def f4_format_date(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_instances").select("file_id", S.format_date(F.col("acq_date")).alias("shown"))


_TAG = "CASE WHEN tag = '00080018' THEN CASE CAST(file_id % 6 AS INTEGER) WHEN 0 THEN '00090010' WHEN 1 THEN '00100000' WHEN 2 THEN '00010010' WHEN 3 THEN '00090005' WHEN 4 THEN '60003000' ELSE '000900FF' END ELSE tag END"


@query(f"""WITH t AS (SELECT file_id, path, {_TAG} AS tag FROM fx_elements) SELECT file_id, path, tag, substr(tag, 4, 1) NOT IN ('1', '9') AS is_public, substr(tag, 4, 1) IN ('1', '9') AS is_private, tag IN ('00090010', '00010010', '000900FF') AS is_creator,
 tag = '00100000' AS is_group_length, tag IN ('00010010', '00090005') AS is_illegal FROM t""")
def f6_tag_flags(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_elements").selectExpr("file_id", "path", f"{_TAG} AS tag")
    return rows.select("file_id", "path", "tag", S.tag_flags(F.col("tag")).alias("f")).select("file_id", "path", "tag", "f.*")


@query("""SELECT file_id, CASE CAST(file_id % 4 AS INTEGER) WHEN 0 THEN 'CT Image Storage' WHEN 1 THEN 'Explicit VR Little Endian' WHEN 2 THEN '1.2.3' ELSE '' END AS uid_name FROM fx_instances""")
def f7_uid_name(spark, sf_dir):
    kind = F.col("file_id") % 4
    uid = F.when(kind == 0, "1.2.840.10008.5.1.4.1.1.2\x00").when(kind == 1, " 1.2.840.10008.1.2.1").when(kind == 2, "1.2.3")
    return uid_name(fixture(spark, sf_dir, "fx_instances").withColumn("uid", uid), "uid").select("file_id", "uid_name")


@query("SELECT file_id, CASE WHEN plane_code = 2 THEN 'RSA' ELSE 'RAI' END AS code, CASE WHEN plane_code = 2 THEN 'CORONAL' ELSE 'AXIAL' END AS plane FROM fx_instances")
def f8_orientation(spark, sf_dir):
    found = instances(spark, sf_dir)
    return found.select("file_id", S.orientation_code(F.col("iop")).alias("code"), S.plane_type(F.col("iop")).alias("plane"))


@query("""WITH p AS (SELECT roi_id, point_no, CASE WHEN point_no % 3 = 0 THEN -x ELSE x END AS x, CASE WHEN point_no % 5 = 0 THEN -y ELSE y END AS y, CASE WHEN point_no % 7 = 0 THEN -z WHEN point_no % 7 = 1 THEN x ELSE z END AS z FROM fx_contour_points),
s AS (SELECT roi_id, point_no, list_reverse_sort([{'s': abs(x), 'l': CASE WHEN x < 0 THEN 'R' ELSE 'L' END}, {'s': abs(y), 'l': CASE WHEN y < 0 THEN 'A' ELSE 'P' END}, {'s': abs(z), 'l': CASE WHEN z < 0 THEN 'F' ELSE 'H' END}]) AS v FROM p),
t AS (SELECT roi_id, point_no, v, v[1].s > 0.0001 AND v[1].s > v[2].s AS one, v[2].s > 0.0001 AND v[2].s > v[3].s AS two, v[3].s > 0.0001 AS three FROM s)
SELECT roi_id, point_no, concat(CASE WHEN one THEN v[1].l ELSE '' END, CASE WHEN one AND two THEN v[2].l ELSE '' END, CASE WHEN one AND two AND three THEN v[3].l ELSE '' END) AS letters FROM t""")
def f9_direction_letters(spark, sf_dir):
    """Points of all signs, some with two equal sizes."""
    points = fixture(spark, sf_dir, "fx_contour_points").selectExpr("roi_id", "point_no", "CASE WHEN point_no % 3 = 0 THEN -x ELSE x END AS x", "CASE WHEN point_no % 5 = 0 THEN -y ELSE y END AS y", "CASE WHEN point_no % 7 = 0 THEN -z WHEN point_no % 7 = 1 THEN x ELSE z END AS z")
    return points.select("roi_id", "point_no", S.direction_letters(F.col("x"), F.col("y"), F.col("z")).alias("letters"))


@query("SELECT roi_id, point_no, abs(x - y) <= 10 AS near, abs(z - 5) AS distance FROM fx_contour_points")
def f11_almost_equal(spark, sf_dir):
    points = fixture(spark, sf_dir, "fx_contour_points")
    zero, up = [F.lit(0.0), F.lit(0.0), F.lit(5.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    return points.select("roi_id", "point_no", S.almost_equal(F.col("x"), F.col("y"), 10.0).alias("near"), S.distance_to_plane([F.col(c) for c in "xyz"], zero, up).alias("distance"))


@query("SELECT roi_id, point_no, CAST(point_no % 7 AS BIGINT) AS distance, point_no % 7 <= 3 AS near, CAST(point_no % 5 AS BIGINT) AS single_distance FROM fx_contour_points")
def f11_ulp_distance(spark, sf_dir):
    """Numbers a known count of steps apart, on both sides of powers of two, at all sizes and signs."""
    points = fixture(spark, sf_dir, "fx_contour_points")
    no, size = F.col("point_no"), F.pow(F.lit(2.0), F.col("point_no") % 1800 - 1000) * F.when(F.col("point_no") % 2 == 0, 1.0).otherwise(-1.0)
    start, step = 1.5 + (no % 1000).cast("double") * 2.0**-52, 2.0**-52
    start = F.when(no % 3 == 0, F.lit(2.0 - 7 * 2.0**-52)).otherwise(start)  # up to the next power of two
    a, b = start * size, (start + (no % 7) * step) * size
    c = F.when(no % 3 == 0, F.lit(2.0 - 5 * 2.0**-23)).otherwise(1.25 + (no % 1000).cast("double") * 2.0**-23) * F.pow(F.lit(2.0), no % 200 - 100)
    d = c + (no % 5) * F.pow(F.lit(2.0), no % 200 - 123)
    near = S.almost_equal(a, b, 0.0, 3)
    return points.select("roi_id", "point_no", S.ulp_distance(a, b).cast("long").alias("distance"), near.alias("near"), S.ulp_distance(c, d, single=True).cast("long").alias("single_distance"))


@query("""SELECT file_id, CAST(instance_number AS DOUBLE) AS px, CASE WHEN plane_code = 2 THEN CAST(0 AS DOUBLE) ELSE CAST(3 AS DOUBLE) END AS py,
 CASE WHEN plane_code = 2 THEN ipp_z - 3 ELSE ipp_z END AS pz, CASE WHEN file_id % 3 = 0 THEN -1.0 ELSE 5.0 END AS mm, CAST(instance_number AS DOUBLE) AS column_, CAST(3 AS DOUBLE) AS row_, CAST(0 AS DOUBLE) AS slice_ FROM fx_instances""")
def f14_index_to_patient(spark, sf_dir):
    found = instances(spark, sf_dir)
    spacing = F.array(F.lit(1.0), F.lit(1.0), F.lit(2.5))
    p = S.index_to_patient([F.col("instance_number").cast("double"), F.lit(3.0), F.lit(0.0)], F.col("ipp"), spacing, F.col("iop"))
    end = F.when(F.col("file_id") % 3 == 0, F.col("cols").cast("double")).otherwise(4.0)  # every third line ends outside
    mm = S.measure_mm(F.lit(1.0), F.lit(1.0), end, F.lit(5.0), F.col("spacing"), F.col("iop"), F.col("rows"), F.col("cols"))
    back = S.patient_to_index(p, F.col("ipp"), spacing, F.col("iop"))
    return found.select("file_id", p[0].alias("px"), p[1].alias("py"), p[2].alias("pz"), mm.alias("mm"), *[F.round(v, 9).alias(name) for v, name in zip(back, ("column_", "row_", "slice_"), strict=True)])


@query("SELECT file_id, acq_date AS date, CASE WHEN instance_number % 2 = 0 THEN '101112' ELSE '010203' END AS time, CASE WHEN modality_code = 'A' THEN 'GML {BW}' WHEN modality_code = 'N' THEN 'BQML' ELSE '' END AS unit FROM fx_instances")
def f15_acq_datetime(spark, sf_dir):
    found = fixture(spark, sf_dir, "fx_instances")
    stamp = F.when(F.col("instance_number") % 2 == 0, F.concat("acq_date", F.lit("101112")))
    unit = F.when(F.col("modality_code") == "A", "GML").when(F.col("modality_code") == "N", "BQML")
    return found.select("file_id", S.acq_datetime(stamp, F.col("acq_date"), F.lit("010203")).alias("t"), S.pet_unit(unit, F.lit("BW")).alias("unit")).select("file_id", "t.*", "unit")


@query("""SELECT file_id, region_no, CAST(x0 AS DOUBLE) AS center, CAST(x1 AS DOUBLE) AS width, CASE WHEN flags = 1 THEN 'SIGMOID' ELSE 'LINEAR' END AS function,
 CASE WHEN x1 > 100 OR x0 > 100 THEN CAST(50 AS DOUBLE) ELSE CAST(x0 AS DOUBLE) END AS d_center, CASE WHEN x1 > 100 OR x0 > 100 THEN CAST(100 AS DOUBLE) ELSE CAST(x1 AS DOUBLE) END AS d_width FROM fx_us_regions""")
def f17_windows(spark, sf_dir):
    regions = fixture(spark, sf_dir, "fx_us_regions")
    w = S.read_window(F.concat("x0", F.lit("\\9")), F.col("x1").cast("string"), F.when(F.col("flags") == 1, "sigmoid").otherwise("none"))
    rows = regions.select("file_id", "region_no", w.alias("w"))
    d = S.default_window(F.col("w.center"), F.col("w.width"), F.col("w.function"), F.lit(0.0), F.lit(100.0), F.lit(0.0), F.lit(4095.0), F.lit(False))
    return rows.select("file_id", "region_no", "w.*", d["center"].alias("d_center"), d["width"].alias("d_width"))
