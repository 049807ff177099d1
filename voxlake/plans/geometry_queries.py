"""Queries of the geometry operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.operators import geometry as G
from voxlake.plans.registry import query
from voxlake.sources.fixtures import fixture, instances


def _slices(spark, sf_dir):
    rows = instances(spark, sf_dir).withColumn("file_order", -F.col("instance_number"))
    return G.sort_slices(rows)


@query("SELECT file_id, CAST(CASE WHEN plane_code = 2 THEN row_number() OVER (PARTITION BY dir, series_uid ORDER BY instance_number DESC) ELSE row_number() OVER (PARTITION BY dir, series_uid ORDER BY ipp_z) END AS INTEGER) AS slice_no FROM fx_instances")
def w1_sort_slices(spark, sf_dir):
    return _slices(spark, sf_dir).select("file_id", "slice_no")


@query("""WITH s AS (SELECT *, CASE WHEN plane_code = 2 THEN row_number() OVER (PARTITION BY dir, series_uid ORDER BY instance_number DESC) ELSE row_number() OVER (PARTITION BY dir, series_uid ORDER BY ipp_z) END AS n FROM fx_instances),
d AS (SELECT *, abs(ipp_z - lag(ipp_z) OVER (PARTITION BY dir, series_uid ORDER BY n)) AS step, row_number() OVER (PARTITION BY dir, series_uid ORDER BY n) AS k, (rows_ <> lag(rows_) OVER (PARTITION BY dir, series_uid ORDER BY n)) AS grown,
 sqrt(power(ipp_z - lag(ipp_z) OVER (PARTITION BY dir, series_uid ORDER BY n), 2)) AS dist,
 CASE WHEN plane_code = 2 THEN abs((ipp_z - rows_) - lag(ipp_z - rows_) OVER (PARTITION BY dir, series_uid ORDER BY n)) ELSE sqrt(power(ipp_z - lag(ipp_z) OVER (PARTITION BY dir, series_uid ORDER BY n), 2) + power(rows_ - lag(rows_) OVER (PARTITION BY dir, series_uid ORDER BY n), 2)) END AS far FROM s),
e AS (SELECT *, lag(step) OVER (PARTITION BY dir, series_uid ORDER BY n) AS step0, lag(far) OVER (PARTITION BY dir, series_uid ORDER BY n) AS far0 FROM d),
g AS (SELECT dir, series_uid, min(plane_code) AS plane, count(*) AS n_slices, bool_and(step IS NULL OR abs(far - step) <= 0.01) AS one_direction, bool_and(step0 IS NULL OR (abs(step - step0) <= 0.01 AND abs(far - far0) <= 0.01)) AS equidistant, arg_max(step, n) AS z FROM e GROUP BY dir, series_uid)
SELECT dir, series_uid, n_slices, CASE WHEN plane = 2 THEN 'RSA' ELSE 'RAI' END AS orientation, one_direction, equidistant, CASE WHEN n_slices = 1 THEN true ELSE plane = 1 AND one_direction AND equidistant END AS is_uniform, coalesce(z, 1.0) AS z_spacing FROM g""")
def w3_slice_geometry(spark, sf_dir):
    """The flagship: series to ordered, validated volumes."""
    return G.slice_geometry(_slices(spark, sf_dir))


@query("""WITH f AS (SELECT *, CASE WHEN plane_code = 2 THEN -instance_number ELSE instance_number END AS k FROM fx_instances)
SELECT dir, series_uid, min(rows_) = max(rows_) AND (bool_and(instance_number = 4) OR bool_and(instance_number <> 4)) AS is_valid,
 2.0 + 0.00001 * arg_min(instance_number % 2, k) AS x_spacing, CASE WHEN arg_min(instance_number, k) = 4 THEN 1.5 ELSE 1.0 END AS y_spacing FROM f GROUP BY dir, series_uid""")
def w4_check_slices(spark, sf_dir):
    """Sizes that differ, spacings that differ, and spacings that differ by less than the tolerance."""
    no = F.col("instance_number")
    return G.check_slices(_slices(spark, sf_dir).withColumn("spacing", F.array(F.when(no == 4, 1.5).otherwise(1.0), 2.0 + 0.00001 * (no % 2))))


@query("""SELECT file_id, copy, CASE WHEN copy = 1 THEN 0 ELSE 1 END AS volume_no FROM fx_instances CROSS JOIN (SELECT unnest([1, 2]) AS copy)""")
def w5_multiseries_split(spark, sf_dir):
    rows = instances(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = rows.withColumn("instance_number", F.col("instance_number") + 10 * F.col("copy")).withColumn("file_order", F.col("file_id") * 2 + F.col("copy"))
    rows = rows.withColumn("slice_location", F.col("ipp_z"))
    return G.multiseries_split(rows).select("file_id", "copy", "volume_no")


@query("""WITH p AS (SELECT a.file_id AS a, b.file_id AS b, a.plane_code AS plane, a.ipp_z AS za, b.ipp_z AS zb, b.rows_ AS rows_b FROM fx_instances a
 JOIN fx_instances b ON a.study_uid = b.study_uid AND a.frame_of_ref_uid = b.frame_of_ref_uid AND a.series_uid <> b.series_uid AND a.plane_code <> b.plane_code)
SELECT a, b, CAST(-0.5 AS DOUBLE) AS x_low, CAST(255.5 AS DOUBLE) AS x_high, CASE WHEN plane = 1 THEN CAST(0 AS DOUBLE) ELSE za - zb END AS y_low, CASE WHEN plane = 1 THEN CAST(0 AS DOUBLE) ELSE za - zb END AS y_high
FROM p WHERE plane = 2 OR (za < zb + 0.5 AND za > zb - rows_b + 0.5)""")
def j12_slice_intersections(spark, sf_dir):
    """Axial slices are cut by coronal ones where these reach their height; coronal ones by all axial ones of the study."""
    found = G.slice_intersections(instances(spark, sf_dir))
    return found.select("a", "b", F.least("x0", "x1").alias("x_low"), F.greatest("x0", "x1").alias("x_high"), F.least("y0", "y1").alias("y_low"), F.greatest("y0", "y1").alias("y_high"))


@query("""WITH g AS (SELECT dir, series_uid, min(plane_code) AS plane, min(file_id // 10 % 2) = 0 AS uniform, avg(rows_) AS r, (arg_min(rows_, instance_number) + arg_max(rows_, instance_number)) / 2.0 AS r2, avg(ipp_z) AS z, (min(ipp_z) + max(ipp_z)) / 2 AS z2 FROM fx_instances GROUP BY dir, series_uid),
h AS (SELECT dir, series_uid, plane, ((CASE WHEN uniform THEN r2 ELSE r END) - 1) / 2 AS half, CASE WHEN uniform THEN z2 ELSE z END AS z FROM g)
SELECT dir, series_uid, CAST(127.5 AS DOUBLE) AS x, round(CASE WHEN plane = 2 THEN 0 ELSE half END, 6) AS y, round(CASE WHEN plane = 2 THEN z - half ELSE z END, 6) AS z FROM h""")
def a6_volume_center(spark, sf_dir):
    rows = _slices(spark, sf_dir).withColumn("is_uniform", F.expr("file_id div 10 % 2 = 0"))
    return G.volume_center(rows).select("dir", "series_uid", "x", F.round("y", 6).alias("y"), F.round("z", 6).alias("z"))


@query("WITH r AS (SELECT roi_id, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS size FROM fx_contour_points GROUP BY roi_id) SELECT roi_id % 4 AS volume_id, CASE WHEN max(size) > 0 THEN max(size) ELSE 1000 END AS extent FROM r GROUP BY roi_id % 4")
def a12_contour_extent(spark, sf_dir):
    return G.contour_extent(fixture(spark, sf_dir, "fx_contour_points").withColumn("volume_id", F.col("roi_id") % 4), ["volume_id"])


@query("SELECT study_uid, CAST(greatest(max(rows_), 256) AS DOUBLE) AS extent FROM fx_instances GROUP BY study_uid")
def a12_volume_extent(spark, sf_dir):
    rows = instances(spark, sf_dir).select("study_uid", F.array("cols", "rows", F.lit(1)).alias("dims"), F.array(F.lit(1.0), F.lit(1.0), F.lit(2.5)).alias("spacing"))
    return G.volume_extent(rows, ["study_uid"])
