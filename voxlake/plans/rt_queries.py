"""Queries of the structure-set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.operators import rt as R
from voxlake.plans.registry import query
from voxlake.sources.fixtures import fixture

_CODES = "CASE type_code WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 4 END"


def _points(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_contour_points").withColumn("volume_id", F.col("roi_id") % 4).withColumn("type", F.expr(_CODES))


def _slices(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_contour_points").select("z", (F.col("roi_id") % 4).alias("volume_id")).distinct()
    return rows.select("volume_id", (F.col("z") / 2.5).cast("int").alias("slice_no"), F.array(F.lit(0.0), F.lit(0.0), F.col("z")).alias("ipp"), F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))).alias("iop"), F.lit(2.5).alias("z_spacing"))


def _elements(spark, sf_dir):
    """Structure sets of three ROIs and one contour each, from instances."""
    files = fixture(spark, sf_dir, "fx_instances").filter("instance_number = 1").select("file_id", "sop_uid", "frame_of_ref_uid")
    step = lambda tag, item: F.struct(F.lit(tag).alias("tag"), F.lit(item).alias("item"))
    row = lambda path, tag, value: F.struct(F.array(*path).alias("path"), F.lit(tag).alias("tag"), value.cast("string").alias("value"))
    rows = []
    for i in (1, 2, 3):
        roi, at = F.lit(10 * i), [step("30060039", i)]
        rows += [row(at, "30060084", roi), row(at, "3006002A", F.lit("255\\0\\7"))]
        contour = [*at, step("30060040", 1)]
        rows += [row(contour, "30060042", F.lit("CLOSED_PLANAR" if i < 3 else "POINT")), row(contour, "30060050", F.concat_ws("\\", F.lit("1\\2"), F.col("file_id"), F.lit("4\\5\\6.5")))]
        rows.append(row([*contour, step("30060016", 1)], "00081155", F.col("sop_uid")))
        if i < 3:
            rows += [row([step("30060020", i)], "30060022", roi), row([step("30060020", i)], "30060026", F.lit(f"roi {i}")), row([step("30060020", i)], "30060024", F.col("frame_of_ref_uid"))]
        if i == 1:
            rows += [row([step("30060080", i)], "30060084", roi), row([step("30060080", i)], "300600A4", F.lit("ORGAN"))]
    return files.withColumn("e", F.explode(F.array(*rows))).select("file_id", "e.*")


@query("""SELECT file_id, 10 * i AS roi_id, CAST(i AS INTEGER) AS roi_item, concat('roi ', CAST(i AS VARCHAR)) AS name, CASE WHEN i = 1 THEN 'ORGAN' END AS interpreted_type, frame_of_ref_uid, 255 AS r, 0 AS g, 7 AS b
FROM fx_instances CROSS JOIN (SELECT unnest([1, 2]) AS i) t WHERE instance_number = 1""")
def j7_rt_rois(spark, sf_dir):
    return R.rt_rois(_elements(spark, sf_dir))


@query("SELECT file_id, dir, series_uid FROM fx_instances WHERE instance_number = 1")
def j8_rtstruct_series(spark, sf_dir):
    refs = R.contours(_elements(spark, sf_dir)).select("file_id", F.explode("ref_sop_uids").alias("ref_uid"))
    return R.rtstruct_series(refs, fixture(spark, sf_dir, "fx_instances"))


@query("SELECT file_id, dir, series_uid FROM fx_instances WHERE instance_number = 1 AND file_id % 20 < 10")
def j8_same_frame(spark, sf_dir):
    """Structure sets of which half name another frame of reference than their images."""
    frame = F.when(F.col("file_id") % 20 < 10, F.col("frame_of_ref_uid")).otherwise("9.9").alias("frame_of_ref_uid")
    found = fixture(spark, sf_dir, "fx_instances")
    refs = R.contours(_elements(spark, sf_dir)).select("file_id", F.explode("ref_sop_uids").alias("ref_uid")).join(found.select("file_id", frame), "file_id")
    return R.rtstruct_series(refs, found, same_frame=True)


@query("SELECT DISTINCT roi_id % 4 AS volume_id, roi_id, contour_id, CAST(z / 2.5 AS INTEGER) AS slice_no FROM fx_contour_points")
def j9_map_contours_uniform(spark, sf_dir):
    return R.map_contours_uniform(_points(spark, sf_dir), _slices(spark, sf_dir))


_SHIFT = "CASE WHEN roi_id % 3 = 1 AND contour_id = 1 THEN point_no % 2 WHEN contour_id = 2 THEN 0.04 WHEN contour_id = 4 THEN 0.09 WHEN contour_id = 5 THEN 0.11 ELSE 0 END"


@query(f"""WITH p AS (SELECT roi_id % 4 AS volume_id, roi_id, contour_id, z + {_SHIFT} AS z FROM fx_contour_points), s AS (SELECT DISTINCT roi_id % 4 AS volume_id, CAST(z / 2.5 AS INTEGER) AS slice_no, z FROM fx_contour_points),
t AS (SELECT * FROM s UNION ALL SELECT volume_id, 100, 7.58 FROM s WHERE slice_no = 3),
f AS (SELECT p.volume_id, roi_id, contour_id, slice_no FROM p JOIN t ON p.volume_id = t.volume_id GROUP BY p.volume_id, roi_id, contour_id, slice_no HAVING bool_and(abs(p.z - t.z) < 0.1))
SELECT volume_id, roi_id, contour_id, min(slice_no) AS slice_no FROM f GROUP BY volume_id, roi_id, contour_id HAVING count(*) = 1""")
def j10_map_contours_nonuniform(spark, sf_dir):
    """Contours on a slice, just beside one, too far from any, of which some points are far, and between two slices that are both near."""
    slices = _slices(spark, sf_dir)
    near = slices.filter("slice_no = 3").withColumns({"slice_no": F.lit(100), "ipp": F.array(F.lit(0.0), F.lit(0.0), F.lit(7.58))})
    points = _points(spark, sf_dir).withColumn("z", F.col("z") + F.expr(_SHIFT))
    return R.map_contours_nonuniform(points, slices.unionByName(near))


@query("SELECT file_id, CAST(i AS INTEGER) AS roi_item, 1 AS contour_id, study_uid AS volume_id, instance_number AS slice_no FROM fx_instances CROSS JOIN (SELECT unnest([1, 2, 3]) AS i) t WHERE instance_number = 1")
def j11_map_contours_by_ref(spark, sf_dir):
    slices = fixture(spark, sf_dir, "fx_instances").select("sop_uid", F.col("study_uid").alias("volume_id"), F.col("instance_number").alias("slice_no"))
    return R.map_contours_by_ref(R.contours(_elements(spark, sf_dir)), slices)


@query("""SELECT file_id, CAST(i AS INTEGER) AS roi_item, CASE WHEN i < 3 THEN 1 ELSE 4 END AS type, CAST(p AS INTEGER) AS point_no, CASE WHEN p = 0 THEN 1.0 ELSE 4.0 END AS x, CASE WHEN p = 0 THEN 2.0 ELSE 5.0 END AS y, CASE WHEN p = 0 THEN CAST(file_id AS DOUBLE) ELSE 6.5 END AS z
FROM fx_instances CROSS JOIN (SELECT unnest([1, 2, 3]) AS i) t CROSS JOIN (SELECT unnest([0, 1]) AS p) q WHERE instance_number = 1""")
def r1_contour_points(spark, sf_dir):
    return R.contour_points(R.contours(_elements(spark, sf_dir))).drop("contour_id")


@query(f"""SELECT roi_id, contour_id, max({_CODES}) AS type, CASE WHEN max({_CODES}) IN (1, 2, 5) AND contour_id = 3 THEN 0 ELSE max({_CODES}) END AS valid_type FROM fx_contour_points GROUP BY roi_id, contour_id""")
def r2_validate_contours(spark, sf_dir):
    points = _points(spark, sf_dir)
    return R.validate_contours(points, R.map_contours_uniform(points.filter("contour_id <> 3"), _slices(spark, sf_dir)))


@query("SELECT roi_id % 4 AS volume_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM fx_contour_points GROUP BY roi_id % 4")
def a4_roi_center(spark, sf_dir):
    return R.roi_center(_points(spark, sf_dir), ["volume_id"]).select("volume_id", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(f"""WITH c AS (SELECT roi_id, contour_id, max({_CODES}) AS t FROM fx_contour_points GROUP BY roi_id, contour_id) SELECT roi_id, count(*) AS n_contours,
 concat_ws(',', CASE WHEN bool_or(t = 1) THEN 'CLOSED_PLANAR' END, CASE WHEN bool_or(t = 2) THEN 'OPEN_PLANAR' END, CASE WHEN bool_or(t = 4) THEN 'POINT' END) AS types FROM c GROUP BY roi_id""")
def a5_roi_summary(spark, sf_dir):
    kinds = _points(spark, sf_dir).groupBy("roi_id", "contour_id").agg(F.max("type").alias("type"))
    return R.roi_summary(kinds, ["roi_id"])


@query("""WITH g AS (SELECT segment_num % 3 AS group_id, max(CASE WHEN segment_num % 3 = 2 THEN 1 ELSE 0 END) AS colour FROM fx_frame_pixels GROUP BY segment_num % 3)
SELECT f.segment_num % 3 AS group_id, volume_id, CAST(pixels[2 * 8 + 3 + 1] AS DOUBLE) AS value FROM fx_frame_pixels f JOIN g ON g.group_id = f.segment_num % 3 WHERE colour = 0 AND frame_no = 4""")
def j17_voxel_across_volumes(spark, sf_dir):
    frames = fixture(spark, sf_dir, "fx_frame_pixels").select((F.col("segment_num") % 3).alias("group_id"), "volume_id", F.col("frame_no").alias("place"), F.lit(8).alias("cols"), F.col("pixels").cast("array<double>").alias("pixels"), (F.col("segment_num") % 3 == 2).alias("is_color"))
    return R.voxel_across_volumes(frames, 3, 2, 4)
