"""Queries of the multi-frame operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.operators import multiframe as M
from voxlake.plans.registry import query
from voxlake.sources.fixtures import fixture, instances


def _frames(spark, sf_dir):
    """Embeddings as frames of volumes: two dimensions, position by frame number."""
    pixels = fixture(spark, sf_dir, "fx_frame_pixels").withColumn("file", F.col("file_id")).withColumn("file_id", F.col("volume_id"))
    axial = F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)))
    rows = pixels.withColumn("frame_no", F.col("file").cast("int")).withColumn("ipp", F.array(F.lit(0.0), F.lit(0.0), -F.col("file").cast("double"))).withColumn("iop", axial)
    return rows.withColumn("dim_values", F.array((F.col("file") % 2 + 1).cast("int"), (F.floor(F.col("file") / 100) + 1).cast("int")))


#: Dimension pointers of files by their number modulo 5, with what they make: the names and the positions in order.
_POINTERS = [
    (("00209111 00209056", "00209111 00209057"), "from the last", "1,0"),
    (("00189117 00189087", "00189117 00189089", "00209111 00209056", "00209111 00209057"), "INSTACK,STACK,GRAD,BVAL", "3,2,1,0"),
    (("00209111 00209128", "00209111 00209056", "00209111 00209057", "00409096 00409210"), "INSTACK,STACK,TPOS,LUT", "2,1,0,3"),
    (("00209111 00209056", "00209111 00209057", "00209111 00209999"), "INSTACK,STACK,OTHER", "1,0,2"),
    (("0020930E 00209301", "00189807 00189808"), "PLANE,DTYPE", "0,1"),
]


def _index(spark, sf_dir, kinds=1):
    files = fixture(spark, sf_dir, "fx_frame_pixels").select(F.col("volume_id").alias("file_id")).distinct()
    pair = lambda i, both: F.struct(F.lit(i).alias("position"), F.lit("1.2").alias("uid"), F.lit(both[9:]).alias("index_pointer"), F.lit(both[:8]).alias("group_pointer"))
    lists = F.lit(None)
    for k, (pointers, _, _) in enumerate(_POINTERS[:kinds]):
        lists = F.when(F.col("file_id") % kinds == k, F.array(*[pair(i, x) for i, x in enumerate(pointers)])).otherwise(lists)
    return files.withColumn("p", F.explode(lists)).select("file_id", "p.*")


_CASES = " ".join(f"WHEN {k} THEN '{choice}'" for k, (_, choice, _) in enumerate(_POINTERS)), " ".join(f"WHEN {k} THEN '{dims}'" for k, (_, _, dims) in enumerate(_POINTERS))


@query(f"SELECT DISTINCT volume_id AS file_id, CASE volume_id % 5 {_CASES[0]} END AS choice, CASE volume_id % 5 {_CASES[1]} END AS dims FROM fx_frame_pixels")
def m5_choose_dims(spark, sf_dir):
    return M.choose_dims(_index(spark, sf_dir, 5)).select("file_id", "choice", F.array_join(F.transform("dims", lambda x: x.cast("string")), ",").alias("dims"))


@query("""SELECT volume_id AS file_id, file_id AS frame_no, CASE WHEN volume_id % 2 = 0 AND max(CASE WHEN file_id % 50 = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY volume_id) = 1 THEN 9.0
 WHEN max(CASE WHEN file_id % 50 = 4 OR file_id % 50 = 5 THEN 1 ELSE 0 END) OVER (PARTITION BY volume_id) = 1 THEN 1.0 ELSE CAST(file_id AS DOUBLE) END AS rescale_slope FROM fx_frame_pixels""")
def m3_merge_shared(spark, sf_dir):
    frames = _frames(spark, sf_dir).select("file_id", "frame_no", F.when(~(F.col("file") % 50).isin(4, 5), F.col("file").cast("double")).alias("rescale_slope"))
    shared = frames.filter("file_id % 2 = 0").select("file_id", F.lit(9.0).alias("rescale_slope")).distinct()
    return M.merge_shared(frames, shared, ["rescale_slope"], {"rescale_slope": 1.0})


@query("""SELECT volume_id AS file_id, file_id AS frame_no, CASE WHEN volume_id % 10 = 3 THEN 2.0 ELSE 5.0 END AS rescale_slope, CASE WHEN volume_id % 10 = 3 THEN -7.0 ELSE 0.0 END AS rescale_intercept FROM fx_frame_pixels""")
def m4_rescale_fallback(spark, sf_dir):
    bare = (F.col("file_id") % 10 == 3) & (F.col("file") % 100 < 50)
    frames = _frames(spark, sf_dir).select("file_id", "frame_no", F.when(~bare, 5.0).alias("rescale_slope"), F.when(~bare, 0.0).alias("rescale_intercept"), F.lit(False).alias("has_rwv"))
    top = frames.select("file_id", F.lit(2.0).alias("rescale_slope"), F.lit(-7.0).alias("rescale_intercept")).distinct()
    return M.rescale_fallback(frames, top).drop("has_rwv")


@query("""SELECT file_id, frame_no, item, label FROM (SELECT volume_id AS file_id, segment_num AS frame_no, file_id AS item, CASE WHEN file_id % 7 = 0 THEN 'BQML' WHEN file_id % 11 = 0 THEN 'g/ml{SUVbw}' ELSE 'x' END AS label,
 row_number() OVER (PARTITION BY volume_id, segment_num ORDER BY CASE WHEN file_id % 7 = 0 THEN 2 WHEN file_id % 11 = 0 THEN 0 ELSE 3 END, file_id) AS r FROM fx_frame_pixels) WHERE r = 1""")
def m6_choose_rwv(spark, sf_dir):
    items = _frames(spark, sf_dir).select("file_id", F.col("segment_num").alias("frame_no"), F.col("file").alias("item"), F.when(F.col("file") % 7 == 0, "BQML").when(F.col("file") % 11 == 0, "g/ml{SUVbw}").otherwise("x").alias("label"))
    return M.choose_rwv(items)


@query("SELECT volume_id AS file_id, file_id AS frame_no, CAST(row_number() OVER (PARTITION BY volume_id ORDER BY file_id DESC) AS INTEGER) AS place FROM fx_frame_pixels")
def w2_sort_frames(spark, sf_dir):
    return M.sort_frames(_frames(spark, sf_dir)).select("file_id", "frame_no", "place")


@query("""WITH f AS (SELECT volume_id, file_id, file_id // 50 % 2 AS d4, CASE WHEN volume_id % 7 = 3 AND file_id < 100 THEN 0 ELSE file_id // 100 + 1 END AS d3 FROM fx_frame_pixels),
b AS (SELECT *, min(d3) OVER (PARTITION BY volume_id) = 0 AS bad, dense_rank() OVER (PARTITION BY volume_id ORDER BY d4) - 1 AS tuple_no FROM f), v AS (SELECT *, CASE WHEN bad THEN 0 ELSE tuple_no END AS v FROM b),
s AS (SELECT volume_id, file_id, bad, v, row_number() OVER (PARTITION BY volume_id, v ORDER BY file_id DESC) - 1 AS by_space, row_number() OVER (PARTITION BY volume_id, v ORDER BY d3, file_id) - 1 AS by_index FROM v)
SELECT 'prefer uniform' AS mode, volume_id AS file_id, file_id AS frame_no, CAST(v AS INTEGER) AS volume_no, CAST(by_space AS INTEGER) AS place FROM s
UNION ALL SELECT 'strict many', volume_id, file_id, CAST(v AS INTEGER), CAST(CASE WHEN bad THEN by_space ELSE by_index END AS INTEGER) FROM s
UNION ALL SELECT 'strict single', volume_id, file_id, 0, CAST(row_number() OVER (PARTITION BY volume_id ORDER BY v, CASE WHEN bad THEN by_space ELSE by_index END) - 1 AS INTEGER) FROM s
UNION ALL SELECT 'skip', volume_id, file_id, 0, CAST(row_number() OVER (PARTITION BY volume_id ORDER BY file_id) - 1 AS INTEGER) FROM s""")
def w6_volumes_from_dims(spark, sf_dir):
    third = F.when((F.col("file_id") % 7 == 3) & (F.col("file") < 100), 0).otherwise(F.floor(F.col("file") / 100) + 1).cast("int")
    frames = _frames(spark, sf_dir).withColumn("dim_values", F.array((F.floor(F.col("file") / 50) % 2 + 1).cast("int"), third))
    chosen = M.choose_dims(_index(spark, sf_dir))
    modes = [M.volumes_from_dims(frames, chosen, mode).select(F.lit(mode).alias("mode"), "file_id", "frame_no", "volume_no", "place") for mode in ("prefer uniform", "strict many", "strict single", "skip")]
    return reduce(DataFrame.unionByName, modes)


@query("""SELECT file_id, CAST(n AS INTEGER) AS frame_no, CASE WHEN file_id % 2 = 0 THEN CAST(40 AS DOUBLE) ELSE CAST(n * 10 AS DOUBLE) END AS step_ms, CASE WHEN file_id % 2 = 0 THEN (n - 1) * CAST(40 AS DOUBLE) ELSE CAST(n * (n + 1) * 5 - 10 AS DOUBLE) END AS offset_ms
FROM fx_instances CROSS JOIN (SELECT unnest([1, 2, 3]) AS n) f""")
def w7_frame_times(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_instances").selectExpr("file_id", "3 AS number_of_frames", "40 AS frame_time", r"'10\\20\\30' AS frame_time_vector", "CASE WHEN file_id % 2 = 0 THEN '00181063' ELSE '00181065' END AS increment_pointer")
    return M.frame_times(rows)


@query("""WITH v AS (SELECT patient_id AS g, file_id AS id, CAST(substr(patient_id, 2) AS BIGINT) % 3 AS kind, file_id // 10 % 60 AS mi, file_id % 10 AS s, CASE WHEN CAST(substr(patient_id, 2) AS BIGINT) % 3 = 2 THEN 0 ELSE 1000000000 - file_id END AS no FROM fx_instances),
t AS (SELECT *, concat('20200101', lpad(CAST(23 - id // 600 % 24 AS VARCHAR), 2, '0'), lpad(CAST(59 - mi AS VARCHAR), 2, '0'), lpad(CAST(59 - s AS VARCHAR), 2, '0')) AS t FROM v),
u AS (SELECT *, kind = 0 AND count(DISTINCT t) OVER (PARTITION BY g) = count(*) OVER (PARTITION BY g) AS timed FROM t),
k AS (SELECT *, CASE WHEN timed THEN CAST(t AS BIGINT) WHEN kind = 2 THEN 0 ELSE no END AS k FROM u),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k, id) AS place, lead(CASE WHEN kind = 0 THEN t END) OVER (PARTITION BY g ORDER BY k, id) AS next FROM k)
SELECT g AS group_id, id AS volume_id, CAST(place AS INTEGER) AS place, CASE WHEN kind = 0 AND next IS NOT NULL THEN (CAST(next AS BIGINT) - CAST(t AS BIGINT)) * 1000 ELSE 1000 END AS raw_step_ms,
 CASE WHEN kind = 0 AND next IS NOT NULL THEN CAST(epoch(strptime(next, '%Y%m%d%H%M%S')) - epoch(strptime(t, '%Y%m%d%H%M%S')) AS BIGINT) * 1000 ELSE 1000 END AS step_ms FROM n""")
def w8_order_4d(spark, sf_dir):
    kind, at = F.substring("patient_id", 2, 20).cast("long") % 3, F.col("file_id")
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    time = F.concat(two(23 - F.floor(at / 600) % 24), two(59 - F.floor(at / 10) % 60), two(59 - at % 10), F.lit(".5"))
    rows = fixture(spark, sf_dir, "fx_instances").select(F.col("patient_id").alias("group_id"), at.alias("volume_id"), F.lit("20200101").alias("acq_date"), F.when(kind == 0, time).alias("acq_time"), F.when(kind == 2, 0).otherwise(1_000_000_000 - at).cast("int").alias("instance_number"))
    return M.order_4d(rows).select("group_id", "volume_id", "place", "raw_step_ms", "step_ms")


@query("SELECT file_id, CAST(n + 1 AS INTEGER) AS frame_no, ipp_x AS x, ipp_y AS y, ipp_z + n * 2.5 AS z, CAST(1 AS DOUBLE) AS x_spacing FROM fx_instances CROSS JOIN (SELECT unnest([0, 1, 2]) AS n) f WHERE file_id % 5 <> 0")
def w10_dose_frames(spark, sf_dir):
    rows = instances(spark, sf_dir).withColumn("frame_offsets", F.lit("0\\2.5\\5")).withColumn("number_of_frames", F.when(F.col("file_id") % 5 == 0, 2).otherwise(3))
    return M.dose_frames(rows)


@query("SELECT cols_ AS dim_x, rows_ AS dim_y, instance_number AS dim_z, modality_code AS pixel_type, count(*) AS n, min(file_id) AS first_volume FROM fx_instances GROUP BY cols_, rows_, instance_number, modality_code HAVING count(*) >= 2")
def a13_group_4d(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_instances").select(F.col("cols_").alias("dim_x"), F.col("rows_").alias("dim_y"), F.col("instance_number").alias("dim_z"), F.col("modality_code").alias("pixel_type"), F.col("file_id").alias("volume_id"))
    return M.group_4d(rows)


@query("""WITH g AS (SELECT volume_id, frame_no, min(segment_num) AS a, max(segment_num) AS b FROM fx_frame_pixels GROUP BY volume_id, frame_no) SELECT volume_id AS file_id, frame_no AS volume_no, CASE WHEN a = b AND a % 2 = 0 THEN concat('s', CAST(a AS VARCHAR)) END AS label FROM g""")
def j14_segment_labels(spark, sf_dir):
    frames = fixture(spark, sf_dir, "fx_frame_pixels").select(F.col("volume_id").alias("file_id"), F.col("frame_no").alias("volume_no"), "segment_num")
    segments = frames.filter("segment_num % 2 = 0").select("file_id", "segment_num", F.concat(F.lit("s"), F.col("segment_num").cast("string")).alias("label")).distinct()
    return M.segment_labels(frames, segments)
