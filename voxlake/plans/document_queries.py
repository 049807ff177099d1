"""Queries of the report, presentation and ultrasound operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.operators import documents as T
from voxlake.plans.registry import query
from voxlake.sources.fixtures import elements, fixture


def _dictionaries(spark):
    public = spark.createDataFrame([("00100010", "PN", "PatientName"), ("00080018", "UI", "SOPInstanceUID"), ("00080022", "DA", "AcquisitionDate"), ("00100020", "LO", "PatientID")], "tag string, dict_vr string, name string")
    return public, spark.createDataFrame([], "grp string, element string, creator string, dict_vr string")


@query("""SELECT file_id, path AS path_text, tag, CASE tag WHEN '00100010' THEN 'PatientName' WHEN '00080018' THEN 'SOPInstanceUID' WHEN '00080022' THEN 'AcquisitionDate' WHEN '00100020' THEN 'PatientID' ELSE '' END AS name,
 vr AS vr_used, CAST(strlen(value) AS INTEGER) AS length, value, CASE WHEN path = '' THEN 0 ELSE 1 END AS depth FROM fx_elements""")
def t1_flatten_elements(spark, sf_dir):
    return T.flatten_elements(elements(spark, sf_dir), *_dictionaries(spark))


@query("""WITH r AS (SELECT file_id, path, tag, CASE WHEN file_id % 5 = 0 THEN '??' WHEN file_id % 7 = 0 THEN 'UN' WHEN tag = '00080022' THEN 'TM' ELSE vr END AS vr FROM fx_elements
 UNION ALL SELECT file_id, '', '00080022', 'DA' FROM fx_instances WHERE file_id % 13 = 0 UNION ALL SELECT file_id, '', '00010010', 'LO' FROM fx_instances WHERE file_id % 11 = 0)
SELECT file_id, path AS path_text, tag, vr = '??' AS bad_vr, vr = 'UN' AS unknown_vr, vr <> 'UN' AND tag IN ('00100010', '00080018', '00080022', '00100020') AND vr <> CASE tag WHEN '00100010' THEN 'PN' WHEN '00080018' THEN 'UI' WHEN '00080022' THEN 'DA' ELSE 'LO' END AS other_vr,
 tag = '00010010' AS is_illegal, tag IN ('00010010', '00091001') AS is_private, count(*) OVER (PARTITION BY file_id, path, tag) > 1 AS is_duplicate FROM r""")
def t2_vr_audit(spark, sf_dir):
    rows = elements(spark, sf_dir).withColumn("vr", F.when(F.col("file_id") % 5 == 0, "??").when(F.col("file_id") % 7 == 0, "UN").when(F.col("tag") == "00080022", "TM").otherwise(F.col("vr")))
    top = F.array().cast("array<struct<tag:string,item:int>>").alias("path")
    more = fixture(spark, sf_dir, "fx_instances").withColumn("e", F.explode(F.array(F.struct(F.lit(13).alias("k"), F.lit("00080022").alias("tag"), F.lit("DA").alias("vr")), F.struct(F.lit(11).alias("k"), F.lit("00010010").alias("tag"), F.lit("LO").alias("vr"))))).filter("file_id % e.k = 0")
    audit = T.vr_audit(rows.unionByName(more.select("file_id", top, "e.tag", "e.vr", F.lit("").alias("value"))), *_dictionaries(spark))
    return audit.withColumn("path_text", T.path_text(F.col("path"))).drop("path")


def _report(spark, sf_dir):
    """Conversations as report trees: an item per turn; every third is a number with a unit, every fourth has a reference."""
    items = fixture(spark, sf_dir, "fx_sr_items")
    step = lambda tag, item: F.struct(F.lit(tag).alias("tag"), item.cast("int").alias("item"))
    at = [step(T.CONTENT, F.col("item_no") + 1)]
    row = lambda path, tag, value: F.struct(F.array(*path).alias("path"), F.lit(tag).alias("tag"), value.cast("string").alias("value"))
    one = F.lit(1)
    kind = F.when(F.col("item_no") % 3 == 2, "NUM").otherwise(F.col("value_type"))
    measured, unit = [*at, step("0040A300", one)], [*at, step("0040A300", one), step("004008EA", one)]
    rows = [
        row(at, "0040A040", kind), row(at, "0040A010", F.lit("CONTAINS")), row([*at, step("0040A043", one)], "00080104", F.concat(F.lit("c"), F.col("item_no"))), row(at, "0040A160", F.col("value")), row([*at, step("0040A168", one)], "00080104", F.col("value")),
        row(measured, "0040A30A", F.col("item_no")), row(unit, "00080104", F.lit("millimeter")), row(unit, "00080100", F.when(F.col("item_no") % 2 == 0, "mm").otherwise("1")), row([*at, step("00081199", one)], "00081155", F.concat(F.lit("1.2.3.5."), F.col("file_id"), F.lit(".1"))),
        row([*at, step("00081199", one)], "00081160", F.lit("1\\2")),
    ]
    return items.withColumn("e", F.explode(F.array(*rows))).select("file_id", "e.*")


@query("SELECT file_id, chapter, CASE WHEN item_no % 3 = 2 THEN 'NUM' ELSE value_type END AS value_type, 'CONTAINS' AS relationship, concat('c', CAST(item_no AS VARCHAR)) AS concept, CASE WHEN item_no % 3 = 2 THEN CAST(item_no AS VARCHAR) ELSE trim(value) END AS value FROM fx_sr_items")
def t3_sr_content(spark, sf_dir):
    return T.sr_content(_report(spark, sf_dir))


@query("SELECT file_id, chapter, concat('c', CAST(item_no AS VARCHAR)) AS concept, CAST(item_no AS VARCHAR) AS value, CASE WHEN item_no % 2 = 0 THEN 'millimeter [mm]' ELSE 'millimeter' END AS unit FROM fx_sr_items WHERE item_no % 3 = 2")
def t4_sr_measurements(spark, sf_dir):
    return T.sr_measurements(_report(spark, sf_dir))


@query("SELECT s.file_id, s.chapter, concat('1.2.3.5.', CAST(s.file_id AS VARCHAR), '.1') AS ref_uid, '1,2' AS frames, i.file_id AS found_file FROM fx_sr_items s LEFT JOIN fx_instances i ON i.sop_uid = concat('1.2.3.5.', CAST(s.file_id AS VARCHAR), '.1')")
def t5_sr_references(spark, sf_dir):
    images = fixture(spark, sf_dir, "fx_instances").withColumn("dir", F.lit("")).select("file_id", "sop_uid", "dir", "name")
    found = T.sr_references(_report(spark, sf_dir), images)
    return found.select("file_id", "chapter", "ref_uid", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"), "found_file")


@query("SELECT file_id, concat('1.', CAST(region_no AS VARCHAR)) AS chapter, CAST(n AS INTEGER) AS point_no, CASE WHEN n = 0 THEN CAST(x0 AS DOUBLE) ELSE CAST(x1 AS DOUBLE) END AS x, CASE WHEN n = 0 THEN CAST(y0 AS DOUBLE) ELSE CAST(y1 AS DOUBLE) END AS y FROM fx_us_regions CROSS JOIN (SELECT unnest([0, 1]) AS n) p")
def t6_sr_coordinates(spark, sf_dir):
    regions = fixture(spark, sf_dir, "fx_us_regions")
    path = F.array(F.struct(F.lit(T.CONTENT).alias("tag"), F.col("region_no").cast("int").alias("item"))).alias("path")
    row = lambda tag, value: F.struct(F.lit(tag).alias("tag"), value.alias("value"))
    rows = regions.select("file_id", path, F.explode(F.array(row("0040A040", F.lit("SCOORD")), row("00700023", F.lit("POLYLINE")), row("00700022", F.concat_ws("\\", "x0", "y0", "x1", "y1")))).alias("e"))
    return T.sr_coordinates(rows.select("file_id", "path", "e.*")).select("file_id", "chapter", "point_no", "x", "y")


@query("SELECT file_id, CAST(region_no AS INTEGER) AS item, 'graphic' AS kind, 'L1' AS layer, 'POLYLINE' AS graphic_type, CAST(x0 AS DOUBLE) AS x FROM fx_us_regions UNION ALL SELECT file_id, CAST(region_no AS INTEGER), 'text', 'L1', NULL, NULL FROM fx_us_regions")
def t7_pr_annotations(spark, sf_dir):
    regions = fixture(spark, sf_dir, "fx_us_regions")
    step = lambda tag, item: F.struct(F.lit(tag).alias("tag"), item.cast("int").alias("item"))
    at = [step("00700001", F.col("region_no"))]
    row = lambda path, tag, value: F.struct(F.array(*path).alias("path"), F.lit(tag).alias("tag"), value.alias("value"))
    graphic = [*at, step("00700009", F.lit(1))]
    rows = [row(at, "00700002", F.lit("L1")), row(graphic, "00700023", F.lit("POLYLINE")), row(graphic, "00700022", F.concat_ws("\\", "x0", "y0")), row([*at, step("00700008", F.lit(1))], "00700006", F.lit("note"))]
    found = T.pr_annotations(regions.withColumn("e", F.explode(F.array(*rows))).select("file_id", "e.*"))
    return found.select("file_id", "item", "kind", "layer", "graphic_type", F.get("data", F.lit(0)).alias("x"))


@query("SELECT file_id, CAST(region_no AS INTEGER) AS region_no, x0, y0, x1, y1, CAST(flags AS INTEGER) AS flags, delta_x, unit_x, '2D' AS spatial_format FROM fx_us_regions WHERE region_no % 9 <> 0")
def t8_us_regions(spark, sf_dir):
    regions = fixture(spark, sf_dir, "fx_us_regions")
    path = F.array(F.struct(F.lit("00186011").alias("tag"), F.col("region_no").cast("int").alias("item"))).alias("path")
    row = lambda tag, value: F.struct(F.lit(tag).alias("tag"), value.cast("string").alias("value"))
    values = [row("00186018", F.col("x0")), row("0018601A", F.col("y0")), row("0018601C", F.col("x1")), row("0018601E", F.when(F.col("region_no") % 9 != 0, F.col("y1"))), row("00186016", F.col("flags")), row("0018602C", F.col("delta_x")), row("00186024", F.when(F.col("unit_x") == "cm", 3).otherwise(0)), row("00186012", F.lit(1))]
    rows = regions.select("file_id", path, F.explode(F.array(*values)).alias("e")).select("file_id", "path", "e.*")
    return T.us_regions(rows).select("file_id", "region_no", "x0", "y0", "x1", "y1", "flags", "delta_x", "unit_x", "spatial_format")


@query("""WITH s AS (SELECT DISTINCT file_id, CAST(n AS INTEGER) AS segment_id, 45 + n AS ax, 46 AS ay, 52 AS bx, 50 + n AS by_ FROM fx_us_regions CROSS JOIN (SELECT unnest([1, 2]) AS n) t),
p AS (SELECT s.*, r.region_no, r.delta_x, r.delta_y, r.unit_x, r.unit_y, r.flags FROM s JOIN fx_us_regions r ON s.file_id = r.file_id WHERE unit_x <> '' AND unit_y <> '' AND ax BETWEEN x0 AND x1 AND bx BETWEEN x0 AND x1 AND ay BETWEEN y0 AND y1 AND by_ BETWEEN y0 AND y1),
q AS (SELECT *, count(*) FILTER (WHERE flags % 2 = 0) OVER (PARTITION BY file_id, segment_id) AS high FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY file_id, segment_id ORDER BY CASE WHEN high = 1 AND flags % 2 = 0 THEN 0 ELSE 1 END, region_no) AS r FROM q)
SELECT file_id, segment_id, region_no, CASE WHEN unit_x = unit_y THEN sqrt(power((bx - ax) * delta_x, 2) + power((by_ - ay) * delta_y, 2)) END AS length, CASE WHEN unit_x = unit_y THEN unit_x END AS unit,
 CASE WHEN unit_x <> unit_y THEN (bx - ax) * delta_x END AS dx, CASE WHEN unit_x <> unit_y THEN (by_ - ay) * delta_y END AS dy FROM o WHERE r = 1""")
def j13_measure_us(spark, sf_dir):
    regions = fixture(spark, sf_dir, "fx_us_regions")
    segments = regions.select("file_id").distinct().withColumn("segment_id", F.explode(F.array(F.lit(1), F.lit(2)))).select("file_id", "segment_id", (F.col("segment_id") + 45).alias("ax"), F.lit(46).alias("ay"), F.lit(52).alias("bx"), (F.col("segment_id") + 50).alias("by"))
    return T.measure_us(segments, regions)


@query("SELECT file_id, series_uid, sop_uid AS ref_uid, file_id AS found_file FROM fx_instances WHERE file_id % 2 = 0")
def j15_pr_references(spark, sf_dir):
    found = fixture(spark, sf_dir, "fx_instances").select("file_id", "series_uid", "sop_uid", "dir", "name")
    step = lambda tag: F.struct(F.lit(tag).alias("tag"), F.lit(1).alias("item"))
    row = lambda path, tag, value: F.struct(F.array(*path).alias("path"), F.lit(tag).alias("tag"), value.alias("value"))
    rows = [row([step("00081115")], "0020000E", F.col("series_uid")), row([step("00081115"), step("00081140")], "00081155", F.when(F.col("file_id") % 2 == 0, F.col("sop_uid")).otherwise("9.9"))]
    return T.pr_references(found.withColumn("e", F.explode(F.array(*rows))).select("file_id", "e.*"), found).select("file_id", "series_uid", "ref_uid", "found_file")


@query("SELECT sop_uid, CAST(n AS INTEGER) AS frame_no, CAST(instance_number AS DOUBLE) AS center FROM fx_instances CROSS JOIN (SELECT unnest([1, 2]) AS n) f WHERE file_id % 3 = 0 OR (file_id % 3 = 1 AND n = 2)")
def j16_pr_voi_by_slice(spark, sf_dir):
    found = fixture(spark, sf_dir, "fx_instances")
    slices = found.select("sop_uid", F.explode(F.array(F.lit(1), F.lit(2))).alias("frame_no"))
    voi = found.filter("file_id % 3 < 2").select("sop_uid", F.when(F.col("file_id") % 3 == 1, 2).alias("frame_no"), F.col("instance_number").cast("double").alias("center"))
    return T.pr_voi_by_slice(voi, slices)


@query("""SELECT i.file_id, i.study_uid, i.series_uid, '1.2.840' AS ref_class, j.sop_uid AS ref_uid, j.file_id AS found_file FROM fx_instances i JOIN fx_instances j ON i.series_uid = j.series_uid AND i.dir = j.dir WHERE i.instance_number = 1
UNION ALL SELECT file_id, '9.9', NULL, NULL, '9.9.9', NULL FROM fx_instances WHERE instance_number = 1 AND file_id % 3 = 0""")
def t5_sr_evidence(spark, sf_dir):
    """A key object per series that lists the series' instances, some with another study that isn't there."""
    found = fixture(spark, sf_dir, "fx_instances")
    step = lambda tag, item: F.struct(F.lit(tag).alias("tag"), item.cast("int").alias("item"))
    row = lambda path, tag, value: F.struct(F.array(*path).alias("path"), F.lit(tag).alias("tag"), value.alias("value"))
    one = F.lit(1)
    study = [step("0040A375", one)]
    series = [*study, step("00081115", one)]
    heads = found.filter("instance_number = 1")
    fixed = F.array(row(study, "0020000D", F.concat("study_uid", F.lit(" "))), row(series, "0020000E", F.col("series_uid")))
    other = F.when(F.col("file_id") % 3 == 0, F.array(row([step("0040A385", one)], "0020000D", F.lit("9.9")), row([step("0040A385", one), step("00081115", one), step("00081199", one)], "00081155", F.lit("9.9.9"))))
    listed = heads.select("file_id", F.explode(F.concat(fixed, F.coalesce(other, F.array().cast("array<struct<path:array<struct<tag:string,item:int>>,tag:string,value:string>>")))).alias("e"))
    members = found.select("dir", "series_uid", "sop_uid", "instance_number").join(heads.select("file_id", "dir", "series_uid"), ["dir", "series_uid"])
    item = [*series, step("00081199", F.col("instance_number"))]
    refs = members.select("file_id", F.explode(F.array(row(item, "00081150", F.lit("1.2.840")), row(item, "00081155", F.col("sop_uid")))).alias("e"))
    return T.sr_evidence(listed.unionByName(refs).select("file_id", "e.*"), found.select("file_id", "sop_uid", "dir", "name"))


def _presentation(spark, sf_dir):
    """Ultrasound regions as displayed areas and layers, an item each, and a shutter for each file."""
    regions = fixture(spark, sf_dir, "fx_us_regions")
    step = lambda tag: F.struct(F.lit(tag).alias("tag"), F.col("region_no").cast("int").alias("item"))
    row = lambda path, tag, value: F.struct(path.alias("path"), F.lit(tag).alias("tag"), value.cast("string").alias("value"))
    area, layer = F.array(step("0070005A")), F.array(step("00700060"))
    items = [
        row(area, "00700052", F.concat_ws("\\", "x0", "y0")), row(area, "00700053", F.concat_ws("\\", "x1", "y1")), row(area, "00700100", F.when(F.col("flags") == 0, "SCALE TO FIT").otherwise("MAGNIFY")), row(area, "00700101", F.concat_ws("\\", "delta_x", "delta_y")),
        row(area, "00700103", F.when(F.col("flags") == 1, "1.5")), row(layer, "00700002", F.concat(F.lit("L"), F.col("region_no"))), row(layer, "00700062", F.col("x0")), row(layer, "00700068", F.col("unit_x")),
    ]
    nested = regions.withColumn("e", F.explode(F.array(*items))).select("file_id", "e.*")
    top = F.array().cast("array<struct<tag:string,item:int>>")
    files, kind = regions.select("file_id").distinct(), F.col("file_id") % 4
    shape = F.when(kind == 0, "RECTANGULAR").when(kind == 1, "CIRCULAR").when(kind == 2, "POLYGONAL\\BITMAP")
    values = [
        row(top, "00181600", shape), row(top, "00181602", F.lit(1)), row(top, "00181604", F.lit(9)), row(top, "00181606", F.when(kind == 0, 2)), row(top, "00181608", F.lit(8)), row(top, "00181610", F.when(kind == 1, "4\\5").otherwise("4")), row(top, "00181612", F.lit(3)),
        row(top, "00181620", F.when(kind == 2, "1\\2\\3\\4\\5\\6")), row(top, "00181622", F.col("file_id")), row(top, "00181624", F.when(kind == 0, "1\\2\\3").otherwise("1\\2")),
    ]
    return nested.unionByName(files.withColumn("e", F.explode(F.array(*values))).select("file_id", "e.*"))


@query("SELECT file_id, CAST(region_no AS INTEGER) AS item, CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, CASE WHEN flags = 0 THEN 'SCALE TO FIT' ELSE 'MAGNIFY' END AS size_mode, delta_x AS spacing_x, CASE WHEN flags = 1 THEN 1.5 END AS magnification FROM fx_us_regions")
def t7_pr_areas(spark, sf_dir):
    return T.pr_areas(_presentation(spark, sf_dir)).withColumn("spacing_x", F.get("pixel_spacing", F.lit(0))).drop("pixel_spacing")


@query("SELECT file_id, CAST(region_no AS INTEGER) AS item, concat('L', CAST(region_no AS VARCHAR)) AS layer, CAST(x0 AS INTEGER) AS layer_order, unit_x AS description FROM fx_us_regions")
def t7_pr_layers(spark, sf_dir):
    return T.pr_layers(_presentation(spark, sf_dir))


@query(r"""WITH f AS (SELECT DISTINCT file_id, file_id % 4 AS k FROM fx_us_regions) SELECT file_id, CASE k WHEN 0 THEN 'RECTANGULAR' WHEN 1 THEN 'CIRCULAR' ELSE 'POLYGONAL\BITMAP' END AS shape, CASE WHEN k = 0 THEN 1 END AS "left", CASE WHEN k = 0 THEN 9 END AS "right", CASE WHEN k = 0 THEN 2 END AS upper,
 CASE WHEN k = 0 THEN 8 END AS lower, CASE WHEN k = 1 THEN '4,5' END AS center, CASE WHEN k = 1 THEN 3 END AS radius, CASE WHEN k = 2 THEN '1,2,3,4,5,6' END AS vertices, CAST(file_id AS INTEGER) AS gray, CASE WHEN k = 0 THEN '1,2,3' END AS lab FROM f WHERE k < 3""")
def t7_pr_shutters(spark, sf_dir):
    found = T.pr_shutters(_presentation(spark, sf_dir))
    return found.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("center", "vertices", "lab")})
