"""Queries of the cataloguing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.functions import sop_classes
from voxlake.operators import catalog as C
from voxlake.plans.registry import query
from voxlake.sources.fixtures import elements, fixture, instances

TAGS = ["0020000E", "00080018", "0020000D", "00100020", "00100010", "00080022", "00091001"]


def _scan(spark, sf_dir):
    return C.scan_tags(elements(spark, sf_dir), TAGS).withColumn("file_order", F.col("file_id"))


@query("""SELECT i.file_id, series_uid, sop_uid, study_uid, i.patient_id, p.patient_name, acq_date, '' AS private_value FROM fx_instances i LEFT JOIN fx_patients p ON i.patient_id = p.patient_id""")
def c1_scan_tags(spark, sf_dir):
    names = ["series_uid", "sop_uid", "study_uid", "patient_id", "patient_name", "acq_date", "private_value"]
    return C.scan_tags(elements(spark, sf_dir), TAGS).toDF("file_id", *names)


@query("SELECT DISTINCT patient_id AS value FROM fx_instances")
def c2_tag_values(spark, sf_dir):
    return C.tag_values(_scan(spark, sf_dir), "00100020")


@query("SELECT patient_id AS value, min(file_id) AS first_order FROM fx_instances GROUP BY patient_id")
def c3_ordered_tag_values(spark, sf_dir):
    return C.ordered_tag_values(_scan(spark, sf_dir), "00100020")


@query("SELECT file_id FROM fx_instances WHERE patient_id = 'P10'")
def c4_files_with_value(spark, sf_dir):
    return C.files_with_value(_scan(spark, sf_dir), "00100020", " P10 ").select("file_id")


@query("SELECT min(file_id) AS file_id FROM fx_instances WHERE patient_id LIKE 'P1%'")
def c5_first_file_with_value(spark, sf_dir):
    return C.first_file_with_value(_scan(spark, sf_dir), "00100020", "P1 ")


_SOP = f"CASE modality_code WHEN 'A' THEN '{sop_classes.ULTRASOUND[0]}' WHEN 'N' THEN '{sop_classes.RTSTRUCT}' ELSE '1.2.840.10008.5.1.4.1.1.2' END"


@query(f"SELECT file_id, CASE modality_code WHEN 'A' THEN 'ultrasound' WHEN 'N' THEN 'rtstruct' ELSE 'plain' END AS kind, modality_code = 'R' AS is_localizer FROM fx_instances WHERE {_SOP} <> ''")
def c7_classify_instance(spark, sf_dir):
    found = instances(spark, sf_dir).withColumn("sop_class", F.expr(_SOP)).withColumn("image_type", F.when(F.col("modality_code") == "R", "ORIGINAL\\LOCALIZER"))
    return C.classify_instance(found).select("file_id", "kind", C.is_localizer(F.col("image_type")).alias("is_localizer"))


_ROOT = "1.2.840.10008.5.1.4.1.1."
#: End of a class under the root ('' for another class, None for none), what else is set, and the kind that this makes.
_KINDS = [
    ("481.3", "", "rtstruct"), ("4.2", "", "spectroscopy"), ("66.5", "", "mesh"), ("68.1", "", "mesh"), ("77.1.6", "", "slide"), ("104.1", "", "pdf"), ("104.3", "", "stl"), ("77.1.1.1", "", "video"),
    ("11.1", "", "grayscale presentation state"), ("11.2", "", "color presentation state"), ("11.3", "", "pseudo-color presentation state"), ("11.4", "", "blending presentation state"), ("11.5", "", "xa/xrf presentation state"),
    ("11.8", "", "advanced blending presentation state"), ("88.59", "", "report"), ("6.1", "", "ultrasound"), ("3", "is_multiframe", "ultrasound"), ("20", "", "nuclear"), ("1.2.1", "", "projection"), ("", "has_functional_groups", "enhanced"),
    ("", "is_mosaic", "mosaic"), ("", "is_grid", "grid"), ("", "is_multiframe", "multiframe"), ("", "", "plain"), ("", "no rows", "other"), ("", "no bits", "other"), (None, "", "plain"), ("481.3", "no rows", "rtstruct"),
]


@query(f"SELECT file_id, CASE CAST(file_id % {len(_KINDS)} AS INTEGER) {' '.join(f"WHEN {i} THEN '{kind}'" for i, (_, _, kind) in enumerate(_KINDS))} END AS kind, false AS is_localizer FROM fx_instances")
def c7_all_kinds(spark, sf_dir):
    """Every kind of instance, the images told apart by flags, and files that are no image."""
    rows, at = instances(spark, sf_dir), (F.col("file_id") % len(_KINDS)).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)
    has = lambda flag: pick([what == flag for _, what, _ in _KINDS])
    rows = rows.withColumn("sop_class", pick([None if end is None else _ROOT + end + "\x00" if end else "9.9" for end, _, _ in _KINDS]))
    rows = rows.withColumns({flag: has(flag) for flag in ("has_functional_groups", "is_multiframe", "is_mosaic", "is_grid")}).withColumn("rows", F.when(~has("no rows"), F.col("rows"))).withColumn("bits_allocated", F.when(~has("no bits"), F.col("bits_allocated")))
    return C.classify_instance(rows.withColumn("image_type", F.lit("ORIGINAL\\PRIMARY"))).select("file_id", "kind", C.is_localizer(F.col("image_type")).alias("is_localizer"))


_FLAG_ROWS = f"""SELECT dir, series_uid, instance_number, file_id, CASE WHEN instance_number % 3 = 1 THEN NULL ELSE rows_ END AS r,
 CASE WHEN instance_number % 2 = 1 THEN '{sop_classes.REPORT[0]}' WHEN instance_number = 2 THEN '{list(sop_classes.PRESENTATION)[1]}' ELSE '1.2.3' END AS sop FROM fx_instances"""


@query(f"""WITH f AS ({_FLAG_ROWS}), n AS (SELECT *, row_number() OVER (PARTITION BY dir, series_uid ORDER BY file_id) AS n FROM f),
g AS (SELECT dir, series_uid, bool_or(n = 1 AND r IS NOT NULL) AS i0, bool_or(n = 1 AND sop = '{sop_classes.REPORT[0]}') AS s0, min(CASE WHEN n > 1 AND r IS NOT NULL THEN n END) AS i,
 min(CASE WHEN n > 1 AND r IS NULL AND sop = '{list(sop_classes.PRESENTATION)[1]}' THEN n END) AS s FROM n GROUP BY dir, series_uid)
SELECT dir, series_uid, i0 OR coalesce(i < coalesce(s, 1000000), false) AS is_image, s0 OR (NOT i0 AND coalesce(s < coalesce(i, 1000000), false)) AS is_softcopy FROM g""")
def c8_series_flags(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_instances")
    rows = rows.selectExpr("dir", "series_uid", "file_id AS file_order", "CASE WHEN instance_number % 3 = 1 THEN NULL ELSE rows_ END AS rows", "cols_ AS cols", "bits_allocated", "0 AS pixel_repr", f"CASE WHEN instance_number % 2 = 1 THEN '{sop_classes.REPORT[0]}' WHEN instance_number = 2 THEN '{list(sop_classes.PRESENTATION)[1]}' ELSE '1.2.3' END AS sop_class")
    return C.series_flags(rows)


@query("SELECT i.file_id, p.patient_name, i.patient_id, study_uid, series_uid, sop_uid, acq_date AS acquisition_date FROM fx_instances i LEFT JOIN fx_patients p ON i.patient_id = p.patient_id")
def c9_image_info(spark, sf_dir):
    return C.image_info(elements(spark, sf_dir)).select("file_id", "patient_name", "patient_id", "study_uid", "series_uid", "sop_uid", "acquisition_date")


@query("SELECT file_id FROM fx_instances WHERE l_key IN (SELECT l_key FROM fx_instances WHERE file_id % 997 = 0)".replace("l_key", "concat(dir, series_uid)"))
def j1_files_in_series(spark, sf_dir):
    files = fixture(spark, sf_dir, "fx_instances")
    return C.files_in_series(files, files.filter("file_id % 997 = 0")).select("file_id")


@query("SELECT e.file_id, e.value AS ref_uid, i.file_id AS found_file FROM fx_elements e LEFT JOIN fx_instances i ON e.value = i.sop_uid WHERE e.tag = '00081155'")
def j2_resolve_uids(spark, sf_dir):
    found = fixture(spark, sf_dir, "fx_instances").select("file_id", "sop_uid", "dir", "name")
    refs = elements(spark, sf_dir).filter("tag = '00081155'").select("file_id", F.col("value").alias("ref_uid")).join(found.select("file_id", "dir"), "file_id")
    return C.resolve_uids(refs, found).select("file_id", "ref_uid", "found_file")


@query("""SELECT i.series_uid, i.study_uid, i.patient_id, min(i.acq_date) AS study_date, p.patient_name, string_agg(concat(i.dir, '/', i.name), ',' ORDER BY concat(i.dir, '/', i.name)) AS files
FROM fx_instances i JOIN fx_patients p ON i.patient_id = p.patient_id JOIN (SELECT study_uid, min(acq_date) AS d FROM fx_instances GROUP BY study_uid) s ON s.study_uid = i.study_uid
WHERE (p.patient_name ILIKE '%building%' OR p.patient_id ILIKE '%7%') AND s.d BETWEEN '19930101' AND '19991231' GROUP BY i.series_uid, i.study_uid, i.patient_id, p.patient_name, s.d
""".replace("min(i.acq_date) AS study_date", "s.d AS study_date"))
def j3_catalog_query(spark, sf_dir):
    found = fixture(spark, sf_dir, "fx_instances")
    studies = found.groupBy("study_uid", "patient_id").agg(F.min("acq_date").alias("study_date"))
    series = found.select("series_uid", "study_uid").distinct()
    images = found.select("series_uid", F.concat_ws("/", "dir", "name").alias("path"))
    out = C.catalog_query(fixture(spark, sf_dir, "fx_patients"), studies, series, images, "building", "7", "19930101", "19991231")
    return out.select("series_uid", "study_uid", "patient_id", "study_date", "patient_name", F.concat_ws(",", "files").alias("files"))


@query("SELECT dir, count(*) AS n FROM fx_instances WHERE file_id % 7 = 0 GROUP BY dir")
def j4_missing_files(spark, sf_dir):
    listed = fixture(spark, sf_dir, "fx_instances").select("dir", "file_id", F.concat_ws("/", "dir", "name").alias("path"))
    return C.missing_files(listed, listed.filter("file_id % 7 <> 0").select("path")).groupBy("dir").agg(F.count("*").alias("n"))


@query("""SELECT file_id, tag, CASE tag WHEN '00091001' THEN CASE WHEN file_id % 2 = 0 THEN 'UN' ELSE 'LO' END WHEN '00100010' THEN 'PN' ELSE vr END AS vr_used, value FROM fx_elements WHERE path = ''""")
def j6_effective_vr(spark, sf_dir):
    rows = elements(spark, sf_dir).filter(F.size("path") == 0)
    rows = rows.withColumn("vr", F.when(F.col("tag").isin("00091001", "00100010"), "UN").otherwise(F.col("vr"))).withColumn("creator", F.when(F.col("file_id") % 2 == 1, "ACME "))
    public = spark.createDataFrame([("00100010", "PN"), ("00080018", "UI")], "tag string, dict_vr string")
    private = spark.createDataFrame([("0009", "01", "ACME", "LO")], "grp string, element string, creator string, dict_vr string")
    return C.effective_vr(rows, public, private).select("file_id", "tag", "vr_used", "value")


@query(f"""WITH f AS (SELECT i.*, r, sop, row_number() OVER (PARTITION BY i.dir, i.series_uid ORDER BY i.name, i.file_id) AS n FROM fx_instances i JOIN ({_FLAG_ROWS}) x ON x.file_id = i.file_id),
g AS (SELECT dir, series_uid, min(patient_id) AS patient_id, min(study_uid) AS study_uid, min(name) AS first_name, count(*) AS n_files, string_agg(name, ',' ORDER BY name) AS files, bool_or(n = 1 AND r IS NOT NULL) AS i0, bool_or(n = 1 AND sop = '{sop_classes.REPORT[0]}') AS s0,
 min(CASE WHEN n > 1 AND r IS NOT NULL THEN n END) AS i, min(CASE WHEN n > 1 AND r IS NULL AND sop = '{list(sop_classes.PRESENTATION)[1]}' THEN n END) AS s FROM f GROUP BY dir, series_uid)
SELECT dir, series_uid, patient_id, study_uid, first_name, n_files, files, i0 OR coalesce(i < coalesce(s, 1000000), false) AS is_image, s0 OR (NOT i0 AND coalesce(s < coalesce(i, 1000000), false)) AS is_softcopy FROM g""")
def a1_series_index(spark, sf_dir):
    rows = instances(spark, sf_dir).withColumn("rows", F.expr("CASE WHEN instance_number % 3 = 1 THEN NULL ELSE rows_ END")).withColumn("pixel_repr", F.lit(0))
    rows = rows.withColumn("sop_class", F.expr(f"CASE WHEN instance_number % 2 = 1 THEN '{sop_classes.REPORT[0]}' WHEN instance_number = 2 THEN '{list(sop_classes.PRESENTATION)[1]}' ELSE '1.2.3' END"))
    return C.series_index(rows).select("dir", "series_uid", "patient_id", "study_uid", "first_name", "n_files", F.concat_ws(",", "files").alias("files"), "is_image", "is_softcopy")


@query("""WITH d AS (SELECT *, coalesce(rows_ <> lag(rows_) OVER (PARTITION BY dir, series_uid ORDER BY file_id), false) AS d FROM fx_instances), m AS (SELECT *, max(CASE WHEN d THEN 1 ELSE 0 END) OVER (PARTITION BY dir, series_uid) = 1 AS is_mixed FROM d)
SELECT file_id, is_mixed, CASE WHEN is_mixed THEN concat(CAST(rows_ AS VARCHAR), '|256|16|1.0000|1.0000') ELSE '' END AS part_key FROM m""")
def a2_mixed_series_split(spark, sf_dir):
    return C.mixed_series_split(instances(spark, sf_dir).withColumn("file_order", F.col("file_id"))).select("file_id", "is_mixed", "part_key")


@query("SELECT file_id, '0020000E' AS tag, CAST(2 AS BIGINT) AS n FROM fx_instances WHERE file_id % 3 = 0")
def a3_duplicate_elements(spark, sf_dir):
    twice = elements(spark, sf_dir).withColumn("copies", F.expr("CASE WHEN tag = '0020000E' AND file_id % 3 = 0 THEN array(1, 2) ELSE array(1) END"))
    return C.duplicate_elements(twice.select("file_id", "path", "tag", F.explode("copies"))).select("file_id", "tag", "n")


@query("SELECT DISTINCT value FROM fx_elements WHERE vr IN ('UI', 'PN') OR tag = '00100020'")
def o3_uid_universe(spark, sf_dir):
    return C.uid_universe(elements(spark, sf_dir))


@query("SELECT file_id, value AS ref_uid FROM fx_elements WHERE tag = '00081155' AND file_id % 5 = 1")
def o4_dangling_refs(spark, sf_dir):
    refs = elements(spark, sf_dir).filter("tag = '00081155'").select("file_id", F.col("value").alias("ref_uid"))
    return C.dangling_refs(refs, fixture(spark, sf_dir, "fx_instances").filter("file_id % 5 <> 1")).select("file_id", "ref_uid")
