"""Queries of sources, sinks and lookups over tables derived from the driver's."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.functions.text import decode_text
from voxlake.operators.catalog import dicomdir_series
from voxlake.plans.registry import query
from voxlake.sources import dicom_files as D
from voxlake.sources.fixtures import fixture
from voxlake.sources.shared import written


@query("SELECT file_id, file_id % 4 <> 3 AS is_dicom FROM fx_instances")
def s2_is_dicom(spark, sf_dir):
    content = F.concat(F.when(F.col("file_id") % 4 == 0, F.lpad(F.lit(""), 128, "x")).otherwise(""), F.when(F.col("file_id") % 4 < 2, "DICM").when(F.col("file_id") % 4 == 2, F.decode(F.lit(b"\x08\x00"), "UTF-8")).otherwise("PNG_"), F.col("sop_uid"))
    return fixture(spark, sf_dir, "fx_instances").select("file_id", D.is_dicom(content.cast("binary")).alias("is_dicom"))


@query("""SELECT concat(dir, '/', name) AS path, concat('/out/', lpad(CAST(dense_rank() OVER (ORDER BY dir, series_uid) AS VARCHAR), 8, '0'), '/', name) AS target_path FROM fx_instances WHERE patient_id LIKE 'P1%'""")
def k2_export_manifest(spark, sf_dir):
    files = fixture(spark, sf_dir, "fx_instances").withColumn("path", F.concat_ws("/", "dir", "name"))
    return D.export_manifest(files.filter("patient_id like 'P1%'"), files, "/out")


@query("SELECT file_id, concat(CAST(file_id AS VARCHAR), CASE WHEN file_id % 2 = 0 THEN '.pdf' ELSE '.stl' END) AS name, md5(sop_uid) AS digest FROM fx_instances")
def k3_extract_encapsulated(spark, sf_dir):
    found = fixture(spark, sf_dir, "fx_instances")
    top = F.array().cast("array<struct<tag:string,item:int>>").alias("path")
    data = found.select("file_id", top, F.lit("00420011").alias("tag"), F.lit(None).cast("string").alias("value"), F.col("sop_uid").cast("binary").alias("value_bin"))
    mime = found.select("file_id", top, F.lit("00420012").alias("tag"), F.when(F.col("file_id") % 2 == 0, "application/pdf").otherwise("model/stl").alias("value"), F.lit(None).cast("binary").alias("value_bin"))
    return D.extract_encapsulated(data.unionByName(mime)).select("file_id", "name", F.md5("payload").alias("digest"))


@query("""SELECT file_id, concat(CAST(file_id AS VARCHAR), CASE WHEN file_id % 3 = 0 THEN '.mpg' ELSE '.mp4' END) AS name, md5(sop_uid) AS digest FROM fx_instances WHERE file_id % 3 < 2""")
def k3_video(spark, sf_dir):
    """Video streams by transfer syntax; other pixel data stays where it is."""
    found = fixture(spark, sf_dir, "fx_instances")
    top = F.array().cast("array<struct<tag:string,item:int>>").alias("path")
    data = found.select("file_id", top, F.lit(D.PIXELS).alias("tag"), F.lit(None).cast("string").alias("value"), F.col("sop_uid").cast("binary").alias("value_bin"))
    kind = F.col("file_id") % 3
    syntax = F.when(kind == 0, "1.2.840.10008.1.2.4.100").when(kind == 1, "1.2.840.10008.1.2.4.102").otherwise("1.2.840.10008.1.2.1")
    return D.extract_encapsulated(data, found.select("file_id", syntax.alias("transfer_syntax"))).select("file_id", "name", F.md5("payload").alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def f5_decode_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", F.md5(decode_text(F.col("text").cast("binary"), F.lit("ISO_IR 192")).cast("binary")).alias("digest"))


@query("SELECT CAST(substr(patient_id, 2) AS BIGINT) % 20 AS file_id, series_uid, count(*) AS n_files, false AS warning FROM fx_instances GROUP BY 1, 2")
def j5_dicomdir_series(spark, sf_dir):
    """Directories of patients with a study each, its series and images, linked by offsets."""
    rows = fixture(spark, sf_dir, "fx_instances").select((F.substring("patient_id", 2, 20).cast("long") % 20).alias("file_id"), F.substring("patient_id", 2, 20).cast("long").alias("p"), F.element_at(F.split("series_uid", r"\."), -1).cast("long").alias("s"), F.col("file_id").alias("i"))
    rows = written(rows)  # read at every level
    chain = lambda keys, at: F.coalesce(F.lead("off").over(Window.partitionBy(*keys).orderBy("off")), F.lit(0)).alias(at)
    level = lambda own, keys, kind, base, low, rows=rows: rows.groupBy("file_id", *keys, own).agg(low.alias("lower_off")).withColumn("off", F.col(own) + base).select("file_id", "off", chain(["file_id", *keys], "next_off"), "lower_off", F.lit(kind).alias("type"), F.when(F.lit(kind) == "IMAGE", F.concat(F.lit("IM/"), F.col(own))).alias("ref_file"))
    big = 10**9
    studies = rows.groupBy("file_id", "p").agg((F.min("s") + 3 * big).alias("lower_off")).select("file_id", (F.col("p") + 2 * big).alias("off"), F.lit(0).cast("long").alias("next_off"), "lower_off", F.lit("STUDY").alias("type"), F.lit(None).cast("string").alias("ref_file"))
    records = level("p", [], "PATIENT", big, F.max(F.col("p")) + 2 * big).unionByName(studies).unionByName(level("s", ["p"], "SERIES", 3 * big, F.min("i") + 4 * big)).unionByName(level("i", ["s"], "IMAGE", 4 * big, F.lit(0).cast("long"), rows.repartition("file_id", "s")))
    roots = rows.groupBy("file_id").agg((F.min("p") + big).alias("root_off"))
    found = dicomdir_series(records, roots)
    return found.select("file_id", F.concat(F.lit("1.2.3.4."), (F.col("series") - 3 * big).cast("string")).alias("series_uid"), F.size("files").cast("long").alias("n_files"), "warning")
