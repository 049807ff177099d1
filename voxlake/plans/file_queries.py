"""Queries over files: frames are written as multi-frame files into the shared folder and read from there."""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators import catalog as C
from voxlake.operators import multiframe as M
from voxlake.operators.documents import path_text
from voxlake.plans.registry import query
from voxlake.sources import dicom_files as D
from voxlake.sources.fixtures import elements, fixture
from voxlake.sources.shared import shared_folder
from voxlake.sources.stores import open_store

SIDE = 8  # rows and columns of a frame


def _element(tag: str, vr: str, data: bytes) -> bytes:
    data += (b"\0" if vr in ("UI", "OW") else b" ") * (len(data) % 2)
    head = struct.pack("<HH", int(tag[:4], 16), int(tag[4:], 16)) + vr.encode()
    return head + (b"\0\0" + struct.pack("<I", len(data)) if vr.encode() in D.LONG else struct.pack("<H", len(data))) + data


def _text(tag: str, vr: str, value: object) -> bytes:
    return _element(tag, vr, str(value).encode())


def _sequence(tag: str, items: list[bytes]) -> bytes:
    return _element(tag, "SQ", b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(x)) + x for x in items))


def multiframe_file(volume: int, frames: list[tuple[int, list[float]]]) -> bytes:
    """A small file of frames (number, values of SIDE x SIDE pixels) with dimensions, shared rescale and positions."""
    pointer = lambda tag: struct.pack("<HH", int(tag[:4], 16), int(tag[4:], 16))
    index = [_text("00209164", "UI", "1.2") + _element("00209165", "AT", pointer(x)) + _element("00209167", "AT", pointer("00209111")) for x in ("00209056", "00209057")]
    shared = _sequence("00289145", [_text("00281052", "DS", -100) + _text("00281053", "DS", 2)])
    per_frame = [_sequence("00209111", [_element("00209157", "UL", struct.pack("<II", n // 50 % 2 + 1, n // 100 + 1))]) + _sequence("00209113", [_text("00200032", "DS", f"0\\0\\{-n}")]) for n, _ in frames]
    short = lambda tag, value: _element(tag, "US", struct.pack("<H", value))
    size = short("00280002", 1) + _text("00280008", "IS", len(frames)) + short("00280010", SIDE) + short("00280011", SIDE) + short("00280100", 16) + short("00280103", 1)
    pixels = b"".join(struct.pack(f"<{len(x)}h", *[round(1000 * v) for v in x]) for _, x in frames)
    body = _text("00080018", "UI", f"1.2.9.{volume}") + _text("00200010", "SH", volume) + _sequence("00209222", index) + size
    return b"\0" * 128 + b"DICM" + _text("00020010", "UI", D.EXPLICIT) + body + _sequence("52009229", [shared]) + _sequence("52009230", per_frame) + _element("7FE00010", "OW", pixels)


def _written(folder: str):
    def run(table: pa.Table) -> pa.Table:
        store, path = open_store(folder)
        frames = sorted(zip(table.column("frame").to_pylist(), table.column("pixels").to_pylist(), strict=True))
        volume = table.column("volume_id")[0].as_py()
        name = f"{path}/v{volume}.dcm"
        attempt = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
        store.create_dir(path, recursive=True)
        with store.open_output_stream(attempt) as file:
            file.write(multiframe_file(volume, frames))
        store.move(attempt, name)
        return pa.table({"volume_id": [volume], "n_frames": [len(frames)]})

    return run


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a multi-frame file for each volume of the frames."""
    folder = f"{shared_folder(spark)}/voxlake-{uuid.uuid4().hex}/files"
    frames = fixture(spark, sf_dir, "fx_frame_pixels").select("volume_id", F.col("file_id").alias("frame"), F.col("pixels").cast("array<double>").alias("pixels"))
    frames.groupBy("volume_id").applyInArrow(_written(folder), "volume_id long, n_frames long").count()
    return folder


def _elements(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Element rows of the files, with the volume's number as ``file_id``."""
    found = D.read_elements(spark, _folder(spark, sf_dir), **options)
    number = found.filter("tag = '00200010'").select("file_id", F.trim("value").cast("long").alias("volume"))
    return found.join(number, "file_id").withColumn("file_id", F.col("volume")).drop("volume")


_FRAMES = "f AS (SELECT volume_id, file_id, row_number() OVER (PARTITION BY volume_id ORDER BY file_id) AS n FROM fx_frame_pixels), v AS (SELECT volume_id, count(*) AS n FROM f GROUP BY volume_id)"
_TOP = [("00020010", "UI", "'1.2.840.10008.1.2.1'"), ("00080018", "UI", "concat('1.2.9.', CAST(volume_id AS VARCHAR))"), ("00200010", "SH", "CAST(volume_id AS VARCHAR)"), ("00209222", "SQ", "''"), ("00280002", "US", "'1'"), ("00280008", "IS", "CAST(n AS VARCHAR)"), ("00280010", "US", "'8'"), ("00280011", "US", "'8'"), ("00280100", "US", "'16'"), ("00280103", "US", "'1'"), ("52009229", "SQ", "''"), ("52009230", "SQ", "''"), ("7FE00010", "OW", "NULL")]
_NESTED = [("00209222[1]", "00209164", "UI", "'1.2'"), ("00209222[1]", "00209165", "AT", "'00209056'"), ("00209222[1]", "00209167", "AT", "'00209111'"), ("00209222[2]", "00209164", "UI", "'1.2'"), ("00209222[2]", "00209165", "AT", "'00209057'"), ("00209222[2]", "00209167", "AT", "'00209111'"), ("52009229[1]", "00289145", "SQ", "''"), ("52009229[1]/00289145[1]", "00281052", "DS", "'-100'"), ("52009229[1]/00289145[1]", "00281053", "DS", "'2'")]
_PER_FRAME = [("", "00209111", "SQ", "''"), ("/00209111[1]", "00209157", "UL", r"concat(CAST(file_id // 50 % 2 + 1 AS VARCHAR), '\', CAST(file_id // 100 + 1 AS VARCHAR))"), ("", "00209113", "SQ", "''"), ("/00209113[1]", "00200032", "DS", r"concat('0\0\', CAST(-file_id AS VARCHAR))")]
_ELEMENTS = " UNION ALL ".join(
    [f"SELECT volume_id AS file_id, '{path}' AS path_text, '{tag}' AS tag, '{vr}' AS vr, {value} AS value FROM v" for path, tag, vr, value in [("", *x) for x in _TOP] + _NESTED]
    + [f"SELECT volume_id, concat('52009230[', CAST(n AS VARCHAR), ']{path}'), '{tag}', '{vr}', {value} FROM f" for path, tag, vr, value in _PER_FRAME]
)


@query(f"WITH {_FRAMES} {_ELEMENTS}")
def s1_read_elements(spark, sf_dir):
    rows = _elements(spark, sf_dir)
    return rows.select("file_id", path_text(F.col("path")).alias("path_text"), "tag", "vr", F.trim(F.translate("value", "\x00", "")).alias("value"))


@query(f"WITH {_FRAMES}, e AS ({_ELEMENTS}) SELECT file_id, path_text, tag FROM e WHERE tag < '5200' AND path_text NOT LIKE '5200%'")
def s1_read_headers(spark, sf_dir):
    """Reading stops before the functional groups."""
    rows = _elements(spark, sf_dir, up_to="5200")
    return rows.select("file_id", path_text(F.col("path")).alias("path_text"), "tag")


@query(f"WITH {_FRAMES} SELECT volume_id AS file_id, CAST(n AS INTEGER) AS frame_no, concat(CAST(file_id // 50 % 2 + 1 AS VARCHAR), ',', CAST(file_id // 100 + 1 AS VARCHAR)) AS dims, '00209056,00209057' AS pointers FROM f")
def m1_dim_values(spark, sf_dir):
    rows = _elements(spark, sf_dir)
    index = M.dim_index(rows)
    pointers = index.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("position", "index_pointer"))).alias("p")).select("file_id", F.array_join(F.col("p.index_pointer"), ",").alias("pointers"))
    values = M.dim_values(rows, index).select("file_id", "frame_no", F.array_join(F.col("dim_values").cast("array<string>"), ",").alias("dims"))
    return values.join(pointers, "file_id")


@query(f"WITH {_FRAMES} SELECT volume_id AS file_id, CAST(n AS INTEGER) AS frame_no, CAST(-file_id AS DOUBLE) AS z, '2' AS rescale_slope, '-100' AS rescale_intercept FROM f")
def m2_frame_groups(spark, sf_dir):
    """Positions of the frames, slope and intercept from the shared group."""
    rows = _elements(spark, sf_dir)
    frames, shared = M.frame_groups(rows), M.frame_groups(rows, M.SHARED)
    merged = M.merge_shared(frames, shared, ["rescale_slope", "rescale_intercept"])
    return merged.select("file_id", "frame_no", F.element_at(F.split("ipp", r"\\"), 3).cast("double").alias("z"), *[F.trim(c).alias(c) for c in ("rescale_slope", "rescale_intercept")])


@query(f"""WITH {_FRAMES}, t AS (SELECT volume_id, dense_rank() OVER (PARTITION BY volume_id ORDER BY file_id // 50 % 2) - 1 AS volume_no, file_id, n FROM f)
SELECT volume_id AS file_id, CAST(n AS INTEGER) AS frame_no, CAST(volume_no AS INTEGER) AS volume_no, CAST(row_number() OVER (PARTITION BY volume_id, volume_no ORDER BY file_id DESC) - 1 AS INTEGER) AS place FROM t""")
def w6_volumes_from_files(spark, sf_dir):
    """From files to volumes: elements, dimensions, functional groups, order in space."""
    rows = _elements(spark, sf_dir)
    index = M.dim_index(rows)
    frames = M.frame_groups(rows).select("file_id", "frame_no", F.split("ipp", r"\\").cast("array<double>").alias("ipp")).withColumn("iop", F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))))
    placed = frames.join(M.dim_values(rows, index), ["file_id", "frame_no"], "left")
    return M.volumes_from_dims(placed, M.choose_dims(index)).select("file_id", "frame_no", "volume_no", "place")


@query(f"WITH {_FRAMES} SELECT f.volume_id AS file_id, CAST(n AS INTEGER) AS frame_no, CAST(list_sum(list_transform(p.pixels, lambda v: round_even(1000 * CAST(v AS DOUBLE), 0))) AS DOUBLE) AS total, CAST(NULL AS VARCHAR) AS reason FROM f JOIN fx_frame_pixels p ON p.file_id = f.file_id")
def s5_read_raw_frames(spark, sf_dir):
    rows = _elements(spark, sf_dir).filter("size(path) = 0")
    number = lambda tag, name: F.max(F.when(F.col("tag") == tag, F.trim("value"))).cast("int").alias(name)
    images = rows.groupBy("file_id").agg(F.max(F.when(F.col("tag") == D.PIXELS, F.col("value_bin"))).alias("value_bin"), number("00280010", "rows"), number("00280011", "cols"), number("00280002", "samples"), number("00280100", "bits_allocated"), number("00280103", "pixel_repr"), number("00280008", "number_of_frames"))
    return D.raw_frames(images).select("file_id", "frame_no", F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x).alias("total"), "reason")


@query(r"""WITH r AS (SELECT CAST(substr(patient_id, 2) AS BIGINT) % 20 AS file_id, file_id AS k, patient_id, series_uid, row_number() OVER (PARTITION BY CAST(substr(patient_id, 2) AS BIGINT) % 20 ORDER BY file_id) AS item FROM fx_instances)
SELECT file_id, CAST(item AS INTEGER) AS item, k AS next_off, CASE WHEN k % 2 = 0 THEN k + 1 END AS lower_off, 'IMAGE' AS type, concat('IM/A/', CAST(k AS VARCHAR)) AS ref_file, patient_id, series_uid FROM r""")
def s3_read_dicomdir(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_instances").selectExpr("CAST(substr(patient_id, 2) AS BIGINT) % 20 AS file_id", "file_id AS k", "patient_id", "series_uid")
    rows = rows.selectExpr("*", "CAST(row_number() OVER (PARTITION BY file_id ORDER BY k) AS INT) AS item")
    row = lambda tag, value: F.struct(F.lit(tag).alias("tag"), value.cast("string").alias("value"))
    values = [row("00041400", F.col("k")), row("00041420", F.when(F.col("k") % 2 == 0, F.col("k") + 1).cast("string")), row("00041430", F.lit("IMAGE ")), row("00041500", F.concat(F.lit("IM\\A\\"), "k")), row("00100020", F.col("patient_id")), row("0020000E", F.col("series_uid"))]
    path = F.array(F.struct(F.lit("00041220").alias("tag"), F.col("item")))
    found = D.read_dicomdir(rows.select("file_id", path.alias("path"), F.explode(F.array(*values)).alias("e")).select("file_id", "path", "e.*"))
    return found.select("file_id", "item", "next_off", "lower_off", "type", "ref_file", "patient_id", "series_uid")


@query("""SELECT i.series_uid, i.patient_id, p.patient_name, s.d AS study_date, count(*) AS n_files FROM fx_instances i LEFT JOIN fx_patients p ON i.patient_id = p.patient_id
JOIN (SELECT study_uid, min(acq_date) AS d FROM fx_instances GROUP BY study_uid) s ON s.study_uid = i.study_uid WHERE s.d >= '19940601' GROUP BY i.series_uid, i.patient_id, p.patient_name, s.d""")
def s4_read_catalog(spark, sf_dir):
    """A catalogue of four tables in the shared folder, read and asked for studies since a date."""
    found = fixture(spark, sf_dir, "fx_instances")
    folder = f"{shared_folder(spark)}/voxlake-{uuid.uuid4().hex}/catalogue"
    tables = {"patients": fixture(spark, sf_dir, "fx_patients"), "studies": found.groupBy("study_uid", "patient_id").agg(F.min("acq_date").alias("study_date")), "series": found.select("series_uid", "study_uid").distinct(), "images": found.select("series_uid", F.concat_ws("/", "dir", "name").alias("path"))}
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}.parquet")
    out = C.catalog_query(*D.read_catalog(spark, folder), date_from="19940601")
    return out.select("series_uid", "patient_id", "patient_name", "study_date", F.size("files").cast("long").alias("n_files"))


@query("SELECT e.file_id, e.path AS path_text, e.tag, e.value, i.study_uid FROM fx_elements e JOIN fx_instances i ON i.file_id = e.file_id")
def k1_write_elements(spark, sf_dir):
    """Element rows written by study, and read again."""
    folder = f"{shared_folder(spark)}/voxlake-{uuid.uuid4().hex}/elements"
    D.write_elements(elements(spark, sf_dir), folder)
    return spark.read.parquet(folder).select("file_id", path_text(F.col("path")).alias("path_text"), "tag", "value", "study_uid")
