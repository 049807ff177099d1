"""Queries over files in every syntax: suppliers and conversations are written as header files and read from there."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators import deid as D
from voxlake.operators import typing as T
from voxlake.operators.documents import path_text
from voxlake.plans.file_forms import file_of, fragments, written
from voxlake.plans.registry import query
from voxlake.sources import dicom_files as R
from voxlake.sources.element_parser import BIG, DEFLATED, EXPLICIT, IMPLICIT

FORMS = [EXPLICIT, IMPLICIT, BIG, DEFLATED]
#: More pixel bytes than the reader takes at a time.
PIXEL_BYTES = 80_000
KNOWN = {"00080018": "UI", "00081140": "SQ", "00081155": "UI", "00100010": "PN", "00100020": "LO", "00280010": "US", "00280100": "US", "00280101": "US", "00189373": "FD", "60000102": "US", "7FE00010": "OW"}


def supplier_elements(key: int, name: str) -> list[tuple]:
    """Header of an image of 200 x 200 pixels, with a reference and numbers of each size."""
    return [
        ("00080018", "UI", f"1.2.9.{key}"), ("00081140", "SQ", [[("00081155", "UI", f"1.2.8.{key}")], [("00081155", "UI", "1.2.8.0")]]),
        ("00100010", "PN", name), ("00100020", "LO", f"S{key}"), ("00189373", "FD", [key / 4, 0.5]), ("00280010", "US", [200]), ("00280100", "US", [16]), ("00280101", "US", [12]),
    ]


def _images(spark: SparkSession, sf_dir: str) -> str:
    """A file for each supplier, in one of four syntaxes by turns; each fifth is cut."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")

    def build(row: dict) -> tuple[str, bytes]:
        key = row["s_suppkey"]
        overlay = [("60000102", "US", [12])] if key % 3 == 0 else []
        pixels = struct.pack("<H", key % 65536) * (PIXEL_BYTES // 2)
        content = file_of([*supplier_elements(key, row["s_name"]), *overlay, ("7FE00010", "OW", pixels)], FORMS[key % 4])
        return f"{key}.dcm", content[:-1] if key % 5 == 0 else content

    return written(rows, build)


def _key() -> Column:
    """The number in a file's name."""
    return F.regexp_extract("path", r"/(\d+)[^/]*$", 1).cast("long").alias("key")


def _by_name(found: DataFrame, report: DataFrame) -> DataFrame:
    """Rows with the number in their file's name as ``key``."""
    return found.join(report.select("file_id", _key()), "file_id")


_S = "s AS (SELECT s_suppkey AS k, s_name AS name FROM supplier)"
_SYNTAX = f"CASE k % 4 WHEN 0 THEN '{EXPLICIT}' WHEN 1 THEN '{IMPLICIT}' WHEN 2 THEN '{BIG}' ELSE '{DEFLATED}' END"
_ROWS = [
    ("", "00020010", "UI", _SYNTAX), ("", "00080018", "UI", "concat('1.2.9.', CAST(k AS VARCHAR))"), ("", "00081140", "SQ", "''"), ("00081140[1]", "00081155", "UI", "concat('1.2.8.', CAST(k AS VARCHAR))"),
    ("00081140[2]", "00081155", "UI", "'1.2.8.0'"), ("", "00100010", "PN", "name"), ("", "00100020", "LO", "concat('S', CAST(k AS VARCHAR))"), ("", "00189373", "FD", r"concat(CAST(k / 4.0 AS VARCHAR), '\0.5')"),
    ("", "00280010", "US", "'200'"), ("", "00280100", "US", "'16'"), ("", "00280101", "US", "'12'"),
]
_HEADER = " UNION ALL ".join(f"SELECT k AS key, '{path}' AS path_text, '{tag}' AS tag, '{vr}' AS vr, {value} AS value FROM s" for path, tag, vr, value in _ROWS)


def _plain(value) -> F.Column:
    return F.trim(F.translate(value, "\x00", ""))


@query(f"WITH {_S}, h AS ({_HEADER} UNION ALL SELECT k, '', '60000102', 'US', '12' FROM s WHERE k % 3 = 0) SELECT * FROM h WHERE key % 5 <> 0 OR key % 4 <> 3")
def s1_syntaxes(spark, sf_dir):
    """Headers of implicit, explicit, big-endian and deflated files alike; what a file lacks after the header doesn't matter, unless it is deflated as a whole."""
    folder = _images(spark, sf_dir)
    rows = R.read_elements(spark, folder, up_to="7000", vr_of=KNOWN)
    return _by_name(rows, R.read_report(spark, folder).filter("error is null or transfer_syntax <> '%s'" % DEFLATED)).select("key", path_text(F.col("path")).alias("path_text"), "tag", "vr", _plain("value").alias("value"))


@query(f"WITH {_S} SELECT k AS key, CAST({PIXEL_BYTES // 2} AS BIGINT) AS n_words, CAST(k % 65536 AS BIGINT) AS word FROM s WHERE k % 5 <> 0")
def s1_pixel_words(spark, sf_dir):
    """Pixel words of all syntaxes in the same byte order; cut files give nothing."""
    folder = _images(spark, sf_dir)
    rows = R.read_elements(spark, folder, tags=["7FE00010"], vr_of=KNOWN)
    word = F.conv(F.hex(F.concat(F.substring("value_bin", -1, 1), F.substring("value_bin", -2, 1))), 16, 10).cast("long")
    return _by_name(rows, R.read_report(spark, folder, up_to="0002")).select("key", (F.octet_length("value_bin") / 2).cast("long").alias("n_words"), word.alias("word"))


@query(f"WITH {_S} SELECT k AS key, {_SYNTAX} AS transfer_syntax, k % 5 = 0 AS is_error, true AS stopped FROM s")
def s1_file_report(spark, sf_dir):
    """Every file with its syntax and whether it is damaged; a header costs less than its file."""
    folder = _images(spark, sf_dir)
    whole, header = R.read_report(spark, folder), R.read_report(spark, folder, tags=["00080018"], up_to="00080018")
    stops = header.select("file_id", F.when(F.col("size") > 65_536, (F.col("bytes_read") <= 65_536) & (F.col("bytes_read") < F.col("size"))).otherwise(True).alias("stopped"))
    return whole.join(stops, "file_id").select(_key(), "transfer_syntax", F.col("error").isNotNull().alias("is_error"), "stopped")


@query(f"WITH {_S} SELECT count(*) AS n_files, count(*) FILTER (WHERE k % 5 = 0) AS n_errors, count(*) FILTER (WHERE k % 3 = 0 AND k % 5 <> 0) AS n_overlay_in_pixels FROM s")
def a11_report_from_files(spark, sf_dir):
    """Errors and overlays in unused pixel bits, from the files themselves."""
    folder = _images(spark, sf_dir)
    return D.deid_report(D.report_facts(R.read_elements(spark, folder, tags=D.REPORT_TAGS, vr_of=KNOWN), R.read_report(spark, folder)))


_TWIN = "t AS (SELECT k, name, form FROM s, (SELECT unnest(['explicit', 'implicit']) AS form))"
_UID = "concat('2.25.', CAST(CAST(('0x' || substr(sha256('s' || {0}), 1, 15)) AS BIGINT) + 1 AS VARCHAR), lpad(CAST(CAST(('0x' || substr(sha256('s' || {0}), 16, 15)) AS BIGINT) AS VARCHAR), 19, '0'))"
_INITIAL = "concat(chr(CAST(65 + CAST(('0x' || substr(md5('s' || {0}), {1}, 8)) AS BIGINT) % 26 AS INTEGER)), '.')"
_NAME = "concat(" + ", '^', ".join(_INITIAL.replace("{1}", str(at)) for at in (1, 9, 17)) + ", '^^')"
_ID = "concat(" + ", ".join(f"substr('{D.ALPHABET}', CAST(CAST(('0x' || substr(sha256('s' || {{0}}), {5 * i + 1}, 5)) AS BIGINT) % 62 + 1 AS INTEGER), 1)" for i in range(11)) + ")"
_CLEAN = [
    ("", "00020010", "UI", f"CASE form WHEN 'explicit' THEN {_UID.format(repr(EXPLICIT))} ELSE {_UID.format(repr(IMPLICIT))} END"), ("", "00080018", "UI", _UID.format("concat('1.2.9.', CAST(k AS VARCHAR))")), ("", "00081140", "SQ", "''"),
    ("00081140[1]", "00081155", "UI", _UID.format("concat('1.2.8.', CAST(k AS VARCHAR))")), ("00081140[2]", "00081155", "UI", _UID.format("'1.2.8.0'")),
    ("", "00080020", "DA", "strftime(DATE '1994-01-01' + CAST(k % 700 AS INTEGER) - INTERVAL 1 YEAR - INTERVAL 1 MONTH - INTERVAL 2 DAY, '%Y%m%d')"), ("", "00100030", "DA", "''"), ("", "00100010", "PN", _NAME.replace("{0}", "name")),
    ("", "0040A123", "PN", _NAME.replace("{0}", "concat(name, '^B')")), ("", "00100020", "LO", _ID.replace("{0}", "concat('S', CAST(k AS VARCHAR))")), ("", "00280010", "US", "'200'"), ("", "00120062", "CS", "'YES'"), ("", "00120063", "LO", "'de-identified'"), ("", "00120064", "SQ", "''"),
]
_CODES = [(f"00120064[{i}]", tag, "SH", f"'{value}'") for i, code in enumerate(("113100", "113104", "113107"), 1) for tag, value in (("00080100", code), ("00080102", "DCM"))]
_TWINS = " UNION ALL ".join(f"SELECT k AS key, form, '{path}' AS path_text, '{tag}' AS tag, '{vr}' AS vr, {value} AS value FROM t" for path, tag, vr, value in [x for x in _CLEAN if x[1] != "00020010"] + _CODES)


@query(f"WITH {_S}, {_TWIN} {_TWINS}")
def d11_implicit_twins(spark, sf_dir):
    """The same headers in explicit and implicit form de-identify alike: representations come from the lists and from the explicit files."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name").withColumn("form", F.explode(F.array(F.lit("explicit"), F.lit("implicit"))))

    def build(row: dict) -> tuple[str, bytes]:
        from datetime import date, timedelta

        key = row["s_suppkey"]
        day = (date(1994, 1, 1) + timedelta(days=key % 700)).strftime("%Y%m%d")
        own = [x for x in supplier_elements(key, row["s_name"]) if x[0] not in ("00280100", "00280101", "00189373")]
        more = [("00080020", "DA", day), ("00091001", "LO", "private"), ("00100030", "DA", "19700101"), ("00102000", "LO", "alert"), ("0040A123", "PN", row["s_name"] + "^B")]
        return f"{key}_{row['form']}.dcm", file_of(sorted([*own, *more]), IMPLICIT if row["form"] == "implicit" else EXPLICIT)

    folder = written(rows, build)
    found = R.read_elements(spark, folder)
    known = T.dictionary_of(T.learned_dictionary(found))
    clean = D.deidentify(found.filter("tag <> '00020010'"), options={"offset": (1, 1, 2, 100)}, salt="s", vr_of=known)
    report = R.read_report(spark, folder, up_to="0002").withColumn("form", F.regexp_extract("path", r"_(\w+)\.dcm$", 1))
    return _by_name(clean, report).join(report.select("file_id", "form"), "file_id").select("key", "form", path_text(F.col("path")).alias("path_text"), "tag", "vr", _plain("value").alias("value"))


def _videos(spark: SparkSession, sf_dir: str) -> str:
    """A stream for each conversation: turns are frames, each of one or two fragments; every third has no offset table."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))

    def build(row: dict) -> tuple[str, bytes]:
        parts, offsets, at = [], [], 0
        for text in row["texts"]:
            data = text.encode()
            data += b" " * (len(data) % 2)
            cut = len(data) // 4 * 2
            offsets.append(at)
            for part in (data[:cut], data[cut:]) if cut and row["conv_id"] % 3 else (data,):
                parts.append(part)
                at += 8 + len(part)
        head = [("00080018", "UI", f"1.2.7.{row['conv_id']}"), ("00280008", "IS", str(len(row["texts"])))]
        return f"{row['conv_id']}.dcm", file_of(head, f"1.2.840.10008.1.2.4.10{row['conv_id'] % 2 * 2}", fragments(parts, offsets if row["conv_id"] % 3 else None))

    return written(rows, build)


_PADDED = "coalesce(text, '') || CASE WHEN octet_length(encode(coalesce(text, ''))) % 2 = 1 THEN ' ' ELSE '' END"


@query(f"SELECT conv_id AS key, CASE WHEN conv_id % 2 = 0 THEN 'mpg' ELSE 'mp4' END AS suffix, md5(string_agg({_PADDED}, '' ORDER BY turn, text)) AS digest FROM conversations GROUP BY conv_id")
def k3_video_files(spark, sf_dir):
    """Streams that were written as fragments come back byte for byte."""
    folder = _videos(spark, sf_dir)
    rows = R.read_elements(spark, folder)
    syntaxes = rows.filter("tag = '00020010'").select("file_id", _plain("value").alias("transfer_syntax"))
    found = R.extract_encapsulated(rows, syntaxes)
    return _by_name(found, R.read_report(spark, folder, up_to="0002")).select("key", F.substring_index("name", ".", -1).alias("suffix"), F.md5("payload").alias("digest"))


@query(f"SELECT conv_id AS key, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS INTEGER) AS frame_no, md5({_PADDED}) AS digest FROM conversations")
def k3_encapsulated_frames(spark, sf_dir):
    """Frames of compressed streams, by the offset table or one a fragment."""
    folder = _videos(spark, sf_dir)
    found = R.encapsulated_frames(R.read_elements(spark, folder))
    return _by_name(found, R.read_report(spark, folder, up_to="0002")).select("key", "frame_no", F.md5("payload").alias("digest"))
