"""Header files in every syntax, ranges and pushed filters, late typing, and what de-identification leaves of them."""

import datetime
import struct

import pytest
from pyspark.sql import functions as F

from voxlake.operators import deid, typing
from voxlake.plans.file_forms import element, file_of, fragments
from voxlake.sources import dicom_files, stores
from voxlake.sources.element_parser import BIG, DEFLATED, EXPLICIT, IMPLICIT
from voxlake.sources.stores import open_store, opens

HEAD = [
    ("00080018", "UI", "1.2.3.44"), ("00080020", "DA", "20200102"), ("00081140", "SQ", [[("00081155", "UI", "1.2.3.44")], [("00081155", "UI", "1.2.3.45")]]), ("00100010", "PN", "DOE^JANE"),
    ("00100020", "LO", "PAT001"), ("00100030", "DA", "19700101"), ("00102000", "LO", "alert"), ("00189373", "FD", [1.5, -2.0]), ("00280010", "US", [2]), ("00280106", "SS", [-7]), ("0040A123", "PN", "ROE^RICK"), ("300600C2", "UI", "1.2.3.46"), ("7FE00010", "OW", struct.pack("<4H", 1, 2, 3, 770)),
]
VRS = {t: vr for t, vr, _ in HEAD} | {"00081155": "UI"}


def plain(rows):
    return [(p, i, t, vr, x, raw) for p, i, t, vr, _, x, raw in rows if t != "00020010"]


def test_syntaxes_hold_the_same():
    expected = plain(dicom_files.parse_elements(file_of(HEAD)))
    assert len(expected) == 15 and ((("00081140", 2),), 1, "00081155", "UI", "1.2.3.45", None) in expected
    value = {tag: (text, raw) for _, _, tag, _, text, raw in expected}
    assert value["00189373"] == ("1.5\\-2.0", None) and value["00280106"] == ("-7", None) and value["7FE00010"] == (None, HEAD[-1][2])
    for syntax in (IMPLICIT, BIG, DEFLATED):
        assert plain(dicom_files.parse_elements(file_of(HEAD, syntax), VRS)) == expected


def test_unknown_sequences_of_undefined_length_are_implicit():
    item = struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + element("00081155", "UI", "1.2.9 ", IMPLICIT) + struct.pack("<HHI", 0xFFFE, 0xE00D, 0)
    data = struct.pack("<HH", 0x0040, 0xA730) + b"UN\0\0" + struct.pack("<I", 0xFFFFFFFF) + item + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0) + element("0040A731", "LO", "next")
    rows = dicom_files.parse_elements(b"\0" * 128 + b"DICM" + element("00020010", "UI", EXPLICIT) + data, {"00081155": "UI"})
    assert [(r[0], r[2], r[3], r[5]) for r in rows[1:]] == [((), "0040A730", "SQ", ""), ((("0040A730", 1),), "00081155", "UI", "1.2.9 "), ((), "0040A731", "LO", "next")]


@pytest.mark.parametrize("syntax", [EXPLICIT, IMPLICIT, BIG, DEFLATED])
def test_cut_files_are_errors(syntax):
    content = file_of(HEAD, syntax)
    for n in (len(content) - 1, len(content) - 3, 150):
        with pytest.raises(ValueError, match="cut"):
            dicom_files.parse_elements(content[:n], VRS)


@pytest.fixture()
def folder(tmp_path):
    pixels = ("7FE00010", "OW", bytes(3_000_000))
    (tmp_path / "deep").mkdir()
    for i, syntax in enumerate((EXPLICIT, IMPLICIT, BIG, DEFLATED)):
        (tmp_path / "deep" / f"f{i}.dcm").write_bytes(file_of([*HEAD[:-1], pixels], syntax))
    (tmp_path / "cut.dcm").write_bytes(file_of([*HEAD[:-1], pixels])[:-1])
    (tmp_path / "other.txt").write_bytes(b"no image")
    (tmp_path / "empty").write_bytes(b"")
    return str(tmp_path)


def test_reports_and_ranges(spark, folder):
    whole = {r.path.rpartition("/")[2]: r for r in dicom_files.read_report(spark, folder).collect()}
    assert {n for n, r in whole.items() if r.is_dicom} == {"f0.dcm", "f1.dcm", "f2.dcm", "f3.dcm", "cut.dcm"} and whole["empty"].error is None
    assert {n for n, r in whole.items() if r.error} == {"cut.dcm"} and whole["f2.dcm"].transfer_syntax == BIG
    assert all(whole[f"f{i}.dcm"].bytes_read >= 3_000_000 for i in range(3))
    header = {r.path.rpartition("/")[2]: r for r in dicom_files.read_report(spark, folder, up_to="00280010").collect()}
    assert all(r.bytes_read <= 65_536 and r.error is None for r in header.values())
    some = {r.path.rpartition("/")[2]: r for r in dicom_files.read_report(spark, folder, tags=["00100010"]).collect()}
    assert all(some[f"f{i}.dcm"].bytes_read <= 140_000 for i in range(3))  # pixels are skipped, only their end is looked for
    assert some["cut.dcm"].error == "cut inside a value"
    ids = {r.file_id for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.xxhash64("path").alias("file_id")).collect()}
    assert {r.file_id for r in whole.values() if r.size} == ids  # Spark lists no empty files


def test_pushed_filters(spark, folder):
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key, "false")
    found = {}
    try:
        for on in ("true", "false"):
            spark.conf.set(key, on)
            rows = dicom_files.element_files(spark, folder, vr_of='{"00100010": "PN", "00081155": "UI", "00081140": "SQ"}')
            one = rows.filter("tag = '00100010'")
            under = rows.filter("root_tag in ('00081140', '00080018')").select("file_id", "tag", "vr", "value")
            least = rows.filter("root_tag <= '00080020'").select("file_id", "tag")
            found[on] = [sorted(map(str, x.collect())) for x in (one, under, least)]
            plan = one._jdf.queryExecution().executedPlan().toString()
            assert ("tag#" in plan.partition("Filter (")[2].partition("\n")[0]) == (on == "false")
    finally:
        spark.conf.set(key, before)
    assert found["true"] == found["false"] and all(found["true"])


def test_fragments(spark, tmp_path):
    parts = [b"ab", b"cdef", b"gh"]
    head = [("00280008", "IS", "2 ")]
    (tmp_path / "a.dcm").write_bytes(file_of(head, "1.2.840.10008.1.2.4.100", fragments(parts, [0, 22])))
    (tmp_path / "b.dcm").write_bytes(file_of(head, "1.2.840.10008.1.2.4.102", fragments(parts)))
    (tmp_path / "c.dcm").write_bytes(file_of([], "1.2.840.10008.1.2.4.102", fragments([])))
    rows = dicom_files.read_elements(spark, str(tmp_path))
    frames = sorted((r.frame_no, bytes(r.payload)) for r in dicom_files.encapsulated_frames(rows).collect())
    assert frames == [(1, b"abcdef"), (1, b"abcdefgh"), (2, b"gh")]
    syntaxes = rows.filter("tag = '00020010'").select("file_id", F.trim(F.translate("value", "\x00", "")).alias("transfer_syntax"))
    assert sorted((r.name[-4:], bytes(r.payload)) for r in dicom_files.extract_encapsulated(rows, syntaxes).collect()) == [(".mp4", b"abcdefgh"), (".mpg", b"abcdefgh")]


def test_late_typing_equals_early_typing(spark, tmp_path):
    (tmp_path / "i.dcm").write_bytes(file_of(HEAD, IMPLICIT))
    (tmp_path / "e.dcm").write_bytes(file_of(HEAD))
    path = f"{tmp_path}/i.dcm"
    known = typing.dictionary_of(typing.learned_dictionary(dicom_files.read_elements(spark, f"{tmp_path}/e.dcm")))
    assert known["00081140"] == "SQ" and known["00189373"] == "FD"
    order = lambda df: sorted(map(str, df.collect()))
    assert order(typing.typed(dicom_files.read_elements(spark, path), known)) == order(dicom_files.read_elements(spark, path, vr_of=known))


IDENTIFIERS = [b"1.2.3.4", b"DOE", b"JANE", b"ROE", b"RICK", b"PAT001", b"20200102", b"19700101", b"alert"]


@pytest.mark.parametrize("syntax", [EXPLICIT, IMPLICIT, BIG, DEFLATED])
def test_no_byte_of_an_identifier_survives(spark, tmp_path, syntax):
    (tmp_path / "f.dcm").write_bytes(file_of(HEAD, syntax))
    for known in (None, VRS):
        out = deid.deidentify(dicom_files.read_elements(spark, str(tmp_path)), vr_of=known).collect()
        left = b"|".join((r.value or "").encode() + b"|" + bytes(r.value_bin or b"") for r in out)
        assert not [x for x in IDENTIFIERS if x in left]
        top = {r.tag: r for r in out if not r.path}
        assert top["00120062"].value == "YES" and top["00080018"].value.startswith("2.25.") and top["0040A123"].value.endswith("^^")
        assert top["00100030"].value == "" and top["00100030"].value_bin is None
        codes = {r.value for r in out if r.tag == "00080100"}
        assert "113107" in codes and "113106" not in codes
        if known or syntax != IMPLICIT:
            assert top["00280010"].value == "2" and top["7FE00010"].value_bin is not None


def test_dates_move_unless_they_are_kept(spark):
    path = "array<struct<tag:string,item:int>>"
    rows = spark.createDataFrame([(1, [], "00080020", "DA", "20200331"), (1, [], "00080030", "TM", "120000")], f"file_id long, path {path}, tag string, vr string, value string")
    value = lambda df: {r.tag: r.value for r in df.collect()}
    years, months, days, seconds = deid.default_offset("x")
    assert 1 <= years <= 2 and 1 <= months <= 3 and 1 <= days <= 4 and 1 <= seconds < 2000
    moved = value(deid.deidentify(rows, salt="x"))
    assert moved == value(deid.deidentify(rows, options={"offset": (years, months, days, seconds)}, salt="x"))
    assert datetime.date(2017, 12, 1) < datetime.datetime.strptime(moved["00080020"], "%Y%m%d").date() < datetime.date(2019, 2, 28) and moved["00080030"] != "120000"
    assert value(deid.deidentify(rows, options={"keep_dates": True}))["00080020"] == "20200331"
    with pytest.raises(ValueError, match="not both"):
        deid.deidentify(rows, options={"keep_dates": True, "offset": (1, 0, 0, 0)})


def test_single_steps_leave_no_bytes(spark):
    path = "array<struct<tag:string,item:int>>"
    rows = spark.createDataFrame([(1, [], "00080018", "UN", None, bytearray(b"9.1 ")), (1, [], "00100010", "UN", None, bytearray(b"A^B ")), (1, [], "00100020", None, None, bytearray(b"P1"))], f"file_id long, path {path}, tag string, vr string, value string, value_bin binary")
    left = lambda df: [(r.tag, r.value) for r in df.filter("value_bin is not null").collect()]
    maps = deid.build_uid_map(rows), deid.build_name_map(rows), deid.build_id_map(rows)
    assert [m.count() for m in maps] == [1, 1, 1]
    mapped = deid.apply_maps(rows, *maps)
    assert left(mapped) == [] and sorted(map(str, mapped.collect())) == sorted(map(str, deid.pseudonymised(rows, rows).collect()))
    assert {r.tag: r.value for r in deid.single_identity(rows, "X Y", "7").collect()}["00100010"] == "X^Y"
    assert left(deid.single_identity(rows, "X Y", "7").filter("tag <> '00080018'")) == [] and left(deid.empty_tags(rows, ["00080018", "00100010", "00100020"])) == []
    assert deid.single_patient_guard(rows).first().n_patients == 1


def test_stores(monkeypatch):
    assert open_store("file:///a/b")[1] == open_store("/a/b")[1] == open_store("file:/a/b")[1] == "/a/b" and open_store("dbfs:/x/y")[1] == "/dbfs/x/y"
    assert not opens("viewfs://store/x")
    asked = []
    monkeypatch.setattr(stores.fs, "FileSystem", type("Stub", (), {"from_uri": staticmethod(lambda uri: asked.append(uri))}))
    open_store("s3a://bucket/key"), open_store("hdfs://host/x")
    assert asked == ["s3://bucket/key", "hdfs://host/x"]
