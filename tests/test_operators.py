"""Small tables for rules that the derived tables don't reach."""

import math
import random
import re
import struct
from pathlib import Path

from pyspark.sql import functions as F

from voxlake.operators import catalog, deid, geometry, pixels
from voxlake.sources import dicom_files
from voxlake.sources.fixtures import instances
from voxlake.sources.shared import shared_folder

PATH = "array<struct<tag:string,item:int>>"


def test_date_shift_shapes(spark):
    cases = [
        ("DA", "20240331", "20230131"), ("DA", "20240229\\20240101", "20221228\\20221101"), ("DA", "2024", ""), ("TM", "12", "12"), ("TM", "1200", "1143"), ("TM", "120000", "114320"),
        ("TM", "120000.123", "114320.000000"), ("TM", "1", ""), ("DT", "2024", "2023"), ("DT", "202403", "202301"), ("DT", "20240331", "20230131"), ("DT", "2024033112", "2023013111"),
        ("DT", "20240331120000.5+0100", "20230131114320.000000"), ("DT", "20240331-0100", "20230131"), ("LO", "20240331", "20240331"), ("DA", "", ""),
    ]
    rows = spark.createDataFrame([(i, [], "00080020", vr, v) for i, (vr, v, _) in enumerate(cases)] + [(99, [], "00080106", "DA", "20240331"), (98, [], "00080032", "TM", "003000"), (98, [], "00080033", "TM", "120000")], f"file_id long, path {PATH}, tag string, vr string, value string")
    moved = {(r.file_id, r.tag): r.value for r in deid.shift_dates(rows, 1, 2, 0, 1000).collect()}
    expected = [moved[i, "00080020"] for i in range(len(cases))]
    assert expected == [c[2] for c in cases]
    assert moved[99, "00080106"] == "20240331"
    assert moved[98, "00080033"] == "120000.000000"  # an hour below one: times stay


def test_removed_sequences_take_their_items(spark):
    step = lambda tag: {"tag": tag, "item": 1}
    rows = spark.createDataFrame([(1, [], "00400555", "SQ", ""), (1, [step("00400555")], "00080100", "SH", "x"), (1, [step("00081140"), step("00400555")], "00080100", "SH", "y"), (1, [step("00081140")], "00081155", "UI", "1.2")], f"file_id long, path {PATH}, tag string, vr string, value string")
    assert {r.value for r in deid.remove_tags(rows, ["00400555"]).collect()} == {"1.2"}
    assert sorted(r.value for r in deid.zero_sequences(rows, ["00400555"]).collect()) == ["", "1.2"]


def test_twice_tagged_files_are_refused(spark):
    rows = spark.createDataFrame([(1, [], "00100010", "PN", "a"), (1, [], "00100010", "PN", "b"), (2, [], "00100010", "PN", "a")], f"file_id long, path {PATH}, tag string, vr string, value string")
    assert {r.file_id for r in deid.deidentify(rows).collect()} == {2}


def test_deidentified_files_keep_no_listed_identifier(spark):
    uids = ["00200200", "00083010", "00880140", "0040A124", "300600C2", "00041511", "04000100"]
    cases = [(tag, "UI") for tag in uids] + [(tag, "LO") for tag in ("00120040", "0040A027", "00340002")]
    rows = [(1, [], tag, vr, f"1.2.{i}") for i, (tag, vr) in enumerate(cases)] + [(1, [], "00080016", "UI", "1.2.840"), (1, [{"tag": "00081140", "item": 1}], "00081150", "UI", "1.2.840"), (1, [], "00102000", "LO", "alert")]
    frame = spark.createDataFrame(rows, f"file_id long, path {PATH}, tag string, vr string, value string")
    source = {tag: value for _, _, tag, _, value in rows}
    out = {r.tag: r.value for r in deid.deidentify(frame).collect()}
    kept = [tag for tag, _ in cases if out.get(tag) == source[tag]]
    assert not kept and out["00200200"].startswith("2.25.")
    assert out["00080016"] == out["00081150"] == "1.2.840" and "00102000" not in out
    assert {r.value for r in deid.deidentify(frame.filter("tag = '00080016'"), uid_tags=["00080016"]).filter("tag = '00080016'").collect()} != {"1.2.840"}


def test_pseudonyms_without_maps(spark, monkeypatch):
    item = [{"tag": "00081140", "item": 1}]
    rows = [(1, [], "00080018", "UI", "9.1"), (1, [], "00080016", "UI", "1.2.840.10008.5.1"), (1, item, "00081150", "UI", "1.2.840.10008.5.1"), (1, item, "00091010", "UI", "9.1"), (2, [], "00091010", "UI", "9.2 "), (2, [], "0020000D", "UI", " 9.2"), (2, [], "00091011", "UI", "9.3"), (2, [], "00100010", "PN", "A^B"), (2, [], "00100020", "LO", "P1"), (2, [], "0040A124", "UI", ""), (3, [], "00100010", None, "A^B"), (3, [], "00080016", "UI", None)]
    frame = spark.createDataFrame(rows, f"file_id long, path {PATH}, tag string, vr string, value string")
    plain = lambda df: sorted(map(str, df.collect()))
    for keep in (False, True):
        mapped = deid.apply_maps(frame, deid.build_uid_map(frame, salt="s"), deid.build_name_map(frame, "s"), deid.build_id_map(frame, salt="s"), preserve_uids=keep)
        assert plain(deid.pseudonymised(frame, frame, "s", preserve_uids=keep)) == plain(mapped)
    monkeypatch.setattr(deid, "BROADCAST_ROWS", 0)
    assert plain(deid.pseudonymised(frame, frame, "s")) == plain(deid.apply_maps(frame, deid.build_uid_map(frame, salt="s"), deid.build_name_map(frame, "s"), deid.build_id_map(frame, salt="s")))
    names = ["Smith", "Jones"]
    assert {r.value.split("^")[0] for r in deid.pseudonymised(frame, frame, "s", surnames=names).filter("vr = 'PN'").collect()} <= set(names)
    one = {r.tag: r.value for r in deid.deidentify(frame.filter("file_id = 2"), options={"name": "Doe X", "id": "7"}).collect()}
    assert (one["00100010"], one["00100020"]) == ("Doe^X", "7")


def test_references_resolve_alike_in_any_partitioning(spark):
    refs = [("u1", "/a", i) for i in range(40)] + [("u2", "/a/b", 99), ("u3", "/a", 100), (None, "/a", 101), ("u1", "/z", 102)]
    files = [("u1", "/a/b", "x", 1), ("u1", "/a", "z", 2), ("u1", "/a", "y", 3), ("u2", "/a", "x", 4), ("u3", "/a/c", "b", 5), ("u3", "/a/b", "c", 6), ("u3", "/ab", "a", 7)]
    asked = spark.createDataFrame(refs, "ref_uid string, dir string, ref_no int")
    have = spark.createDataFrame(files, "sop_uid string, dir string, name string, file_id long")
    for parts in (1, 3, 7):
        found = catalog.resolve_uids(asked.repartition(parts), have.repartition(parts))
        assert {r.ref_no: r.found_file for r in found.collect()} == {**dict.fromkeys(range(40), 3), 99: None, 100: 6, 101: None, 102: None}


def series(spark, rows):
    return spark.createDataFrame([("/d", "s", i, *r) for i, r in enumerate(rows)], "dir string, series_uid string, file_order int, ipp array<double>, iop array<double>, instance_number int").withColumns({"rows": F.lit(4), "cols": F.lit(4), "spacing": F.array(F.lit(1.0), F.lit(1.0)), "file_id": F.col("file_order").cast("long")})


AXIAL = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]


def test_slice_geometry(spark):
    def shape(zs, iop=AXIAL):
        return geometry.slice_geometry(geometry.sort_slices(series(spark, [([0.0, 0.0, float(z)], iop, i) for i, z in enumerate(zs)]))).first()

    uniform = shape([4, 0, 2])
    assert (uniform.is_uniform, uniform.z_spacing) == (True, 2.0)
    assert not shape([0, 2, 6]).is_uniform
    assert shape([0, 7]).is_uniform and shape([5]).is_uniform and shape([5]).z_spacing == 1.0
    assert not shape([3, 3]).is_uniform


def test_multiseries_split(spark):
    at = lambda z: ([0.0, 0.0, float(z)], AXIAL)
    volumes = lambda zs: [r.volume_no for r in geometry.multiseries_split(series(spark, [(*at(z), i) for i, z in enumerate(zs)])).orderBy("file_order").collect()]
    assert volumes([1, 1, 2, 2, 3, 3]) == [0, 1, 0, 1, 0, 1]
    assert volumes([1, 2, 3, 1, 2, 3]) == [0, 0, 0, 1, 1, 1]
    assert volumes([1, 2, 3, 1, 2]) == [0] * 5
    assert volumes([1, 2, 3]) == [0] * 3


def test_windows_and_tables(spark):
    rows = spark.createDataFrame([(v, c, w, f) for v, c, w, f in [(0.0, 50.0, 100.0, "LINEAR"), (100.0, 50.0, 100.0, "LINEAR"), (49.5, 50.0, 100.0, "LINEAR"), (5.0, 5.0, 1.0, "LINEAR"), (50.0, 50.0, 100.0, "SIGMOID"), (50.0, 50.0, 100.0, "LINEAR_EXACT")]], "v double, c double, w double, f string")
    assert [r[0] for r in rows.select(pixels.window_value(F.col("v"), F.col("c"), F.col("w"), F.col("f"))).collect()] == [0, 255, 127, 127, 127, 127]
    frame = spark.createDataFrame([([-3.7, 0.0, 2.9, 99.0],)], "pixels array<double>")
    table = F.array(*[F.lit(x) for x in (10, 20, 30)])
    assert pixels.apply_lut(frame, F.lit(5), F.lit(16), table).first().pixels == [10, 10, 30, 30]
    assert pixels.apply_lut(frame, F.lit(-1), F.lit(16), table).first().pixels == [10, 20, 30, 30]
    assert pixels.apply_lut(frame, F.lit(0), F.lit(32), table).first().pixels is None


def element(tag, vr, data):
    group, number = int(tag[:4], 16), int(tag[4:], 16)
    data += b" " * (len(data) % 2)
    head = struct.pack("<HH", group, number) + vr
    return head + (b"\0\0" + struct.pack("<I", len(data)) if vr in dicom_files.LONG else struct.pack("<H", len(data))) + data


def implicit(tag, data):
    return struct.pack("<HHI", int(tag[:4], 16), int(tag[4:], 16), len(data)) + data


def test_files_to_elements(spark, tmp_path):
    item = element("00081155", b"UI", b"1.2.3")
    sequence = struct.pack("<HH", 0x0008, 0x1140) + b"SQ\0\0" + struct.pack("<I", 0xFFFFFFFF) + struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + item + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    body = element("00080018", b"UI", b"9.9") + sequence + element("00100010", b"PN", b"Doe^J") + element("00100010", b"PN", b"Doe^K") + element("00280010", b"US", struct.pack("<H", 512))
    preamble = b"\0" * 128 + b"DICM"
    (tmp_path / "explicit.dcm").write_bytes(preamble + element("00020010", b"UI", dicom_files.EXPLICIT.encode()) + body)
    (tmp_path / "implicit.dcm").write_bytes(preamble + element("00020010", b"UI", dicom_files.IMPLICIT.encode()) + implicit("00100020", b"P1"))
    (tmp_path / "bare.dcm").write_bytes(body)
    (tmp_path / "cut.dcm").write_bytes((preamble + body)[:-1])
    (tmp_path / "other.txt").write_bytes(b"no image")
    rows = dicom_files.read_elements(spark, str(tmp_path), vr_of={"00100020": "LO"}).collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r.file_id, []).append((tuple((s.tag, s.item) for s in r.path), r.tag, r.vr, r.value))
    assert len(by_file) == 3  # the cut file and the text are skipped
    whole = max(by_file.values(), key=len)
    assert ((("00081140", 1),), "00081155", "UI", "1.2.3 ") in whole
    assert [v for p, t, _, v in whole if t == "00100010"] == ["Doe^J ", "Doe^K "]
    assert ((), "00280010", "US", "512") in whole
    assert any(((), "00100020", "LO", "P1") in v for v in by_file.values())
    assert {r.tag for r in dicom_files.read_elements(spark, str(tmp_path), tags=["00100010"]).collect()} == {"00100010"}
    assert {r.is_dicom for r in dicom_files.read_files(spark, str(tmp_path)).filter("name = 'other.txt'").collect()} == {False}


def test_raw_frames(spark):
    data = struct.pack("<8H", *range(8))
    rows = spark.createDataFrame([(1, data, 2, 2, 1, 16, 0, 2), (2, data[:4], 2, 2, 1, 16, 0, 1), (3, None, 2, 2, 1, 16, 0, 1)], "file_id long, value_bin binary, rows int, cols int, samples int, bits_allocated int, pixel_repr int, number_of_frames int")
    found = {(r.file_id, r.frame_no): (r.pixels, r.reason) for r in dicom_files.raw_frames(rows).collect()}
    assert found == {(1, 1): ([0, 1, 2, 3], None), (1, 2): ([4, 5, 6, 7], None), (2, 0): (None, "too short"), (3, 0): (None, "no uncompressed data")}


def test_slice_intersections_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(4)

    def frame(angle, tilt):
        u, v = (math.cos(angle), math.sin(angle), 0.0), (-math.sin(angle) * math.sin(tilt), math.cos(angle) * math.sin(tilt), math.cos(tilt))
        return u, v, tuple(u[(k + 1) % 3] * v[(k + 2) % 3] - u[(k + 2) % 3] * v[(k + 1) % 3] for k in range(3))

    rows = []
    turns = [(0.0, 0.0), (0.0, 0.0), (math.pi / 2, 0.0), (0.3, 0.2), (math.pi, 0.0), (0.0, 5e-8), (0.0, 1e-5)]
    for s, (angle, tilt) in enumerate(turns):
        u, v, n = frame(angle, tilt)
        for k in range(14):
            shift = 7.0 * k - 40 + rng.random()
            rows.append((len(rows), "st" if s % 5 else "st2", "fr" if k else "", f"s{s}", [shift * n[i] - 30 * (u[i] + v[i]) + (5.0 if i == 0 else 0.0) for i in range(3)], [*u, *v], [2.0, 1.5], 32, 40))
    kinds = "file_id long, study_uid string, frame_of_ref_uid string, series_uid string, ipp array<double>, iop array<double>, spacing array<double>, rows int, cols int"
    slices = spark.createDataFrame(rows, kinds)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    cross = lambda a, b: [a[(k + 1) % 3] * b[(k + 2) % 3] - a[(k + 2) % 3] * b[(k + 1) % 3] for k in range(3)]
    shape = {r.file_id: [list(c) for c in r.corners] for r in geometry.corners(slices).collect()}
    expected = set()
    for a in rows:
        na = cross(a[5][:3], a[5][3:])
        for b in rows:
            if a[1:3] != b[1:3] or not a[2] or a[3] == b[3]:
                continue
            tilt = cross(na, cross(b[5][:3], b[5][3:]))
            heights = [dot(na, [c[i] - a[4][i] for i in range(3)]) for c in shape[b[0]]]
            hits = sum(p * q < 0 or (p == 0 and q != 0) for p, q in zip(heights, heights[1:] + heights[:1], strict=True))
            if dot(tilt, tilt) > 1e-12 and hits == 2:
                expected.add((a[0], b[0]))
    for crowd in (4096, 5):
        monkeypatch.setattr(geometry, "CROWD", crowd)
        assert sorted((r.a, r.b) for r in geometry.slice_intersections(slices).collect()) == sorted(expected)


def test_few_slices_are_compared_in_vain(spark):
    axial = [(i, "st", "fr", f"s{i % 3}", [0.0, 0.0, 2.0 * i], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]) for i in range(600)]
    coronal = [(1000 + i, "st", "fr", "c", [0.0, 1.0 * i, 300.0], [1.0, 0.0, 0.0, 0.0, 0.0, -1.0]) for i in range(60)]
    kinds = "file_id long, study_uid string, frame_of_ref_uid string, series_uid string, ipp array<double>, iop array<double>"
    slices = spark.createDataFrame(axial + coronal, kinds).withColumns({"spacing": F.array(F.lit(1.0), F.lit(1.0)), "rows": F.lit(64), "cols": F.lit(64)})
    seen = {}
    before = geometry._candidates
    try:
        geometry._candidates = lambda rows, keys: seen.setdefault("pairs", before(rows, keys))
        found = geometry.slice_intersections(slices).count()
    finally:
        geometry._candidates = before
    assert found and seen["pairs"].count() <= 2 * found < 2 * 660 * 60


def test_numbers_are_as_wide_as_they_are(spark):
    files = spark.range(10_001).select(F.col("id").alias("file_id"), F.lit("/a").alias("dir"), F.lpad(F.col("id").cast("string"), 6, "0").alias("name"))
    found = {r.file_id: r.out_name for r in deid.number_outputs(files).collect()}
    assert (found[0], found[9998], found[9999], found[10_000]) == ("0001.dcm", "9999.dcm", "00010000.dcm", "00010001.dcm")
    assert len(set(found.values())) == len(found)


def test_slice_intersections_are_compiled(spark):
    """The JVM interprets methods of more than 8,000 bytes, some hundred times slower than it runs compiled ones."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan with its code is there before it runs
    try:
        plan = geometry.slice_intersections(instances(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan()
        code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000


def test_directory_records_take_little_disk(spark):
    """What the walk writes between its steps is compressed, and each record is written a few times only."""
    n = 20_000
    images = spark.range(n).selectExpr("1L as file_id", "id + 10 as off", "if(id % 4 = 3, 0L, id + 11) as next_off", "0L as lower_off", "'IMAGE' as type", "concat('IM/', id) as ref_file")
    heads = spark.createDataFrame([(1, 1, 0, 2, "PATIENT", None), (1, 2, 0, 3, "STUDY", None), (1, 3, 0, 10, "SERIES", None)], "file_id long, off long, next_off long, lower_off long, type string, ref_file string")
    size = lambda: sum(p.stat().st_size for p in Path(shared_folder(spark)[7:]).rglob("*") if p.is_file())
    before = size()
    assert [r.files for r in catalog.dicomdir_series(images.unionByName(heads)).collect()] == [["IM/0", "IM/1", "IM/2", "IM/3"]]
    assert size() - before < 35 * n
