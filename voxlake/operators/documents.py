"""Metadata trees, structured reports, presentation states and ultrasound regions as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.functions.scalars import parse_ds, parse_is, tag_flags
from voxlake.operators.catalog import effective_vr, resolve_uids

VALID_VR = "^(AE|AS|AT|CS|DA|DS|DT|FD|FL|IS|LO|LT|OB|OD|OF|OL|OV|OW|PN|SH|SL|SQ|SS|ST|SV|TM|UC|UI|UL|UN|UR|US|UT|UV)$"


def path_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["tag"], F.lit("["), s["item"].cast("string"), F.lit("]"))), "/")


def flatten_elements(elements: DataFrame, public: DataFrame, private: DataFrame) -> DataFrame:
    """Tree rows: ``file_id``, ``path_text``, ``tag``, ``name``, ``vr_used``, ``length``, ``value`` and ``depth``; ``public`` has names too."""
    rows = effective_vr(elements, public, private).join(public.select("tag", F.col("name").alias("_name")), "tag", "left")
    return rows.select("file_id", path_text(F.col("path")).alias("path_text"), "tag", F.coalesce("_name", F.lit("")).alias("name"), "vr_used", F.octet_length("value").alias("length"), "value", F.size("path").alias("depth"))


def vr_audit(elements: DataFrame, public: DataFrame, private: DataFrame) -> DataFrame:
    """Flags of each element: ``bad_vr``, ``unknown_vr``, ``other_vr`` (against the dictionary; dual ones agree), ``is_illegal``, ``is_private``, ``is_duplicate``."""
    rows = effective_vr(elements, public, private).join(public.select("tag", F.col("dict_vr").alias("_d")), "tag", "left").withColumn("_f", tag_flags(F.col("tag")))
    other = F.col("_d").isNotNull() & ~F.array_contains(F.split("_d", "_"), F.col("vr")) & (F.col("vr") != "UN")
    twice = F.count("*").over(Window.partitionBy("file_id", "path", "tag")) > 1
    return rows.select("file_id", "path", "tag", (~F.col("vr").rlike(VALID_VR)).alias("bad_vr"), (F.col("vr") == "UN").alias("unknown_vr"), other.alias("other_vr"), F.col("_f.is_illegal").alias("is_illegal"), F.col("_f.is_private").alias("is_private"), twice.alias("is_duplicate"))


CONTENT = "0040A730"


def _content(elements: DataFrame) -> DataFrame:
    """Elements of report items with ``chapter`` (1.2.3 by item numbers) and ``rest`` (the path below the item)."""
    depth = F.size(F.filter("path", lambda s: s["tag"] == CONTENT))
    head = F.slice("path", 1, depth)
    rows = elements.filter(F.forall(head, lambda s: s["tag"] == CONTENT))
    chapter = F.concat_ws(".", F.lit("1"), F.array_join(F.transform(head, lambda s: s["item"].cast("string")), "."))
    return rows.withColumn("chapter", F.when(depth > 0, chapter).otherwise("1")).withColumn("rest", F.slice("path", depth + 1, F.size("path") - depth + 1))


def _own(tag: str, name: str, *inside: str) -> Column:
    at = F.size("rest") == len(inside)
    for i, sequence in enumerate(inside):
        at = at & (F.get("rest", F.lit(i))["tag"] == sequence)
    return F.max(F.when(at & (F.col("tag") == tag), F.trim("value"))).alias(name)


def sr_content(elements: DataFrame) -> DataFrame:
    """Report tree: ``file_id``, ``chapter``, ``value_type``, ``relationship``, ``concept`` and ``value`` by type."""
    found = _content(elements).groupBy("file_id", "chapter").agg(
        _own("0040A040", "value_type"), _own("0040A010", "relationship"), _own("00080104", "concept", "0040A043"), _own("0040A160", "text"), _own("00080104", "code", "0040A168"),
        _own("0040A121", "date"), _own("0040A122", "time"), _own("0040A120", "stamp"), _own("0040A123", "person"), _own("0040A124", "uid"), _own("0040A30A", "number", "0040A300"),
    ).filter("value_type is not null")
    kinds = {"TEXT": "text", "CODE": "code", "DATE": "date", "TIME": "time", "DATETIME": "stamp", "PNAME": "person", "UIDREF": "uid", "NUM": "number"}
    value = F.coalesce(*[F.when(F.col("value_type") == kind, F.col(column)) for kind, column in kinds.items()], F.lit(""))
    return found.select("file_id", "chapter", "value_type", "relationship", "concept", value.alias("value"))


def sr_measurements(elements: DataFrame) -> DataFrame:
    """NUM items: ``concept``, ``value`` and ``unit``: the meaning, and the code in brackets unless it is 1 or "no units"."""
    rows = _content(elements).groupBy("file_id", "chapter").agg(_own("0040A040", "value_type"), _own("00080104", "concept", "0040A043"), _own("0040A30A", "value", "0040A300"), _own("00080104", "meaning", "0040A300", "004008EA"), _own("00080100", "code", "0040A300", "004008EA"))
    bare = F.col("code").isNull() | (F.col("code") == "1") | (F.lower("meaning") == "no units")
    return rows.filter("value_type = 'NUM'").select("file_id", "chapter", "concept", "value", F.when(bare, F.coalesce("meaning", F.lit(""))).otherwise(F.concat_ws(" ", "meaning", F.concat(F.lit("["), "code", F.lit("]")))).alias("unit"))


def sr_references(elements: DataFrame, instances: DataFrame) -> DataFrame:
    """References of report items: ``chapter``, ``ref_class``, ``ref_uid``, ``frames`` (numbers or null), ``found_file``."""
    rows = _content(elements).filter(F.get("rest", F.lit(0))["tag"] == "00081199")
    pick = lambda tag, name: F.max(F.when(F.col("tag") == tag, F.trim("value"))).alias(name)
    refs = rows.groupBy("file_id", "chapter", F.get("rest", F.lit(0))["item"].alias("item")).agg(pick("00081150", "ref_class"), pick("00081155", "ref_uid"), pick("00081160", "frames"))
    own = instances.select("file_id", "dir").distinct()
    placed = refs.join(own, "file_id", "left").withColumn("dir", F.coalesce("dir", F.lit("")))
    return resolve_uids(placed, instances).select("file_id", "chapter", "ref_class", "ref_uid", parse_is(F.col("frames")).alias("frames"), "found_file")


def sr_evidence(elements: DataFrame, instances: DataFrame) -> DataFrame:
    """Evidence of key objects and reports: ``study_uid``, ``series_uid``, ``ref_class``, ``ref_uid`` and ``found_file`` of each listed instance.

    Read from the sequences of current (0040,A375) and other (0040,A385) evidence: studies hold series, series instances.
    """
    at = lambda i: F.get("path", F.lit(i))
    rows = elements.filter(at(0)["tag"].isin("0040A375", "0040A385")).withColumn("list", at(0)["tag"]).withColumn("study", at(0)["item"]).withColumn("series", at(1)["item"])
    pick = lambda tag, name: F.max(F.when(F.col("tag") == tag, F.trim("value"))).alias(name)
    key = ["file_id", "list", "study"]
    studies = rows.filter((F.size("path") == 1) & (F.col("tag") == "0020000D")).groupBy(*key).agg(pick("0020000D", "study_uid"))
    series = rows.filter((F.size("path") == 2) & (at(1)["tag"] == "00081115") & (F.col("tag") == "0020000E")).groupBy(*key, "series").agg(pick("0020000E", "series_uid"))
    refs = rows.filter((F.size("path") == 3) & (at(1)["tag"] == "00081115") & (at(2)["tag"] == "00081199")).groupBy(*key, "series", at(2)["item"].alias("item")).agg(pick("00081150", "ref_class"), pick("00081155", "ref_uid"))
    placed = refs.join(studies, key, "left").join(series, [*key, "series"], "left").join(instances.select("file_id", "dir").distinct(), "file_id", "left").withColumn("dir", F.coalesce("dir", F.lit("")))
    return resolve_uids(placed, instances).select("file_id", "study_uid", "series_uid", "ref_class", "ref_uid", "found_file")


def sr_coordinates(elements: DataFrame) -> DataFrame:
    """Points of SCOORD (2-D) and SCOORD3D items and numbers of TCOORD: ``chapter``, ``graphic_type``, ``point_no``, ``x``, ``y``, ``z``."""
    rows = _content(elements).groupBy("file_id", "chapter").agg(_own("0040A040", "value_type"), _own("00700023", "graphic_type"), _own("00700022", "data"), _own("0040A130", "range_type"), _own("0040A132", "samples"), _own("0040A138", "offsets"))
    numbers = parse_ds(F.coalesce("data", "samples", "offsets"))
    width = F.when(F.col("value_type") == "SCOORD", 2).when(F.col("value_type") == "SCOORD3D", 3).when(F.col("value_type") == "TCOORD", 1)
    rows = rows.withColumn("_v", numbers).withColumn("_w", width).filter((F.size("_v") > 0) & (F.size("_v") % F.col("_w") == 0))
    points = F.transform(F.sequence(F.lit(0), (F.size("_v") / F.col("_w") - 1).cast("int")), lambda i: F.slice("_v", i * F.col("_w") + 1, F.col("_w")))
    flat = rows.select("file_id", "chapter", F.coalesce("graphic_type", "range_type").alias("graphic_type"), F.posexplode(points).alias("point_no", "p"))
    return flat.select("file_id", "chapter", "graphic_type", "point_no", *[F.get("p", F.lit(i)).alias(c) for i, c in enumerate("xyz")])


def pr_annotations(elements: DataFrame) -> DataFrame:
    """Graphic and text objects of presentation states: ``item``, ``kind``, ``object``, ``layer``, ``graphic_type``, ``text``, ``data``."""
    rows = elements.filter(F.get("path", F.lit(0))["tag"] == "00700001")
    layer = rows.filter((F.size("path") == 1) & (F.col("tag") == "00700002")).select("file_id", F.col("path")[0]["item"].alias("item"), F.trim("value").alias("layer"))
    kinds = F.when(F.get("path", F.lit(1))["tag"] == "00700009", "graphic").when(F.get("path", F.lit(1))["tag"] == "00700008", "text")
    pick = lambda tag, name: F.max(F.when(F.col("tag") == tag, F.trim("value"))).alias(name)
    found = rows.withColumn("kind", kinds).filter((F.size("path") == 2) & F.col("kind").isNotNull()).groupBy("file_id", F.col("path")[0]["item"].alias("item"), "kind", F.col("path")[1]["item"].alias("object")).agg(pick("00700023", "graphic_type"), pick("00700006", "text"), pick("00700022", "data"))
    return found.join(layer, ["file_id", "item"], "left").select("file_id", "item", "kind", "object", "layer", "graphic_type", "text", parse_ds(F.col("data")).alias("data"))


def _items(elements: DataFrame, sequence: str, *columns: Column) -> DataFrame:
    rows = elements.filter((F.size("path") == 1) & (F.col("path")[0]["tag"] == sequence))
    return rows.groupBy("file_id", F.col("path")[0]["item"].alias("item")).agg(*columns)


def _pick(tag: str, name: str) -> Column:
    return F.max(F.when(F.col("tag") == tag, F.trim("value"))).alias(name)


def pr_areas(elements: DataFrame) -> DataFrame:
    """Displayed areas of presentation states: ``item``, ``x0``, ``y0``, ``x1``, ``y1``, ``size_mode``, ``pixel_spacing`` and ``magnification``."""
    found = _items(elements, "0070005A", _pick("00700052", "low"), _pick("00700053", "high"), _pick("00700100", "size_mode"), _pick("00700101", "spacing"), _pick("00700103", "magnification"))
    low, high = parse_is(F.col("low")), parse_is(F.col("high"))
    return found.select("file_id", "item", *[F.get(v, F.lit(i)).alias(f"{c}{k}") for k, v in ((0, low), (1, high)) for i, c in enumerate("xy")], "size_mode", parse_ds(F.col("spacing")).alias("pixel_spacing"), F.get(parse_ds(F.col("magnification")), F.lit(0)).alias("magnification"))


def pr_layers(elements: DataFrame) -> DataFrame:
    """Graphic layers of presentation states: ``item``, ``layer``, ``layer_order`` and ``description``."""
    return _items(elements, "00700060", _pick("00700002", "layer"), _pick("00700062", "layer_order").try_cast("int").alias("layer_order"), _pick("00700068", "description"))


def pr_shutters(elements: DataFrame) -> DataFrame:
    """Display shutters of files that have one: ``shape`` and what belongs to it.

    ``left``, ``right``, ``upper``, ``lower`` only if all four are there; ``center`` (row, column) only as a pair with
    ``radius``; ``vertices`` from two numbers on; ``gray`` and the three numbers of ``lab``, else null.
    """
    tags = {"shape": "00181600", "left": "00181602", "right": "00181604", "upper": "00181606", "lower": "00181608", "center": "00181610", "radius": "00181612", "vertices": "00181620", "gray": "00181622", "lab": "00181624"}
    rows = elements.filter((F.size("path") == 0) & F.col("tag").isin(list(tags.values()))).groupBy("file_id").agg(*[_pick(tag, name) for name, tag in tags.items()]).filter("shape is not null")
    one = {name: F.get(parse_is(F.col(name)), F.lit(0)) for name in ("left", "right", "upper", "lower", "radius", "gray")}
    edges = one["left"].isNotNull() & one["right"].isNotNull() & one["upper"].isNotNull() & one["lower"].isNotNull()
    center, vertices, lab = parse_is(F.col("center")), parse_is(F.col("vertices")), parse_is(F.col("lab"))
    round_ = (F.size(center) == 2) & one["radius"].isNotNull()
    return rows.select("file_id", F.translate("shape", "\x00", "").alias("shape"), *[F.when(edges, one[name]).alias(name) for name in ("left", "right", "upper", "lower")], F.when(round_, center).alias("center"), F.when(round_, one["radius"]).alias("radius"), F.when(F.size(vertices) > 1, vertices).alias("vertices"), one["gray"].alias("gray"), F.when(F.size(lab) == 3, lab).alias("lab"))


def pr_references(elements: DataFrame, instances: DataFrame) -> DataFrame:
    """Images that a presentation state refers to: ``file_id``, ``series_uid``, ``ref_uid``, ``frames``, ``found_file``; unresolved ones are dropped."""
    rows = elements.filter(F.get("path", F.lit(0))["tag"] == "00081115")
    pick = lambda tag, name: F.max(F.when(F.col("tag") == tag, F.trim("value"))).alias(name)
    series = rows.filter(F.size("path") == 1).groupBy("file_id", F.col("path")[0]["item"].alias("s")).agg(pick("0020000E", "series_uid"))
    images = rows.filter((F.size("path") == 2) & (F.get("path", F.lit(1))["tag"] == "00081140")).groupBy("file_id", F.col("path")[0]["item"].alias("s"), F.col("path")[1]["item"].alias("i")).agg(pick("00081155", "ref_uid"), pick("00081160", "frames"))
    own = instances.select("file_id", "dir").distinct()
    placed = images.join(series, ["file_id", "s"]).join(own, "file_id", "left").withColumn("dir", F.coalesce("dir", F.lit("")))
    return resolve_uids(placed, instances).filter("found_file is not null").select("file_id", "series_uid", "ref_uid", parse_is(F.col("frames")).alias("frames"), "found_file")


def pr_voi_by_slice(voi: DataFrame, slices: DataFrame) -> DataFrame:
    """Windows of presentation states on slices by SOP UID and frame (from 1; null holds for all frames)."""
    joined = slices.join(voi.withColumnRenamed("frame_no", "_f"), "sop_uid")
    return joined.filter(F.col("_f").isNull() | (F.col("_f") == F.col("frame_no"))).drop("_f")


#: Codes of ultrasound regions; fixed values of the format.
UNITS = {1: "%", 2: "dB", 3: "cm", 4: "s", 5: "Hz", 6: "dB/s", 7: "cm/s", 8: "cm2", 9: "cm2/s", 10: "cm3", 11: "cm3/s", 12: "degree"}
SPATIAL = {1: "2D", 2: "M-Mode", 3: "Spectral", 4: "Waveform", 5: "Graphics"}
DATA_TYPES = {
    1: "Tissue", 2: "Color Flow", 3: "PW Spectral Doppler", 4: "CW Spectral Doppler", 5: "Doppler Mean Trace", 6: "Doppler Mode Trace", 7: "Doppler Max Trace", 8: "Volume Trace",
    10: "ECG Trace", 11: "Pulse Trace", 12: "Phonocardiogram Trace", 13: "Gray bar", 14: "Color bar", 15: "Integrated Backscatter", 16: "Area Trace", 17: "d(area)/dt", 18: "other",
}


def us_regions(elements: DataFrame) -> DataFrame:
    """Calibrated regions with box, units, deltas, flags and kinds; a region without its four box values is skipped."""
    rows = elements.filter((F.size("path") == 1) & (F.col("path")[0]["tag"] == "00186011"))
    pick = lambda tag, name, kind="int": F.max(F.when(F.col("tag") == tag, F.trim("value"))).try_cast(kind).alias(name)
    found = rows.groupBy("file_id", F.col("path")[0]["item"].alias("region_no")).agg(
        pick("00186018", "x0"), pick("0018601A", "y0"), pick("0018601C", "x1"), pick("0018601E", "y1"), pick("00186016", "flags"), pick("0018602C", "delta_x", "double"),
        pick("0018602E", "delta_y", "double"), pick("00186024", "ux"), pick("00186026", "uy"), pick("00186012", "spatial"), pick("00186014", "data_type"),
    ).dropna(subset=["x0", "y0", "x1", "y1"])
    named = lambda table, column, name: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col(column)), F.lit("")).alias(name)
    return found.select("file_id", "region_no", "x0", "y0", "x1", "y1", F.coalesce("flags", F.lit(0)).alias("flags"), "delta_x", "delta_y", named(UNITS, "ux", "unit_x"), named(UNITS, "uy", "unit_y"), named(SPATIAL, "spatial", "spatial_format"), named(DATA_TYPES, "data_type", "data_type"))


def measure_us(segments: DataFrame, regions: DataFrame) -> DataFrame:
    """Lengths of segments in the region that holds both ends: ``segment_id``, ``region_no``, ``length``, ``unit``, ``dx``, ``dy``.

    Regions need a unit. The only one of high priority (flag bit 0 clear) counts, else the first. Equal units of x
    and y give one length, others the two extents. Segments and regions meet within an image.
    """
    known = regions.filter("unit_x <> '' and unit_y <> ''")
    pairs = segments.join(known, "file_id").filter("ax between x0 and x1 and bx between x0 and x1 and ay between y0 and y1 and by between y0 and y1")
    high = F.col("flags").bitwiseAND(F.lit(1)) == 0
    w = Window.partitionBy("file_id", "segment_id")
    pairs = pairs.withColumn("_only", F.count_if(high).over(w) == 1).withColumn("_r", F.row_number().over(w.orderBy(F.when(F.col("_only") & high, 0).otherwise(1), "region_no"))).filter("_r = 1")
    dx, dy = F.abs((F.col("bx") - F.col("ax")) * F.col("delta_x")), F.abs((F.col("by") - F.col("ay")) * F.col("delta_y"))
    same = F.col("unit_x") == F.col("unit_y")
    return pairs.select("file_id", "segment_id", "region_no", F.when(same, F.sqrt(dx * dx + dy * dy)).alias("length"), F.when(same, F.col("unit_x")).alias("unit"), F.when(~same, dx).alias("dx"), F.when(~same, dy).alias("dy"))
