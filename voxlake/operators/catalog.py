"""Cataloguing instances: tag scans, predicates, joins and aggregates over files, series and studies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.functions import sop_classes
from voxlake.functions.scalars import tag_flags, until_nul
from voxlake.sources.shared import written


def scan_tags(elements: DataFrame, tags: list[str]) -> DataFrame:
    """One row per file with a column for each listed tag: its top-level value, cut at the first NUL.

    Private, creator and illegal tags give ''. Of duplicate elements the first by ``elem_idx`` counts. A listed tag
    that a file doesn't have is null. One aggregation, combined before its only shuffle; files without any listed tag stay.
    """
    order = F.col("elem_idx") if "elem_idx" in elements.columns else F.lit(0)
    public = [t for t in tags if int(t[:4], 16) % 2 == 0 and int(t[:4], 16) not in (1, 3, 5, 7)]
    own = lambda t: (F.col("tag") == t) & (F.size("path") == 0)
    per_tag = [F.min_by(F.when(own(t), until_nul(F.col("value"))), F.when(own(t), order)).alias(t) if t in public else F.lit("").alias(t) for t in tags]
    return elements.groupBy("file_id").agg(*per_tag) if per_tag else elements.select("file_id").distinct()


def tag_values(scan: DataFrame, tag: str | None = None) -> DataFrame:
    """Distinct values of a tag's column, or of all tags together."""
    tags = [tag] if tag else [c for c in scan.columns if c not in ("file_id", "file_order", "path")]
    values = scan.select(F.explode(F.array(*[F.col(f"`{t}`") for t in tags])).alias("value"))
    return values.filter("value is not null").distinct()


def ordered_tag_values(scan: DataFrame, tag: str, order: str = "file_order") -> DataFrame:
    """``value`` and ``first_order``: distinct values by the file in which they come first."""
    return scan.filter(F.col(f"`{tag}`").isNotNull()).groupBy(F.col(f"`{tag}`").alias("value")).agg(F.min(order).alias("first_order"))


def files_with_value(scan: DataFrame, tag: str, value: str) -> DataFrame:
    """Files whose trimmed value equals the trimmed ``value``."""
    return scan.filter(F.trim(F.col(f"`{tag}`")) == value.strip())


def first_file_with_value(scan: DataFrame, tag: str, value: str, order: str = "file_order", key: str = "file_id") -> DataFrame:
    """The first file whose value starts with ``value`` less one trailing blank; one row, null without a match."""
    start = value[:-1] if value.endswith(" ") else value
    return scan.filter(F.col(f"`{tag}`").startswith(start)).agg(F.min_by(key, order).alias(key))


def is_image(rows: Column, cols: Column, bits_allocated: Column) -> Column:
    return F.coalesce((rows > 0) & (cols > 0) & bits_allocated.isNotNull(), F.lit(False))


def is_localizer(image_type: Column) -> Column:
    return F.coalesce(F.contains(F.upper(image_type), F.lit("LOCALIZER")), F.lit(False))


def _lookup(kinds: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), key)


def classify_instance(instances: DataFrame) -> DataFrame:
    """Adds ``kind`` from the SOP class, and for images from it and the flags ``has_functional_groups``, ``is_multiframe``, ``is_mosaic``, ``is_grid``.

    Files that are no image and of no known class are ``other``.
    """
    sop = F.trim(F.translate("sop_class", "\x00", ""))
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in instances.columns else F.lit(False)
    image = F.when(flag("has_functional_groups"), "enhanced").when(flag("is_mosaic"), "mosaic").when(flag("is_grid"), "grid").when(flag("is_multiframe"), "multiframe").otherwise("plain")
    image = F.coalesce(_lookup(sop_classes.IMAGE_KINDS, sop), image)
    picture = is_image(F.col("rows"), F.col("cols"), F.col("bits_allocated"))
    return instances.withColumn("kind", F.coalesce(_lookup(sop_classes.KINDS, sop), F.when(picture, image).otherwise("other")))


def series_flags(files: DataFrame, keys: list[str] = ("dir", "series_uid")) -> DataFrame:
    """Per series ``is_image`` and ``is_softcopy``.

    The first file is an image by rows, columns and bits allocated or by four special classes, a softcopy by
    grayscale presentation and report classes. If it is no image, the later files decide: the first that is an image
    (pixel representation too, or a structure set) or a softcopy (two presentation classes). Conditional minima of
    the file order; no row leaves its group.
    """
    sop = F.trim(F.translate("sop_class", "\x00", ""))
    basic = F.col("rows").isNotNull() & F.col("cols").isNotNull() & F.col("bits_allocated").isNotNull()
    first = Window.partitionBy(*keys).orderBy("file_order")
    image_first = basic | sop.isin(sop_classes.SERIES_IMAGES)
    later_image = (basic & F.col("pixel_repr").isNotNull()) | (sop == sop_classes.RTSTRUCT)
    later_soft = ~later_image & sop.isin(list(sop_classes.PRESENTATION)[:2])
    rows = files.select(*keys, "file_order", F.coalesce(image_first, F.lit(False)).alias("i0"), F.coalesce(sop.isin(sop_classes.SERIES_SOFTCOPIES), F.lit(False)).alias("s0"), F.coalesce(later_image, F.lit(False)).alias("i1"), F.coalesce(later_soft, F.lit(False)).alias("s1"))
    rows = rows.withColumn("n", F.row_number().over(first))
    found = rows.groupBy(*keys).agg(F.bool_or((F.col("n") == 1) & F.col("i0")).alias("i0"), F.bool_or((F.col("n") == 1) & F.col("s0")).alias("s0"), F.min(F.when((F.col("n") > 1) & F.col("i1"), F.col("n"))).alias("i"), F.min(F.when((F.col("n") > 1) & F.col("s1"), F.col("n"))).alias("s"))
    image_wins = F.col("i").isNotNull() & (F.col("s").isNull() | (F.col("i") < F.col("s")))
    soft_seen = F.col("s").isNotNull() & (F.col("i").isNull() | (F.col("s") < F.col("i")))
    return found.select(*keys, (F.col("i0") | image_wins).alias("is_image"), (F.col("s0") | (~F.col("i0") & soft_seen)).alias("is_softcopy"))


IMAGE_INFO = {
    "patient_name": "00100010", "patient_id": "00100020", "birth_date": "00100030", "sex": "00100040", "study_uid": "0020000D", "study_date": "00080020", "study_time": "00080030",
    "study_description": "00081030", "study_id": "00200010", "series_uid": "0020000E", "series_date": "00080021", "series_time": "00080031", "series_description": "0008103E",
    "series_number": "00200011", "modality": "00080060", "sop_uid": "00080018", "sop_class": "00080016", "instance_number": "00200013", "acquisition_date": "00080022",
    "acquisition_time": "00080032", "frame_of_ref_uid": "00200052", "body_part": "00180015", "laterality": "00200060", "manufacturer": "00080070", "institution": "00080080",
    "photometric": "00280004", "image_type": "00080008",
}


def image_info(elements: DataFrame) -> DataFrame:
    """One row per file with the identity and display attributes under their names."""
    scan = scan_tags(elements, list(IMAGE_INFO.values()))
    return scan.select("file_id", *[F.col(f"`{tag}`").alias(name) for name, tag in IMAGE_INFO.items()])


def uid_name(rows: DataFrame, column: str, names: DataFrame | None = None) -> DataFrame:
    """Adds ``uid_name``: the name of the class or syntax in ``column``, the UID itself where it has none, '' for null.

    ``names`` has uid and name, one row per UID; by default the names that come with the library.
    """
    names = rows.sparkSession.createDataFrame(list(sop_classes.NAMES.items()), "uid string, name string") if names is None else names
    found = rows.withColumn("_uid", F.trim(F.translate(column, "\x00", ""))).join(names.select(F.col("uid").alias("_uid"), F.col("name").alias("_name")), "_uid", "left")
    return found.withColumn("uid_name", F.coalesce(F.nullif(F.trim("_name"), F.lit("")), F.col("_uid"), F.lit(""))).select(*rows.columns, "uid_name")


def files_in_series(files: DataFrame, asked: DataFrame) -> DataFrame:
    """Files of the series of the asked files, in the same directory; both have ``dir`` and ``series_uid``."""
    key = lambda df: df.withColumn("series_key", F.trim("series_uid"))
    return key(files).join(key(asked).select("dir", "series_key").distinct(), ["dir", "series_key"], "left_semi").drop("series_key")


def resolve_uids(refs: DataFrame, instances: DataFrame) -> DataFrame:
    """References (``ref_uid``, ``dir``) with ``found_file``: the first match by directory and name, the own directory and those below it only.

    Unresolved references keep a null. A reference row stays one row; the answer follows from its UID and directory.
    """
    asked = refs.select("ref_uid", "dir").filter("ref_uid is not null and dir is not null").distinct()
    files = instances.select(F.col("sop_uid").alias("ref_uid"), F.col("dir").alias("found_dir"), F.col("name").alias("found_name"), F.col("file_id").alias("found_file"))
    pairs = asked.join(files, "ref_uid").filter((F.col("found_dir") == F.col("dir")) | F.startswith(F.col("found_dir"), F.concat("dir", F.lit("/"))))
    best = pairs.groupBy("ref_uid", "dir").agg(F.min_by("found_file", F.struct((F.col("found_dir") != F.col("dir")).alias("below"), "found_dir", "found_name", "found_file")).alias("found_file"))
    return refs.join(best, ["ref_uid", "dir"], "left").select(*refs.columns, "found_file")


def catalog_query(patients: DataFrame, studies: DataFrame, series: DataFrame, images: DataFrame, name: str = "", pid: str = "", date_from: str = "", date_to: str = "") -> DataFrame:
    """Series of studies in a date range whose patient's name or id holds the text, with their sorted files.

    Without name and id there is no patient filter. A series without its patient stays then; files are gathered per
    series, paths only.
    """
    dated = studies.filter((F.col("study_date") >= date_from) if date_from else F.lit(True)).filter((F.col("study_date") <= date_to) if date_to else F.lit(True))
    if name or pid:
        hit = F.lit(False)
        for text, column in ((name, "patient_name"), (pid, "patient_id")):
            hit = hit | F.col(column).ilike(f"%{text}%") if text else hit
        dated = dated.join(patients.filter(hit).select("patient_id"), "patient_id", "left_semi")
    chosen = series.join(dated.select("study_uid", "patient_id", "study_date"), "study_uid")
    files = images.groupBy("series_uid").agg(F.array_sort(F.collect_list("path")).alias("files"))
    return chosen.join(patients.select("patient_id", "patient_name"), "patient_id", "left").join(files, "series_uid", "left")


def missing_files(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Listed rows whose ``path`` no file has."""
    return listed.join(files.select("path").distinct(), "path", "left_anti")


#: Record types of a directory file that stand for images and for softcopies.
IMAGE_RECORDS, SOFTCOPY_RECORDS = ("IMAGE", "RT STRUCTURE SET", "SPECTROSCOPY"), ("PRESENTATION", "SR DOCUMENT")


def _chain_heads(rows: DataFrame) -> DataFrame:
    """``file_id``, ``off`` and ``head``, the first record of its chain, of every record; none for chains that are rings.

    A round looks up what each record points at, which is twice as far as in the round before. Records that point at a
    head that is known to be one are done, and of them only those that others point at go into the next round: work
    shrinks to the long chains, and no record is pointed at by many.
    """
    chain = rows.select("file_id", F.col("next_off").alias("off"), F.col("off").alias("up")).filter("off > 0")
    first = written(rows.select("file_id", "off").join(chain.hint("merge"), ["file_id", "off"], "left").select("file_id", "off", F.coalesce("up", "off").alias("head"), F.col("up").isNull().alias("done")))
    found, known, active = [first.filter("done").drop("done")], first.filter("done"), first.filter("not done")
    most = left = active.count()
    reach = 1
    while left and reach <= most:  # a chain that is open beyond has more records than there are
        asked = active.select("file_id", F.col("head").alias("off")).distinct()
        known = written(known.unionByName(active).join(asked.hint("merge"), ["file_id", "off"], "left_semi"))
        jump = known.select("file_id", F.col("off").alias("head"), F.col("head").alias("next"), "done")
        moved = written(active.drop("done").join(jump.hint("merge"), ["file_id", "head"]).select("file_id", "off", F.col("next").alias("head"), "done"))
        found.append(moved.filter("done").drop("done"))
        known, active = known.filter("done").unionByName(moved.filter("done")), moved.filter("not done")
        reach, left = 2 * reach, active.count()
    return reduce(DataFrame.unionByName, found)


def dicomdir_series(records: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Series of a directory file: ``file_id``, ``patient``, ``study``, ``series`` (offsets), ``kinds``, ``files``, ``warning``.

    ``records`` has file_id, off, next_off, lower_off, type and ref_file; ``roots`` the first offset of each file.
    Sibling chains are followed by next offsets, levels by lower offsets: every record gets the head of its chain by
    pointer doubling, then four levels join by (file, chain head). Records whose head is known leave the doubling. Without a root the walk starts at every PATIENT.
    A record of an unexpected type marks its series' file with a warning. Records, and records with their heads, are
    written once each, compressed; their files are too small to tell Spark how many rows they have, so joins say how.
    """
    rows = written(records.select("file_id", "off", "next_off", "lower_off", "type", "ref_file"))
    full = written(rows.drop("next_off").join(_chain_heads(rows).hint("merge"), ["file_id", "off"]))
    level = lambda kind: full.filter(F.col("type") == kind)
    patients = level("PATIENT").select("file_id", F.col("off").alias("patient"), F.col("lower_off").alias("l1"), "head")
    if roots is not None:
        known = roots.filter("root_off > 0").select("file_id", F.col("root_off").alias("head"))
        without = patients.join(known.select("file_id").distinct(), "file_id", "left_anti")
        patients = patients.join(known, ["file_id", "head"], "left_semi").unionByName(without)
    studies = level("STUDY").select("file_id", F.col("head").alias("l1"), F.col("off").alias("study"), F.col("lower_off").alias("l2"))
    series = level("SERIES").select("file_id", F.col("head").alias("l2"), F.col("off").alias("series"), F.col("lower_off").alias("l3"))
    leaves = full.select("file_id", F.col("head").alias("l3"), "type", "ref_file", "off")
    walked = patients.drop("head").join(studies.hint("merge"), ["file_id", "l1"]).join(series.hint("merge"), ["file_id", "l2"]).join(leaves.hint("merge"), ["file_id", "l3"], "left")
    kind = F.when(F.col("type").isin(*IMAGE_RECORDS), "image").when(F.col("type").isin(*SOFTCOPY_RECORDS), "softcopy").when(F.col("type").isNotNull(), "unexpected")
    # with l3, which follows from the series, rows are grouped where the last join has dealt them
    grouped = walked.withColumn("kind", kind).groupBy("file_id", "l3", "patient", "study", "series").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") != "unexpected", F.struct("off", "ref_file")))), lambda x: x["ref_file"]).alias("files"))
    return grouped.drop("l3").withColumn("warning", F.array_contains("kinds", "unexpected"))


def effective_vr(elements: DataFrame, public: DataFrame, private: DataFrame) -> DataFrame:
    """Adds ``vr_used``: LO for creators, UL for group lengths, the explicit VR unless UN or invalid, else the dictionary's.

    ``public`` has tag and dict_vr; ``private`` grp (4 hex digits), element (2), creator and dict_vr. Elements have
    ``creator`` where it is known. Both dictionaries are small tables and join as Spark sees fit.
    """
    valid = F.col("vr").rlike("^(AE|AS|AT|CS|DA|DS|DT|FD|FL|IS|LO|LT|OB|OD|OF|OL|OV|OW|PN|SH|SL|SQ|SS|ST|SV|TM|UC|UI|UL|UR|US|UT|UV)$")
    creator = F.col("creator") if "creator" in elements.columns else F.lit(None).cast("string")
    flags = tag_flags(F.col("tag"))
    rows = elements.withColumn("_flags", flags).withColumn("_grp", F.substring("tag", 1, 4)).withColumn("_el", F.substring("tag", 7, 2)).withColumn("_creator", F.trim(creator))
    own = private.select(F.col("grp").alias("_grp"), F.col("element").alias("_el"), F.trim("creator").alias("_creator"), F.col("dict_vr").alias("_private_vr"))
    rows = rows.join(public.select("tag", F.col("dict_vr").alias("_public_vr")), "tag", "left").join(own, ["_grp", "_el", "_creator"], "left")
    known = F.when(F.col("_flags.is_private"), F.col("_private_vr")).otherwise(F.col("_public_vr"))
    used = F.when(F.col("_flags.is_creator"), "LO").when(F.col("_flags.is_group_length"), "UL").when(valid, F.col("vr")).otherwise(F.coalesce(known, F.lit("UN")))
    return rows.withColumn("vr_used", used).select(*elements.columns, "vr_used")


def series_index(instances: DataFrame) -> DataFrame:
    """One row per directory and series: attributes of the first file by name, the sorted files, their count and the series' flags.

    The same series in two directories gives two rows; files without a series give one row each. ``is_image`` and
    ``is_softcopy`` are there where the instances have what ``series_flags`` reads; files count in the order of names.
    """
    key = F.coalesce("series_uid", F.concat(F.lit("file "), F.col("file_id").cast("string")))
    first = F.struct("name", "file_id")
    attributes = [c for c in ("patient_id", "study_uid", "modality", "acq_date") if c in instances.columns]
    keyed = instances.withColumn("series_key", key)
    found = keyed.groupBy("dir", "series_key").agg(F.first("series_uid").alias("series_uid"), *[F.min_by(c, first).alias(c) for c in attributes], F.min("name").alias("first_name"), F.count("*").alias("n_files"), F.array_sort(F.collect_list("name")).alias("files"))
    if {"rows", "cols", "bits_allocated", "pixel_repr", "sop_class"} <= set(instances.columns):
        found = found.join(series_flags(keyed.withColumn("file_order", first), ["dir", "series_key"]), ["dir", "series_key"])
    return found.drop("series_key")


def mixed_series_split(instances: DataFrame, keys: list[str] = ("dir", "series_uid"), tolerance: float = 1e-4) -> DataFrame:
    """Adds ``is_mixed`` and ``part_key``: where neighbouring images of a series differ, a key of what they differ in, else ''.

    Compared in file order: rows, columns, bits, class, photometric, colour profile, localizer and spacing.
    """
    w = Window.partitionBy(*keys).orderBy("file_order")
    exact = [c for c in ("rows", "cols", "bits_allocated", "sop_class", "photometric", "has_icc", "is_localizer") if c in instances.columns]
    differs = F.lit(False)
    for c in exact:
        differs = differs | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    near = F.lit(False)
    for i in (0, 1):
        near = near | F.coalesce(F.abs(F.col("spacing")[i] - F.lag("spacing").over(w)[i]) > tolerance, F.lit(False))
    changed = (F.row_number().over(w) > 1) & (differs | near)
    marked = instances.withColumn("_changed", changed)
    whole = Window.partitionBy(*keys)
    spacing = [F.format_string("%.4f", F.col("spacing")[i]) for i in (0, 1)]
    part = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in exact], *spacing)
    marked = marked.withColumn("is_mixed", F.max("_changed").over(whole))
    return marked.withColumn("part_key", F.when(F.col("is_mixed"), part).otherwise("")).drop("_changed")


def duplicate_elements(elements: DataFrame) -> DataFrame:
    """``file_id``, ``path``, ``tag`` and ``n`` of tags that come more than once in one data set or item."""
    return elements.groupBy("file_id", "path", "tag").agg(F.count("*").alias("n")).filter("n > 1")


def uid_universe(elements: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Distinct identifier values (UIDs, names and ids by VR, or of the listed tags)."""
    wanted = F.col("tag").isin(tags) if tags else F.col("vr").isin("UI", "PN") | (F.col("tag") == "00100020")
    return elements.filter(wanted).select(F.trim("value").alias("value")).distinct()


def dangling_refs(refs: DataFrame, instances: DataFrame) -> DataFrame:
    """References whose ``ref_uid`` no instance has."""
    return refs.join(instances.select(F.col("sop_uid").alias("ref_uid")).distinct(), "ref_uid", "left_anti")
