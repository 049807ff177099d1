"""Structure sets: ROIs, contours, the series that they belong to, and the slices that contours lie on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.functions.scalars import components, distance_to_plane, dot, normal, parse_ds

#: Codes of geometric types; anything else is 0.
TYPES = {"CLOSED_PLANAR": 1, "OPEN_PLANAR": 2, "OPEN_NONPLANAR": 3, "POINT": 4, "CLOSEDPLANAR_XOR": 5}
PLANAR = (1, 2, 5)


def _step(level: int) -> Column:
    return F.get("path", F.lit(level))


def _pick(tag: str, name: str) -> Column:
    return F.max(F.when(F.col("tag") == tag, F.trim("value"))).alias(name)


def _items(elements: DataFrame, sequence: str) -> DataFrame:
    return elements.filter((F.size("path") == 1) & (_step(0)["tag"] == sequence)).groupBy("file_id", _step(0)["item"].alias("item"))


def rt_rois(elements: DataFrame) -> DataFrame:
    """ROI contour items with name and frame of reference by ROI number, and the interpreted type where observed.

    Contour items without a structure-set ROI are left out; ``r``, ``g`` and ``b`` come from the display colour.
    """
    contours = _items(elements, "30060039").agg(_pick("30060084", "roi_id"), _pick("3006002A", "color"))
    sets = _items(elements, "30060020").agg(_pick("30060022", "roi_id"), _pick("30060026", "name"), _pick("30060024", "frame_of_ref_uid"))
    seen = _items(elements, "30060080").agg(_pick("30060084", "roi_id"), _pick("300600A4", "interpreted_type")).groupBy("file_id", "roi_id").agg(F.min_by("interpreted_type", "item").alias("interpreted_type"))
    color = parse_ds(F.col("color"))
    rows = contours.join(sets.drop("item"), ["file_id", "roi_id"]).join(seen, ["file_id", "roi_id"], "left")
    return rows.select("file_id", F.col("roi_id").cast("int").alias("roi_id"), F.col("item").alias("roi_item"), "name", "interpreted_type", "frame_of_ref_uid", *[F.get(color, F.lit(i)).cast("int").alias(c) for i, c in enumerate("rgb")])


def contours(elements: DataFrame) -> DataFrame:
    """``file_id``, ``roi_item``, ``contour_id``, ``type`` (code), ``data`` (text) and ``ref_sop_uids`` of each contour."""
    rows = elements.filter((F.size("path") >= 2) & (_step(0)["tag"] == "30060039") & (_step(1)["tag"] == "30060040"))
    found = rows.groupBy("file_id", _step(0)["item"].alias("roi_item"), _step(1)["item"].alias("contour_id"))
    codes = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    flat = found.agg(_pick("30060042", "kind"), _pick("30060050", "data"), F.array_sort(F.collect_set(F.when((F.col("tag") == "00081155") & (F.size("path") == 3), F.trim("value")))).alias("ref_sop_uids"))
    return flat.select("file_id", "roi_item", "contour_id", F.coalesce(F.element_at(codes, F.upper("kind")), F.lit(0)).alias("type"), "data", "ref_sop_uids")


def contour_points(found: DataFrame) -> DataFrame:
    """Points (from 0) of contours: the coordinate text in threes; a text of other length or with a bad number has none."""
    numbers = parse_ds(F.col("data"))
    whole = found.withColumn("_v", numbers).filter((F.size("_v") > 0) & (F.size("_v") % 3 == 0))
    points = F.transform(F.sequence(F.lit(0), (F.size("_v") / 3 - 1).cast("int")), lambda i: F.slice("_v", i * 3 + 1, 3))
    rows = whole.select("file_id", "roi_item", "contour_id", "type", F.posexplode(points).alias("point_no", "p"))
    return rows.select("file_id", "roi_item", "contour_id", "type", "point_no", *[F.col("p")[i].alias(c) for i, c in enumerate("xyz")])


def rtstruct_series(refs: DataFrame, instances: DataFrame, same_frame: bool = False) -> DataFrame:
    """Distinct series (``file_id`` of the structure set, ``dir``, ``series_uid``) of which any instance is referenced by a contour.

    Only series with a frame of reference count; with ``same_frame`` it must be the structure set's. ``refs`` has
    file_id, ref_uid and, for that, frame_of_ref_uid.
    """
    images = instances.filter(F.coalesce(F.col("frame_of_ref_uid") != "", F.lit(False))).select(F.col("sop_uid").alias("ref_uid"), "dir", "series_uid", F.col("frame_of_ref_uid").alias("_frame"))
    hits = refs.join(images, "ref_uid")
    if same_frame:
        hits = hits.filter(F.col("_frame") == F.col("frame_of_ref_uid"))
    return hits.select("file_id", "dir", "series_uid").distinct()


def map_contours_uniform(points: DataFrame, slices: DataFrame, keys: list[str] = ("roi_id", "contour_id")) -> DataFrame:
    """``keys`` and ``slice_no``: slices to whose plane any point of the contour is nearer than half the slice spacing.

    Points and slices share ``volume_id``; slices have ipp, iop and z_spacing. The join is by equal steps along the
    normal: a slice offers its own step and both neighbours.
    """
    way = lambda p: dot(normal(F.col("iop")), p)
    frame = slices.groupBy("volume_id").agg(F.min_by("iop", "slice_no").alias("iop"), F.min_by("z_spacing", "slice_no").alias("z_spacing"))
    planes = slices.select("volume_id", "slice_no", F.col("ipp").alias("_p0"), (F.floor(way(components(F.col("ipp"))) / F.col("z_spacing"))).alias("_at"))
    planes = planes.withColumn("bucket", F.explode(F.array(F.col("_at") - 1, F.col("_at"), F.col("_at") + 1)))
    located = points.join(frame, "volume_id").withColumn("bucket", F.floor(way([F.col(c) for c in "xyz"]) / F.col("z_spacing")))
    pairs = located.join(planes, ["volume_id", "bucket"])
    near = distance_to_plane([F.col(c) for c in "xyz"], components(F.col("_p0")), normal(F.col("iop"))) < F.col("z_spacing") / 2
    return pairs.filter(near).select("volume_id", *keys, "slice_no").distinct()


def map_contours_nonuniform(points: DataFrame, slices: DataFrame, keys: list[str] = ("roi_id", "contour_id"), most: float = 0.1) -> DataFrame:
    """``keys`` and ``slice_no`` of contours all of whose points are nearer than ``most`` to one slice's plane, and one alone."""
    # each contour first shrinks to its reach along every orientation of the volume; then reaches meet planes by steps of ``most``
    step = 2 * most
    ways = slices.groupBy("volume_id", F.array(*normal(F.col("iop"))).alias("n")).agg(F.count("*").alias("planes")).drop("planes")
    along = lambda p: dot([F.col("n")[i] for i in range(3)], p)
    spans = points.join(ways, "volume_id").groupBy("volume_id", *keys, "n").agg(F.min(along([F.col(c) for c in "xyz"])).alias("low"), F.max(along([F.col(c) for c in "xyz"])).alias("high"))
    planes = slices.select("volume_id", "slice_no", F.array(*normal(F.col("iop"))).alias("n"), "ipp").withColumn("at", along(components(F.col("ipp"))))
    planes = planes.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("at") / step) - 1, F.floor(F.col("at") / step) + 1)))
    thin = spans.filter(F.col("high") - F.col("low") < step).withColumn("bucket", F.floor(F.col("low") / step))
    fits = thin.join(planes.select("volume_id", "n", "bucket", "slice_no", "at"), ["volume_id", "n", "bucket"]).filter((F.abs(F.col("low") - F.col("at")) < most) & (F.abs(F.col("high") - F.col("at")) < most))
    return fits.groupBy("volume_id", *keys).agg(F.count("*").alias("n"), F.min("slice_no").alias("slice_no")).filter("n = 1").drop("n")


def map_contours_by_ref(found: DataFrame, slices: DataFrame) -> DataFrame:
    """Contours with the ``slice_no`` of every slice whose SOP UID they reference; ``slices`` has sop_uid, volume_id, slice_no."""
    refs = found.withColumn("sop_uid", F.explode("ref_sop_uids"))
    return refs.join(slices.select("sop_uid", "volume_id", "slice_no"), "sop_uid").select("file_id", "roi_item", "contour_id", "volume_id", "slice_no").distinct()


def validate_contours(points: DataFrame, mapped: DataFrame, keys: list[str] = ("roi_id", "contour_id")) -> DataFrame:
    """``keys``, ``type`` and ``valid_type``: a planar type is lost (0) if the contour lies on several slices or on none."""
    slices = mapped.groupBy(*keys).agg(F.countDistinct("slice_no").alias("n"))
    kinds = points.groupBy(*keys).agg(F.max("type").alias("type"))
    rows = kinds.join(slices, list(keys), "left")
    lost = F.col("type").isin(*PLANAR) & (F.coalesce("n", F.lit(0)) != 1)
    return rows.select(*keys, "type", F.when(lost, 0).otherwise(F.col("type")).alias("valid_type"))


def roi_center(points: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Mean of all points of all ROIs of an image."""
    return points.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in "xyz"])


def roi_summary(found: DataFrame, keys: list[str] = ("file_id", "roi_item")) -> DataFrame:
    """``keys``, ``n_contours`` and ``types``: the names of the geometric types that are there, in the order of their codes."""
    names = {code: name for name, code in TYPES.items()}
    present = [F.max(F.when(F.col("type") == code, names[code])).alias(f"_{code}") for code in sorted(names)]
    rows = found.groupBy(*keys).agg(F.count("*").alias("n_contours"), *present)
    return rows.select(*keys, "n_contours", F.concat_ws(",", *[f"_{code}" for code in sorted(names)]).alias("types"))


def voxel_across_volumes(frames: DataFrame, x: int, y: int, z: int, group: str = "group_id") -> DataFrame:
    """The same voxel of every volume of a 4-D group: ``group``, ``volume_id``, ``value``; none for a group with a colour volume.

    ``frames`` has place (from 0), cols, pixels, and is_color.
    """
    color = F.max("is_color").over(Window.partitionBy(group))
    rows = frames.withColumn("_c", color).filter(~F.col("_c") & (F.col("place") == z))
    return rows.select(group, "volume_id", F.get("pixels", (F.lit(y) * F.col("cols") + x).cast("int")).alias("value"))
