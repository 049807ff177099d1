"""Multi-frame images: functional groups, dimensions, splits into volumes, times and 4-D groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.functions.scalars import components, dot, normal, parse_ds

PER_FRAME, SHARED = "52009230", "52009229"
#: (group pointer, index pointer) -> name of a dimension; fixed values of the format.
POINTERS = {
    ("00209111", "00209056"): "STACK", ("00209111", "00209057"): "INSTACK", ("00209111", "00209128"): "TPOS", ("00209310", "0020930D"): "TOFF",
    ("00189117", "00189087"): "BVAL", ("00189117", "00189089"): "GRAD", ("00189341", "00189344"): "CONTRAST", ("00409096", "00409210"): "LUT",
    ("0020930E", "00209301"): "PLANE", ("00189807", "00189808"): "DTYPE", ("00189226", "00089007"): "FTYPE", ("00189114", "00189082"): "ECHO",
    ("", "00189807"): "PADTYPE", ("", "00189825"): "PAWAVE", ("00189825", "00189826"): "PAWAVE", ("", "00189821"): "PAWAVE", ("00189821", "00189826"): "PAWAVE", ("", "0018993D"): "RECALG",
}
#: (number of pointers, names for dimensions 6, 5, 4, 3 with '' for none, required positions); the first that fits counts.
CHOICES = [
    (3, ("", "DTYPE", "TOFF", "PLANE"), ""), (3, ("", "DTYPE", "TPOS", "PLANE"), ""), (2, ("", "", "DTYPE", "PLANE"), "PLANE,DTYPE"),
    (4, ("CONTRAST", "TPOS", "STACK", "INSTACK"), ""), (4, ("CONTRAST", "TOFF", "STACK", "INSTACK"), ""), (3, ("", "CONTRAST", "STACK", "INSTACK"), "INSTACK,STACK,CONTRAST"),
    (2, ("", "", "CONTRAST", "INSTACK"), "CONTRAST,INSTACK"), (4, ("FTYPE", "TPOS", "STACK", "INSTACK"), ""), (4, ("FTYPE", "TOFF", "STACK", "INSTACK"), ""),
    (3, ("", "FTYPE", "STACK", "INSTACK"), ""), (4, ("ECHO", "TPOS", "STACK", "INSTACK"), ""), (4, ("ECHO", "TOFF", "STACK", "INSTACK"), ""),
    (3, ("", "ECHO", "STACK", "INSTACK"), ""), (4, ("BVAL", "GRAD", "STACK", "INSTACK"), ""), (3, ("", "BVAL", "GRAD", "INSTACK"), ""),
    (3, ("", "GRAD", "STACK", "INSTACK"), ""), (3, ("", "BVAL", "STACK", "INSTACK"), ""), (4, ("LUT", "TPOS", "STACK", "INSTACK"), "TPOS,STACK,INSTACK,LUT"),
    (3, ("", "LUT", "TPOS", "INSTACK"), "TPOS,INSTACK,LUT"), (3, ("", "PADTYPE", "TPOS", "PLANE"), ""), (4, ("PAWAVE", "PADTYPE", "TPOS", "PLANE"), ""),
    (4, ("RECALG", "PADTYPE", "TPOS", "PLANE"), ""),
]


def _step(level: int) -> Column:
    return F.get("path", F.lit(level))


def dim_index(elements: DataFrame) -> DataFrame:
    """``file_id``, ``position`` (from 0 over the whole list), ``uid``, ``index_pointer`` and ``group_pointer`` of each dimension."""
    rows = elements.filter((F.size("path") == 1) & (_step(0)["tag"] == "00209222"))
    pick = lambda tag, name: F.max(F.when(F.col("tag") == tag, F.trim("value"))).alias(name)
    found = rows.groupBy("file_id", _step(0)["item"].alias("item")).agg(pick("00209164", "uid"), pick("00209165", "index_pointer"), pick("00209167", "group_pointer"))
    return found.select("file_id", (F.row_number().over(Window.partitionBy("file_id").orderBy("item")) - 1).alias("position"), "uid", "index_pointer", "group_pointer")


def dim_values(elements: DataFrame, index: DataFrame) -> DataFrame:
    """``file_id``, ``frame_no`` (from 1) and ``dim_values``; a list of another length than the index is null."""
    rows = elements.filter((F.size("path") == 2) & (_step(0)["tag"] == PER_FRAME) & (_step(1)["tag"] == "00209111") & (F.col("tag") == "00209157"))
    values = rows.select("file_id", _step(0)["item"].alias("frame_no"), F.transform(F.split("value", r"\\"), lambda x: x.try_cast("int")).alias("v"))
    sizes = index.groupBy("file_id").agg(F.count("*").alias("n"))
    return values.join(sizes, "file_id").select("file_id", "frame_no", F.when(F.size("v") == F.col("n"), F.col("v")).alias("dim_values"))


#: Attributes of functional groups: column -> (group sequence, tag).
ATTRIBUTES = {
    "ipp": ("00209113", "00200032"), "iop": ("00209116", "00200037"), "spacing": ("00289110", "00280030"), "window_center": ("00289132", "00281050"),
    "window_width": ("00289132", "00281051"), "lut_function": ("00289132", "00281056"), "rescale_slope": ("00289145", "00281053"), "rescale_intercept": ("00289145", "00281052"),
    "segment_num": ("0062000A", "0062000B"), "frame_time": ("00209111", "00189074"),
}


def frame_groups(elements: DataFrame, group: str = PER_FRAME) -> DataFrame:
    """Functional group attributes as text columns, one row per (file, frame); for the shared group ``frame_no`` is its item."""
    rows = elements.filter((F.size("path") == 2) & (_step(0)["tag"] == group))
    hit = lambda sequence, tag: (_step(1)["tag"] == sequence) & (F.col("tag") == tag)
    return rows.groupBy("file_id", _step(0)["item"].alias("frame_no")).agg(*[F.max(F.when(hit(*where), F.col("value"))).alias(name) for name, where in ATTRIBUTES.items()])


def merge_shared(frames: DataFrame, shared: DataFrame, columns: list[str], defaults: dict[str, float] | None = None) -> DataFrame:
    """Whole-column rule: if any frame of a file lacks an attribute and the shared group has it, all frames take the shared one.

    Columns with a default (slope 1, intercept 0) take it everywhere when a frame lacks them and nothing is shared.
    """
    rows = frames.join(shared.select("file_id", *[F.col(c).alias(f"_s_{c}") for c in columns]), "file_id", "left")
    w = Window.partitionBy("file_id")
    for c in columns:
        lacks = F.max(F.col(c).isNull()).over(w)
        value = F.when(lacks & F.col(f"_s_{c}").isNotNull(), F.col(f"_s_{c}"))
        if defaults and c in defaults:
            value = value.when(lacks, F.lit(defaults[c]))
        rows = rows.withColumn(f"_n_{c}", value.otherwise(F.col(c)))
    return rows.select(*[F.col(f"_n_{c}").alias(c) if c in columns else F.col(c) for c in frames.columns])


def rescale_fallback(frames: DataFrame, top: DataFrame) -> DataFrame:
    """If any frame has neither a rescale nor a real-world map (``has_rwv``), the file's own slope and intercept go to all frames."""
    rows = frames.join(top.select("file_id", F.col("rescale_slope").alias("_a"), F.col("rescale_intercept").alias("_b")), "file_id", "left")
    bare = F.max(F.col("rescale_slope").isNull() & ~F.coalesce(F.col("has_rwv"), F.lit(False))).over(Window.partitionBy("file_id"))
    rows = rows.withColumn("_use", bare & F.col("_a").isNotNull() & F.col("_b").isNotNull())
    new = {"rescale_slope": F.when(F.col("_use"), F.col("_a")).otherwise(F.col("rescale_slope")), "rescale_intercept": F.when(F.col("_use"), F.col("_b")).otherwise(F.col("rescale_intercept"))}
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in frames.columns])


def choose_dims(index: DataFrame, strict: bool = False) -> DataFrame:
    """``file_id``, ``choice`` and ``dims``: the positions (in the full list) that serve as dimensions 3, 4, 5, ... in this order.

    ``choice`` names what they are, or is 'from the last'. Of a file's organisations the first UID counts, with six pointers at most. Known combinations have their own
    order; else the last pointer is dimension 3, the one before it 4, and so on. ``strict`` skips the combinations.
    """
    name = F.element_at(F.create_map(*[x for (g, i), n in POINTERS.items() for x in (F.lit(f"{g} {i}"), F.lit(n))]), F.concat_ws(" ", F.upper(F.coalesce("group_pointer", F.lit(""))), F.upper("index_pointer")))
    first = Window.partitionBy("file_id")
    rows = index.withColumn("_uid", F.min("uid").over(first)).filter(F.col("uid").eqNullSafe(F.col("_uid"))).withColumn("name", F.coalesce(name, F.lit("OTHER")))
    lists = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("p")).filter(F.size("p") <= 6)
    names, places = F.col("p.name"), F.col("p.position")
    at = lambda n: F.element_at(places, F.array_position(names, n).cast("int"))
    fits, dims = [], []
    for n, wanted, order in CHOICES:
        chosen = [x for x in reversed(wanted) if x]
        test = F.size("p") == n
        for x in chosen:
            test = test & F.array_contains(names, x)
        if order:
            test = test & (names == F.array(*map(F.lit, order.split(","))))
        fits.append((",".join(chosen), test))
        dims.append(F.array(*[at(x) for x in chosen]))
    other = F.filter("p", lambda x: ~x["name"].isin("STACK", "INSTACK", "TPOS", "TOFF"))
    has = lambda *xs: F.array_contains(names, xs[0]) if len(xs) == 1 else F.array_contains(names, xs[0]) & has(*xs[1:])
    for n, extra in ((3, ()), (4, ("TPOS",)), (4, ("TOFF",))):
        fits.append((",".join(["INSTACK", "STACK", *extra, "OTHER"]), (F.size("p") == n) & has("STACK", "INSTACK", *extra) & (F.size(other) == 1)))
        dims.append(F.array(at("INSTACK"), at("STACK"), *[at(x) for x in extra], F.get(other, F.lit(0))["position"]))
    choice, value = F.lit("from the last"), F.reverse(places)
    if not strict:
        for (name, test), dim in reversed(list(zip(fits, dims, strict=True))):
            choice, value = F.when(test, F.lit(name)).otherwise(choice), F.when(test, dim).otherwise(value)
    return lists.select("file_id", choice.alias("choice"), value.alias("dims"))


def choose_rwv(items: DataFrame) -> DataFrame:
    """One real-world map per (file, frame): the only one, else by label SUVbw, g/ml or GML, BQML, else the first item.

    ``items`` has file_id, frame_no, item, label, slope, intercept. Labels keep their own item, so an item without a
    label does not shift those after it.
    """
    label = F.lower(F.coalesce("label", F.lit("")))
    rank = F.when(label == "g/ml{suvbw}", 0).when(label.startswith("g/ml") | (label == "gml"), 1).when(label.isin("bq/ml", "bqml"), 2).otherwise(3)
    w = Window.partitionBy("file_id", "frame_no").orderBy(rank, "item")
    return items.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def sort_frames(frames: DataFrame) -> DataFrame:
    """Adds ``place`` (from 1): by distance along the first frame's normal; a file with any missing position keeps its order."""
    w = Window.partitionBy("file_id")
    first = F.first("iop").over(w.orderBy("frame_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = frames.withColumn("_iop", first)
    good = F.min(F.coalesce((F.size("ipp") == 3) & (F.size("iop") == 6), F.lit(False))).over(w)
    rows = rows.withColumn("_d", F.when(good, dot(normal(F.col("_iop")), components(F.col("ipp")))))
    return rows.withColumn("place", F.row_number().over(w.orderBy("_d", "frame_no"))).drop("_iop", "_d")


def volumes_from_dims(frames: DataFrame, chosen: DataFrame, mode: str = "prefer uniform") -> DataFrame:
    """Adds ``volume_no`` and ``place`` (both from 0): a volume per tuple of the dimensions above the third.

    A file with an index 0 or missing, or the same place twice in a volume, falls back to one volume in spatial
    order. Modes: 'prefer uniform' orders each volume in space, 'strict many' by the third dimension, 'strict
    single' puts the volumes behind each other, 'skip' takes one volume in frame order.
    """
    if mode == "skip":
        return frames.withColumn("volume_no", F.lit(0)).withColumn("place", F.row_number().over(Window.partitionBy("file_id").orderBy("frame_no")) - 1)
    rows = frames.join(chosen.select("file_id", "dims"), "file_id", "left")
    values = F.transform("dims", lambda p: F.get("dim_values", p))
    rows = rows.withColumn("_v", F.when(F.size("dims") > 0, values))
    rows = rows.withColumn("_tuple", F.reverse(F.slice("_v", 2, 7))).withColumn("_place", F.col("_v")[0] - 1)
    w = Window.partitionBy("file_id")
    bad = F.col("_v").isNull() | F.exists("_v", lambda x: x.isNull() | (x <= 0))
    twice = F.count("*").over(Window.partitionBy("file_id", "_tuple", "_place")) > 1
    rows = rows.withColumn("_fallback", F.max(F.coalesce(bad | twice, F.lit(True))).over(w))
    rows = rows.withColumn("volume_no", F.when(F.col("_fallback"), 0).otherwise(F.dense_rank().over(w.orderBy("_tuple")) - 1))
    spatial = Window.partitionBy("file_id", "volume_no")
    head = F.first("iop").over(spatial.orderBy("frame_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    good = F.min(F.coalesce((F.size("ipp") == 3) & (F.size("iop") == 6), F.lit(False))).over(spatial)
    rows = rows.withColumn("_iop", head).withColumn("_d", F.when(good, dot(normal(F.col("_iop")), components(F.col("ipp")))))
    by_space = F.row_number().over(spatial.orderBy("_d", "_place", "frame_no")) - 1
    by_index = F.row_number().over(spatial.orderBy("_place", "frame_no")) - 1
    rows = rows.withColumn("place", F.when(F.col("_fallback") | F.lit(mode == "prefer uniform"), by_space).otherwise(by_index))
    if mode == "strict single":
        rows = rows.withColumn("place", F.row_number().over(w.orderBy("volume_no", "place")) - 1).withColumn("volume_no", F.lit(0))
    return rows.select(*frames.columns, "volume_no", "place")


def frame_times(instances: DataFrame) -> DataFrame:
    """``file_id``, ``frame_no`` (from 1), ``step_ms`` and ``offset_ms``: constant, from a vector, or 100 ms by the increment pointer."""
    vector = parse_ds(F.col("frame_time_vector"))
    constant = F.array_repeat(F.coalesce(F.col("frame_time").cast("double"), F.lit(100.0)), F.col("number_of_frames").cast("int"))
    steps = F.when(F.upper("increment_pointer") == "00181065", F.slice(vector, 1, F.greatest(F.col("number_of_frames").cast("int"), F.lit(0)))).otherwise(constant)
    rows = instances.select("file_id", F.posexplode(steps).alias("at", "step_ms"))
    w = Window.partitionBy("file_id").orderBy("at")
    return rows.select("file_id", (F.col("at") + 1).alias("frame_no"), "step_ms", (F.sum("step_ms").over(w) - F.first("step_ms").over(w)).alias("offset_ms"))


def group_4d(volumes: DataFrame) -> DataFrame:
    """Candidate 4-D groups: dimensions and pixel type with two volumes or more that have no group yet."""
    free = volumes.filter("group_id is null") if "group_id" in volumes.columns else volumes
    return free.groupBy("dim_x", "dim_y", "dim_z", "pixel_type").agg(F.count("*").alias("n"), F.min("volume_id").alias("first_volume")).filter("n >= 2")


def order_4d(volumes: DataFrame, group: str = "group_id") -> DataFrame:
    """Adds ``place`` (from 1), ``raw_step_ms`` and ``step_ms`` to the volumes of 4-D groups.

    Order: by date and time if all are there and differ, else by instance number if all differ and are positive,
    else by id. The raw step is the difference of the digits put together, times 1000; the other one that of the
    timestamps. The last step is 1000.
    """
    w = Window.partitionBy(group)
    stamp = F.concat("acq_date", F.rpad(F.substring_index("acq_time", ".", 1), 6, "0"))
    rows = volumes.withColumn("_t", stamp)
    n = F.count("*").over(w)
    timed = (F.count("_t").over(w) == n) & (F.size(F.collect_set("_t").over(w)) == n)
    numbered = (F.size(F.collect_set(F.when(F.col("instance_number") > 0, F.col("instance_number"))).over(w)) == n)
    rows = rows.withColumn("_key", F.when(timed, F.col("_t").cast("decimal(20,0)")).when(numbered, F.col("instance_number").cast("decimal(20,0)")))
    order = w.orderBy("_key", "volume_id")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("_next", F.lead("_t").over(order))
    seconds = lambda c: F.unix_timestamp(F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss")))
    raw = (F.col("_next").cast("long") - F.col("_t").cast("long")) * 1000
    true = (seconds(F.col("_next")) - seconds(F.col("_t"))) * 1000
    return rows.withColumn("raw_step_ms", F.coalesce(raw, F.lit(1000))).withColumn("step_ms", F.coalesce(true, F.lit(1000))).drop("_t", "_key", "_next")


def dose_frames(instances: DataFrame) -> DataFrame:
    """``file_id``, ``frame_no`` (from 1), ``x``, ``y``, ``z`` and ``x_spacing``: the base position, z plus the frame's offset.

    Offsets must be as many as frames. Of a spacing pair the first value is x here.
    """
    offsets = parse_ds(F.col("frame_offsets"))
    rows = instances.filter(F.coalesce(F.size(offsets) == F.col("number_of_frames"), F.lit(False))).select("file_id", "ipp", "spacing", F.posexplode(offsets).alias("at", "off"))
    return rows.select("file_id", (F.col("at") + 1).alias("frame_no"), F.col("ipp")[0].alias("x"), F.col("ipp")[1].alias("y"), (F.col("ipp")[2] + F.col("off")).alias("z"), F.col("spacing")[0].alias("x_spacing"))


def segment_labels(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """``file_id``, ``volume_no`` and ``label``: that of the segment, if all frames of a volume carry one segment number."""
    one = frames.groupBy("file_id", "volume_no").agg(F.min("segment_num").alias("a"), F.max("segment_num").alias("b"), F.count("segment_num").alias("n"), F.count("*").alias("m"))
    alone = one.select("file_id", "volume_no", F.when((F.col("a") == F.col("b")) & (F.col("n") == F.col("m")), F.col("a")).alias("segment_num"))
    return alone.join(segments.select("file_id", "segment_num", "label"), ["file_id", "segment_num"], "left").select("file_id", "volume_no", "label")
