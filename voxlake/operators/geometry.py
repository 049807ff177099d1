"""Slices in space: order, spacing, validation, splits into volumes and intersections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.functions.scalars import components, cross, dot, normal, orientation_code
from voxlake.sources.shared import written

SERIES = ["dir", "series_uid"]


def _differ(a: Column, b: Column, eps: float) -> Column:
    return F.exists(F.zip_with(a, b, lambda x, y: F.abs(x - y) >= eps), lambda x: x)


def sort_slices(instances: DataFrame, keys: list[str] = SERIES, order: str = "file_order", eps: float = 1e-3) -> DataFrame:
    """Adds ``slice_no`` (from 1): by the distance along the normal of the series' first slice, then in input order.

    If any slice lacks position or orientation, or an orientation differs by ``eps`` or more in any cosine from the
    first one's, the series keeps its input order. The pairwise comparison that this stands for isn't transitive;
    this rule is, and agrees with it wherever all orientations do.
    """
    w = Window.partitionBy(*keys)
    first = w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = instances.withColumn("_first_iop", F.first("iop").over(first))
    good = F.coalesce((F.size("ipp") == 3) & (F.size("iop") == 6) & (F.size("_first_iop") == 6) & ~_differ(F.col("iop"), F.col("_first_iop"), eps), F.lit(False))
    rows = rows.withColumn("_sortable", F.min(good).over(w)).withColumn("_dist", F.when(F.col("_sortable"), dot(normal(F.col("_first_iop")), components(F.col("ipp")))))
    return rows.withColumn("slice_no", F.row_number().over(w.orderBy("_dist", order))).drop("_first_iop", "_sortable", "_dist")


def corners(slices: DataFrame) -> DataFrame:
    """Adds ``corners``: the four outer corners (array of x, y, z) from position, orientation, spacing (x, y), rows and cols.

    The position is the middle of the first pixel, so the corners lie half a pixel outside.
    """
    p, row, col = components(F.col("ipp")), components(F.col("iop")), components(F.col("iop"), 3)
    sx, sy = F.col("spacing")[0], F.col("spacing")[1]

    def corner(i: Column, j: Column) -> Column:
        return F.array(*[p[k] + row[k] * sx * i + col[k] * sy * j for k in range(3)])

    left, top, right, bottom = F.lit(-0.5), F.lit(-0.5), F.col("cols") - 0.5, F.col("rows") - 0.5
    return slices.withColumn("corners", F.array(corner(left, top), corner(right, top), corner(right, bottom), corner(left, bottom)))


def _length(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((a[i] - b[i]) * (a[i] - b[i]) for i in (1, 2)), (a[0] - b[0]) * (a[0] - b[0])))


def slice_geometry(slices: DataFrame, keys: list[str] = SERIES, tolerance: float = 0.01) -> DataFrame:
    """Per series of sorted slices: ``n_slices``, ``orientation``, ``one_direction``, ``equidistant``, ``is_uniform`` and ``z_spacing``.

    A step is one direction if the orientation code stays and the four corner lengths agree; from the third slice on
    lengths must repeat the step before. Uniform is both (one slice: always; two: the first alone), unless the way
    from the first to the last slice differs from the normal by more than 1e-4 in a component, or is nothing. The
    spacing is the last step of the origin's corner, 1 for one slice.
    """
    w = Window.partitionBy(*keys).orderBy("slice_no")
    rows = corners(slices).select(*keys, "slice_no", "ipp", "iop", "corners", orientation_code(F.col("iop")).alias("code"))
    rows = rows.withColumn("_before", F.lag("corners").over(w)).withColumn("_code", F.lag("code").over(w))
    rows = rows.withColumn("steps", F.when(F.col("_before").isNotNull(), F.array(*[_length(F.col("corners")[i], F.col("_before")[i]) for i in range(4)])))
    rows = rows.withColumn("_steps", F.lag("steps").over(w))
    same = F.forall(F.col("steps"), lambda x: F.abs(x - F.col("steps")[0]) <= tolerance)
    direction = F.when(F.col("steps").isNull(), True).otherwise((F.col("code") == F.col("_code")) & same)
    equal = F.when(F.col("_steps").isNull(), True).otherwise(F.forall(F.zip_with("steps", "_steps", lambda a, b: F.abs(a - b)), lambda x: x <= tolerance))
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n_slices"), F.min_by("code", "slice_no").alias("orientation"), F.bool_and(direction).alias("one_direction"), F.bool_and(equal).alias("equidistant"),
        F.min_by("ipp", "slice_no").alias("_p0"), F.max_by("ipp", "slice_no").alias("_p1"), F.min_by("iop", "slice_no").alias("_iop"), F.max_by(F.col("steps")[0], "slice_no").alias("_z"),
    )
    way = [F.col("_p1")[i] - F.col("_p0")[i] for i in range(3)]
    size = F.sqrt(dot(way, way))
    along = F.when(size > 0, sum((F.when(F.abs(a / size - b) > 1e-4, 1).otherwise(0) for a, b in zip(way, normal(F.col("_iop")), strict=True)), F.lit(0)) == 0).otherwise(False)
    uniform = F.when(F.col("n_slices") == 1, True).otherwise(F.col("one_direction") & F.col("equidistant") & along)
    return found.select(*keys, "n_slices", "orientation", "one_direction", "equidistant", uniform.alias("is_uniform"), F.coalesce("_z", F.lit(1.0)).alias("z_spacing"))


def check_slices(slices: DataFrame, keys: list[str] = SERIES, order: str = "slice_no", tolerance: float = 1e-4) -> DataFrame:
    """Per series ``is_valid``, ``x_spacing`` and ``y_spacing``: sizes as in the first slice, spacing within the tolerance.

    Of a spacing pair the second value is x and the first is y.
    """
    first = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.first(F.struct("rows", "cols", "spacing")).over(first)
    rows = slices.withColumn("_head", head)
    same = F.col("rows").eqNullSafe(F.col("_head.rows")) & F.col("cols").eqNullSafe(F.col("_head.cols"))
    near = F.coalesce(~_differ(F.col("spacing"), F.col("_head.spacing"), tolerance), F.lit(False))
    return rows.groupBy(*keys).agg(F.bool_and(same & near).alias("is_valid"), F.first("_head.spacing").alias("_s")).select(*keys, "is_valid", F.col("_s")[1].alias("x_spacing"), F.col("_s")[0].alias("y_spacing"))


def multiseries_split(instances: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Adds ``volume_no`` (from 0): series that hold several volumes of the same places are split, others are volume 0.

    Files are ordered by image index, else instance number (0 or more); of files with one number the last stays and
    the others get a null volume. Positions count in steps of 0.001. A split needs the same number, over one, of
    files at every position (or of slice locations, if the orientations differ), and all files numbered. In runs
    1 1 1 2 2 2 volume j takes the j-th of each run; in rounds 1 2 3 1 2 3 each round is a volume.
    """
    w = Window.partitionBy(*keys)
    number = F.coalesce(*[F.col(c) for c in ("image_index", "instance_number") if c in instances.columns])
    rows = instances.withColumn("_n", F.when(number >= 0, number))
    last = F.row_number().over(Window.partitionBy(*keys, "_n").orderBy(F.col("file_order").desc()))
    rows = rows.withColumn("_kept", F.col("_n").isNotNull() & (last == 1))
    kept = Window.partitionBy(*keys, "_kept")
    ordered = kept.orderBy("_n")
    grain = lambda array, step: F.transform(array, lambda x: F.round(x / step).cast("long"))
    rows = rows.withColumn("_o", grain(F.col("iop"), 1e-4)).withColumn("_one", F.min("_o").over(kept).eqNullSafe(F.max("_o").over(kept)))
    location = F.array(F.round(F.col("slice_location") * 1000).cast("long")) if "slice_location" in instances.columns else F.lit(None).cast("array<long>")
    rows = rows.withColumn("_place", F.when(F.col("_one"), F.reverse(grain(F.col("ipp"), 1e-3))).otherwise(location))
    at_place = Window.partitionBy(*keys, "_kept", "_place")
    rows = rows.withColumn("_count", F.count("*").over(at_place)).withColumn("_new", F.coalesce(~F.col("_place").eqNullSafe(F.lag("_place").over(ordered)), F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(ordered)).withColumn("_row", F.row_number().over(ordered) - 1)
    rows = rows.withColumn("_size", F.count("*").over(Window.partitionBy(*keys, "_kept", "_run"))).withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_kept", "_run").orderBy("_n")) - 1)
    per = F.min("_count").over(kept)
    fits = (per == F.max("_count").over(kept)) & (per > 1) & (F.count("_place").over(kept) == F.count("*").over(kept))
    runs = fits & (F.min("_size").over(kept) == per) & (F.max("_size").over(kept) == per)
    rounds = fits & (F.max("_size").over(kept) == 1)
    places = (F.count("*").over(kept) / per).cast("long")
    rows = rows.withColumn("_volume", F.when(runs, F.col("_nth")).when(rounds, F.floor(F.col("_row") / places)).otherwise(0))
    split = F.max(F.when(F.col("_kept"), F.col("_volume"))).over(w) > 0
    out = rows.withColumn("volume_no", F.when(F.col("_kept") | ~split, F.when(F.col("_kept"), F.col("_volume")).otherwise(0)).cast("int"))
    return out.select(*instances.columns, "volume_no")


#: Slices of a class, or of a study, that meet under one join key, about; more are dealt to several.
CROWD = 4096
#: Normals are classes by this grain: within a class they differ by less than what counts as parallel.
GRAIN = 1e-7
PARALLEL = 1e-12


def _candidates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of slices of which b reaches the height of a, and that no parallel classes hold; ``a_`` and ``b_`` before the columns.

    Slices are grouped to classes of orientation. Along a class's normal a slice of it is a point and one of another
    class an interval; both go to steps of a quarter of the mean slice side, and meet by step. Classes that are parallel
    never meet. A study with more than ``CROWD`` slices is dealt by parts of both sides, so that a key has about as
    many rows however large the study.
    """
    own = rows.groupBy(*keys, "cls").agg(F.max("reach").alias("_reach"), F.count("*").alias("_n_class")).withColumnRenamed("cls", "_cls")
    whole = rows.groupBy(*keys).agg((F.greatest(F.avg("side") / 4, F.lit(1e-3))).alias("_step"), F.count("*").alias("_n"))
    own = own.join(whole, list(keys)).withColumns({"_parts_a": F.ceil(F.col("_n_class") / CROWD), "_parts_b": F.ceil(F.col("_n") / CROWD)}).drop("_n", "_n_class")
    met = rows.join(own.hint("merge"), list(keys))  # few classes for each study: Spark splits the slices of a large one; their file is too small to tell their size
    axis = [F.col("_cls")[i] * GRAIN for i in range(3)]
    step = lambda height: F.floor(height / F.col("_step")).cast("long")
    part = lambda n: F.pmod(F.xxhash64("f"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    named = lambda rows, side, columns: rows.select(*keys, "_cls", "_at", "_a", "_b", *[F.col(c).alias(f"{side}_{c}") for c in columns])
    points = met.filter(F.col("cls") == F.col("_cls")).withColumn("_at", step(dot(axis, _columns("p", 3))))
    points = points.withColumn("_a", part("_parts_a")).withColumn("_b", every("_parts_b"))
    tilt = cross(axis, [F.col("cls")[i] * GRAIN for i in range(3)])
    reach = 2e-6 * (2 + F.col("_reach") + F.col("reach"))
    spans = met.filter((F.col("cls") != F.col("_cls")) & (dot(tilt, tilt) > PARALLEL / 100)).withColumns({f"_h{i}": dot(axis, _columns(f"c{i}", 3)) for i in range(4)})
    heights = _columns("_h", 4)
    spans = spans.withColumns({"_low": step(F.least(*heights) - reach), "_high": step(F.greatest(*heights) + reach)})
    spans = spans.withColumn("_at", F.explode(F.sequence("_low", "_high")))
    spans = spans.withColumn("_b", part("_parts_b")).withColumn("_a", every("_parts_a"))
    return named(points, "a", _A).join(named(spans, "b", _B).hint("merge"), [*keys, "_cls", "_at", "_a", "_b"])  # what explodes is more than Spark takes it for


def _names(stem: str, n: int) -> list[str]:
    return [f"{stem}{i}" for i in range(n)]


def _columns(stem: str, n: int) -> list[Column]:
    return [F.col(c) for c in _names(stem, n)]


#: What a pair has of its slices: position, cosines, spacing and normal of a, normal and corners of b.
_A = ["f", "v", *_names("p", 3), *_names("r", 6), *_names("s", 2), *_names("n", 3)]
_B = ["f", "v", *_names("n", 3), *[c for i in range(4) for c in _names(f"c{i}", 3)]]


#: What a slice gets beside its position, cosines and spacing: normal, corners, farthest coordinates and longer side.
_MEASURED = [*_names("n", 3), *[c for i in range(4) for c in _names(f"c{i}", 3)], "reach", "side"]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices with ``_MEASURED`` and their class, without those that lack a number, which no plane can meet."""
    for batch in batches:
        given = [*_names("p", 3), *_names("r", 6), *_names("s", 2), "rows", "cols"]
        at = {name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(float) for name in given}
        whole = np.flatnonzero(np.logical_and.reduce([np.isfinite(x) for x in at.values()]))
        at = {name: x[whole] for name, x in at.items()}
        p, r = [at[c] for c in _names("p", 3)], [at[c] for c in _names("r", 6)]
        n = cross(r[:3], r[3:])
        low, right, bottom = -0.5, at["cols"] - 0.5, at["rows"] - 0.5
        places = [(low, low), (right, low), (right, bottom), (low, bottom)]
        c = [[p[k] + r[k] * at["s0"] * i + r[3 + k] * at["s1"] * j for k in range(3)] for i, j in places]
        far = lambda columns: np.max(np.abs(columns), axis=0)
        side = np.maximum(*[np.sqrt(dot(*[[c[i][m] - c[k][m] for m in range(3)]] * 2)) for i, k in ((0, 1), (1, 2))])
        grains = np.clip(np.rint(np.stack(n, axis=1) / GRAIN), -9e18, 9e18).astype(np.int64)
        first = np.take_along_axis(grains, (grains != 0).argmax(axis=1)[:, None], axis=1)
        grains = np.where(first < 0, -grains, grains)  # opposite normals are one class
        classes = pa.ListArray.from_arrays(np.arange(0, grains.size + 1, 3, dtype=np.int32), grains.reshape(-1))
        new = [*n, *[x for corner in c for x in corner], far([x for corner in c for x in corner]) + far(p), side]
        names = [name for name in batch.schema.names if name not in ("rows", "cols")]
        own = batch.select(names).take(pa.array(whole))
        yield pa.RecordBatch.from_arrays([*own.columns, *map(pa.array, new), classes], [*names, *_MEASURED, "cls"])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of pairs of slices; whole columns at a time, as Spark makes one method of all this that is too long to be compiled."""
    for batch in batches:
        at = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names) if name[2:] not in ("f", "v")}
        many = lambda stem, n: [at[c] for c in _names(stem, n)]
        n, p = many("a_n", 3), many("a_p", 3)
        with np.errstate(all="ignore"):
            tilt = cross(n, many("b_n", 3))
            h = [dot(n, [at[f"b_c{i}{k}"] - p[k] for k in range(3)]) for i in range(4)]
            edges = [(i, (i + 1) % 4) for i in range(4)]
            hits = [(h[i] * h[j] < 0) | ((h[i] == 0) & (h[j] != 0)) for i, j in edges]
            kept = np.flatnonzero((dot(tilt, tilt) > PARALLEL) & (sum(hit.astype(np.int8) for hit in hits) == 2))
            at = {name: values[kept] for name, values in at.items()}
            h, hits, p = [x[kept] for x in h], [x[kept] for x in hits], many("a_p", 3)
            out = []
            for order in (range(4), range(3, -1, -1)):  # of two hits the one comes first, the other last
                point = [np.full(len(kept), np.nan)] * 3
                for e in reversed(order):
                    (i, j), hit = edges[e], hits[e]
                    along = h[i] / (h[i] - h[j])
                    point = [np.where(hit, at[f"b_c{i}{k}"] + along * (at[f"b_c{j}{k}"] - at[f"b_c{i}{k}"]), point[k]) for k in range(3)]
                out += [dot(many("a_r", 6)[3 * axis : 3 * axis + 3], [point[k] - p[k] for k in range(3)]) / at[f"a_s{axis}"] for axis in (0, 1)]
        ids = [batch.column(batch.schema.get_field_index(name)).take(pa.array(kept)) for name in ("a_f", "b_f")]
        yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, out)], ["a", "b", "x0", "y0", "x1", "y1"])


def slice_intersections(slices: DataFrame, keys: list[str] = ("study_uid", "frame_of_ref_uid"), volume: str = "series_uid") -> DataFrame:
    """Lines in which slices of other volumes cut a slice, in its pixel coordinates: ``a``, ``b``, ``x0``, ``y0``, ``x1``, ``y1``.

    Slices pair within a study and a frame of reference that isn't empty; planes with equal or opposite normals do
    not. The four edges of slice b cut the plane of slice a; only exactly two hits make a line. Only pairs that can
    cross are compared, so their number is near the size of the answer. Slices are read once and written to the shared
    folder, narrow and compressed.
    """
    frame = keys[-1]
    rows = slices.filter(F.coalesce(F.col(frame) != "", F.lit(False)) & (F.size("ipp") == 3) & (F.size("iop") == 6))
    sizes = {"p": ("ipp", 3), "r": ("iop", 6), "s": ("spacing", 2)}
    flat = [F.col(column)[k].cast("double").alias(f"{stem}{k}") for stem, (column, n) in sizes.items() for k in range(n)]
    rows = rows.select(*keys, F.col(volume).alias("v"), F.col("file_id").alias("f"), *flat, F.col("rows").cast("double").alias("rows"), F.col("cols").cast("double").alias("cols"))
    kinds = [f"`{name}` {kind}" for name, kind in rows.dtypes if name not in ("rows", "cols")]
    rows = rows.mapInArrow(_measured, ", ".join([*kinds, *[f"{c} double" for c in _MEASURED], "cls array<long>"]))
    pairs = _candidates(written(rows), list(keys)).filter("a_v <> b_v")
    kind = dict(rows.dtypes)["f"]
    wanted = [f"{side}_{c}" for side, columns in (("a", _A), ("b", _B)) for c in columns if c != "v"]
    return pairs.select(*wanted).mapInArrow(_lines, f"a {kind}, b {kind}, x0 double, y0 double, x1 double, y1 double")


def volume_center(slices: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Per series ``x``, ``y``, ``z``: of a uniform one the middle between the first and the last slice's middles, else the mean of all corners.

    ``slices`` has ``slice_no`` and ``is_uniform``.
    """
    rows = corners(slices)
    middle = [(F.col("corners")[0][k] + F.col("corners")[1][k] + F.col("corners")[2][k] + F.col("corners")[3][k]) / 4 for k in range(3)]
    found = rows.groupBy(*keys).agg(F.bool_and("is_uniform").alias("u"), F.min_by(F.array(*middle), "slice_no").alias("p"), F.max_by(F.array(*middle), "slice_no").alias("q"), *[F.avg(m).alias(f"m{k}") for k, m in enumerate(middle)])
    return found.select(*keys, *[F.when(F.col("u"), (F.col("p")[k] + F.col("q")[k]) / 2).otherwise(F.col(f"m{k}")).alias(name) for k, name in enumerate("xyz")])


def volume_extent(volumes: DataFrame, keys: list[str]) -> DataFrame:
    """Largest size (dimension x spacing) of an axis over the volumes of each group; 1000 if it isn't positive.

    ``volumes`` has arrays ``dims`` and ``spacing`` of three.
    """
    most = F.greatest(*[F.col("dims")[i] * F.col("spacing")[i] for i in range(3)])
    return volumes.groupBy(*keys).agg(F.max(most).alias("m")).select(*keys, F.when(F.col("m") > 0, F.col("m")).otherwise(1000.0).alias("extent"))


def contour_extent(points: DataFrame, keys: list[str], roi: str = "roi_id") -> DataFrame:
    """Largest size of an axis over the ROIs of each group of contours; 1000 if it isn't positive. Points have x, y, z."""
    sizes = points.groupBy(*keys, roi).agg(F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]).alias("size"))
    return sizes.groupBy(*keys).agg(F.max("size").alias("m")).select(*keys, F.when(F.col("m") > 0, F.col("m")).otherwise(1000.0).alias("extent"))
