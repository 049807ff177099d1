"""Pixel arrays, one row per frame: rescale, windows, lookup tables, ranges, histograms and mosaics.

Arrays stay arrays: a frame's steps are NumPy operations on its array, fused in one pass over Arrow batches; nothing
explodes into pixels, and the histogram counts inside each task first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions.sop_classes import PET

LOST = 2.0**24  # beyond it single precision loses whole numbers


#: A frame's step: its pixels as doubles and its parameters, to new pixels; None where the frame has no result.
Step = Callable[[np.ndarray, dict], np.ndarray | None]


def _in_arrow(frames: DataFrame, params: dict[str, Column], steps: list[Step], kind: str) -> DataFrame:
    """Frames with the pixels that ``steps`` give one after the other, all in one pass over Arrow batches.

    A frame is one NumPy array from its batch, without a copy; what each step needs of the frame comes beside it. Null
    frames and null pixels stay null. Other columns go through. Spark cuts batches by bytes.
    """
    keys, names = list(params), [f"_p{i}" for i in range(len(params))]
    rows = frames.select(*frames.columns, *[c.alias(n) for n, c in zip(names, params.values(), strict=True)])
    at = frames.columns.index("pixels")
    out_type = pa.list_({"double": pa.float64(), "int": pa.int32()}[kind])
    schema = frames.withColumn("pixels", F.lit(None).cast(f"array<{kind}>")).schema
    plain = np.float64 if kind == "double" else np.int32

    def value(column: pa.Array, i: int):
        if pa.types.is_struct(column.type):  # a lookup table
            return None if not column[i].is_valid else {k: column.field(k)[i].values.to_numpy(zero_copy_only=False) if k == "data" and column.field(k)[i].is_valid else column.field(k)[i].as_py() for k in column.type.names}
        return column[i].as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = batch.column(at)
            own = dict(zip(keys, (batch.column(len(schema) + i) for i in range(len(names))), strict=True))
            parts, masks, sizes, nulls = [], [], [], []
            for i in range(batch.num_rows):
                found, lost = None, None
                if pixels[i].is_valid:
                    values = pixels[i].values
                    lost = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None
                    found = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                    frame = {k: value(c, i) for k, c in own.items()}
                    with np.errstate(all="ignore"):
                        for step in steps:
                            found = None if found is None else step(found, frame)
                nulls.append(found is None)
                found = np.empty(0, plain) if found is None else found
                blank = np.isnan(found) if kind == "int" and found.dtype.kind == "f" else np.zeros(len(found), bool)
                parts.append(np.where(blank, 0, found).astype(plain, copy=False))
                masks.append(blank if lost is None or len(lost) != len(found) else blank | lost)
                sizes.append(len(found))
            flat, mask = (np.concatenate(parts), np.concatenate(masks)) if parts else (np.empty(0, plain), np.empty(0, bool))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, mask=mask if mask.any() else None), mask=pa.array(nulls, pa.bool_()))
            columns = [lists.cast(out_type) if j == at else batch.column(j) for j in range(len(schema))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def _rescaled(v: np.ndarray, frame: dict) -> np.ndarray:
    slope, intercept = (frame[k] for k in ("slope", "intercept"))
    return v * (1.0 if slope is None else slope) + (0.0 if intercept is None else intercept)


def _windowed(black_above: bool) -> Step:
    def step(v: np.ndarray, frame: dict) -> np.ndarray:
        center, width, function = frame["center"], frame["width"], frame["function"]
        if center is None or width is None:
            return np.full(len(v), np.nan)
        if function == "SIGMOID":
            return np.floor(255 / (1 + np.exp(-4 * (v - center) / width)))
        exact = function == "LINEAR_EXACT" or (function == "LINEAR" and width <= 1)
        half, mid = (width / 2, center) if exact else ((width - 1) / 2, center - 0.5)
        inside = np.floor(255 * ((v - mid) / (width if exact else width - 1) + 0.5))
        return np.where(v <= mid - half, 0.0, np.where(v > mid + half, 0.0 if black_above else 255.0, inside))

    return step


def _looked_up(v: np.ndarray, lut: dict) -> np.ndarray | None:
    """Pixels through a lookup table: truncated, shifted only if the first mapped value is negative, clamped to both ends; None beyond 16 bits."""
    data = lut["data"]
    if lut["bits"] is None or lut["bits"] > 16:
        return None
    if data is None or not len(data):
        return np.full(len(v), np.nan)
    whole = np.nan_to_num(np.trunc(v)) - min(lut["first_mapped"] or 0, 0)
    return data[np.clip(whole, 0, len(data) - 1).astype(np.int64)].astype(np.float64)


def _modality(v: np.ndarray, frame: dict) -> np.ndarray | None:
    lut = frame.get("modality")
    if lut is None or (frame["slope"] is not None and frame["intercept"] is not None):
        return _rescaled(v, frame)
    return _looked_up(v, lut)


def _of_interest(black_above: bool) -> Step:
    window = _windowed(black_above)
    return lambda v, frame: window(v, frame) if frame.get("voi") is None else _looked_up(v, frame["voi"])


def _presented(v: np.ndarray, frame: dict) -> np.ndarray | None:
    if frame.get("presentation") is not None:
        return _looked_up(v, frame["presentation"])
    return frame["top"] - v if frame["shape"] == "INVERSE" else v


_SCALE = {"slope": "rescale_slope", "intercept": "rescale_intercept"}
_WINDOW = {"center": "window_center", "width": "window_width", "function": "lut_function"}


def _params(names: dict[str, str]) -> dict[str, Column]:
    return {k: F.col(c).cast("string" if k == "function" else "double") for k, c in names.items()}


def _with_precision(frames: DataFrame) -> DataFrame:
    big = F.greatest(F.abs(F.array_max("pixels")), F.abs(F.array_min("pixels"))) > LOST
    return frames.withColumn("is_double", F.coalesce(F.col("sop_class").isin(*PET) | (F.col("sop_class") == ""), F.lit(True)) | F.coalesce(big, F.lit(False)))


def rescale(frames: DataFrame) -> DataFrame:
    """Pixels times slope plus intercept; ``is_double`` tells whether the volume needs double precision.

    It does for two PET classes, an empty SOP class, and where the result passes 2**24.
    """
    return _with_precision(_in_arrow(frames, _params(_SCALE), [_rescaled], "double"))


def window_value(v: Column, center: Column, width: Column, function: Column, black_above: bool = False) -> Column:
    """A value through a window as 0 to 255: below 0, above 255 (or 0 in the other mode), between truncated.

    A LINEAR window of width 1 or less works as LINEAR_EXACT.
    """
    exact = (function == "LINEAR_EXACT") | ((function == "LINEAR") & (width <= 1))
    half = F.when(exact, width / 2).otherwise((width - 1) / 2)
    mid = F.when(exact, center).otherwise(center - 0.5)
    ratio = F.when(function == "SIGMOID", 1 / (1 + F.exp(-4 * (v - center) / width))).when(exact, (v - center) / width + 0.5).otherwise((v - (center - 0.5)) / (width - 1) + 0.5)
    inside = F.floor(255 * ratio).cast("int")
    above = F.lit(0 if black_above else 255)
    return F.when(function == "SIGMOID", inside).when(v <= mid - half, F.lit(0)).when(v > mid + half, above).otherwise(inside)


def apply_window(frames: DataFrame, black_above: bool = False) -> DataFrame:
    """Pixels through each frame's own window (window_center, window_width, lut_function), as ``window_value`` gives them."""
    return _in_arrow(frames, _params(_WINDOW), [_windowed(black_above)], "int")


def apply_lut(frames: DataFrame, first_mapped: Column, bits: Column, data: Column) -> DataFrame:
    """Each frame's pixels through its lookup table: truncated, shifted only if the first mapped value is negative, clamped to both ends.

    Tables of more than 16 bits are refused: the pixels become null.
    """
    lut = F.struct(first_mapped.alias("first_mapped"), bits.alias("bits"), data.alias("data"))
    return _in_arrow(frames, {"lut": lut}, [lambda v, frame: _looked_up(v, frame["lut"])], "int")


def modality_lut(frames: DataFrame, lut: Column | None = None) -> DataFrame:
    """The first step: slope and intercept where a frame has both, else its table (struct of first_mapped, bits, data), else nothing."""
    return _with_precision(_in_arrow(frames, _params(_SCALE) | ({} if lut is None else {"modality": lut}), [_modality], "double"))


def presentation_lut(frames: DataFrame, shape: Column, top: Column | None = None, lut: Column | None = None) -> DataFrame:
    """The last step: a table where there is one, else the shape: INVERSE turns values around below ``top`` (255), IDENTITY keeps them."""
    params = {"shape": shape, "top": F.lit(255) if top is None else top} | ({} if lut is None else {"presentation": lut})
    return _in_arrow(frames, params, [_presented], "int")


def grayscale_pipeline(frames: DataFrame, shape: Column, modality: Column | None = None, voi: Column | None = None, presentation: Column | None = None) -> DataFrame:
    """Modality, values of interest, presentation: each step by the frame's table where it has one (null: it has none).

    Without tables: rescale, the window, the shape. Tables are structs of first_mapped, bits and data. After a table
    of interest values reach up to its bits, after a window up to 255; INVERSE turns around within that. The three steps are one
    pass over a frame's array.
    """
    tables = {k: c for k, c in (("modality", modality), ("voi", voi), ("presentation", presentation)) if c is not None}
    top = F.lit(255) if voi is None else F.when(voi.isNotNull(), (F.pow(F.lit(2.0), voi["bits"]) - 1).cast("int")).otherwise(255)
    params = _params(_SCALE | _WINDOW) | {"shape": shape, "top": top} | tables
    return _in_arrow(frames, params, [_modality, _of_interest(False), _presented], "int")


def pixel_minmax(frames: DataFrame, keys: list[str], max_window: bool = False) -> DataFrame:
    """``keys``, ``vmin``, ``vmax`` over all pixels; with ``max_window`` the range of bits_stored, if all pixels lie in it."""
    aggs = [F.min(F.array_min("pixels")).cast("double").alias("vmin"), F.max(F.array_max("pixels")).cast("double").alias("vmax")]
    if not max_window:
        return frames.groupBy(*keys).agg(*aggs)
    rows = frames.groupBy(*keys).agg(*aggs, F.max("bits_stored").alias("b"), F.max("pixel_repr").alias("s"))
    low = F.when(F.col("s") == 1, -F.pow(F.lit(2.0), F.col("b") - 1)).otherwise(0.0)
    high = F.when(F.col("s") == 1, F.pow(F.lit(2.0), F.col("b") - 1) - 1).otherwise(F.pow(F.lit(2.0), F.col("b")) - 1)
    fits = (F.col("vmin") >= low) & (F.col("vmax") <= high)
    return rows.select(*keys, F.when(fits, low).otherwise(F.col("vmin")).alias("vmin"), F.when(fits, high).otherwise(F.col("vmax")).alias("vmax"))


def bins_of(vmin: Column, vmax: Column, is_float: Column) -> Column:
    """Number of bins: the range plus one, 2048 at most; 256 at least for floats; 2048 beyond 32 bits."""
    n = F.least(F.round(vmax - vmin) + 1, F.lit(2048.0))
    return F.when(vmax - vmin >= 4294967295.0, 2048).when(is_float, F.greatest(n, F.lit(256.0))).otherwise(n).cast("int")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bin counts per group of this task; rows carry the group's number of bins and range."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for group, n, low, high, pixels in zip(*(batch.column(i) for i in range(5)), strict=True):
            values, bins = pixels.values.to_numpy(zero_copy_only=False).astype(float), n.as_py()
            span = high.as_py() - low.as_py()
            at = np.zeros(len(values), int) if span <= 0 else np.minimum(((values - low.as_py()) / span * bins).astype(int), bins - 1)
            totals[group.as_py()] = totals.get(group.as_py(), np.zeros(bins, np.int64)) + np.bincount(at[(at >= 0) & np.isfinite(values)], minlength=bins)[:bins]
    groups = np.repeat(np.array(list(totals), np.int64), [len(x) for x in totals.values()])
    bins = np.concatenate([np.arange(len(x)) for x in totals.values()]) if totals else np.empty(0, int)
    counts = np.concatenate(list(totals.values())) if totals else np.empty(0, np.int64)
    held = counts > 0
    yield pa.RecordBatch.from_arrays([pa.array(groups[held]), pa.array(bins[held].astype(np.int32)), pa.array(counts[held])], ["group", "bin", "n"])


def histogram(frames: DataFrame, group: str, is_float: bool = True) -> DataFrame:
    """``group``, ``bin``, ``n`` and ``log_max`` (log of the largest count if over 2): bins that hold pixels, over the group's range."""
    ranges = pixel_minmax(frames, [group]).withColumn("bins", bins_of(F.col("vmin"), F.col("vmax"), F.lit(is_float)))
    rows = frames.filter(F.size("pixels") > 0).join(ranges, group).select(F.col(group).cast("long").alias("group"), "bins", "vmin", "vmax", F.col("pixels").cast("array<double>").alias("pixels"))
    counts = rows.mapInArrow(_counted, "group long, bin int, n long").groupBy("group", "bin").agg(F.sum("n").alias("n"))
    top = counts.groupBy("group").agg(F.max("n").alias("m"))
    return counts.join(top, "group").select(F.col("group").alias(group), "bin", "n", F.when(F.col("m") > 2, F.log(F.col("m").cast("double"))).alias("log_max"))


def histogram_rgb(frames: DataFrame, group: str) -> DataFrame:
    """256 bins per channel over 0 to 255 of interleaved pixels: ``group``, ``channel``, ``bin``, ``n``."""
    channel = lambda c: F.struct(F.lit(c).alias("c"), F.filter("pixels", lambda v, i: i % 3 == c).cast("array<double>").alias("pixels"))
    split = frames.filter(F.size("pixels") > 0).select(group, F.explode(F.array(*[channel(c) for c in range(3)])).alias("p"))
    rows = split.select((F.col(group).cast("long") * 3 + F.col("p.c")).alias("g"), F.lit(256).alias("bins"), F.lit(0.0).alias("vmin"), F.lit(256.0).alias("vmax"), "p.pixels").filter(F.size("pixels") > 0)
    counts = rows.mapInArrow(_counted, "group long, bin int, n long").groupBy("group", "bin").agg(F.sum("n").alias("n"))
    return counts.select(F.expr("group div 3").alias(group), (F.col("group") % 3).cast("int").alias("channel"), "bin", "n")


def split_mosaic(frames: DataFrame, inverted: bool = False) -> DataFrame:
    """Tiles of a mosaic as frames: ``file_id``, ``tile`` (from 0), ``pixels``; tile z lies at (z mod s, z div s), s = ceil(sqrt n).

    ``frames`` has rows, cols, n_tiles and pixels row by row; a frame whose size doesn't divide by s has no tiles.
    """
    square = F.ceil(F.sqrt("n_tiles")).cast("int")
    rows = frames.withColumn("_s", square).filter((F.col("rows") % F.col("_s") == 0) & (F.col("cols") % F.col("_s") == 0) & (F.size("pixels") == F.col("rows") * F.col("cols")))
    rows = rows.withColumn("_h", F.expr("rows div _s").cast("int")).withColumn("_w", F.expr("cols div _s").cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)))
    z = (F.col("n_tiles") - 1 - F.col("tile")) if inverted else F.col("tile")
    rows = rows.withColumn("_z", z.cast("int"))
    lines = F.transform(F.sequence(F.lit(0), F.col("_h") - 1), lambda y: F.slice("pixels", (F.expr("_z div _s").cast("int") * F.col("_h") + y) * F.col("cols") + (F.col("_z") % F.col("_s")) * F.col("_w") + 1, F.col("_w")))
    return rows.select("file_id", "tile", F.flatten(lines).alias("pixels"))
