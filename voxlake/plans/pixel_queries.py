"""Queries of the pixel operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.functions.sop_classes import PET
from voxlake.operators import pixels as P
from voxlake.plans.registry import query
from voxlake.sources.fixtures import fixture


def _frames(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_frame_pixels").select("file_id", "volume_id", "frame_no", F.transform("pixels", lambda v: F.round(v.cast("double") * 1000)).alias("pixels"))
    return rows.withColumn("rescale_slope", F.lit(2.0)).withColumn("rescale_intercept", F.lit(-100.0)).withColumn("sop_class", F.lit("1.2")).withColumn("window_center", F.lit(40.0)).withColumn("window_width", F.lit(400.0)).withColumn("lut_function", F.lit("LINEAR"))


_PIX = "list_transform(pixels, lambda v: round(CAST(v AS DOUBLE) * 1000))"
_SUM = "CAST(list_sum({0}) AS DOUBLE)"


@query(f"""WITH r AS (SELECT file_id, CASE CAST(file_id % 4 AS INTEGER) WHEN 0 THEN '{PET[0]}' WHEN 1 THEN '' WHEN 2 THEN '1.2' END AS sop, CASE WHEN file_id % 8 = 2 THEN 1000000.0 ELSE 2.0 END AS slope, {_PIX} AS p FROM fx_frame_pixels),
s AS (SELECT file_id, sop, [v * slope - 100 FOR v IN p] AS p FROM r)
SELECT file_id, {_SUM.format("p")} AS total, coalesce(sop IN ('{PET[0]}', '{PET[1]}', ''), true) OR list_max([abs(v) FOR v IN p]) > 16777216 AS is_double FROM s""")
def p1_rescale(spark, sf_dir):
    """Classes that need doubles, one that does not, none at all, and slopes that pass the limit of single precision."""
    kind = F.col("file_id") % 4
    rows = _frames(spark, sf_dir).withColumn("sop_class", F.when(kind == 0, PET[0]).when(kind == 1, "").when(kind == 2, "1.2")).withColumn("rescale_slope", F.when(F.col("file_id") % 8 == 2, 1e6).otherwise(2.0))
    return P.rescale(rows).select("file_id", F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x).alias("total"), "is_double")


_WINDOW = "CASE WHEN v <= 39.5 - 199.5 THEN 0 WHEN v > 39.5 + 199.5 THEN 255 ELSE CAST(floor(255 * ((v - 39.5) / 399.0 + 0.5)) AS INTEGER) END"


_EXACT = "CASE WHEN v <= 40 - 200 THEN 0 WHEN v > 40 + 200 THEN 255 ELSE CAST(floor(255 * ((v - 40) / 400.0 + 0.5)) AS INTEGER) END"
_NARROW = "CASE WHEN v <= 40 - 0.5 THEN 0 WHEN v > 40 + 0.5 THEN 255 ELSE CAST(floor(255 * ((v - 40) / 1.0 + 0.5)) AS INTEGER) END"
_SIGMOID = "CAST(floor(255 / (1 + exp(-4 * (v - 40) / 400.0))) AS INTEGER)"


@query(f"SELECT file_id, CAST(list_sum(list_transform({_PIX}, lambda v: CASE file_id % 4 WHEN 0 THEN {_WINDOW} WHEN 1 THEN {_EXACT} WHEN 2 THEN {_SIGMOID} ELSE {_NARROW} END)) AS BIGINT) AS total FROM fx_frame_pixels")
def p2_apply_window(spark, sf_dir):
    """All three functions, and a linear window too narrow for its own."""
    kind = F.col("file_id") % 4
    rows = _frames(spark, sf_dir).withColumn("lut_function", F.when(kind == 1, "LINEAR_EXACT").when(kind == 2, "SIGMOID").otherwise("LINEAR")).withColumn("window_width", F.when(kind == 3, 1.0).otherwise(400.0))
    return P.apply_window(rows).select("file_id", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"SELECT file_id, CAST(list_sum(list_transform({_PIX}, lambda v: greatest(0, least(9, CAST(trunc(v) AS INTEGER) + 5)) * 10)) AS BIGINT) AS total FROM fx_frame_pixels")
def p3_apply_lut(spark, sf_dir):
    table = F.array(*[F.lit(i * 10) for i in range(10)])
    return P.apply_lut(_frames(spark, sf_dir), F.lit(-5), F.lit(16), table).select("file_id", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"SELECT file_id, CAST(list_sum(list_transform(list_transform({_PIX}, lambda u: u * 2 - 100), lambda v: 255 - {_WINDOW})) AS BIGINT) AS total FROM fx_frame_pixels")
def p4_grayscale_pipeline(spark, sf_dir):
    return P.grayscale_pipeline(_frames(spark, sf_dir), F.lit("INVERSE")).select("file_id", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"""WITH m AS (SELECT file_id, list_transform({_PIX}, lambda v: CASE WHEN file_id % 3 = 0 THEN greatest(0, least(63, CAST(trunc(v) AS INTEGER) + 32)) * 3.0 ELSE v * 2 - 100 END) AS p FROM fx_frame_pixels),
w AS (SELECT file_id, list_transform(p, lambda v: CASE WHEN file_id % 2 = 0 THEN greatest(0, least(99, CAST(trunc(v) AS INTEGER))) * 10 ELSE {_WINDOW} END) AS p FROM m)
SELECT file_id, array_to_string(list_transform(p, lambda v: CAST(CASE WHEN file_id % 5 = 0 THEN 500 - least(v, 499) WHEN file_id % 2 = 0 THEN 1023 - v ELSE 255 - v END AS BIGINT)), ',') AS shown FROM w""")
def p4_lookup_tables(spark, sf_dir):
    """Frames with and without tables at each step; without slope and intercept a modality table counts."""
    frames, at = _frames(spark, sf_dir), F.col("file_id")
    frames = frames.withColumns({c: F.when(at % 3 != 0, F.col(c)) for c in ("rescale_slope", "rescale_intercept")})
    table = lambda when, first, bits, data: F.when(when, F.struct(F.lit(first).alias("first_mapped"), F.lit(bits).alias("bits"), F.array(*map(F.lit, data)).alias("data")))
    shown = P.grayscale_pipeline(frames, F.lit("INVERSE"), table(at % 3 == 0, -32, 8, range(0, 192, 3)), table(at % 2 == 0, 0, 10, range(0, 1000, 10)), table(at % 5 == 0, 0, 9, range(500, 0, -1)))
    return shown.select("file_id", F.array_join(F.col("pixels").cast("array<long>").cast("array<string>"), ",").alias("shown"))


@query(f"""WITH t AS (SELECT file_id, {_PIX} AS p, unnest(range(4)) AS tile FROM fx_frame_pixels), c AS (SELECT file_id, tile, p, unnest(range(4)) AS y FROM t)
SELECT file_id, tile, CAST(sum(list_sum(p[(tile // 2 * 4 + y) * 8 + tile % 2 * 4 + 1 : (tile // 2 * 4 + y) * 8 + tile % 2 * 4 + 4])) AS DOUBLE) AS total FROM c GROUP BY file_id, tile""")
def p7_split_mosaic(spark, sf_dir):
    rows = _frames(spark, sf_dir).withColumn("rows", F.lit(8)).withColumn("cols", F.lit(8)).withColumn("n_tiles", F.lit(4))
    return P.split_mosaic(rows).select("file_id", "tile", F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"SELECT volume_id, min(list_min({_PIX})) AS vmin, max(list_max({_PIX})) AS vmax FROM fx_frame_pixels GROUP BY volume_id")
def a7_pixel_minmax(spark, sf_dir):
    return P.pixel_minmax(_frames(spark, sf_dir), ["volume_id"])


@query(f"""WITH r AS (SELECT volume_id, min(list_min({_PIX})) AS lo, max(list_max({_PIX})) AS hi, CASE WHEN volume_id % 3 = 0 THEN 16 ELSE 8 END AS b, volume_id % 2 AS s FROM fx_frame_pixels GROUP BY volume_id),
t AS (SELECT *, CASE WHEN s = 1 THEN -power(2, b - 1) ELSE 0 END AS tl, CASE WHEN s = 1 THEN power(2, b - 1) ELSE power(2, b) END - 1 AS th FROM r)
SELECT volume_id, CAST(CASE WHEN lo >= tl AND hi <= th THEN tl ELSE lo END AS DOUBLE) AS vmin, CAST(CASE WHEN lo >= tl AND hi <= th THEN th ELSE hi END AS DOUBLE) AS vmax FROM t""")
def a7_max_window(spark, sf_dir):
    """The range of the type where all pixels lie in it: signed ones of 16 bits here, 8 bits and unsigned ones keep their own."""
    rows = _frames(spark, sf_dir).withColumn("bits_stored", F.when(F.col("volume_id") % 3 == 0, 16).otherwise(8)).withColumn("pixel_repr", (F.col("volume_id") % 2).cast("int"))
    return P.pixel_minmax(rows, ["volume_id"], max_window=True)


@query(f"""WITH v AS (SELECT volume_id, unnest({_PIX}) AS v FROM fx_frame_pixels), r AS (SELECT volume_id, min(v) AS lo, max(v) AS hi FROM v GROUP BY volume_id),
b AS (SELECT volume_id, lo, hi, greatest(least(round(hi - lo) + 1, 2048), 256) AS n FROM r), c AS (SELECT v.volume_id, CAST(least(floor((v - lo) / (hi - lo) * n), n - 1) AS INTEGER) AS bin, count(*) AS n FROM v JOIN b ON v.volume_id = b.volume_id GROUP BY 1, 2)
SELECT volume_id, bin, n, CASE WHEN max(n) OVER (PARTITION BY volume_id) > 2 THEN ln(CAST(max(n) OVER (PARTITION BY volume_id) AS DOUBLE)) END AS log_max FROM c""")
def a8_histogram(spark, sf_dir):
    return P.histogram(_frames(spark, sf_dir), "volume_id")


@query(f"""WITH v AS (SELECT volume_id, unnest({_PIX}) AS v, unnest(range(64)) AS i FROM fx_frame_pixels) SELECT volume_id, CAST(i % 3 AS INTEGER) AS channel, CAST(abs(v) % 256 AS INTEGER) AS bin, count(*) AS n FROM v GROUP BY 1, 2, 3""")
def a9_histogram_rgb(spark, sf_dir):
    rows = _frames(spark, sf_dir).withColumn("pixels", F.transform("pixels", lambda v: F.abs(v) % 256))
    return P.histogram_rgb(rows, "volume_id")
