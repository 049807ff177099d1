"""Hand-computed cases of the scalar functions."""

import math
import random
import struct

from pyspark.sql import functions as F

from voxlake.functions import scalars as S
from voxlake.functions.text import decode_text


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r.v for r in rows.select("i", column(F.col("s")).alias("v")).orderBy("i").collect()]


def test_numbers(spark):
    assert values(spark, ["1\\2\\3", "1,5\\2", " 4 \\\\5\x00", "1\\x", "", None, "1e2"], S.parse_ds) == [[1, 2, 3], [1.5, 2], [4, 5], None, [], None, [100]]
    assert values(spark, ["1\\-2", "1.5", "99999999999"], S.parse_is) == [[1, -2], None, None]
    assert values(spark, ["1\\2", "1\\2\\3"], S.parse_position) == [None, [1, 2, 3]]
    assert values(spark, ["0.5", "1\\2", "1\\2\\3"], S.parse_spacing) == [[0.5, 0.5], [1, 2], None]


def test_names(spark):
    cases = {"Doe": "Doe", "Doe^Jane": "Jane Doe", "Doe^": "Doe", "Doe^Jane^M": "Jane M Doe", "Doe^Jane^M^Dr": "Dr Jane M Doe", "Doe^Jane^^Dr^Jr": "Dr Jane Doe, Jr", "a^b^c^d^e^f": "a^b^c^d^e^f", "Doe^Jane=Roe": "Jane Doe Roe"}
    assert values(spark, list(cases), S.format_pn) == list(cases.values())


def test_dates_and_tags(spark):
    assert values(spark, ["20200229", "20210229", "x", None], S.format_date) == ["29 Feb 2020", "", "", ""]
    flags = values(spark, ["00100010", "00090010", "00080000", "00090001", "00010010", "00091001"], S.tag_flags)
    assert [(f.is_private, f.is_creator, f.is_group_length, f.is_illegal) for f in flags] == [(False, False, False, False), (True, True, False, False), (False, False, True, False), (True, False, False, True), (True, True, False, True), (True, False, False, False)]


def test_almost_equal(spark):
    inf, nan = float("inf"), float("nan")
    rows = spark.createDataFrame([(0.0, -0.0, 0.0), (1.0, 1.0 + 1e-9, 1e-6), (1.0, 1.1, 1e-6), (nan, nan, 1.0), (inf, inf, 0.0), (inf, -inf, inf), (inf, 1.0, inf)], "a double, b double, e double")
    assert [r[0] for r in rows.select(S.almost_equal(F.col("a"), F.col("b"), F.col("e"))).collect()] == [True, True, False, False, True, False, False]


def test_directions(spark):
    rows = spark.createDataFrame([(1.0, 0.0, 0.0), (-1.0, 0.5, 0.2), (0.5, 0.5, 0.1), (0.00001, 0.0, 0.0), (0.1, -0.3, -0.2)], "x double, y double, z double")
    assert [r[0] for r in rows.select(S.direction_letters(F.col("x"), F.col("y"), F.col("z"))).collect()] == ["L", "RPH", "", "", "AFL"]


def test_text(spark):
    rows = spark.createDataFrame([("Müller".encode("latin-1"), "ISO_IR 100"), ("Müller".encode(), "ISO_IR 192"), ("Иван".encode("iso8859-5"), "ISO_IR 144"), (b"plain", None), (None, "ISO_IR 100")], "b binary, c string")
    assert [r[0] for r in rows.select(decode_text(F.col("b"), F.col("c"))).collect()] == ["Müller", "Müller", "Иван", "plain", None]


def test_almost_equal_on_edges(spark):
    inf, nan, after = float("inf"), float("nan"), 1.0000000000000002
    cases = [
        (0.0, -0.0, 0.0, True), (1.0, 1.0, 0.0, True), (1.0, after, 0.0, False), (1.0, after, 1e-15, True), (1e-7, -1e-7, 1e-6, True), (1.0, -1.0, 0.0, False), (5e-324, 1e-323, 0.0, False), (5e-324, 1e-323, 1e-323, True),
        (1.7976931348623157e308, inf, 1e308, False), (inf, inf, 0.0, True), (inf, -inf, 1e308, False), (nan, nan, 0.0, False), (nan, 1.0, 1e308, False), (None, 1.0, 1.0, None),
    ]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, a double, b double, eps double")
    assert [r.v for r in rows.select("i", S.almost_equal(F.col("a"), F.col("b"), F.col("eps")).alias("v")).orderBy("i").collect()] == [c[3] for c in cases]


def test_text_with_escapes(spark):
    """Names in several scripts, as the format's standard shows them."""
    cases = [
        (b"Yamada^Tarou=\x1b$B;3ED\x1b(B^\x1b$BB@O:\x1b(B=\x1b$B$d$^$@\x1b(B^\x1b$B$?$m$&\x1b(B", "\\ISO 2022 IR 87", "Yamada^Tarou=山田^太郎=やまだ^たろう"),
        (b"\xd4\xcf\xc0\xde^\xc0\xdb\xb3=\x1b$B;3ED\x1b(J^\x1b$BB@O:\x1b(J", "ISO 2022 IR 13\\ISO 2022 IR 87", "ﾔﾏﾀﾞ^ﾀﾛｳ=山田^太郎"),
        (b"Hong^Gildong=\x1b$)C\xfb\xf3^\x1b$)C\xd1\xce\xd4\xd7=\x1b$)C\xc8\xab^\x1b$)C\xb1\xe6\xb5\xbf", "\\ISO 2022 IR 149", "Hong^Gildong=洪^吉洞=홍^길동"),
        (b"Buc^J\xe9r\xf4me=\x1b-F\xc4\xe9\xef^\xe9", "ISO 2022 IR 100\\ISO 2022 IR 126", "Buc^Jérôme=Διο^é"),
        (b"\x1b-L\xbb\xee\xdaceMap", "\\ISO 2022 IR 144", "ЛюкceMap"),
        (b"Wang^XiaoDong=\xcd\xf5", "GB18030", "Wang^XiaoDong=王"), (b"a\x1b(Bb", None, "ab"), (b"\x1b$)A\xcd\xf5", "\\ISO 2022 IR 58", "王"),
    ]
    rows = spark.createDataFrame([(i, b, c) for i, (b, c, _) in enumerate(cases)], "i int, b binary, c string").orderBy("i")
    assert [r[0] for r in rows.select(decode_text(F.col("b"), F.col("c"))).collect()] == [c[2] for c in cases]
    assert [r[0] for r in rows.limit(1).select(decode_text(F.lit(b"\xc8\xe2"), F.col("c"), "cp1251")).collect()] == ["Ив"]


def _bits(x, single=False):
    kind, whole = ("<f", "<i") if single else ("<d", "<q")
    n = struct.unpack(whole, struct.pack(kind, x))[0]
    return n if n >= 0 else -(n & (2**31 - 1 if single else 2**63 - 1))


def test_ordered_bits_are_the_bit_pattern(spark):
    rng = random.Random(1)
    doubles = [0.0, -0.0, 5e-324, -5e-324, 1e-323, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, math.nextafter(1, 2), math.nextafter(1, 0), 2.0**52, 2.0**1023, 1.7976931348623157e308, -1.7976931348623157e308, 0.1, -3.7]
    doubles += [sign * 2.0**e for e in range(-1074, 1024, 13) for sign in (1, -1)] + [math.nextafter(2.0**e, 0) for e in range(-1073, 1024, 17)] + [rng.uniform(-1, 1) * 2.0 ** rng.randint(-1060, 1020) for _ in range(500)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(doubles)], "i int, x double").select("i", S.ordered_bits(F.col("x")).alias("v"))
    assert [r.v for r in got.orderBy("i").collect()] == [_bits(x) for x in doubles]
    floats = [struct.unpack("<f", struct.pack("<f", x))[0] for x in [0.0, 1.0, -1.0, 1e-45, 1.17549435e-38, 3.4028235e38, 0.1, *[rng.uniform(-1, 1) * 2.0 ** rng.randint(-148, 126) for _ in range(300)]]]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(floats)], "i int, x double").select("i", S.ordered_bits(F.col("x"), single=True).alias("v"))
    assert [r.v for r in got.orderBy("i").collect()] == [_bits(x, single=True) for x in floats]
    assert [r[0] for r in spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(S.ordered_bits(F.col("x"))).collect()] == [None] * 3


def test_almost_equal_by_steps(spark):
    inf, nan, one, top, least = float("inf"), float("nan"), 1.0, 1.7976931348623157e308, 5e-324
    far = lambda x, n: x + n * 2.0**-52
    cases = [
        (one, math.nextafter(one, 2), 1, True), (one, math.nextafter(one, 2), 0, False), (one, far(one, 100), 100, True), (one, far(one, 100), 99, False), (least, 2 * least, 1, True), (top, math.nextafter(top, 0), 1, True),
        (one, far(one, 10**6), 10**6, True), (-one, -far(one, 3), 3, True), (-one, -far(one, 3), 2, False), (-least, least, 2, True), (-least, least, 1, False), (0.0, -0.0, 0, True), (one, -one, 10**9, False), (top, inf, 10**9, False), (inf, inf, 0, True),
        (inf, -inf, 10**9, False), (nan, nan, 10**9, False), (nan, one, 10**9, False), (-top, top, 2**62, False), (None, one, 5, None),
    ]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, a double, b double, n long")
    assert [r.v for r in rows.select("i", S.almost_equal(F.col("a"), F.col("b"), 0.0, F.col("n")).alias("v")).orderBy("i").collect()] == [c[3] for c in cases]
