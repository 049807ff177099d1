"""Scalar functions on columns of header values. All are built-in expressions; null inputs give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INTEGER = r"^[+-]?[0-9]+$"


def clean(text: Column) -> Column:
    """Trimmed text without NUL characters."""
    return F.trim(F.translate(text, "\x00", ""))


def until_nul(text: Column) -> Column:
    """Text before the first NUL."""
    return F.substring_index(text, "\x00", 1)


def _parts(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"\\"), lambda x: x != ""), clean)


def parse_ds(text: Column) -> Column:
    r"""Decimal strings split at ``\`` as array<double>; a comma counts as a point, empty parts are skipped, one bad part makes the whole null."""
    parts = _parts(F.replace(text, F.lit(","), F.lit(".")))
    numbers = F.transform(parts, lambda x: F.when(x.rlike(_NUMBER), x).try_cast("double"))
    return F.when(~F.exists(numbers, lambda x: x.isNull()), numbers)


def parse_is(text: Column) -> Column:
    r"""Integer strings split at ``\`` as array<int>; one bad part makes the whole null."""
    numbers = F.transform(_parts(text), lambda x: F.when(x.rlike(_INTEGER), x).try_cast("int"))
    return F.when(~F.exists(numbers, lambda x: x.isNull()), numbers)


def parse_position(text: Column) -> Column:
    """Exactly three numbers, else null."""
    numbers = parse_ds(text)
    return F.when(F.size(numbers) == 3, numbers)


def parse_orientation(text: Column) -> Column:
    """Exactly six numbers, else null."""
    numbers = parse_ds(text)
    return F.when(F.size(numbers) == 6, numbers)


def parse_spacing(text: Column) -> Column:
    """Two numbers, or one taken twice, else null."""
    numbers = parse_ds(text)
    return F.when(F.size(numbers) == 2, numbers).when(F.size(numbers) == 1, F.array_repeat(numbers[0], 2))


def _name(group: Column) -> Column:
    part = F.transform(F.split(group, r"\^"), clean)
    n = F.size(part)
    lead = lambda i: F.when(part[i] != "", F.concat(part[i], F.lit(" "))).otherwise("")
    suffix = F.when(part[4] != "", F.concat(F.lit(", "), part[4])).otherwise("")
    order = F.when(n == 1, part[0]).when(n == 2, F.concat(lead(1), part[0])).when(n == 3, F.concat(lead(1), lead(2), part[0]))
    return order.when(n == 4, F.concat(lead(3), lead(1), lead(2), part[0])).when(n == 5, F.concat(lead(3), lead(1), lead(2), part[0], suffix)).otherwise(group)


def format_pn(text: Column) -> Column:
    """Person names: groups at ``=`` joined by a blank where something stands before, each as "prefix given middle family, suffix"; over five parts stay raw."""
    names = F.transform(F.split(text, "="), _name)
    return F.aggregate(names, F.lit(""), lambda a, x: F.concat(a, F.when(a != "", " ").otherwise(""), x))


def format_date(text: Column) -> Column:
    """``yyyyMMdd`` as ``d MMM yyyy``; anything else, null too, is ''."""
    date = F.when(text.rlike("^[0-9]{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    return F.coalesce(F.date_format(date, "d MMM yyyy"), F.lit(""))


def _hex(tag: Column, at: int) -> Column:
    return F.conv(F.substring(tag, at, 4), 16, 10).cast("int")


def tag_flags(tag: Column) -> Column:
    """Struct of ``is_public``, ``is_private``, ``is_creator``, ``is_group_length`` and ``is_illegal`` of an eight-digit hex tag."""
    group, element = _hex(tag, 1), _hex(tag, 5)
    private = group % 2 == 1
    illegal = group.isin(1, 3, 5, 7) | (private & element.between(1, 15))
    return F.struct((~private).alias("is_public"), private.alias("is_private"), (private & element.between(0x10, 0xFF)).alias("is_creator"), (element == 0).alias("is_group_length"), illegal.alias("is_illegal"))


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def components(array: Column, start: int = 0) -> list[Column]:
    return [array[start + i] for i in range(3)]


def normal(iop: Column) -> list[Column]:
    """Row x column direction of an orientation of six cosines."""
    return cross(components(iop), components(iop, 3))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def orientation_code(iop: Column) -> Column:
    """A letter of R/L, A/P, I/S for the row, column and normal direction, by the largest absolute component; of equal ones the last."""

    def letter(v: Column) -> Column:
        sizes = F.transform(v, F.abs)
        at = 3 - F.array_position(F.reverse(sizes), F.array_max(sizes)) + 1
        return F.when(F.element_at(v, at.cast("int")) > 0, F.substring(F.lit("RAI"), at.cast("int"), F.lit(1))).otherwise(F.substring(F.lit("LPS"), at.cast("int"), F.lit(1)))

    def code(o: Column) -> Column:
        return F.array_join(F.transform(F.array(F.slice(o, 1, 3), F.slice(o, 4, 3), F.array(*normal(o))), letter), "")

    return F.when(F.size(iop) == 6, let(iop, code))


def direction_letters(x: Column, y: Column, z: Column, threshold: float = 1e-4) -> Column:
    """Up to three letters R/L, A/P, F/H in falling size; stops at a component within the threshold or at a tie."""
    named = F.array(*[F.struct(F.abs(v).alias("size"), F.when(v < 0, low).otherwise(high).alias("letter")) for v, low, high in ((x, "R", "L"), (y, "A", "P"), (z, "F", "H"))])

    def letters(sorted_: Column) -> Column:
        s = [sorted_[i]["size"] for i in range(3)]
        ok1 = (s[0] > threshold) & (s[0] > s[1])
        ok2, ok3 = ok1 & (s[1] > threshold) & (s[1] > s[2]), (s[2] > threshold)
        pick = lambda ok, i: F.when(ok, sorted_[i]["letter"]).otherwise("")
        return F.concat(pick(ok1, 0), pick(ok2, 1), pick(ok2 & ok3, 2))

    return let(F.sort_array(named, asc=False), letters)


def plane_type(iop: Column, threshold: float = 0.8) -> Column:
    """AXIAL, CORONAL or SAGITTAL by the major axes of row and column; OBLIQUE without one; UNKNOWN if both are the same."""

    def axis(v: Column) -> Column:
        sizes = F.transform(v, F.abs)
        most = F.array_max(sizes)
        alone = F.size(F.filter(sizes, lambda x: x == most)) == 1
        return F.when((most > threshold) & alone, F.array_position(sizes, most).cast("int")).otherwise(0)

    def kind(axes: Column) -> Column:
        total = axes[0] + axes[1]
        named = F.when(axes[0] == axes[1], "UNKNOWN").when(total == 3, "AXIAL").when(total == 4, "CORONAL").otherwise("SAGITTAL")
        return F.when((axes[0] == 0) | (axes[1] == 0), "OBLIQUE").otherwise(named)

    return F.when(F.size(iop) == 6, let(F.transform(F.array(F.slice(iop, 1, 3), F.slice(iop, 4, 3)), axis), kind))


def ordered_bits(x: Column, single: bool = False) -> Column:
    """A whole number that orders as the floating-point numbers do: neighbours differ by one, both zeros are 0.

    It is the number's bit pattern, with the sign before it, from its exponent and significand; scaling by powers of
    two is exact. ``single`` counts in steps of single precision. Null for NaN and infinities.
    """
    digits, least, bias = (23, -126, 127) if single else (52, -1022, 1023)
    size = F.abs(x.cast("double"))
    power = lambda n: F.pow(F.lit(2.0), n)

    def bits(guess: Column) -> Column:
        # the logarithm may be off by one beside a power of two; above the largest one there is no next
        exponent = F.when(power(guess) > size, guess - 1).when((guess < bias) & (power(F.least(guess + 1, F.lit(bias))) <= size), guess + 1).otherwise(guess)
        scale = digits - F.greatest(exponent, F.lit(least))
        half = F.floor(scale / 2)
        whole = (size * power(half) * power(scale - half)).cast("long")
        return F.when(exponent < least, whole).otherwise((exponent + bias).cast("long") * (1 << digits) + whole - (1 << digits))

    found = F.when(size == 0, F.lit(0).cast("long")).when(size < float("inf"), let(F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size))), bits))
    return F.when(x < 0, -found).otherwise(found)


def ulp_distance(a: Column, b: Column, single: bool = False) -> Column:
    """How many representable numbers b is from a."""
    return F.abs(ordered_bits(a, single).cast("decimal(20,0)") - ordered_bits(b, single).cast("decimal(20,0)"))


def almost_equal(a: Column, b: Column, eps: Column | float, max_ulps: Column | int | None = None, single: bool = False) -> Column:
    """|a - b| <= eps, or at most ``max_ulps`` representable numbers apart; NaN equals nothing, an infinity only itself."""
    eps = eps if isinstance(eps, Column) else F.lit(eps)
    infinite = (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
    near = F.abs(a - b) <= eps
    if max_ulps is not None:
        near = near | (ulp_distance(a, b, single) <= (max_ulps if isinstance(max_ulps, Column) else F.lit(max_ulps)))
    return F.when(F.isnan(a) | F.isnan(b), False).when(infinite, a == b).otherwise(near)


def distance_to_plane(point: list[Column], origin: list[Column], direction: list[Column]) -> Column:
    return F.abs(dot(direction, [p - o for p, o in zip(point, origin, strict=True)]))


def index_to_patient(index: list[Column], origin: Column, spacing: Column, iop: Column) -> list[Column]:
    """Patient coordinates of column, row and slice numbers: origin + spacing times the three directions."""
    axes = [components(iop), components(iop, 3), normal(iop)]
    return [origin[i] + sum((index[k] * spacing[k] * axes[k][i] for k in (1, 2)), index[0] * spacing[0] * axes[0][i]) for i in range(3)]


def patient_to_index(point: list[Column], origin: Column, spacing: Column, iop: Column) -> list[Column]:
    """The inverse of ``index_to_patient`` for orthonormal directions."""
    step = [point[i] - origin[i] for i in range(3)]
    return [dot(step, axis) / spacing[k] for k, axis in enumerate((components(iop), components(iop, 3), normal(iop)))]


def measure_mm(x0: Column, y0: Column, x1: Column, y1: Column, spacing: Column, iop: Column, rows: Column, cols: Column) -> Column:
    """Distance in patient space between two points of an image (column, row); -1 if one lies outside."""
    inside = (x0 >= 0) & (y0 >= 0) & (x1 >= 0) & (y1 >= 0) & (x0 < cols) & (y0 < rows) & (x1 < cols) & (y1 < rows)
    row, col = components(iop), components(iop, 3)
    step = [(x1 - x0) * spacing[0] * row[i] + (y1 - y0) * spacing[1] * col[i] for i in range(3)]
    return F.when(inside, F.sqrt(dot(step, step))).otherwise(F.lit(-1.0))


def acq_datetime(stamp: Column, date: Column, time: Column) -> Column:
    """Struct of ``date`` and ``time``: a stamp of 14 characters or more split at 8, else the pair if both are there, else blanks."""
    whole, pair = F.coalesce(F.length(stamp) >= 14, F.lit(False)), date.isNotNull() & time.isNotNull()
    return F.struct(F.when(whole, F.substring(stamp, 1, 8)).when(pair, date).otherwise("").alias("date"), F.when(whole, F.substring(stamp, 9, 1_000_000)).when(pair, time).otherwise("").alias("time"))


def pet_unit(units: Column, suv_type: Column) -> Column:
    """Unit label; for GML and CM2ML the SUV type follows in braces."""
    named = F.coalesce(units, F.lit(""))
    return F.when(named.isin("GML", "CM2ML") & (F.coalesce(suv_type, F.lit("")) != ""), F.concat(named, F.lit(" {"), suv_type, F.lit("}"))).otherwise(named)


def read_window(center: Column, width: Column, function: Column) -> Column:
    """Struct of the first ``center`` and ``width`` and of the ``function``: SIGMOID, LINEAR_EXACT or else LINEAR."""
    named = F.upper(clean(function))
    return F.struct(F.get(parse_ds(center), F.lit(0)).alias("center"), F.get(parse_ds(width), F.lit(0)).alias("width"), F.when(named.isin("SIGMOID", "LINEAR_EXACT"), named).otherwise("LINEAR").alias("function"))


def default_window(center: Column, width: Column, function: Column, vmin: Column, vmax: Column, rmin: Column, rmax: Column, is_8bit: Column) -> Column:
    """Struct of ``center``, ``width`` and ``function``.

    The given window stays unless it is undefined, wider than the range of the values or centred outside. Then 8-bit
    images take 128 and 255, others the range of the values (that of the type if they are all equal), or half of the
    largest and its size. A LINEAR window of width 1 or less, or over a range of 1 or less, becomes LINEAR_EXACT.
    """
    span = vmax - vmin
    bad = width.isNull() | center.isNull() | (width > span) | (center > vmax) | (center < vmin)
    range_, low = F.when(span > 0, span).otherwise(rmax - rmin), F.when(span > 0, vmin).otherwise(rmin)
    new_center = F.when(is_8bit, F.lit(128.0)).when(range_ > 0, range_ / 2 + low).otherwise(0.5 * vmax)
    new_width = F.when(is_8bit, F.lit(255.0)).when(range_ > 0, range_).otherwise(F.abs(vmax))
    w = F.when(bad, new_width).otherwise(width)
    linear = F.when(bad & is_8bit, F.lit("LINEAR_EXACT")).otherwise(function)
    exact = F.when((linear == "LINEAR") & ((w <= 1) | (span <= 1)), "LINEAR_EXACT").otherwise(linear)
    return F.struct(F.when(bad, new_center).otherwise(center).alias("center"), w.alias("width"), exact.alias("function"))
