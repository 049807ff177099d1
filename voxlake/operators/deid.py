"""De-identification of element tables: consistent pseudonyms, date shifts, structure edits and stamps.

Elements are rows (file_id, path, tag, vr, value); an item under a removed tag goes with it, found by the tags of its
path. Pseudonyms are keyed hashes, so retries and later runs agree, and equal values of different files map alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.functions.scalars import clean, let, tag_flags
from voxlake.operators.deid_tags import DATE_TAGS, ID_TAGS, KEPT_DATES, NAME_TAGS, PROFILE, UID_TAGS  # noqa: F401
from voxlake.operators.typing import listed_dictionary, typed
from voxlake.sources.shared import checkpointed, numbered, written

#: Values that are looked up in every task; more of them join by value.
BROADCAST_ROWS = 100_000
#: UIDs that the standard itself gives begin so.
STANDARD_ROOT = "1.2.840.10008."
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
INITIALS = [f"{chr(65 + i)}." for i in range(26)]


def _digits(text: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(text, at, n), 16, 10).cast("long")


def _uid_of(sha: Column) -> Column:
    return F.concat(F.lit("2.25."), (_digits(sha, 1, 15) + 1).cast("string"), F.lpad(_digits(sha, 16, 15).cast("string"), 19, "0"))


def _name_of(md5: Column, surnames: list[str] | None) -> Column:
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (_digits(md5, at, 8) % len(values) + 1).cast("int"))
    return F.concat(pick(surnames or INITIALS, 1), F.lit("^"), pick(INITIALS, 9), F.lit("^"), pick(INITIALS, 17), F.lit("^^"))


def _id_of(sha: Column) -> Column:
    return F.concat(*[F.substring(F.lit(ALPHABET), (_digits(sha, i * 5 + 1, 5) % 62 + 1).cast("int"), F.lit(1)) for i in range(11)])


def _sha(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), value), 256)


def _md5(value: Column, salt: str) -> Column:
    return F.md5(F.concat(F.lit(salt), value).cast("binary"))


def pseudo_uid(uid: Column, salt: str) -> Column:
    """``2.25.`` and a number from the keyed SHA-256 of the identifier."""
    return let(_sha(uid, salt), _uid_of)


def pseudo_name(name: Column, salt: str, surnames: list[str] | None = None) -> Column:
    """``S^A.^B.^^`` by the MD5 of the name; without surnames the first part is an initial too."""
    return let(_md5(name, salt), lambda h: _name_of(h, surnames))


def pseudo_id(value: Column, salt: str) -> Column:
    """Eleven characters of [0-9A-Za-z] by the keyed SHA-256."""
    return let(_sha(value, salt), _id_of)


def _listed(elements: DataFrame) -> DataFrame:
    """Elements with text where the lists know what an unknown binary value is."""
    return typed(elements, listed_dictionary())


def _replaced(elements: DataFrame, where: Column, value: Column) -> DataFrame:
    """Another value where a condition holds; the bytes of the old one go, its length follows."""
    where = F.coalesce(where, F.lit(False))
    new = {"value": value, "value_bin": F.lit(None), "vl": F.octet_length(value).cast("long")}
    return elements.withColumns({c: F.when(where, new[c]).otherwise(F.col(c)) for c in new if c in elements.columns})


def _is_name(name_tags: list[str] = NAME_TAGS) -> Column:
    return (F.col("vr") == "PN") | F.col("tag").isin(name_tags)


def _distinct(elements: DataFrame, wanted: Column) -> DataFrame:
    return _listed(elements).filter(wanted).select(clean(F.col("value")).alias("old")).filter("old <> ''").distinct()


def build_uid_map(elements: DataFrame, uid_tags: list[str] = UID_TAGS, salt: str = "") -> DataFrame:
    """``old`` and ``new`` of every distinct value of the identifier tags, at any depth."""
    return _distinct(elements, F.col("tag").isin(uid_tags)).withColumn("new", pseudo_uid(F.col("old"), salt))


def build_name_map(elements: DataFrame, salt: str = "", surnames: list[str] | None = None) -> DataFrame:
    """``old`` and ``new`` of every distinct person name, by representation or tag; different names may share a pseudonym."""
    return _distinct(elements, _is_name()).withColumn("new", pseudo_name(F.col("old"), salt, surnames))


def build_id_map(elements: DataFrame, id_tags: list[str] = ID_TAGS, salt: str = "") -> DataFrame:
    """``old`` and ``new`` of every distinct value of the id tags."""
    return _distinct(elements, F.col("tag").isin(id_tags)).withColumn("new", pseudo_id(F.col("old"), salt))


def build_maps(elements: DataFrame, salt: str = "", uid_tags: list[str] = UID_TAGS, id_tags: list[str] = ID_TAGS, surnames: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The maps of ``build_uid_map``, ``build_name_map`` and ``build_id_map``, for which the elements are read once."""
    kinds = {"uid": F.col("tag").isin(uid_tags), "name": _is_name(), "id": F.col("tag").isin(id_tags)}
    marked = _listed(elements).select(clean(F.col("value")).alias("old"), F.array_compact(F.array(*[F.when(own, kind) for kind, own in kinds.items()])).alias("kinds"))
    found = written(marked.filter("old <> ''").select(F.explode("kinds").alias("kind"), "old").distinct())
    new = {"uid": pseudo_uid(F.col("old"), salt), "name": pseudo_name(F.col("old"), salt, surnames), "id": pseudo_id(F.col("old"), salt)}
    return tuple(found.filter(F.col("kind") == kind).select("old", column.alias("new")) for kind, column in new.items())


def apply_maps(elements: DataFrame, uids: DataFrame, names: DataFrame, ids: DataFrame, uid_tags: list[str] = UID_TAGS, id_tags: list[str] = ID_TAGS, preserve_uids: bool = False) -> DataFrame:
    """Values replaced by their pseudonyms; unmapped ones stay.

    UIDs by tag or VR, names by VR or tag, ids by tag. With ``preserve_uids`` only (0400,0100) changes. One join by value
    over the three maps together: in every task up to ``BROADCAST_ROWS`` of them, so that values of very many rows
    are no key; rows of no kind are dealt by file, so they do not meet in one task either and the elements are read once.
    The maps are read twice, and all elements are shuffled by value if the maps are large. Where the maps are the
    elements' own, ``pseudonymised`` gives the same rows without either.
    """
    uid = F.col("tag") == "04000100" if preserve_uids else F.col("tag").isin(uid_tags) | (F.col("vr") == "UI")
    kind = F.when(F.col("tag").isin(id_tags), "id").when(F.coalesce(uid, F.lit(False)), "uid").when(_is_name(), "name")
    maps = uids.withColumn("kind", F.lit("uid")).unionByName(names.withColumn("kind", F.lit("name"))).unionByName(ids.withColumn("kind", F.lit("id")))
    maps = F.broadcast(maps) if maps.count() <= BROADCAST_ROWS else maps.hint("merge")  # a file may be too small to tell its rows
    own = F.when(F.col("_kind") == "", F.col("file_id").cast("string")).otherwise(clean(F.col("value")))
    marked = _listed(elements).withColumn("_kind", F.coalesce(kind, F.lit(""))).withColumn("_old", own)
    new = marked.join(maps.select(F.col("kind").alias("_kind"), F.col("old").alias("_old"), F.col("new").alias("_new")), ["_kind", "_old"], "left")
    return _replaced(new, F.col("_new").isNotNull(), F.col("_new")).select(*elements.columns)


def _moved_uids(source: DataFrame, uid_tags: list[str], id_tags: list[str], salt: str) -> DataFrame | None:
    """``_old`` and ``_new`` of the UIDs under other tags that are identifiers too; None if there are none.

    The few values of other tags are looked for among the identifiers, not the other way round: without any, nothing
    but their tags is read.
    """
    old = clean(F.col("value"))
    found = checkpointed(source.filter(_other_uid(uid_tags, id_tags)).select(old.alias("_old")).filter("_old <> ''").distinct())
    n = found.count()
    if not n:
        return None
    known = source.filter(F.col("tag").isin(uid_tags)).select(old.alias("_old"))
    if n <= BROADCAST_ROWS:
        known = known.join(F.broadcast(found), "_old", "left_semi")
    moved = checkpointed(found.join(known.distinct(), "_old", "left_semi").select("_old", pseudo_uid(F.col("_old"), salt).alias("_new")))
    return None if moved.isEmpty() else moved


def _other_uid(uid_tags: list[str], id_tags: list[str]) -> Column:
    """A UID under a tag of no list that the standard itself doesn't name (classes, syntaxes)."""
    return F.coalesce((F.col("vr") == "UI") & ~F.col("tag").isin(uid_tags) & ~F.col("tag").isin(id_tags) & ~F.startswith(clean(F.col("value")), F.lit(STANDARD_ROOT)), F.lit(False))


def _looked_up(elements: DataFrame, moved: DataFrame, uid_tags: list[str], id_tags: list[str]) -> DataFrame:
    old, other = clean(F.col("value")), _other_uid(uid_tags, id_tags)
    if moved.count() <= BROADCAST_ROWS:
        found = elements.join(F.broadcast(moved), other & (old == F.col("_old")), "left")
    else:  # rows without a lookup are dealt by file
        key = F.when(other, F.concat(F.lit("v"), old)).otherwise(F.concat(F.lit("f"), F.col("file_id").cast("string")))
        found = elements.withColumn("_key", key).join(moved.withColumn("_key", F.concat(F.lit("v"), "_old")), "_key", "left")
    return _replaced(found, F.col("_new").isNotNull(), F.col("_new")).select(*elements.columns)


def _hashed(rows: DataFrame, salt: str, uid_tags: list[str], id_tags: list[str], name_tags: list[str], preserve_uids: bool) -> DataFrame:
    """Adds ``_kind`` (1 id, 2 UID, 3 name; null for others and blank values) and the hash ``_hash`` that the pseudonym comes from."""
    old = clean(F.col("value"))
    uid = F.col("tag").isin([t for t in uid_tags if t == "04000100"] if preserve_uids else uid_tags)
    kind = F.when(F.col("tag").isin(id_tags), 1).when(uid, 2).when(_is_name(name_tags), 3)
    rows = rows.withColumn("_kind", F.when(old != "", kind))
    return rows.withColumn("_hash", F.when(F.col("_kind") == 3, _md5(old, salt)).when(F.col("_kind") < 3, _sha(old, salt)))


def _pseudonym(surnames: list[str] | None) -> Column:
    """The pseudonym of a ``_hashed`` row; null for others."""
    return F.when(F.col("_kind") == 1, _id_of(F.col("_hash"))).when(F.col("_kind") == 2, _uid_of(F.col("_hash"))).when(F.col("_kind") == 3, _name_of(F.col("_hash"), surnames))


def pseudonymised(elements: DataFrame, source: DataFrame, salt: str = "", uid_tags: list[str] = UID_TAGS, id_tags: list[str] = ID_TAGS, surnames: list[str] | None = None, preserve_uids: bool = False, name_tags: list[str] = NAME_TAGS) -> DataFrame:
    """The same values as ``apply_maps`` with the maps of ``source``, without a join for those that are mapped anyway.

    A pseudonym is a hash of its value, so tags of the lists and person names take it in the projection. Only UIDs
    under other tags have to be looked up among the identifiers of ``source``. What the standard itself names
    (classes, syntaxes) is no identity and takes no part, so no value of all files is a join key.
    """
    rows = _listed(elements)
    moved = None if preserve_uids else _moved_uids(_listed(source), uid_tags, id_tags, salt)
    if moved is not None:
        rows = _looked_up(rows, moved, uid_tags, id_tags)
    hashed = _hashed(rows, salt, uid_tags, id_tags, name_tags, preserve_uids).withColumn("_new", _pseudonym(surnames))
    return _replaced(hashed, F.col("_new").isNotNull(), F.col("_new")).select(*rows.columns)


def single_identity(elements: DataFrame, name: str = "", pid: str = "") -> DataFrame:
    """One-patient mode, if either text is given: the name where given, the id even when blank; blanks become ``^``."""
    if not name and not pid:
        return elements
    return _replaced(elements, F.col("tag").isin(["00100020", "00100010"] if name else ["00100020"]), F.when(F.col("tag") == "00100020", F.lit(pid.replace(" ", "^"))).otherwise(F.lit(name.replace(" ", "^"))))


def single_patient_guard(elements: DataFrame) -> DataFrame:
    """``n_patients`` and ``refused``: whether there is more than one patient id."""
    ids = _listed(elements).filter("tag = '00100020'").agg(F.countDistinct(clean(F.col("value"))).alias("n_patients"))
    return ids.withColumn("refused", F.col("n_patients") > 1)


def _under(tags: list[str]) -> Column:
    return F.exists("path", lambda step: step["tag"].isin(tags))


def remove_tags(elements: DataFrame, tags: list[str]) -> DataFrame:
    """Without the tags and all items under them, at any depth."""
    return elements.filter(~(F.col("tag").isin(tags) | _under(tags))) if tags else elements


def empty_tags(elements: DataFrame, tags: list[str]) -> DataFrame:
    """Values of the tags blanked; a blanked sequence loses its items."""
    return zero_sequences(elements, tags)


def zero_sequences(elements: DataFrame, tags: list[str]) -> DataFrame:
    """The tags stay, empty; what lies under them goes."""
    if not tags:
        return elements
    return _replaced(elements.filter(~_under(tags)), F.col("tag").isin(tags), F.lit(""))


def _odd(tag: Column) -> Column:
    return F.substring(tag, 4, 1).isin(*"13579BDF")


def remove_private(elements: DataFrame) -> DataFrame:
    """Without odd groups, at any depth."""
    return elements.filter(~(_odd(F.col("tag")) | F.exists("path", lambda step: _odd(step["tag"]))))


def remove_group_length(elements: DataFrame) -> DataFrame:
    return elements.filter(~tag_flags(F.col("tag"))["is_group_length"])


def _repeating(prefix: str) -> Column:
    """Even groups xx00 to xxFF at the top level, and items under them."""
    group = F.when(F.size("path") > 0, F.get("path", F.lit(0))["tag"]).otherwise(F.col("tag"))
    return group.startswith(prefix) & ~_odd(group)


def remove_overlays(elements: DataFrame) -> DataFrame:
    """Without overlays (60xx, even) and graphic annotations."""
    return remove_tags(elements.filter(~_repeating("60")), ["00700001"])


def remove_curves(elements: DataFrame) -> DataFrame:
    """Without curves (50xx, even)."""
    return elements.filter(~_repeating("50"))


def is_date_time(vr: Column, tag: Column) -> Column:
    return vr.isin("DA", "TM", "DT") & ~tag.isin(KEPT_DATES)


def _hour(value: Column, vr: Column) -> Column:
    return F.when(vr == "TM", F.substring(value, 1, 2)).when((vr == "DT") & (F.length(value) >= 10), F.substring(value, 9, 2))


def has_early_time(elements: DataFrame) -> DataFrame:
    """``file_id`` and ``early``: whether a time or stamp of the file has an hour below one."""
    return _listed(elements).groupBy("file_id").agg(F.bool_or(_early()).alias("early"))


def _values() -> Column:
    return F.split(clean(F.col("value")), r"\\")


def _several() -> Column:
    return F.contains("value", F.lit("\\"))


def _early() -> Column:
    """Whether a row has a time or stamp, of those that move, with an hour below one."""
    zero = lambda x: F.coalesce(_hour(x, F.col("vr")) == "00", F.lit(False))
    one = F.when(_several(), F.exists(_values(), lambda x: zero(F.trim(x)))).otherwise(zero(clean(F.col("value"))))
    return F.coalesce(F.when(is_date_time(F.col("vr"), F.col("tag")), one), F.lit(False))


def _with_shifted(rows: DataFrame, early: Column, offset: tuple[int, int, int, int]) -> tuple[DataFrame, Column]:
    """Rows with columns that the moved value needs, and the moved value; null where nothing moves.

    Only several values in one, which are rare, take a lambda that Spark interprets.
    """

    def bind(name: str, column: Column, then: Callable[[Column], Column]) -> Column:
        nonlocal rows
        rows = rows.withColumn(f"_date_{name}", column)
        return then(F.col(f"_date_{name}"))

    one = bind("one", F.when(_moves() & ~_several(), clean(F.col("value"))), lambda column: column)
    single = _moved(one, F.col("vr"), early, *offset, bind=bind)
    several = F.array_join(F.transform(_values(), lambda x: F.when(F.trim(x) == "", "").otherwise(_moved(F.trim(x), F.col("vr"), early, *offset))), "\\")
    return rows, F.when(one.isNotNull(), single).when(_moves(), several)


def _moves() -> Column:
    return is_date_time(F.col("vr"), F.col("tag")) & (clean(F.col("value")) != "")


def _back(date: Column, years: int, months: int, days: int) -> Column:
    """Years, then months, then days earlier; each step keeps within the month."""
    return F.date_sub(F.add_months(F.add_months(date, -12 * years), -months), days)


def _part(text: Column, at: int, n: int) -> Column:
    return F.substring(text, at, n).try_cast("int")


def _date(text: Column) -> Column:
    """The date of eight digits; null if there is none."""
    return F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)).try_cast("date")


def _digits_of(date: Column) -> Column:
    return F.replace(date.cast("string"), F.lit("-"), F.lit(""))


def _two(number: Column) -> Column:
    return F.lpad(F.floor(number).cast("string"), 2, "0")


def _clock(text: Column, at: int) -> Column:
    """Seconds of the six digits from a place on; null if they are no time."""
    h, m, s = (_part(text, at + k, 2) for k in (0, 2, 4))
    return F.when((h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)


def _six(seconds: Column) -> Column:
    return F.concat(_two(seconds / 3600), _two(seconds / 60 % 60), _two(seconds % 60))


def _moved(value: Column, vr: Column, early: Column, years: int, months: int, days: int, seconds: int, bind=lambda name, column, then: let(column, then)) -> Column:
    """A moved date, time or stamp; blank for other shapes. ``bind`` keeps what is used more than once."""
    n = F.length(value)
    blank = F.lit("")
    minus, plus, dot = F.instr(value, "-"), F.instr(value, "+"), F.instr(value, ".")
    zoned = F.when((minus == 0) & (plus == 0), value).when((minus > 0) & (plus > 0), blank).when(minus > 4, F.substring_index(value, "-", 1)).when(plus > 4, F.substring_index(value, "+", 1)).otherwise(blank)

    def result(stamp: Column, k: Column, first: Column, back: Column, at: Column, clock: Column) -> Column:
        # times go round midnight and keep no day; stamps go on to the day before
        whole = F.concat(_digits_of(F.date_add(back, F.floor(at / 86_400).cast("int"))), clock)
        da = F.when(k == 8, _digits_of(back))
        tm = F.when(dot == 7, F.concat(F.when(early, F.substring(value, 1, 6)).otherwise(F.coalesce(clock, blank)), F.lit(".000000")))
        tm = tm.when(dot > 0, blank).when(early & (n == 6), F.concat(value, F.lit(".000000"))).when(n == 2, value).when(n == 4, F.when(early, value).otherwise(F.substring(clock, 1, 4))).when(n == 6, clock)
        dt = F.when(k.isNull(), blank).when(k == 4, F.substring(_digits_of(F.add_months(first, -12 * years)), 1, 4)).when(k == 6, F.substring(_digits_of(_back(first, years, months, 0)), 1, 6)).when(k == 8, _digits_of(back))
        dt = dt.when(k.isin(10, 12, 14), F.substring(whole, F.lit(1), k)).when((k >= 15) & (F.instr(stamp, ".") == 15), F.concat(whole, F.lit(".000000"))).otherwise(blank)
        return F.coalesce(F.when(vr == "DA", da).when(vr == "TM", tm).when(vr == "DT", dt), blank)

    def with_stamp(stamp: Column) -> Column:
        return bind("k", F.when(F.substring(stamp, 1, 14).rlike("^[0-9]+$"), F.length(stamp)), lambda k: with_length(stamp, k))

    def with_length(stamp: Column, k: Column) -> Column:
        return bind("padded", F.concat(F.substring(stamp, 1, 14), F.substring(F.lit("00000101000000"), k + 1, F.lit(14))), lambda padded: bind("first", _date(padded), lambda first: with_first(stamp, k, padded, first)))

    def with_first(stamp: Column, k: Column, padded: Column, first: Column) -> Column:
        at = _clock(padded, 9) - F.when(early, 0).otherwise(seconds)
        return bind("back", _back(first, years, months, days), lambda back: bind("at", at, lambda at: bind("clock", _six(F.pmod(at, F.lit(86_400))), lambda clock: result(stamp, k, first, back, at, clock))))

    return bind("stamp", F.when(vr == "DT", zoned).when((vr == "DA") & (n == 8), value).when(vr == "TM", F.concat(F.lit("20000102"), F.substring(value, 1, 6))), with_stamp)


def shift_dates(elements: DataFrame, years: int, months: int, days: int, seconds: int) -> DataFrame:
    r"""All dates, times and stamps but five tags moved into the past by one offset.

    Dates of eight digits step back by years, months and days, within the month at each step. Times of 4 or 6 digits
    or 6 and a fraction step back by seconds, around midnight, unless the file has an hour below one; a fraction
    becomes zeros. Stamps move by what their length holds and lose their zone. Values between ``\`` move one by one;
    other shapes become empty. Empty values stay as they are.
    """
    rows = _listed(elements)
    marked = rows.withColumn("_early", F.max(_early()).over(Window.partitionBy("file_id")))
    staged, moved = _with_shifted(marked, F.col("_early"), (years, months, days, seconds))
    return _replaced(staged, moved.isNotNull(), moved).select(*rows.columns)


def default_offset(salt: str) -> tuple[int, int, int, int]:
    """One offset for a run, by its salt: 1 to 2 years, 1 to 3 months, 1 to 4 days and 1 to 1999 seconds."""
    found = hashlib.sha256(b"offset" + salt.encode()).digest()
    return tuple(1 + int.from_bytes(found[4 * i : 4 * i + 4]) % most for i, most in enumerate((2, 3, 4, 1999)))


def stamp_profile(elements: DataFrame, text: str, options: dict[str, bool], files: DataFrame | None = None) -> DataFrame:
    """Adds the removed-identity mark, the method's text and an item with a code for each option that holds.

    Codes: 113100 basic profile; 113101 pixel data, 113102 recognisable features (when asked for); 113103 graphics,
    113104 structured content, 113105 descriptors (these three when such content was *not* removed); 113106 full
    dates or 113107 modified dates; 113108 patient characteristics, 113109 device, 113112 institution, 113110 UIDs
    kept; 113111 safe private. ``files`` are the files to mark, by default those of the elements.
    """
    files = elements.select("file_id").distinct() if files is None else files
    new = files.withColumn("_row", F.explode(F.array(*[F.struct(*[v.alias(c) for c, v in row.items()]) for row in _stamp_rows(text, options)]))).select("file_id", "_row.*")
    return remove_tags(elements, STAMP_TAGS).unionByName(new, allowMissingColumns=True)


STAMP_TAGS = ["00120062", "00120063", "00120064"]


def _stamp_rows(text: str, options: dict[str, bool]) -> list[dict[str, Column]]:
    """The rows of a stamp: path, tag, vr, value."""
    codes = ["113100"]
    codes += [code for code, name in (("113101", "clean_pixels"), ("113102", "clean_features"), ("113106", "keep_dates"), ("113107", "shift_dates"), ("113108", "keep_patient"), ("113109", "keep_device"), ("113112", "keep_institution"), ("113110", "keep_uids"), ("113111", "keep_private")) if options.get(name)]
    codes += [code for code, name in (("113103", "remove_graphics"), ("113104", "remove_structured"), ("113105", "remove_descriptions")) if not options.get(name)]
    row = lambda path, tag, vr, value: {"path": path, "tag": F.lit(tag), "vr": F.lit(vr), "value": F.lit(value)}
    top = F.array().cast("array<struct<tag:string,item:int>>")
    rows = [row(top, "00120062", "CS", "YES"), row(top, "00120063", "LO", text), row(top, "00120064", "SQ", "")]
    for i, code in enumerate(sorted(codes), 1):
        path = F.array(F.struct(F.lit("00120064").alias("tag"), F.lit(i).alias("item")))
        rows += [row(path, "00080100", "SH", code), row(path, "00080102", "SH", "DCM")]
    return rows


TOPICS = {"": "", "description": "keep_descriptions", "device": "keep_device", "patient": "keep_patient", "institution": "keep_institution"}


def profile_actions(profile: dict[str, list[str]], options: dict) -> tuple[set[str], set[str]]:
    """Tags that go and tags that are blanked, by the topics that the options don't keep; what goes isn't blanked."""
    gone, blank = set(), set(profile.get("zero", [])) | set(profile.get("structured_zero", []) if options.get("remove_structured") else [])
    for topic, keep in TOPICS.items():
        if keep and options.get(keep):
            continue
        name = f"{topic}_" if topic else ""
        blank |= {*profile.get(f"{name}empty", []), *profile.get(f"{name}replace", [])}
        gone |= {*profile.get(f"{name}remove", [])}
    return gone, blank - gone


def deidentify(elements: DataFrame, profile: dict[str, list[str]] = PROFILE, options: dict | None = None, salt: str = "", uid_tags: list[str] = UID_TAGS, id_tags: list[str] = ID_TAGS, name_tags: list[str] = NAME_TAGS, vr_of: dict[str, str] | None = None) -> DataFrame:
    """All steps in one pass: private tags, graphics, zeroed, emptied and removed tags by topic, dates, UIDs, names, ids, group lengths, stamp.

    Values without a representation are typed first, by the lists and ``vr_of`` (``typing.dictionary_of`` makes one from
    the files in explicit form); what stays unknown and binary is removed, as nobody can say what it holds. No bytes of
    a replaced value stay. Dates move by ``offset`` (years, months, days, seconds), by default one that the salt gives,
    unless ``keep_dates``. Files with a tag twice in one data set are refused: none of their rows comes out. More options: ``keep_*``
    and ``remove_*`` flags as in ``stamp_profile``, ``name`` and ``id`` for a single patient (set last, so they stay),
    ``text`` of the stamp.

    What goes and what is blanked is one test of the tag and one of the path. Rows are dealt by file once; one sort
    finds tags that are there twice, the file's first row, which brings the stamp, and hours below one.
    """
    options = options or {}
    if options.get("keep_dates") and options.get("offset"):
        raise ValueError("dates are kept or moved by an offset, not both")
    offset = None if options.get("keep_dates") else options.get("offset") or default_offset(salt)
    rows = typed(elements, listed_dictionary() | (vr_of or {}))
    gone, blank = profile_actions(profile, options)
    graphics = options.get("remove_graphics", True)
    gone |= set(STAMP_TAGS) | ({"00700001"} if graphics else set())
    below = sorted(gone | blank)
    private = (lambda tag: F.lit(False)) if options.get("keep_private") else _odd
    leaves = F.col("tag").isin(sorted(gone)) | private(F.col("tag")) | (F.substring("tag", 5, 4) == "0000") | F.when(F.size("path") > 0, F.exists("path", lambda step: step["tag"].isin(below) | private(step["tag"]))).otherwise(False)
    if graphics:
        leaves |= _repeating("60") | _repeating("50")
    if "value_bin" in rows.columns:
        leaves |= F.coalesce(F.col("vr"), F.lit("UN")).isin("UN", "") & F.col("value_bin").isNotNull() & ~_odd(F.col("tag"))
    leaves = F.coalesce(leaves, F.lit(False))
    blanked = F.col("tag").isin(sorted(blank))

    moved = None if options.get("keep_uids") else _moved_uids(rows, uid_tags, id_tags, salt)
    in_order = Window.partitionBy("file_id").orderBy("tag", "path")
    whole = Window.partitionBy("file_id")
    twice = (F.lag("tag").over(in_order) == F.col("tag")) & (F.lag("path").over(in_order) == F.col("path"))
    marked = rows.withColumns({"_leaves": leaves, "_early": _early() & ~leaves & ~blanked, "_twice": F.coalesce(twice, F.lit(False)), "_at": F.row_number().over(in_order)})
    marked = marked.withColumns({"_early": F.max("_early").over(whole), "_twice": F.max("_twice").over(whole)}).filter("not _twice")
    if moved is not None:
        marked = _looked_up(marked, moved, uid_tags, id_tags)
    # each row takes one of these, the first that holds
    new = F.when(blanked, F.lit(""))
    if options.get("name") or options.get("id"):
        new = new.when(F.col("tag") == "00100020", F.lit((options.get("id") or "").replace(" ", "^")))
        if options.get("name"):
            new = new.when(F.col("tag") == "00100010", F.lit(options["name"].replace(" ", "^")))
    if offset:
        marked, moved_date = _with_shifted(marked, F.col("_early"), offset)
        new = F.coalesce(new, moved_date)
    hashed = _hashed(marked, salt, uid_tags, id_tags, name_tags, bool(options.get("keep_uids"))).withColumn("_new", F.coalesce(new, _pseudonym(options.get("surnames"))))
    done = _replaced(hashed, F.col("_new").isNotNull(), F.col("_new"))
    flags = options | {"shift_dates": bool(offset), "keep_dates": not offset, "remove_graphics": graphics, "remove_descriptions": not options.get("keep_descriptions")}
    stamps = _stamp_rows(options.get("text", "de-identified"), flags)
    n = len(stamps)
    # an own row is place 0; what stands inside explode is interpreted, not compiled, so it is no more than places
    places = F.concat(F.when(F.col("_leaves"), F.array().cast("array<int>")).otherwise(F.array(F.lit(0))), F.when(F.col("_at") == 1, F.array(*map(F.lit, range(1, n + 1)))).otherwise(F.array().cast("array<int>")))
    placed = done.withColumn("_places", places).select(*rows.columns, F.explode("_places").alias("_place"))
    stamped = F.get(F.array(*[F.struct(*[row.get(c, F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c != "file_id"]) for row in stamps]), F.col("_place") - 1)
    return placed.select(*[F.col(c) if c == "file_id" else F.when(F.col("_place") == 0, F.col(c)).otherwise(stamped[c]).alias(c) for c in rows.columns])


#: What a report needs of a file: bits, and the overlay's position and data.
REPORT_TAGS = ["00280100", "00280101", "60000102", "60003000"]


def report_facts(elements: DataFrame, files: DataFrame) -> DataFrame:
    """What ``deid_report`` counts, for each header file: from its elements and from the report of its reading (``error``)."""
    top = elements.filter((F.size("path") == 0) & F.col("tag").isin(REPORT_TAGS))
    number = lambda tag, name: F.max(F.when(F.col("tag") == tag, F.trim("value").try_cast("int"))).alias(name)
    facts = top.groupBy("file_id").agg(number("00280100", "bits_allocated"), number("00280101", "bits_stored"), number("60000102", "overlay_bit_position"), F.bool_or(F.col("tag") == "60003000").alias("has_overlay_data"))
    return files.filter("is_dicom").select("file_id", F.col("error").isNotNull().alias("is_error")).join(facts, "file_id", "left")


def deid_report(files: DataFrame) -> DataFrame:
    """One row: ``n_files``, ``n_errors`` and ``n_overlay_in_pixels`` from ``is_error``, bits and the overlay's position and data."""
    overlay = (F.col("bits_allocated") > F.col("bits_stored")) & F.col("overlay_bit_position").isNotNull() & ~F.coalesce(F.col("has_overlay_data"), F.lit(False))
    return files.agg(F.count("*").alias("n_files"), F.count_if("is_error").alias("n_errors"), F.count_if(overlay).alias("n_overlay_in_pixels"))


def number_outputs(files: DataFrame) -> DataFrame:
    """``file_id``, ``out_dir`` and ``out_name``: files numbered by name within a directory, directories by their path.

    Each number is as wide as itself asks for: a file's has 4 digits up to 9999, 8 up to 99,999,999, else 10; a
    directory's 8 or 10.
    """
    per_dir = numbered(files.select("dir").distinct(), ["dir"], "d")
    rows = files.withColumn("k", F.row_number().over(Window.partitionBy("dir").orderBy("name", "file_id"))).join(per_dir, "dir")
    pad = lambda value, width: F.lpad(value.cast("string"), width, F.lit("0"))
    long = lambda value: F.when(value <= 99_999_999, 8).otherwise(10)
    k, d = F.col("k"), F.col("d")
    return rows.select("file_id", pad(d, long(d)).alias("out_dir"), F.concat(pad(k, F.when(k <= 9999, 4).otherwise(long(k))), F.lit(".dcm")).alias("out_name"))
