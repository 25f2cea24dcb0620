"""Text columns: the two kinds of case folding, label parsing, number formats, XMP fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone, as NOCASE comparison does."""
    return F.translate(c, _UPPER, _LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, _LOWER, _UPPER)


def contains_folded(c: Column, needle: str) -> Column:
    """Unicode case-insensitive substring; % and _ have no meaning."""
    return F.lower(c).contains(F.lower(F.lit(needle)))


def like_nocase(c: Column, query: str) -> Column:
    """LIKE '%query%' without regard to A-Z's case; % and _ in the query are wildcards, a backslash is itself."""
    folded = query.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\")
    return ascii_lower(c).like(f"%{folded}%")


def within_path(c: Column, folder: str) -> Column:
    """Whether a path is the folder or below it, by whole components."""
    folder = folder.rstrip("/") or "/"
    return (c == folder) | c.startswith(folder if folder == "/" else folder + "/")


def parent_path(c: Column) -> Column:
    return F.regexp_replace(c, r"/[^/]*$", "")


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"[^/]*$", 0)


def extension(c: Column) -> Column:
    """What follows the last dot of a name; empty without one or for a name that begins with its only dot."""
    return F.regexp_extract(base_name(c), r"^.+\.([^.]*)$", 1)


def stem_path(c: Column) -> Column:
    """The path without its extension."""
    return F.regexp_replace(c, r"(?<=[^/])\.[^./]*$", "")


#: Extensions by kind of asset.
KINDS = {
    "raw": ("arw", "cr2", "cr3", "nef", "dng", "raf", "rw2", "orf"),
    "jpeg": ("jpg", "jpeg"),
    "heif": ("heif", "heic", "hif"),
    "png": ("png",),
    "tiff": ("tif", "tiff"),
    "webp": ("webp",),
}


def _first(cases: list[tuple[Column, object]], otherwise: object = None) -> Column:
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def asset_kind(ext: Column) -> Column:
    """The kind of an extension, A-Z's case ignored; null for what is no asset."""
    low = ascii_lower(ext)
    return _first([(low.isin(*names), kind) for kind, names in KINDS.items()])


#: The colour labels with a canonical spelling.
COLORS = ("Red", "Yellow", "Green", "Blue", "Purple")
#: Pick labels by their spellings.
PICKS = {"rejected": ("1", "rejected"), "pending": ("2", "pending"), "accepted": ("3", "accepted", "picked")}


def color_label(c: Column) -> Column:
    """Canonical spelling of the known labels; other text is kept trimmed; empty and 'none' are null."""
    low = ascii_lower(F.trim(c))
    return F.when((low == "") | (low == "none"), None).otherwise(_first([(low == name.lower(), name) for name in COLORS], F.trim(c)))


def pick_label(c: Column) -> Column:
    low = ascii_lower(F.trim(c))
    return _first([(low.isin(*spellings), name) for name, spellings in PICKS.items()])


def pick_with_rating(pick: Column, rating: Column) -> Column:
    """The pick label, or rejected where there is none and the rating says -1."""
    return F.coalesce(pick_label(pick), F.when(F.trim(rating) == "-1", "rejected"))


def rating(c: Column) -> Column:
    """0 to 5, or null for anything else."""
    text = F.trim(c)
    number = F.when(text.rlike(r"^\+?[0-9]{1,9}$"), text.try_cast("int"))
    return F.when(number.between(0, 5), number)


def format_number(c: Column) -> Column:
    """No decimals within 0.005 of a whole number; else two, without zeros at the end."""
    whole = F.abs(c - F.rint(c)) < 0.005
    return F.when(whole, F.format_string("%.0f", F.rint(c))).otherwise(F.regexp_replace(F.format_string("%.2f", c), "0+$", ""))


def trim_fraction(c: Column) -> Column:
    """a/b as a number where both parse and b is not 0; else the text unchanged."""
    a = F.substring_index(c, "/", 1).try_cast("double")
    b = F.regexp_extract(c, "^[^/]*/(.*)$", 1).try_cast("double")
    return F.when((F.instr(c, "/") > 0) & a.isNotNull() & b.isNotNull() & (b != 0), format_number(a / F.when(b != 0, b))).otherwise(c)


def _without_unit(c: Column, unit: str) -> Column:
    return F.regexp_replace(F.trim(c), re.escape(unit) + "$", "")


def aperture(c: Column) -> Column:
    return F.concat(F.lit("f/"), trim_fraction(c))


def exposure_time(c: Column) -> Column:
    return F.concat(_without_unit(c, " s"), F.lit(" s"))


def focal_length(c: Column) -> Column:
    return F.concat(trim_fraction(_without_unit(c, " mm")), F.lit(" mm"))


def exposure_compensation(c: Column) -> Column:
    number = trim_fraction(c)
    return F.concat(F.when(number.startswith("-") | (number == "0"), "").otherwise("+"), number, F.lit(" EV"))


#: Chroma subsampling by its factors; ratios stand for themselves.
CHROMA = {"1 1": "4:4:4", "1 2": "4:4:0", "2 1": "4:2:2", "2 2": "4:2:0", "4 1": "4:1:1", "4 2": "4:1:0"}
CHROMA_RATIOS = ("4:0:0", "4:1:0", "4:1:1", "4:2:0", "4:2:2", "4:4:0", "4:4:4")


def chroma_subsampling(c: Column) -> Column:
    compact = F.trim(F.regexp_replace(F.translate(F.regexp_replace(F.trim(c), "^(YCbCr)+", ""), ",x", "  "), r"\s+", " "))
    return _first([(compact.isin(*CHROMA_RATIOS), compact), *((compact == k, v) for k, v in CHROMA.items())])


#: Camera vendors by parts of the make, first match wins.
VENDORS = {"sony": ("sony",), "canon": ("canon",), "nikon": ("nikon",), "fujifilm": ("fujifilm", "fuji"), "panasonic": ("panasonic",), "olympus": ("olympus", "om digital"), "apple": ("apple",)}


def camera_vendor(make: Column) -> Column:
    low = ascii_lower(F.coalesce(make, F.lit("")))
    return _first([(low.rlike("|".join(parts)), name) for name, parts in VENDORS.items()], "other")


def split_list(c: Column) -> Column:
    """Comma-separated values, trimmed, the empty ones dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def split_tag_path(c: Column) -> Column:
    """A typed tag path cut at runs of backslash, slash or pipe."""
    return F.filter(F.transform(F.split(c, r"[\\/|]+"), lambda x: F.trim(x)), lambda x: x != "")


def hash_tag_query(c: Column) -> Column:
    """The tag part of an input such as 'words #tag'; empty without one."""
    return F.regexp_extract(c, r"(?:^|\s)#([^#]*)$", 1)


#: The five entities, with the ampersand last when reading and first when writing.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def unescape_xml(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def escape_xml(c: Column) -> Column:
    for entity, char in reversed(ENTITIES):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def xml_value(xml: Column, name: str) -> Column:
    """The value of an attribute or else of an element, unescaped and null where there is neither."""
    quoted = re.escape(name)
    attribute = F.regexp_extract(xml, rf"""(?s)[\s]{quoted}\s*=\s*["']([^"']*)["']""", 1)
    element = F.regexp_extract(xml, rf"(?s)<{quoted}(?:\s[^>]*)?>(.*?)</{quoted}>", 1)
    return unescape_xml(F.coalesce(F.nullif(attribute, F.lit("")), F.nullif(element, F.lit(""))))


def xml_items(xml: Column, item: str) -> Column:
    """The trimmed, unescaped texts of all such elements, empty ones dropped."""
    found = F.regexp_extract_all(xml, F.lit(rf"(?s)<{re.escape(item)}(?:\s[^>]*)?>(.*?)</{re.escape(item)}>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(unescape_xml(x))), lambda x: x != "")


def summary_revision(size: Column, modified_ms: Column) -> Column:
    return F.concat_ws(":", size.cast("string"), modified_ms.cast("string"))


def stable_id(c: Column) -> Column:
    """The first 16 hexadecimal digits of a text's SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def normalized_tag_name(c: Column) -> Column:
    """A trimmed tag name; null where it is empty or holds a pipe or a control character."""
    name = F.trim(c)
    return F.when((name != "") & ~name.rlike(r"[|\p{Cntrl}]"), name)


def exif_seconds(c: Column) -> Column:
    """Epoch seconds of 'YYYY:MM:DD HH:MM:SS', by place; no range is checked, text behind is ignored, null where digits are missing."""
    part = lambda at, n: F.when(F.octet_length(c) >= 19, F.substring(c, at, n)).try_cast("long")
    year, month, day, hour, minute, second = (part(a, n) for a, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2)))
    return civil_days(year, month, day) * 86400 + hour * 3600 + minute * 60 + second


def civil_days(year: Column, month: Column, day: Column) -> Column:
    """Days from 1970-01-01, with years that begin in March: then a leap day is a year's last, and month lengths follow one formula."""
    y = F.when(month <= 2, year - 1).otherwise(year)
    m = F.when(month > 2, month - 3).otherwise(month + 9)
    days = 365 * y + F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400)
    return days + F.floor((153 * m + 2) / 5) + day - 1 - 719468


def gps_degrees(degrees: Column, minutes: Column, seconds: Column, side: Column) -> Column:
    """Decimal degrees; south and west are negative."""
    size = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(F.trim(side)).isin("S", "W"), -size).otherwise(size)


def xmp_gps_degrees(c: Column) -> Column:
    """'52,30.5N', '52,30,15N' or '52,30.5,N' as decimal degrees; null for other text."""
    parts = F.regexp_extract_all(c, F.lit(r"^\s*([^,]+),([^,]+?)(?:,([^,]+?))?,?\s*([NSEW])\s*$"), F.lit(0))
    ok = F.size(parts) == 1
    part = lambda k: F.regexp_extract(c, r"^\s*([^,]+),([^,]+?)(?:,([^,]+?))?,?\s*([NSEW])\s*$", k)
    number = lambda k: F.trim(part(k)).try_cast("double")
    return F.when(ok, gps_degrees(number(1), number(2), F.when(part(3) == "", 0.0).otherwise(number(3)), part(4)))


def swapped_for_display(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """Orientations 5 to 8 turn the picture."""
    turned = orientation.between(5, 8)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def oriented_point(width: Column, height: Column, x: Column, y: Column, orientation: Column) -> Column:
    """A point of the stored picture as a point of the displayed one: struct(width, height, x, y)."""
    w, h = swapped_for_display(width, height, orientation)
    from_right, from_bottom = F.greatest(width - x, F.lit(0)), F.greatest(height - y, F.lit(0))
    turned = orientation.between(5, 8)
    along = F.when(turned, F.when(orientation.isin(6, 7), from_bottom).otherwise(y)).otherwise(F.when(orientation.isin(2, 3), from_right).otherwise(x))
    down = F.when(turned, F.when(orientation.isin(7, 8), from_right).otherwise(x)).otherwise(F.when(orientation.isin(3, 4), from_bottom).otherwise(y))
    return F.struct(w.alias("width"), h.alias("height"), along.alias("x"), down.alias("y"))


def rational_text(numerator: Column, denominator: Column) -> Column:
    """A rational's display: whole numbers plain, 0/0 as undef, others as n/d."""
    return F.when((denominator == 0) & (numerator == 0), "undef").when(numerator % F.when(denominator != 0, denominator) == 0, (numerator / F.when(denominator != 0, denominator)).cast("long").cast("string")).otherwise(F.concat_ws("/", numerator.cast("string"), denominator.cast("string")))


#: Seconds between the QuickTime epoch, 1904-01-01, and 1970-01-01.
QUICKTIME_EPOCH = 2082844800


def quicktime_date(seconds: Column) -> Column:
    """'YYYY:MM:DD HH:MM:SS' in UTC; zeros for 0, and the number itself for a time before 1970."""
    date = F.date_format(F.timestamp_seconds(seconds - QUICKTIME_EPOCH), "yyyy:MM:dd HH:mm:ss")
    return F.when(seconds == 0, "0000:00:00 00:00:00").when(seconds < QUICKTIME_EPOCH, seconds.cast("string")).otherwise(date)


def duration_text(seconds: Column) -> Column:
    """'H:MM:SS', or 'M:SS' under an hour."""
    whole = F.round(seconds).cast("long")
    hours, minutes, rest = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%d:%02d", minutes, rest))
