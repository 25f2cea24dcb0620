"""Metadata: long tag relations to wide records, with precedence and normal forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X


def first_value(group: str, *names: str) -> Column:
    """An aggregate: the value of the first tag of the first name that there is."""
    found = [F.min_by("value", F.when((F.col("group") == group) & (F.col("name") == n), F.col("ord"))) for n in names]
    return F.coalesce(*found)


def first_text(group: str, *names: str) -> Column:
    """As first_value, trimmed, blank values passed over."""
    found = [F.min_by(F.trim("value"), F.when((F.col("group") == group) & (F.col("name") == n), F.col("ord"))) for n in names]
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in found))


#: Field, EXIF names, XMP names, and what the value becomes.
CAPTURE = (
    ("aperture", ("FNumber",), ("FNumber",), X.aperture),
    ("exposure_time", ("ExposureTime",), ("ExposureTime",), X.exposure_time),
    ("focal_length", ("FocalLength",), ("FocalLength",), X.focal_length),
    ("iso", ("ISO",), ("ISOSpeedRatings", "PhotographicSensitivity", "ISO"), None),
    ("exposure_compensation", ("ExposureCompensation",), ("ExposureBiasValue", "ExposureCompensation"), X.exposure_compensation),
    ("captured_at", ("DateTimeOriginal",), ("DateTimeOriginal",), None),
    ("camera_make", ("Make",), ("Make",), None),
    ("camera_model", ("Model",), ("Model",), None),
    ("lens_make", ("LensMake",), ("LensMake",), None),
    ("lens_model", ("LensModel",), ("LensModel", "Lens"), None),
)


def capture(tags: DataFrame) -> DataFrame:
    """One row per path: capture fields from (path, ord, group, name, value), XMP over EXIF over composites where it has a value."""
    composites = {"aperture": first_value("Composite", "Aperture"), "exposure_time": first_value("Composite", "ShutterSpeed")}
    raw = []
    for field, exif, xmp, _ in CAPTURE:
        below = first_value("EXIF", *exif)
        raw.append(F.coalesce(first_text("XMP", *xmp), below, composites[field]).alias(field) if field in composites else F.coalesce(first_text("XMP", *xmp), below).alias(field))
    kelvin = first_text("XMP", "Temperature", "ColorTemperature")
    tint = first_text("XMP", "Tint")
    wide = tags.groupBy("path").agg(*raw, kelvin.alias("kelvin"), tint.alias("tint_text"), first_value("EXIF", "YCbCrSubSampling").alias("chroma"))
    shaped = [(shape(F.col(f)) if shape else F.col(f)).alias(f) for f, _, _, shape in CAPTURE]
    k = F.when(F.col("kelvin").rlike(r"^\+?[0-9]{1,10}$"), F.col("kelvin").try_cast("long"))
    t = F.when(F.col("tint_text").rlike(r"^[+-]?[0-9]{1,10}$"), F.col("tint_text").try_cast("int"))
    return wide.select("path", *shaped, X.camera_vendor(F.col("camera_make")).alias("vendor"), F.when(k > 0, F.concat(k.cast("string"), F.lit(" K"))).alias("color_temperature"), t.cast("string").alias("tint"), X.chroma_subsampling(F.col("chroma")).alias("chroma_subsampling"))


def editable(tags: DataFrame) -> DataFrame:
    """One row per path: rating, labels, texts and keyword lists."""
    names = {"rating": ("Rating",), "label": ("Label",), "pick": ("PickLabel",), "title": ("Title",), "description": ("Description",), "creator": ("Creator",), "copyright": ("Rights", "Copyright"), "subject": ("Subject",), "hierarchy": ("HierarchicalSubject",)}
    wide = tags.groupBy("path").agg(*(first_value("XMP", *n).alias(f) for f, n in names.items()))
    none = F.array().cast("array<string>")
    return wide.select(
        "path", X.rating(F.col("rating")).alias("rating"), X.color_label(F.col("label")).alias("color_label"), X.pick_with_rating(F.col("pick"), F.col("rating")).alias("pick_label"),
        "title", "description", "creator", "copyright",
        F.coalesce(X.split_list(F.col("subject")), none).alias("keywords"), F.coalesce(X.split_list(F.col("hierarchy")), none).alias("hierarchical_keywords"))


def xmp_fields(sidecars: DataFrame) -> DataFrame:
    """Editable fields of sidecars (path, xml), by patterns that take broken markup too."""
    xml = F.col("xml")
    return sidecars.select(
        "path", X.rating(X.xml_value(xml, "xmp:Rating")).alias("rating"), X.color_label(X.xml_value(xml, "xmp:Label")).alias("color_label"),
        X.pick_with_rating(X.xml_value(xml, "digiKam:PickLabel"), X.xml_value(xml, "xmp:Rating")).alias("pick_label"),
        _bag(xml, "dc:subject").alias("keywords"), _bag(xml, "lr:hierarchicalSubject").alias("hierarchical_keywords"))


def _bag(xml: Column, name: str) -> Column:
    return X.xml_items(F.regexp_extract(xml, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1), "rdf:li")


def patched(xml: Column, name: str, present: Column, value: Column) -> Column:
    """XMP text with an attribute set, or removed where the present value is null; unchanged where no value is present (a tri-state patch)."""
    pattern = F.lit(rf"""\s{name}\s*=\s*["'][^"']*["']""")
    bare = F.regexp_replace(xml, pattern, F.lit(""))
    text = X.escape_xml(value)
    quoted = F.regexp_replace(text, r"([\\$])", r"\\$1")
    with_value = F.regexp_replace(bare, F.lit("<rdf:Description(?=[\\s/>])"), F.concat(F.lit(f'<rdf:Description {name}="'), quoted, F.lit('"')))
    return F.when(~present, xml).when(value.isNull(), bare).otherwise(with_value)


def overlay(below: DataFrame, above: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of below with each field replaced where above has a value that is not blank."""
    joined = below.alias("b").join(above.alias("a"), key, "left")
    return joined.select(key, *(F.coalesce(F.nullif(F.trim(F.col(f"a.{f}").cast("string")), F.lit("")), F.col(f"b.{f}").cast("string")).alias(f) for f in fields))
