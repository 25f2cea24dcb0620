"""Cross-site boilerplate lines by distinct-site spread.

Lines that stand often enough to matter get a HyperLogLog sketch of the sites they stand on, merged
by aggregation. Where an estimate is near the threshold, the sites are counted exactly. Lines at or
over the threshold are boilerplate and go from every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._tables import kept

#: Estimates outside threshold * (1 -+ MARGIN) are trusted; the sketches' relative standard error is far smaller.
MARGIN = 0.2
LOG2_REGISTERS = 12


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes stand for a line."""
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def has_word(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def flags(places: str) -> Column:
    """For a column of ascending places: true at each of them, false before it; one pass, whatever their number."""
    before = lambda k: F.when(k > 0, F.get(F.col(places), k - 1)).otherwise(-1)
    return F.flatten(F.transform(places, lambda x, k: F.concat(F.array_repeat(F.lit(False), x - before(k) - 1), F.array(F.lit(True)))))


def boilerplate(docs: DataFrame, min_sites: int, site_column: str = "source", text_column: str = "text") -> DataFrame:
    """(k1, k2) of the lines with a word that stand on at least min_sites distinct sites; a null site is none."""
    lines = docs.where(F.col(site_column).isNotNull()).select(F.col(site_column).alias("site"), F.explode(lines_of(text_column)).alias("line")).where(has_word(F.col("line")))
    k1, k2 = line_key(F.col("line"))
    keyed = lines.select(k1.alias("k1"), k2.alias("k2"), F.col("site").cast("string").alias("site"))
    # a line on min_sites sites stands at least as many times; most lines stand once and need no sketch
    # (tables of their own, so that the joins deal both sides anew and can split a line that is very frequent)
    frequent = kept(keyed.groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("k1", "k2"), "frequent-lines")
    seen = keyed.join(frequent, ["k1", "k2"], "left_semi")
    spread = seen.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", F.lit(LOG2_REGISTERS)).alias("sketch")).select("k1", "k2", F.hll_sketch_estimate("sketch").alias("sites"))
    sure = spread.where(F.col("sites") > min_sites * (1 + MARGIN)).select("k1", "k2")
    near = kept(spread.where(F.col("sites").between(min_sites * (1 - MARGIN), min_sites * (1 + MARGIN))).select("k1", "k2"), "near-lines")
    exact = seen.join(near, ["k1", "k2"], "left_semi").select("k1", "k2", "site").distinct().groupBy("k1", "k2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("k1", "k2")
    return sure.unionByName(exact)


def _without_boilerplate(docs: DataFrame, min_sites: int, id_column: str, site_column: str, text_column: str) -> DataFrame:
    """_q_doc (a struct of the row's own columns) and _q_text, _q_lines, _q_removed."""
    text, site, doc_id = (F.col(f"_q_doc.`{c}`") for c in (text_column, site_column, id_column))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_q_doc"))
    rows = packed.select("_q_doc", F.xxhash64(doc_id, text).alias("_q_row"), F.xxhash64(F.lit(1), doc_id, text).alias("_q_row2"))
    found = kept(boilerplate(packed.select(site.alias("site"), text.alias("text")), min_sites, "site", "text"), "boilerplate")
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    places = rows.select("_q_row", "_q_row2", F.posexplode(lines).alias("at", "line")).where(has_word(F.col("line")))
    k1, k2 = line_key(F.col("line"))
    hits = places.select("_q_row", "_q_row2", "at", k1.alias("k1"), k2.alias("k2")).join(found, ["k1", "k2"], "left_semi")
    gone = hits.groupBy("_q_row", "_q_row2").agg(F.array_sort(F.collect_set("at")).alias("_q_gone"))
    joined = rows.join(gone.hint("shuffle_hash"), ["_q_row", "_q_row2"], "left")
    left = F.array_compact(F.zip_with(lines, flags("_q_gone"), lambda line, out: F.when(~F.coalesce(out, F.lit(False)), line)))
    n = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    cut = joined.withColumn("_q_kept", F.when(F.col("_q_gone").isNotNull(), left))
    new_text = F.when(F.col("_q_kept").isNotNull(), F.array_join("_q_kept", "\n")).otherwise(text)
    removed = F.when(F.col("_q_kept").isNotNull(), F.size(lines) - F.size("_q_kept")).otherwise(0).cast("long")
    return cut.select("_q_doc", new_text.alias("_q_text"), n.alias("_q_lines"), removed.alias("_q_removed"))


def _own(docs: DataFrame, changed: dict[str, Column]) -> list[Column]:
    return [(changed[c] if c in changed else F.col(f"_q_doc.`{c}`")).alias(c) for c in docs.columns]


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, id_column: str = "doc_id", site_column: str = "source", text_column: str = "text") -> DataFrame:
    """One row per document: its own columns with the text less its boilerplate lines, and n_lines, n_removed (in place of columns so named).

    Lines are cut at \\n and compared whole. A text that loses no line, null too, stays as it was (null has no lines, an empty text one);
    lines without a word never go; a null site adds no site; ids may be null or repeated (a row is known by its id and text); an empty
    table gives no rows. Other columns may have any names.
    """
    added = {"n_lines": F.col("_q_lines"), "n_removed": F.col("_q_removed")}
    done = _without_boilerplate(docs, min_sites, id_column, site_column, text_column)
    own = [c for c in docs.columns if c not in added]
    return done.select(*_own(docs.select(*(F.col(f"`{c}`") for c in own)), {text_column: F.col("_q_text")}), *(c.alias(n) for n, c in added.items()))


def cleaned(docs: DataFrame, min_sites: int = 10, id_column: str = "doc_id", site_column: str = "source", text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """The documents with all their columns, their texts less the boilerplate lines, and the length column, where there is one, counted anew where the text changed."""
    done = _without_boilerplate(docs, min_sites, id_column, site_column, text_column)
    length = F.when(F.col("_q_removed") > 0, F.length("_q_text").cast("long")).otherwise(F.col(f"_q_doc.`{length_column}`")) if length_column in docs.columns else F.lit(None)
    return done.select(*_own(docs, {text_column: F.col("_q_text"), length_column: length}))
