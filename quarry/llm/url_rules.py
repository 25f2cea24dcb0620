"""URL filters: fixed host and path rules, and association rules mined by FP-growth.

A url becomes a set of tokens. FP-growth finds token combinations of bad urls; of the rules that conclude
from them to the label, those of enough support and confidence stay. They are matched by an inverted index:
each rule is filed under its rarest token, met by an equality join, and verified on all its tokens.

FP-growth makes every combination of tokens that occur together, so it is spared what can't matter: tokens in
too few bad urls; tokens that alone decide, since a combination with one decides nothing more; and of tokens that
stand in the very same labelled urls all but one, for which any of them may then stand in a rule. Rules have at most
three tokens (a parameter), so urls of many tokens go to it in parts.

All of it is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._tables import kept

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class UrlRule(NamedTuple):
    """Fits its host and all subdomains where the url's path starts with its path."""

    verdict: str
    host: str
    path: str


def with_host_and_path(pages: DataFrame, url_column: str = "url") -> DataFrame:
    """Adds host (after the first ://, A-Z lower-cased) and path; both empty where the url is null or has no ://."""
    url = F.coalesce(F.col(url_column), F.lit(""))
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", path)


def fixed_rule(rules: list[UrlRule]) -> Column:
    """The longest rule that fits host and path, as struct(rule, verdict), or null. Of equally long ones, the first given."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: -len(r.host + r.path))[::-1]:
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url_column: str = "url") -> Column:
    """The distinct tokens of a url with host and path: host and its labels, path segments (numbers as one), extension, query keys, scheme, fragment."""
    url = F.coalesce(F.col(url_column), F.lit(""))
    tagged = lambda tag, parts: F.transform(F.array_remove(parts, ""), lambda x: F.concat(F.lit(tag), x))
    segment = F.transform(F.split("path", "/"), lambda x: F.regexp_replace(x, r"[0-9]+", "0"))
    query = F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    keys = F.transform(query, lambda x: F.substring_index(x, "=", 1))
    others = F.array(
        F.concat(F.lit("site:"), F.col("host")),
        F.concat(F.lit("scheme:"), F.translate(F.regexp_extract(url, "^([A-Za-z]+)://", 1), UPPER, LOWER)),
        F.concat(F.lit("ext:"), F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)),
        F.when(F.instr(url, "#") > 0, F.lit("fragment:yes")).otherwise(F.lit("fragment:no")),
    )
    return F.array_distinct(F.concat(tagged("host:", F.split("host", r"\.")), tagged("path:", segment), tagged("key:", keys), others))


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of urls (tokens, ...) with each rule (rule_id, needs, anchors) they fit; repeated where a url has several of a rule's anchors."""
    filed = rules.select("rule_id", "needs", F.explode("anchors").alias("anchor"))
    met = urls.withColumn("anchor", F.explode("tokens")).join(filed, "anchor")
    return met.where(F.forall("needs", lambda some: F.arrays_overlap(some, F.col("tokens")))).drop("anchor", "needs")


def parts_of(baskets: DataFrame, items: str, most: int, width: int = 3) -> DataFrame:
    """Rows of at most most * width of a basket's items, such that any `most` of its items stand together in a row: its items in blocks of width, `most` blocks a row."""
    blocks = F.ceil(F.size(items) / width).cast("int")
    out, before = baskets.withColumn("_items", F.array().cast(baskets.schema[items].dataType)), F.lit(-1)
    for k in range(most):  # ascending choices of blocks; a basket of few blocks makes one choice, of all
        last = F.greatest(blocks, F.lit(most)) - most + k
        out = out.withColumn(f"_b{k}", F.explode(F.sequence(before + 1, last)))
        before = F.col(f"_b{k}")
    return out.select(F.flatten(F.array(*(F.slice(items, F.col(f"_b{k}") * width + 1, width) for k in range(most)))).alias(items))


def mine(urls: DataFrame, labels: DataFrame, min_support: float, min_count: int, min_confidence: float, bad: str, id_column: str, label_id_column: str, most_terms: int = 3) -> DataFrame:
    """(rule_id, needs, anchors, confidence, support) of the rules tokens -> bad label. urls has the id and tokens; an id's labels are bad if any is.

    needs is an array of arrays: a url fits that has a token of each. All rules of one token to most_terms tokens are found that have the support and confidence, less those that hold
    a token which decides alone. FP-growth makes all subsets of what stands together, so a bad url of many tokens is given to it in parts of 3 * most_terms tokens in which any most_terms of them
    stand together somewhere; parts count a combination once at least, and what is frequent in them is counted exactly, over all labelled urls.
    """
    judged = labels.select(F.col(f"`{label_id_column}`").alias(id_column), F.expr(bad).alias("bad")).where("bad IS NOT NULL").groupBy(id_column).agg(F.bool_or("bad").alias("bad"))
    baskets = kept(urls.join(judged, id_column).select(F.monotonically_increasing_id().alias("basket"), "tokens", "bad"), "url-baskets")
    number = max(1, baskets.count())
    least = ceil(max(min_support * number, min_count))
    rows = baskets.select("basket", "bad", F.explode("tokens").alias("token"))
    same = [F.bit_xor(F.xxhash64(F.lit(k), "basket")).alias(f"x{k}") for k in range(2)]  # stand for the set of urls
    frequent = rows.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), *same).where(F.col("n_bad") >= least)
    classes = kept(frequent.groupBy("n", "n_bad", "x0", "x1").agg(F.min("token").alias("class"), F.array_sort(F.collect_set("token")).alias("members")), "url-token-classes")
    alone = F.col("n_bad") / F.col("n") >= min_confidence
    single = classes.where(alone).select(F.array("members").alias("needs"), F.col("members").alias("anchors"))

    telling = classes.where(~alone).select(F.explode("members").alias("token"), "class", (F.col("n_bad") / F.col("n")).alias("share"))
    ranked = rows.where("bad").join(telling, "token").groupBy("basket").agg(F.sort_array(F.collect_set(F.struct("share", "class")), asc=False).alias("own"))
    items = kept(parts_of(ranked.select(F.col("own.class").alias("items")), "items", most_terms).where(F.size("items") > 1), "url-items")
    parts = items.count()
    found = [single]
    if parts:
        sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / parts), minConfidence=1.0).fit(items).freqItemsets
        rule = sets.where(F.size("items").between(2, most_terms)).select(F.array_sort("items").alias("rule"), F.explode("items").alias("class"))
        combined = kept(rule, "url-combinations").join(classes.select("class", "members", "n"), "class").groupBy("rule")
        found.append(combined.agg(F.array_sort(F.collect_set("members")).alias("needs"), F.min_by("members", F.struct("n", "class")).alias("anchors")).drop("rule"))
    found = kept(reduce(DataFrame.unionByName, found).withColumn("rule_id", F.xxhash64("needs")), "url-candidates")
    counted = matches(baskets, found).select("rule_id", "basket", "bad").distinct().groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"))
    sound = counted.where((F.col("n_bad") >= least) & (F.col("n_bad") / F.col("n") >= min_confidence))
    return found.join(sound, "rule_id").select("rule_id", "needs", "anchors", (F.col("n_bad") / F.col("n")).alias("confidence"), (F.col("n_bad") / number).alias("support"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[UrlRule], min_support: float = 0.002, min_count: int = 20, min_confidence: float = 0.8, most_terms: int = 3, bad: str = "quality = 0 OR toxic = 1", id_column: str = "page_id", label_id_column: str = "doc_id", url_column: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule (the fixed rule that fits, else null), verdict, mined_rule (an association rule's id, else null).

    bad is SQL over the labels; a rule has at most most_terms tokens, and needs min_support of the labelled pages and min_count of them. A fixed rule decides where one fits; else a page is blocked if a mined rule's tokens are all in its url. Labels are joined by id; pages and
    labels with null ids, and null labels, teach nothing, but every page is judged. A null url has empty host and path and only its empty tokens. Repeated rows each
    get a row; other columns are ignored; an empty table gives no rows; without labels nothing is mined. Equal urls are matched once.
    """
    narrow = pages.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{url_column}`").alias("url"))
    parsed = with_host_and_path(narrow).withColumn("fixed", fixed_rule(rules))
    urls = parsed.select("id", tokens().alias("tokens"))
    mined = kept(mine(urls, labels, min_support, min_count, min_confidence, bad, "id", label_id_column, most_terms), "url-rules")
    open_urls = parsed.where("fixed IS NULL").select("url", tokens().alias("tokens")).distinct()
    blocked = matches(open_urls, mined).groupBy("url").agg(F.min("rule_id").alias("mined_rule"))
    joined = parsed.join(blocked.withColumnRenamed("url", "blocked_url"), F.col("url").eqNullSafe(F.col("blocked_url")) & F.col("fixed").isNull(), "left")
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    return joined.select(F.col("id").alias(id_column), "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "mined_rule")
