"""Search: prefix terms over an inverted index, and ranked directory names."""

from __future__ import annotations

import unicodedata
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import ascii_lower, like_nocase


def _marked_letters(last: int = 0x2FFF) -> tuple[str, str]:
    """Letters with marks up to a code point and, at the same places, the letters that Unicode's canonical decomposition leaves without them."""
    bare = {chr(k): "".join(x for x in unicodedata.normalize("NFD", chr(k)) if not unicodedata.combining(x)) for k in range(0x80, last + 1)}
    found = {c: b for c, b in bare.items() if len(b) == 1 and b != c}
    return "".join(found), "".join(found.values())


MARKED, PLAIN = _marked_letters()


def fold(c: Column) -> Column:
    """Lower case, without marks: letters that carry one become plain, combining marks go. Text of ASCII characters has none."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.regexp_replace(F.lower(F.translate(c, MARKED, PLAIN)), r"\p{M}", ""))


def words(c: Column) -> Column:
    """The runs of letters and digits of the folded text, in order."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def index(rows: DataFrame, key: str | tuple[str, ...], *columns: str) -> DataFrame:
    """(key, field, at, word): one row per word of each column; a key may be several columns."""
    keys = (key,) if isinstance(key, str) else key
    fields = F.array(*(F.struct(F.lit(c).alias("field"), words(F.col(c)).alias("words")) for c in columns))
    exploded = rows.select(*keys, F.explode(fields).alias("f"))
    return exploded.select(*keys, F.col("f.field").alias("field"), F.posexplode("f.words").alias("at", "word"))


class Term(NamedTuple):
    """A word of a query: the number of its white-space separated term, how many words that has, and its place among them."""

    term: int
    n: int
    at: int
    word: str

    @property
    def last(self) -> bool:
        return self.at == self.n - 1


def query_terms(query: str) -> list[Term]:
    """The words of each white-space separated term; a term of several words is a phrase."""
    out = []
    for k, text in enumerate(query.split()):
        folded = "".join(x for x in text.translate(str.maketrans(MARKED, PLAIN)).lower() if unicodedata.category(x)[0] != "M")
        split = "".join(x if unicodedata.category(x)[0] in "LN" else " " for x in folded).split(" ")
        found = [w for w in split if w]
        out += [Term(k, len(found), at, w) for at, w in enumerate(found)]
    return out


def fits(word: Column, t: Term) -> Column:
    """A term's last word is a prefix; words before it must stand whole."""
    return word.startswith(t.word) if t.last else word == t.word


def match_all(indexed: DataFrame, query: str, *key: str) -> DataFrame:
    """The keys of an index (key, field, at, word) that match every term in some field. A term's words must stand right before one another.

    A query without terms matches nothing; callers list a directory then.
    """
    terms = query_terms(query)
    if not terms:
        return indexed.select(*key).limit(0)
    hit = [fits(F.col("word"), t) for t in terms]
    told = [F.when(h, F.struct(F.lit(t.term).alias("term"), F.lit(t.n).alias("n"), F.lit(t.at).alias("t"))) for h, t in zip(hit, terms, strict=True)]
    hits = indexed.where(reduce(Column.__or__, hit)).select(*key, "field", "at", F.explode(F.array_compact(F.array(*told))).alias("hit"))
    placed = hits.select(*key, "field", (F.col("at") - F.col("hit.t")).alias("start"), "hit.term", "hit.n", "hit.t")
    phrases = placed.groupBy(*key, "field", "start", "term", "n").agg(F.countDistinct("t").alias("found")).where("found = n")
    return phrases.groupBy(*key).agg(F.countDistinct("term").alias("terms")).where(F.col("terms") == len({t.term for t in terms})).select(*key)


def spellings(last: int = 0x2FFF) -> dict[str, str]:
    """For each letter or digit of folded text, the characters up to a code point that may fold to it."""
    plain, out = str.maketrans(MARKED, PLAIN), {}
    for c in map(chr, range(0x21, last + 1)):
        for x in {c.translate(plain).lower()[:1], c.lower()[:1], c}:
            out[x] = out.get(x, "") + c
    return out


SPELLINGS = spellings()


def beginning(word: str) -> str:
    """A pattern that finds a folded word, or what goes on from it, where a word of the text as it is begins; it may find more."""
    sigma = {x: "Σσς" for x in "σς"}  # which of the small ones a capital becomes is decided by its place
    letter = lambda x: "[" + "".join(sorted({*SPELLINGS.get(x, x), *sigma.get(x, x), *(x.upper() if len(x.upper()) == 1 else x)})) + "]"
    return r"(?<![\p{L}\p{N}])" + "".join(letter(x) + r"\p{M}*" for x in word)


def candidates(rows: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows whose columns have a beginning of each word of the query; no other row can match, so no other is folded and taken apart."""
    for word in sorted({t.word for t in query_terms(query)}, key=lambda w: (-len(w), w)):  # the rarest first, as a rule
        rows = rows.where(reduce(Column.__or__, (F.coalesce(F.col(c).rlike(beginning(word)), F.lit(False)) for c in columns)))
    return rows


def match_texts(rows: DataFrame, query: str, key: str, *columns: str) -> DataFrame:
    """The keys of rows that match the query, without an index."""
    return match_all(index(candidates(rows, query, *columns), key, *columns), query, key)


def match_or_list(rows: DataFrame, query: str, key: str, *columns: str) -> DataFrame:
    """The keys of rows that match the query; a query of white space alone lists all of them."""
    return match_texts(rows, query, key, *columns) if query.strip() else rows.select(key)


def rank_directories(directories: DataFrame, query: str) -> DataFrame:
    """Directories whose name contains the query, with rank 0 (equal), 1 (begins with it) or 2; in order of rank, name without case, path from the end."""
    name, text = ascii_lower(F.col("name")), ascii_lower(F.lit(query))
    literal = query.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\\", "\\\\")
    rank = F.when(name == text, 0).when(name.like(literal + "%"), 1).otherwise(2)
    return directories.where(like_nocase(F.col("name"), query)).withColumn("rank", rank).orderBy("rank", name, F.col("path").desc())


def ancestors(path: Column, root: Column) -> Column:
    """The folders between root and path, the topmost first, both ends left out."""
    below = F.filter(F.split(F.substring(path, F.length(root) + 1, F.length(path)), "/"), lambda x: x != "")
    prefix = lambda k: F.concat(root, F.lit("/"), F.array_join(F.slice(below, 1, k), "/"))
    return F.when(F.size(below) > 1, F.transform(F.sequence(F.lit(1), F.size(below) - 1), prefix)).otherwise(F.array().cast("array<string>"))


def search_tree(matches: DataFrame, path: str = "path", root: str = "root_path") -> DataFrame:
    """(path, is_match): the matches and all their ancestors, each once."""
    both = matches.select(F.explode(F.concat(F.transform(ancestors(F.col(path), F.col(root)), lambda p: F.struct(p.alias("path"), F.lit(False).alias("is_match"))), F.array(F.struct(F.col(path).alias("path"), F.lit(True).alias("is_match"))))).alias("n"))
    return both.groupBy("n.path").agg(F.bool_or("n.is_match").alias("is_match"))
