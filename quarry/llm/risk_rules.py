"""Quality rules whose cutoffs are chosen to limit the false rejection of good documents.

A rule rejects a document whose measure lies beyond a cutoff. Settings are tried along paths fixed in advance: all
rules tighten together, or all but one, or one alone, from lenient cutoffs to strict ones. For every stratum and
setting the good documents of the labelled holdout that it would reject are counted, by whichever rule. The exact
binomial test of 'its false rejection rate is over the limit' must reject that for a setting and for all that come
before it on its path (fixed-sequence testing, which needs no correction within a path), at a level corrected for the
number of strata and paths (Bonferroni). So with probability 1 - delta, no stratum has a safe setting that in truth
rejects more than its share alpha of good documents, and any safe one may be taken: the one that rejects the most
labelled documents that are not good. Where too few labels can show safety, the rules are off.

All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._tables import kept

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: str, name: str, body: str) -> str:
    """SQL for body with name bound to value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def words_sql(text: str) -> str:
    return rf"array_remove(split({text}, '[\\x20\\x09-\\x0D]+'), '')"


def repeat_words_sql(words: str, few: int = 16) -> str:
    """Words inside three-word windows that stand twice or more in the array.

    Windows are hashed and sorted; neighbours that are equal give the repeated hashes. Few of them are looked up one by one; many
    are found by sorting the windows with their places. Both ways are exact.
    """
    hashes = f"CASE WHEN size({words}) > 2 THEN transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2])) ELSE array() END"
    # sort_array compares values, where array_sort would evaluate an expression a comparison
    twice = let("sort_array(h)", "s", "array_distinct(filter(s, (x, i) -> i > 0 AND x = s[greatest(i - 1, 0)]))")
    looked_up = "filter(sequence(0, size(h) - 1), i -> array_contains(d, h[i]))"
    placed = "sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))"
    paired = let(placed, "p", "transform(filter(p, (y, j) -> (j > 0 AND p[greatest(j - 1, 0)].x = y.x) OR (j < size(p) - 1 AND p[least(j + 1, size(p) - 1)].x = y.x)), y -> y.i)")
    covered = "size(array_distinct(flatten(transform({0}, i -> array(i, i + 1, i + 2)))))"
    some = let(twice, "d", f"CASE WHEN size(d) = 0 THEN 0 WHEN size(d) <= {few} THEN {covered.format(looked_up)} ELSE {covered.format(paired)} END")
    return let(hashes, "h", f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE {some} END")


def measures(docs: DataFrame, carry: dict[str, str], text_column: str = "text") -> DataFrame:
    """The columns in carry (new name: column) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_loud, all long.

    Null is an empty text. Everything is computed within a row, whatever its length.
    """
    text = docs.select(*(F.col(f"`{c}`").alias(new) for new, c in carry.items()), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("_q_text"))
    split = text.withColumn("_q_words", F.expr(words_sql("_q_text")))
    lines = "filter(split(_q_text, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    without = lambda letters: F.length("_q_text") - F.length(F.translate("_q_text", letters, ""))
    return split.select(
        *carry,
        F.size("_q_words").cast("long").alias("n_words"),
        F.length(F.translate("_q_text", SPACES, "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        F.expr(let(lines, "l", "size(l) - size(array_distinct(l))")).cast("long").alias("n_dup_lines"),
        F.expr(let("_q_words", "w", repeat_words_sql("w"))).cast("long").alias("n_repeat_words"),
        without("!?").cast("long").alias("n_loud"),
    )


@dataclass(frozen=True)
class Rule:
    """Rejects where the measure is over the cutoff; cutoffs from lenient to strict."""

    name: str
    measure: str
    cutoffs: tuple[float, ...]


#: Measures are SQL over the columns of measures(); all are 0 for a text without words.
RULES = (
    Rule("symbols", "coalesce(try_divide(n_symbols, n_words), 0)", (2.0, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1)),
    Rule("loud", "coalesce(try_divide(n_loud, n_words), 0)", (3.0, 2.0, 1.0, 0.7, 0.5, 0.3)),
    Rule("dup_lines", "coalesce(try_divide(n_dup_lines, n_words), 0)", (0.3, 0.2, 0.1, 0.05)),
    Rule("repeats", "coalesce(try_divide(n_repeat_words, n_words), 0)", (0.9, 0.7, 0.5, 0.4, 0.3)),
    Rule("long_words", "coalesce(try_divide(word_chars, n_words), 0)", (60.0, 30.0, 20.0, 15.0)),
)


def binomial_tail_sql(k: str, n: str, p: float) -> str:
    """SQL for P(X <= k), X binomial(n, p), summed exactly term by term in logarithms."""
    step = f"ln(({n} - i + 1) / i) + ln({p!r}D / (1 - {p!r}D))"
    add = "named_struct('t', a.t + {s}, 'sum', greatest(a.sum, a.t + {s}) + ln(1 + exp(-abs(a.sum - a.t - {s}))))".format(s=f"({step})")
    first = f"cast({n} * ln(1 - {p!r}D) AS DOUBLE)"
    return f"aggregate(CASE WHEN {k} > 0 THEN sequence(1L, {k}) ELSE array() END, named_struct('t', {first}, 'sum', {first}), (a, i) -> {add}, a -> least(1D, exp(a.sum)))"


def paths(rules: tuple[Rule, ...]) -> list[tuple[Rule, ...]]:
    """The sets of rules that tighten together: all, all but one, each alone."""
    several = [tuple(r for r in rules if r is not out) for out in rules] if len(rules) > 2 else []
    return [rules, *several, *((r,) for r in rules if len(rules) > 1)]


def setting(path: tuple[Rule, ...], step: int) -> dict[str, float]:
    """Each rule's cutoff at a step; one with fewer cutoffs stays at its strictest."""
    return {r.name: r.cutoffs[min(step, len(r.cutoffs) - 1)] for r in path}


def choose_cutoffs(measured: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, alpha: float = 0.02, delta: float = 0.05, good: str = "quality", id_column: str = "doc_id") -> DataFrame:
    """(stratum, cutoffs: a map from rule to cutoff) for the strata that have a safe setting which rejects any labelled document that is not good.

    measured has id, stratum and measures(). The holdout is every document whose labels are all 1; one with any other label is not good; null labels
    and ids count for nothing; a null stratum is one of its own.
    """
    judged = labels.where(F.col(good).isNotNull()).groupBy(F.col(f"`{id_column}`").alias("id")).agg((F.min(good).eqNullSafe(1) & F.max(good).eqNullSafe(1)).alias("sound"))
    held = measured.join(judged, "id")
    # cutoffs tighten along a path, so what a row adds to all of a path's settings is the first step that rejects it
    places = {r.name: F.expr(f"size(filter(array({', '.join(f'{c!r}D' for c in r.cutoffs)}), c -> NOT {r.measure} > c))") for r in rules}
    none = max(len(r.cutoffs) for r in rules)
    step_of = {r.name: F.when(F.col(f"_at_{r.name}") < len(r.cutoffs), F.col(f"_at_{r.name}")).otherwise(none) for r in rules}
    placed = held.select("stratum", "sound", *(c.alias(f"_at_{n}") for n, c in places.items()))
    firsts = F.array(*(F.least(*(step_of[r.name] for r in path), F.lit(none)) for path in paths(rules)))
    rejected = placed.select("stratum", "sound", F.posexplode(firsts).alias("path", "first")).groupBy("stratum", "path", "first").agg(F.count_if("sound").alias("k"), F.count_if(~F.col("sound")).alias("b"))
    as_map = lambda path, step: "map(" + ", ".join(f"'{n}', {c!r}D" for n, c in setting(path, step).items()) + ")"
    tried = [f"{p}, {step}, {as_map(path, step)}" for p, path in enumerate(paths(rules)) for step in range(max(len(r.cutoffs) for r in path))]
    settings = F.broadcast(measured.sparkSession.range(1).select(F.expr(f"stack({len(tried)}, {', '.join(tried)}) AS (path, step, cutoffs)")))  # a row a setting
    so_far = lambda c: F.coalesce(F.sum(F.when(F.col("first") <= F.col("step"), F.col(c))), F.lit(0)).alias(c)
    counts = rejected.join(settings.select("path", "step"), "path").groupBy("stratum", "path", "step").agg(F.sum("k").alias("n"), so_far("k"), so_far("b"))
    table = kept(counts.join(settings, ["path", "step"]), "settings")
    tests = len(paths(rules)) * max(1, table.select("stratum").distinct().count())
    tail = F.expr(f"CASE WHEN k > n * {alpha!r}D THEN 1D ELSE {binomial_tail_sql('k', 'n', alpha)} END")
    # a path ends before its first setting that is not shown to be safe
    judged_settings = table.withColumn("safe", tail <= delta / tests)
    ends = judged_settings.groupBy("stratum", "path").agg(F.min(F.when(~F.col("safe"), F.col("step"))).alias("end"))
    on = judged_settings.alias("s").join(ends.alias("e"), F.expr("s.stratum <=> e.stratum AND s.path = e.path AND (e.end IS NULL OR s.step < e.end)"))
    best = F.max_by("s.cutoffs", F.struct("s.b", -F.col("s.path"), -F.col("s.step")))
    return on.where("s.b > 0").groupBy(F.col("s.stratum").alias("stratum")).agg(best.alias("cutoffs"))


def verdicts(measured: DataFrame, cutoffs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 50, most_repeats: int = 50) -> DataFrame:
    """measured with base_failed and kept. A stratum without cutoffs has no rule on."""
    own = cutoffs.select(F.col("stratum").alias("_q_stratum"), F.col("cutoffs").alias("_q_cutoffs"))
    joined = measured.join(own, F.col("stratum").eqNullSafe(F.col("_q_stratum")), "left")
    rejected: Column = F.lit(False)
    for r in rules:
        rejected = rejected | F.coalesce(F.expr(r.measure) > F.try_element_at("_q_cutoffs", F.lit(r.name)), F.lit(False))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    return joined.withColumn("base_failed", base).withColumn("kept", ~base & ~rejected).drop("_q_stratum", "_q_cutoffs")


def judge(docs: DataFrame, labels: DataFrame, stratum_column: str = "lang", id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per document: id, stratum, the base measures, base_failed, kept.

    A null or empty text has no words and fails the base; null ids are judged and never labelled; repeated rows each get a row; other
    columns are ignored; an empty table gives no rows; without labels only the base decides.
    """
    measured = kept(measures(docs, {"id": id_column, "stratum": stratum_column}, text_column), "measures")
    cutoffs = kept(choose_cutoffs(measured, labels, rules, alpha, delta, id_column=id_column), "cutoffs")  # a row a stratum, broadcast where its size allows
    out = verdicts(measured, cutoffs, rules)
    return out.withColumnRenamed("id", id_column)
