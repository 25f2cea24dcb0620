"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), window=1024, end_id=0)


#: A document is kept, or predicted good, from this score on.
QUALITY_CUT = 0.3


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.line_crf import fit, held_out, score_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.string_tiling import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shortest=5, coverage=0.5)
    return found.select("doc_id", "contaminated", "n_items", "item_id", "coverage")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.warc import round_trip

    records = round_trip(table(spark, sf_dir, "pages")).where("kind = 'record'")
    return records.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP5_SQL = """
WITH full_pages AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), judged AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM full_pages
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM judged
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.line_spread import remove_boilerplate

    kept = remove_boilerplate(table(spark, sf_dir, "documents"), min_sites=10)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE source IS NOT NULL AND text IS NOT NULL
), boilerplate AS (
  SELECT coalesce(list(line), []) AS gone FROM (
    SELECT line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT source) >= 10)
), split AS (
  SELECT doc_id, string_split(text, chr(10)) AS own, list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone, x)) AS kept
  FROM documents, boilerplate
)
SELECT doc_id, CAST(coalesce(len(own), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(own) - len(kept), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
FROM split
"""


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.url_rules import UrlRule, judge

    rules = [UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"), UrlRule("block", "net", "/es/"), UrlRule("block", "net", "/fr/")]
    judged = judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.recompression import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents"), width=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), t AS (
  SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM w
), v AS (
  SELECT r, k, md5(string_agg(word, ' ') OVER s) AS h, count(*) OVER s AS n FROM t WINDOW s AS (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
), again AS (
  SELECT h FROM v WHERE n = 35 GROUP BY h HAVING count(*) > 1
), covered AS (
  SELECT DISTINCT r, unnest(range(k, k + 35)) AS k FROM v WHERE n = 35 AND h IN (SELECT h FROM again)
), stay AS (
  SELECT r, string_agg(word, ' ' ORDER BY k) AS kept FROM t WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.r = t.r AND c.k = t.k) GROUP BY r
), gone AS (
  SELECT r, count(*) AS n FROM covered GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN stay ON stay.r = w.r LEFT JOIN gone ON gone.r = w.r
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.risk_rules import BASE, judge

    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *BASE, "base_failed", "kept")


def op9_sql() -> str:
    """The base measures, the tests along the paths and the verdicts in SQL; paths, cutoffs and levels are the operator's."""
    from quarry.llm.risk_rules import RULES, paths, setting

    ways = paths(RULES)
    settings = [(p, step, rule, cutoff) for p, path in enumerate(ways) for step in range(max(len(r.cutoffs) for r in path)) for rule, cutoff in setting(path, step).items()]
    values = ", ".join(f"({p}, {step}, '{rule}', {cutoff})" for p, step, rule, cutoff in settings)
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), t AS (
  SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM w
), v AS (
  SELECT r, k, string_agg(word, ' ') OVER s AS three, count(*) OVER s AS n FROM t WINDOW s AS (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)
), again AS (
  SELECT *, count(*) OVER (PARTITION BY r, three) AS times FROM v WHERE n = 3
), repeats AS (
  SELECT r, count(DISTINCT k + d) AS n FROM again, (VALUES (0), (1), (2)) x(d) WHERE times > 1 GROUP BY r
), m AS (
  SELECT w.r, doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(text, '[^!?]', '', 'g')) AS BIGINT) AS n_loud,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN repeats ON repeats.r = w.r
), d AS (
  SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM m
), x AS (
  SELECT r, unnest(['symbols', 'loud', 'dup_lines', 'repeats', 'long_words']) AS rule, CASE WHEN n_words = 0 THEN 0 ELSE unnest([n_symbols, n_loud, n_dup_lines, n_repeat_words, word_chars]) / n_words END AS measure FROM d
), s(path, step, rule, cutoff) AS (VALUES {values}
), sound AS (
  SELECT doc_id, min(quality) = 1 AND max(quality) = 1 AS sound FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), held AS (
  SELECT d.r, d.lang, sound.sound FROM d JOIN sound ON sound.doc_id = d.doc_id
), hits AS (
  SELECT held.r, held.lang, held.sound, path, step, bool_or(measure > cutoff) AS hit FROM held JOIN x ON x.r = held.r JOIN s ON s.rule = x.rule GROUP BY ALL
), k AS (
  SELECT lang, path, step, count(*) FILTER (WHERE sound) AS n, count(*) FILTER (WHERE sound AND hit) AS k, count(*) FILTER (WHERE NOT sound AND hit) AS b FROM hits GROUP BY lang, path, step
), tested AS (
  SELECT *, k <= n * 0.02 AND list_sum(list_transform(range(0, k + 1), lambda i: exp(CASE WHEN i = 0 THEN 0 ELSE lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) END + i * ln(0.02::DOUBLE) + (n - i) * ln(0.98::DOUBLE))))
    <= 0.05 / ({len(ways)} * (SELECT count(DISTINCT coalesce(lang, '?')) FROM held)) AS safe FROM k
), held_so_far AS (
  SELECT *, bool_and(safe) OVER (PARTITION BY lang, path ORDER BY step) AS on FROM tested
), best AS (
  SELECT lang, path, step FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY b DESC, path, step) AS place FROM held_so_far WHERE "on" AND b > 0) y WHERE place = 1
), rejected AS (
  SELECT x.r, bool_or(measure > cutoff) AS hit FROM d JOIN best ON best.lang IS NOT DISTINCT FROM d.lang JOIN x ON x.r = d.r JOIN s ON s.path = best.path AND s.step = best.step AND s.rule = x.rule GROUP BY x.r
), judged AS (
  SELECT d.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(hit, false) AS hit FROM d LEFT JOIN rejected ON rejected.r = d.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT hit AS kept FROM judged
""".replace(" AS on FROM", ' AS "on" FROM')


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), words=4, most_bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.dual_tree import cluster

    found = cluster(table(spark, sf_dir, "embeddings"), clusters=40, rounds=5, dimensions=64, scale=256, seed="2")
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op11_sql() -> str:
    """The rounds one after another; vectors are whole numbers in doubles, so sums and products are exact."""
    floor = "(s - ((s % n) + n) % n) // n"
    rounds = "".join(f"""
), a{k} AS (
  SELECT r, arg_min(c.k, (list_inner_product(x, x) - 2 * list_inner_product(x, m) + list_inner_product(m, m), c.k)) AS k FROM v, c{k} c GROUP BY r
), s{k} AS (
  SELECT a.k, count(*) AS n, d, sum(CAST(x[d] AS HUGEINT)) AS s FROM a{k} a JOIN v ON v.r = a.r, range(1, 65) t(d) GROUP BY a.k, d
), c{k + 1} AS (
  SELECT c.k, coalesce(n.m, c.m) AS m FROM c{k} c LEFT JOIN (SELECT k, list(CAST({floor} AS DOUBLE) ORDER BY d) AS m FROM s{k} GROUP BY k) n ON n.k = c.k""" for k in range(5))
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (
  SELECT CAST(r - 1 AS INTEGER) AS k, x AS m FROM v WHERE r <= 40{rounds}
), f AS (
  SELECT r, min((list_inner_product(x, x) - 2 * list_inner_product(x, m) + list_inner_product(m, m), c.k)) AS best FROM v, c5 c GROUP BY r
), g AS (
  SELECT vec_id, best[2] AS cluster, CAST(best[1] AS BIGINT) AS distance FROM f JOIN v ON v.r = f.r
)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(m, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM g JOIN c5 ON c5.k = g.cluster
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.middle import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf_dir, "documents"), seed=42, percent=50, suffix_first=80)
    back = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM d
), r AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS x FROM u
), c AS (
  SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r
), p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.chat import format_conversations, read_back

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return read_back(format_conversations(turns.unionByName(more)))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]|SYS\]|ROLE\]))', '\1\\\2', 'g'))
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 13
      ELSE 17 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*/?(?:s>|INST\]|SYS\]|ROLE\]))', '\1\\\2', 'g')) END AS size FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_warc": op5_warc,
    "op6_line_dedup": op6_line_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash": op10_simhash,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_chat_formatting": op13_chat_formatting,
}
ORACLE: dict[str, str] = {"op5_warc": OP5_SQL, "op6_line_dedup": OP6_SQL, "op8_substring_dedup": OP8_SQL, "op9_quality_rules": op9_sql(), "op11_centroid_clustering": op11_sql(), "op12_fill_in_middle": OP12_SQL, "op13_chat_formatting": OP13_SQL}
