"""The registered queries over the operators, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytespans, decontaminate, language, lines, mixing, rules, simhash, substrings, tokens, toxicity
from .common import NO_ID, crc_fold, read


def _given(c: str):
    return F.when(F.col(c) != NO_ID, F.col(c))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held = crc_fold(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs.where(~held), labels.where(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = crc_fold(F.col("doc_id"), 5) == 0
    model = language.learn(docs.where(~held))
    return language.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytespans.drop_repeated_bytes(read(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The public tokenizer's file, or else under /opt/tokenizers."""
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return str(public_tokenizers.path(name))
    return f"/opt/tokenizers/{name}"


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path())


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeated_windows(read(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(_given("doc").alias("doc_id"), simhash.hex_of(F.col("fp")).alias("fingerprint"), _given("component_id").alias("component_id"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_decontaminate, op3_language, op4_quality_rules, op5_suffix_dedup, op6_token_counts, op7_mixing, op8_substring_dedup, op9_simhash, op10_line_dedup, pipeline)
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SPACE = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

ORACLES: dict[str, str] = {
    "op4_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
g AS (SELECT rid, i, list_slice(w, i, i + 4) AS g FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
p AS (SELECT rid, i, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS far FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, sum(least(5, coalesce(far, 5)))::BIGINT AS n FROM p GROUP BY rid),
x AS (SELECT *, list_filter(string_split(t, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT doc_id, stratum, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(t) - length(replace(t, '!', '')) AS n_bangs, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM x LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN [least(64, n_symbols * 64 // word_chars), least(64, n_bangs * 64 // word_chars), least(64, n_capitals * 64 // word_chars)] ELSE [0, 0, 0] END || [CASE WHEN n_lines > 0 THEN least(64, n_dup_lines * 64 // n_lines) ELSE 0 END, CASE WHEN n_words > 0 THEN least(64, n_repeat_words * 64 // n_words) ELSE 0 END] AS steps FROM m),
l AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT stratum, q, steps FROM f JOIN l USING (doc_id) WHERE NOT base_failed),
s AS (SELECT stratum, rule, steps[rule] AS step, sum(q) AS g, sum(1 - q) AS b FROM h, unnest(range(1, 6)) AS u(rule) GROUP BY ALL),
c AS (SELECT stratum, rule, step, sum(g) OVER (PARTITION BY stratum, rule)::DOUBLE AS good, sum(b) OVER (PARTITION BY stratum, rule)::DOUBLE AS bad, sum(g) OVER (PARTITION BY stratum, rule ORDER BY step DESC)::DOUBLE AS good_rejected, sum(b) OVER (PARTITION BY stratum, rule ORDER BY step DESC)::DOUBLE AS bad_rejected FROM s),
e AS (SELECT *, CASE WHEN good_rejected <= good * (0.02 / 5) THEN list_sum(list_transform(range(0, good_rejected::BIGINT + 1), lambda j: exp(lgamma(good + 1) - lgamma(j + 1) - lgamma(good - j + 1) + j * ln(0.02 / 5) + (good - j) * ln(1 - 0.02 / 5)))) END AS chance, round(bad_rejected / bad - good_rejected / good, 9) AS gap FROM c WHERE step > 0 AND bad_rejected > 0),
o AS (SELECT stratum, rule, step AS cutoff FROM e WHERE gap > 0 AND chance <= 0.05 / (5 * (SELECT count(DISTINCT coalesce('=' || stratum, 'null')) FROM h)) QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gap DESC, step DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce((SELECT bool_or(f.steps[o.rule] >= o.cutoff) FROM o WHERE o.stratum IS NOT DISTINCT FROM f.stratum), false) AS kept FROM f""",
    "op7_mixing": rf"""
WITH s AS (SELECT doc_id, source, len({WORDS}) AS size, ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::UBIGINT AS bits FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
p AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM t),
q AS (SELECT *, row_number() OVER o AS place, sum(cap) OVER (o ROWS UNBOUNDED PRECEDING) - cap AS capped, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(source_size) OVER () AS total FROM p WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
r AS (SELECT *, (total * 1.5::DOUBLE - capped) / open AS level FROM q),
g AS (SELECT source, source_size, coalesce(least(cap, (SELECT arg_min(level, place) FROM r WHERE level <= cap / w) * w), cap) AS target FROM r),
n AS (SELECT source, size, count(*) * size AS words, size * 1048576 // (size + 64) AS w FROM s GROUP BY source, size),
k AS (SELECT n.*, target, row_number() OVER z AS place, (sum(words) OVER (z ROWS UNBOUNDED PRECEDING) - words) * 2.0::DOUBLE AS capped, (sum(words::HUGEINT * w) OVER (z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS open FROM n JOIN g ON n.source IS NOT DISTINCT FROM g.source WINDOW z AS (PARTITION BY n.source ORDER BY size DESC)),
v AS (SELECT source, arg_min(level, place) AS level FROM (SELECT *, (target - capped) / open AS level FROM k WHERE open > 0) WHERE level * w <= 2 GROUP BY source),
e AS (SELECT g.*, level FROM g LEFT JOIN v ON g.source IS NOT DISTINCT FROM v.source),
m AS (SELECT s.*, source_size, target, coalesce(least(2.0::DOUBLE, level * (size * 1048576 // (size + 64))), 2.0::DOUBLE) AS copies, floor(copies) AS c, copies - c AS p, (bits + 0.5::DOUBLE) / 281474976710656 AS u, (u / (1 - u)) / (p / (1 - p)) AS rank FROM s JOIN e ON s.source IS NOT DISTINCT FROM e.source),
x AS (SELECT *, target - sum(c * size) OVER (PARTITION BY source) AS needed FROM m),
o AS (SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY p > 0 DESC, rank, bits, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS before FROM x)
SELECT doc_id, size, source_size, target, ((c + CASE WHEN p > 0 AND 2 * (needed - before) >= size THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM o""",
    "op8_substring_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
g AS (SELECT rid, doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS g FROM d, unnest(range(1, len(w) - 48)) AS u(i)),
h AS (SELECT rid, i FROM g JOIN (SELECT g, min(coalesce(doc_id, -9223372036854775808)) AS least FROM g GROUP BY g) USING (g) WHERE coalesce(doc_id, -9223372036854775808) > least),
p AS (SELECT DISTINCT rid, j FROM h, unnest(range(i, i + 50)) AS u(j)),
x AS (SELECT rid, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
y AS (SELECT x.*, p.j IS NOT NULL AS gone FROM x LEFT JOIN p USING (rid, j)),
z AS (SELECT rid, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM y GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN z USING (rid)""",
    "op10_line_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, {SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.top AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM g GROUP BY rid, doc_id""",
}
