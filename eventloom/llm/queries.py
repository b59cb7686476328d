"""Registered queries of the training-data operators, with SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import (
    ball_kmeans,
    decontamination,
    divergence,
    exact_dedup,
    language_id,
    licenses,
    mixing,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    token_count,
    url_filter,
)
from eventloom.llm.common import is_held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents")).drop("text_key")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.new_index(spark)
    try:
        resolved = exact_dedup.resolve_table(_table(spark, sf_dir, "documents"), index)
    finally:
        index.drop()
    return resolved.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, _table(spark, sf_dir, "labels")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.cluster(_table(spark, sf_dir, "embeddings"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_count": op1_token_count,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_url_filter": op5_url_filter,
    "op6_mix_sources": op6_mix_sources,
    "op7_license_scan": op7_license_scan,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_source_divergence": op11_source_divergence,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_benchmark_decontamination": op13_benchmark_decontamination,
}


def _glob_regex(glob: str) -> str:
    """A glob of the URL filter as an anchored regular expression."""
    import re

    return "(?s)^" + "".join(".*" if x == "**" else "[^/]*" if x == "*" else re.escape(x) for x in url_filter.parse(glob)) + "$"


def _op5_sql() -> str:
    by_length = sorted(url_filter.HOST_RULES, key=lambda r: -len(r[0]))
    fits = lambda glob: f"regexp_matches(canonical, '{_glob_regex(glob)}')"
    rule = "CASE " + " ".join(f"WHEN {fits(url_filter.host_glob(r))} THEN '{r}'" for r, _ in by_length) + " END"
    said = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in by_length) + " ELSE CASE WHEN glob_hits > 0 THEN 'block' ELSE 'allow' END END"
    hits = " + ".join(f"CAST({fits(g)} AS BIGINT)" for g in url_filter.BLOCK_GLOBS)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH cut AS (
  SELECT page_id, coalesce(strpos(url, '://') > 0, false) AS has, substr(url, strpos(url, '://') + 3) AS rest FROM pages
), parts AS (
  SELECT page_id,
    CASE WHEN has THEN translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{upper}', '{upper.lower()}') ELSE '' END AS host,
    CASE WHEN has THEN regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM cut
), canonical AS (
  SELECT *, CASE WHEN host || path = '' THEN '' ELSE '.' || host || path END AS canonical FROM parts
), judged AS (
  SELECT page_id, host, path, {rule} AS rule, {hits} AS glob_hits FROM canonical
)
SELECT page_id, host, path, rule, {said} AS verdict, glob_hits FROM judged
"""


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST(CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS drawn
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), listed AS (
  SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM sizes
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM listed
), found AS (
  SELECT max(level) FILTER (level <= cap / weight) AS level FROM levels
), rates AS (
  SELECT l.source, source_size, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, f.level * weight) END AS target FROM levels l, found f
)
SELECT s.doc_id, s.size, r.source_size, r.target,
  s.size * CAST(floor(rate) + CASE WHEN s.drawn < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM sized s JOIN (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM rates) r
  ON s.source IS NOT DISTINCT FROM r.source
"""

OP9_SQL = r"""
WITH digests AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), groups AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM digests GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM digests JOIN groups USING (text_sha256)
"""

OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), places AS (
  SELECT nr, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS lang_n FROM places GROUP BY lang, term HAVING count(DISTINCT nr) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS lang_size FROM kept GROUP BY lang
), counted AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM places GROUP BY lang, source, term
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), dense AS (
  SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)
), sizes AS (
  SELECT lang, source, sum(n) AS size FROM dense GROUP BY lang, source
), shares AS (
  SELECT d.lang, d.source, d.term, d.n, 1 + CAST(1000000000 AS HUGEINT) * (d.n + 1) // (s.size + l.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (d.lang_n + 1) // (l.lang_size + l.v) AS q
  FROM dense d JOIN sizes s USING (lang, source) JOIN langs l USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def _op12_sql(rounds: int = 10) -> str:
    """Each round as two more CTEs: every vector with every centroid, then the means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""near{r} AS MATERIALIZED (
  SELECT nr, CAST(min_by(c, (distance, c)) AS INTEGER) AS c, min(distance) AS distance
  FROM (SELECT x.nr, m.c, CAST(sum((x.v - m.v) * (x.v - m.v)) AS BIGINT) AS distance FROM whole x JOIN mean{r} m USING (d) GROUP BY x.nr, m.c) GROUP BY nr
)"""
        )
        if r < rounds:
            steps.append(
                f"""mean{r + 1} AS MATERIALIZED (
  SELECT m.c, m.d, coalesce(f.v, m.v) AS v FROM mean{r} m
  LEFT JOIN (SELECT n.c, x.d, CAST(floor(CAST(sum(x.v) AS DECIMAL(38, 0)) / count(*)) AS BIGINT) AS v FROM near{r} n JOIN whole x USING (nr) GROUP BY n.c, x.d) f USING (c, d)
)"""
            )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS nr, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), whole AS MATERIALIZED (
  SELECT nr, d, CAST(floor(1024 * CAST(embedding[d] AS DOUBLE)) AS BIGINT) AS v FROM kept, range(1, 65) t(d)
), starts AS (
  SELECT nr, row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE)))) - 1 AS c FROM kept QUALIFY c < 8
), mean0 AS MATERIALIZED (
  SELECT s.c, x.d, x.v FROM starts s JOIN whole x USING (nr)
), {", ".join(steps)}, named AS (
  SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM mean{rounds} GROUP BY c
)
SELECT k.vec_id, n.c AS cluster, n.distance, CAST(sum(n.distance) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia, CAST(sum(n.distance) OVER () AS BIGINT) AS inertia, m.centroid_sha256
FROM near{rounds} n JOIN kept k USING (nr) JOIN named m USING (c)
"""


OP13_SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS nr, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), windows AS MATERIALIZED (
  SELECT DISTINCT item, least(len(words), 10) AS n, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS run
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM items WHERE len(words) > 0)
), places AS (
  SELECT nr, i, n, array_to_string(words[i : i + n - 1], ' ') AS run
  FROM (SELECT nr, words, unnest(range(1, len(words) + 1)) AS i FROM docs) JOIN (SELECT DISTINCT n FROM windows) ON i + n - 1 <= len(words)
), met AS MATERIALIZED (
  SELECT nr, i, n, item FROM places JOIN windows USING (n, run)
), hit AS (
  SELECT nr, count(DISTINCT w) AS n_hit FROM (SELECT nr, unnest(range(i, i + n)) AS w FROM met) GROUP BY nr
), found AS (
  SELECT nr, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS listed FROM (SELECT DISTINCT nr, item FROM met) GROUP BY nr
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (nr) LEFT JOIN found USING (nr)
"""

ORACLE_SQL: dict[str, str] = {
    "op5_url_filter": _op5_sql(),
    "op6_mix_sources": OP6_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_centroid_clusters": _op12_sql(),
    "op13_benchmark_decontamination": OP13_SQL,
}
