"""The opN_ queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, bpe_merges, compact_windows, decontam, fertility, fim, importance, langid, minhash, pii, quality_qda, token_counts, url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op2_near_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.duplicate_ids(docs, shingle=2).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op3_quality_classifier(spark, sf_dir):
    return quality_qda.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark, sf_dir):
    out = fertility.fertility_rules(table(spark, sf_dir, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*first, *(c for c in out.columns if c not in first))


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn_languages(docs))


def op6_substring_dedup(spark, sf_dir):
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    return decontam.digest_hits(decontam.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_pii(spark, sf_dir):
    return pii.digest_spans(pii.find_pii(table(spark, sf_dir, "documents")))


def op10_byte_bpe(spark, sf_dir):
    return bpe.digest_tokens(bpe.encode(table(spark, sf_dir, "documents"), decoded=True))


def op11_importance_resampling(spark, sf_dir):
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op12_fill_in_middle(spark, sf_dir):
    return fim.digest_forms(fim.fill_in_middle(table(spark, sf_dir, "documents")))


def op13_bpe(spark, sf_dir):
    return bpe_merges.digest_tokens(bpe_merges.encode(table(spark, sf_dir, "documents"), decoded=True))


def queries():
    return {k: v for k, v in globals().items() if k[:2] == "op" and k[2].isdigit()}


ORACLE_SQL = {
    "op1_url_filter": r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rows_ AS (SELECT row_number() OVER () AS k, * FROM parts),
fits AS (SELECT k, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY k ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
  FROM rows_ JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM rows_ LEFT JOIN (SELECT * FROM fits WHERE n = 1) USING (k)""",
    "op2_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i : i + 1] AS g FROM (SELECT *, unnest(range(1, greatest(2, len(w)))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
ids AS (SELECT doc_id, dense_rank() OVER (ORDER BY g) AS g FROM s),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM ids a JOIN ids b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM sym UNION SELECT r.x, s2.y FROM reach r JOIN sym s2 ON r.y = s2.x),
low AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY gs) AS class_id FROM (SELECT doc_id, list_sort(list(g)) AS gs FROM ids GROUP BY doc_id))
SELECT DISTINCT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept, coalesce(class_id, d.doc_id) AS class_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.x = d.doc_id LEFT JOIN cls ON cls.doc_id = d.doc_id""",
    "op8_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, w[i : i + least(10, len(w)) - 1] AS p, least(10, len(w)) AS m FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT k, i, m, w[i : i + m - 1] AS p FROM (SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hits AS (SELECT k, i, dw.m, item FROM dw JOIN bw USING (p)),
pos AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + m)) AS j FROM hits) GROUP BY k),
its AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (k) LEFT JOIN its USING (k)""",
}


def oracle_sql():
    return dict(ORACLE_SQL)
