"""Registered queries of sources, sinks, sampling and reports, and their DuckDB SQL. What they write lies in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import events, jobs, rules, runs, sampling, traces
from tracemill.plans.catalogue import load, query
from tracemill.plans.lifecycle import RECORD_SQL, records, repairs
from tracemill.sources import documents, jsonl, reports
from tracemill.sources.versions import Files, Store, workspace
from tracemill.streaming.keyed import KeyedTable

# ---- versioned tables


class Broken(RuntimeError):
    pass


@query("SELECT o_orderkey, o_totalprice FROM orders")
def snk_atomic(spark, sf):
    """Two exports, then one that fails half-way; what is read is the second."""
    store, o = Store(spark, workspace(spark, "atomic")), load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    store.commit({"orders": o.where("o_orderkey % 2 = 0")})
    store.commit({"orders": o})
    fault = F.when(F.col("o_orderkey") % 7 == 3, F.raise_error(F.lit("interrupted")).cast("long")).otherwise(F.col("o_orderkey"))
    try:
        store.commit({"orders": o.withColumn("o_orderkey", fault)})
    except Exception as e:
        if "interrupted" not in str(e):
            raise
    else:
        raise Broken("the export did not fail")
    store.sweep()
    return store.read("orders")


@query(f"WITH {RECORD_SQL} SELECT 'detail' AS file, * FROM records UNION ALL SELECT 'training', * FROM records WHERE status = 'success' AND finish_reason = 'eos'")
def snk_dual_files(spark, sf):
    store = Store(spark, workspace(spark, "dual"))
    jobs.write_exports(records(spark, sf), store)
    return store.read("detail").select(F.lit("detail").alias("file"), "*").unionByName(store.read("training").select(F.lit("training").alias("file"), "*"))


BATCH_SQL = """rows_ AS (SELECT l_orderkey % 5000 AS k, l_linenumber AS batch, l_orderkey AS place, CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'success' END AS status FROM lineitem WHERE l_linenumber <= 3),
t AS (SELECT k, attempts, status FROM (SELECT k, count(*) OVER (PARTITION BY k) AS attempts, status, row_number() OVER (PARTITION BY k ORDER BY batch DESC, place DESC, status DESC) AS n FROM rows_) WHERE n = 1)"""


def batches(spark, sf):
    status = F.when(F.col("l_returnflag") == "R", "error").otherwise("success")
    return load(spark, sf, "lineitem").where("l_linenumber <= 3").select((F.col("l_orderkey") % 5000).alias("k"), F.col("l_linenumber").alias("batch"), F.struct(F.col("l_linenumber").alias("batch"), F.col("l_orderkey").alias("at")).alias("seq"), status.alias("status"), F.lit(1).cast("long").alias("attempts"))


def ingested(spark, sf):
    table = KeyedTable(Store(spark, workspace(spark, "ingest")), "rows", ["k"], buckets=16)
    rows = batches(spark, sf)
    for batch in (1, 2, 2, 3, 1):  # replayed batches change nothing
        table.apply(rows.where(F.col("batch") == batch).drop("batch"), batch)
    return table


@query(f"WITH {BATCH_SQL} SELECT * FROM t")
def snk_incremental(spark, sf):
    return ingested(spark, sf).read().select("k", "attempts", "status")


@query(f"WITH {BATCH_SQL} SELECT 'live' AS file, * FROM t WHERE status = 'success' UNION ALL SELECT 'final', * FROM t")
def st_live_snapshot(spark, sf):
    table = ingested(spark, sf)
    shown = lambda name: table.store.read("detail").select(F.lit(name).alias("file"), "k", "attempts", "status")
    table.snapshot("k", require_eos=False)
    live = shown("live")
    table.snapshot("k", final=True, require_eos=False)
    return live.unionByName(shown("final"))


@query("SELECT n_name AS key, CAST(count(*) AS BIGINT) AS customers, CASE WHEN n_regionkey < 2 THEN max(c_acctbal) ELSE min(c_acctbal) END AS threshold FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_regionkey")
def snk_config_merge(spark, sf):
    """A document for each nation, then those of two regions merged anew."""
    store = Store(spark, workspace(spark, "config"))
    c = load(spark, sf, "customer").join(load(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("key"), "n_regionkey"), "c_nationkey")
    made = lambda df, threshold: df.groupBy("key").agg(F.count(F.lit(1)).alias("customers"), threshold.alias("threshold"))
    documents.merge_documents(store, "config", made(c, F.min("c_acctbal")))
    documents.merge_documents(store, "config", made(c.where("n_regionkey < 2"), F.max("c_acctbal")))
    return store.read("config")


@query("SELECT vec_id, list_max(embedding)::DOUBLE AS score FROM embeddings")
def snk_cache_pt(spark, sf):
    store, e = Store(spark, workspace(spark, "scores")), load(spark, sf, "embeddings")
    documents.save_scores(store, e.select("vec_id", F.array_max("embedding").cast("double").alias("score")), model="m", method="contrast", used=1)
    return documents.load_scores(store, model="m", method="contrast")


# ---- sources

LINES_SQL = "l AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS idx, CASE WHEN event_id % 50 = 7 THEN '' WHEN event_id % 50 = 8 THEN '  ' ELSE props END AS line FROM events)"


def written_lines(spark, sf):
    path = workspace(spark, "lines")
    line = F.when(F.col("event_id") % 50 == 7, "").when(F.col("event_id") % 50 == 8, "  ").otherwise(F.col("props"))
    load(spark, sf, "events").orderBy("event_id").select(line.alias("value")).write.text(path)
    return path


@query(f"WITH {LINES_SQL} SELECT idx, line FROM l WHERE trim(line) <> ''")
def src_samples(spark, sf):
    return jsonl.samples(spark, written_lines(spark, sf))


@query(f"WITH {LINES_SQL} SELECT idx, line FROM l WHERE trim(line) <> '' AND idx < (SELECT count(*) // 2 FROM events) AND idx NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def src_samples_v3(spark, sf):
    e = load(spark, sf, "events")
    return jsonl.samples(spark, written_lines(spark, sf), limit=e.count() // 2, completed=e.where("event_type = 'click'").select(F.col("event_id").alias("idx")))


@query("SELECT user_id % 20 AS part, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) - 1 AS idx, event_id FROM events")
def src_json_array(spark, sf):
    """Files that hold an array each, of the events of some users."""
    path = workspace(spark, "arrays")
    one = load(spark, sf, "events").groupBy((F.col("user_id") % 20).alias("part")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("event_id", "event_type")))).alias("value"))
    one.repartition("part").write.partitionBy("part").text(path)
    rows = jsonl.array_elements(spark, path)
    return rows.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "idx", F.get_json_object("value", "$.event_id").cast("long").alias("event_id"))


@query("SELECT event_id AS sample_index, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM events")
def src_jsonl_tail(spark, sf):
    """A whole output, and beside it one of which the last line was torn."""
    path = workspace(spark, "tail")
    load(spark, sf, "events").orderBy("event_id").select(F.to_json(F.struct(F.col("event_id").alias("sample_index"))).alias("value")).write.text(path)
    Files(spark).write(f"{path}/part-torn.txt", '{"sample_index": 7}')
    return jsonl.resumed(spark, path, "sample_index long").select("sample_index", "idx")


@query("SELECT event_id AS idx, CASE WHEN event_id < 97 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events WHERE event_id < 97")
def src_jsonl_strict_prefix(spark, sf):
    """All lines before the first bad one pass the strict reader."""
    lines = load(spark, sf, "events").select(F.col("event_id").alias("idx"), F.when(F.col("event_id") % 101 == 97, "{").otherwise(F.col("props")).alias("line"))
    return jsonl.strict(lines.where("idx < 97"), "k long")


@query("SELECT p_type AS experiment, p_brand AS model, p_retailprice / 10000 AS precision, p_size / 50 AS recall, CASE WHEN p_partkey % 2 = 0 THEN p_size / 50 END AS full_recall FROM part WHERE p_partkey % 2 = 0 AND p_size / 50 >= 0.5")
def src_experiments(spark, sf):
    path = workspace(spark, "experiments")
    p = load(spark, sf, "part").select("p_type", F.col("p_brand").alias("model"), (F.col("p_retailprice") / 10000).alias("precision"), (F.col("p_size") / 50).alias("recall"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") / 50).alias("full_recall"))
    names = [r[0] for r in p.select("p_type").distinct().collect()]  # one for each experiment
    for name in names:
        own = p.where(F.col("p_type") == name).drop("p_type")
        (own if name != names[0] else own.withColumn("note", F.lit("x"))).write.json(f"{path}/{name}")
    return reports.experiments(spark, [f"{path}/{n}" for n in names], lowest_full_recall=0.5).select("experiment", "model", "precision", "recall", "full_recall")


# ---- patterns

RULE_SQL = r"""rules AS (SELECT item_id, list_filter(string_split(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' '), lambda w: w <> '')[2:4] AS w FROM benchmark),
hits AS (SELECT d.doc_id, r.item_id, regexp_extract(d.text, '(?:^|[^\pL\pM\pN_])(' || w[1] || '\s+' || w[2] || '\s+' || w[3] || ')(?:$|[^\pL\pM\pN_])', 1) AS hit, d.text FROM documents d JOIN rules r ON contains(d.text, w[1]) WHERE len(w) = 3)"""


@query(rf"WITH {RULE_SQL} SELECT DISTINCT doc_id FROM hits WHERE hit <> ''")
def jn_substring(spark, sf):
    """Documents in which the exact rule of some benchmark phrase matches."""
    words = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z]+", " "), " "), lambda w: w != "")
    phrase = load(spark, sf, "benchmark").select(F.col("item_id").alias("seq"), F.slice(words, 2, 3).alias("w")).where("size(w) = 3").select("seq", F.array_join("w", " ").alias("span"))
    learned = rules.learn(phrase, least_chars=1, least_words=1, exact_only=True)
    return rules.apply(load(spark, sf, "documents"), learned, key="doc_id", text_col="text").select("doc_id").distinct()


@query(r"WITH s AS (SELECT item_id, list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: w <> '')[1:2] AS w FROM benchmark), p AS (SELECT item_id, w[1] || ' ' || w[2] AS span FROM s WHERE len(w) = 2) SELECT span, CAST(count(*) AS BIGINT) AS support FROM p WHERE length(span) >= 6 GROUP BY span")
def ag_rules(spark, sf):
    words = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 2)
    spans = load(spark, sf, "benchmark").select(F.col("item_id").alias("seq"), words.alias("w")).where("size(w) = 2").select("seq", F.concat_ws(" ", "w").alias("span"))
    return rules.learn(spans).select(F.col("examples")[0].alias("span"), "support")


# ---- sampling and reports

U_SQL = "CAST('0x' || substr(sha256('42:' || vec_id || ':0'), 1, 13) AS BIGINT) / 4503599627370496.0"


@query(f"""WITH x AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)), k AS (SELECT *, max(x) OVER v AS m, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rn FROM x WINDOW v AS (PARTITION BY vec_id)),
p AS (SELECT *, CASE WHEN x >= (SELECT 1) * t THEN exp((x - m) / 0.1) ELSE 0 END AS p FROM (SELECT *, max(CASE WHEN rn = 20 THEN x END) OVER (PARTITION BY vec_id) AS t FROM k)),
f AS (SELECT *, (sum(p) OVER (PARTITION BY vec_id ORDER BY rn) - p) / sum(p) OVER (PARTITION BY vec_id) AS before FROM p), q AS (SELECT *, CASE WHEN rn = 1 OR before <= 0.8 THEN p ELSE 0 END AS q FROM f),
c AS (SELECT *, sum(q) OVER (PARTITION BY vec_id ORDER BY i) AS c, sum(q) OVER (PARTITION BY vec_id) AS s FROM q) SELECT vec_id, CAST(min(i) AS INTEGER) AS token FROM c WHERE c > {U_SQL} * s GROUP BY vec_id""")
def smp_token(spark, sf):
    u = sampling.uniform(F.lit(42), F.col("vec_id"), F.lit(0))
    return load(spark, sf, "embeddings").select("vec_id", sampling.sample_token(F.col("embedding"), u, temperature=0.1, top_k=20, top_p=0.8).alias("token"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS token FROM embeddings")
def smp_token_greedy(spark, sf):
    return load(spark, sf, "embeddings").select("vec_id", sampling.sample_token(F.col("embedding"), F.lit(None), greedy=True).alias("token"))


@query("""WITH r AS (SELECT l_returnflag AS method, l_linenumber AS model, l_linestatus AS domain, round(l_discount * 10000) AS v FROM lineitem)
SELECT CAST(grouping(method, model, domain) AS BIGINT) AS level, method, model, domain, count(*) AS n, round(avg(v) / 10000, 9) AS mean, round(quantile_cont(v, 0.25) / 10000, 9) AS q25, round(quantile_cont(v, 0.5) / 10000, 9) AS q50, round(quantile_cont(v, 0.75) / 10000, 9) AS q75
FROM r GROUP BY GROUPING SETS ((method, model, domain), (method, model), (method), (domain), ())""")
def jn_cross_runs(spark, sf):
    r = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("model"), F.col("l_linestatus").alias("domain"), "l_discount")
    out = runs.across(r, [("method", "model", "domain"), ("method", "model"), ("method",), ("domain",), ()], F.col("l_discount"))
    return out.select(F.col("level").cast("long").alias("level"), "method", "model", "domain", "n", *(F.round(c, 9).alias(c) for c in ("mean", "q25", "q50", "q75")))


# ---- repair events of an order's lines

@query("SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey * 1000000 + l_suppkey * 10 + l_linenumber) - 1 AS INTEGER) AS n, l_quantity::INT // 5 AS start, l_linenumber::INT AS size FROM lineitem")
def ev_explode(spark, sf):
    e = repairs(spark, sf).select("l_orderkey", F.posexplode("events").alias("n", "e"))
    return e.select("l_orderkey", "n", F.col("e.start").alias("start"), F.col("e.n").alias("size"))


def histories(spark, sf):
    """Tokens of an order, its repairs (which removed one token each) and a baseline that lacks every third token."""
    w = F.struct("l_linenumber", (F.col("l_partkey") % 5).alias("t"), (F.col("l_suppkey") % 5).alias("old"))
    o = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(w)).alias("w"))
    ids = F.transform("w", lambda x: x["t"].cast("long"))
    before = F.transform("w", lambda x, i: F.struct(i.alias("start"), F.array(x["old"].cast("long")).alias("before")))
    return o.select("l_orderkey", ids.alias("ids"), F.filter(before, lambda e: e["start"] % 2 == 1).alias("events"), F.filter(ids, lambda x, i: i % 3 != 2).alias("baseline"))


@query()
def ev_unmatched(spark, sf):
    m = histories(spark, sf).select("l_orderkey", events.baseline_mask(F.col("events"), F.col("ids"), F.col("baseline")).alias("m"))
    return m.select("l_orderkey", F.array_join(F.col("m.mask").cast("array<string>"), "").alias("mask"), "m.unmatched")


@query()
def fn_align(spark, sf):
    return histories(spark, sf).select("l_orderkey", F.posexplode(events.align("ids", "baseline")).alias("n", "block")).select("l_orderkey", "n", "block.*")


LONGEST_SQL = """t AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey % 5 AS x, l_suppkey % 5 AS o FROM lineitem), a AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY n, x, o) - 1 AS i FROM t), b AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS j FROM a WHERE i % 3 <> 2),
m AS (SELECT k, i, j, i - row_number() OVER (PARTITION BY k, i - j ORDER BY i) AS g FROM a JOIN b USING (k, x))"""


@query(f"WITH {LONGEST_SQL} SELECT k AS l_orderkey, CAST(max(n) AS INTEGER) AS longest FROM (SELECT k, count(*) AS n FROM m GROUP BY k, i - j, g) GROUP BY k")
def fn_align_longest(spark, sf):
    """The longest block of an alignment is the longest run that both share."""
    blocks = histories(spark, sf).select("l_orderkey", events.align("ids", "baseline").alias("b")).where(F.size("b") > 0)
    return blocks.select("l_orderkey", F.array_max(F.transform("b", lambda x: x["size"])).alias("longest"))


# ---- parsers over mixed inputs

@query(r"""WITH r AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'x \boxed{' || role || '} y \boxed{ ' || conv_id || '}' WHEN 1 THEN '  ' || role || ' ' || conv_id || '  ' WHEN 2 THEN '<skeleton> a' || turn || ' </skeleton> t <reason>' || role || '</reason>' WHEN 3 THEN '<reason>r</reason><skeleton>s</skeleton>' ELSE '<skeleton>' || role END AS reply FROM conversations)
SELECT conv_id, turn, CASE turn % 5 WHEN 2 THEN 'a' || turn || '/' || regexp_extract(reply, '<reason>(.*)</reason>', 1) || '/ok' WHEN 3 THEN 's/r/order' END AS parsed FROM r WHERE turn % 5 IN (2, 3)""")
def fn_parse_ssr_mixed(spark, sf):
    t = F.col("turn") % 5
    reply = F.when(t == 2, F.concat(F.lit("<skeleton> a"), F.col("turn").cast("string"), F.lit(" </skeleton> t <reason>"), "role", F.lit("</reason>"))).otherwise(F.lit("<reason>r</reason><skeleton>s</skeleton>"))
    rows = load(spark, sf, "conversations").where((t == 2) | (t == 3)).select("conv_id", "turn", text.parse_pair(reply, "skeleton", "reason").alias("p"))
    return rows.select("conv_id", "turn", F.concat_ws("/", "p.skeleton", "p.reason", "p.status").alias("parsed"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def jn_ledger_open(spark, sf):
    """Customers without a large order: the ledger lacks some of them."""
    done = load(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return jobs.not_done(load(spark, sf, "customer").select("c_custkey"), done, ["c_custkey"])


# ---- figures of traces

@query("SELECT event_id AS idx FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 50 IN (7, 8)) ORDER BY event_id LIMIT 960")
def src_quality_lines(spark, sf):
    """The first thousand lines of a file of samples, blank ones counted."""
    return jsonl.samples(spark, written_lines(spark, sf), limit=1000).select("idx")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch FROM orders")
def smp_batch(spark, sf):
    return traces.batches(load(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 64)


@query("SELECT l_returnflag AS k, count(*) AS n, round(avg(round(l_discount * 10000)) / 10000, 9) AS mean, round(quantile_cont(round(l_discount * 10000), 0.5) / 10000, 9) AS median, round((quantile_cont(round(l_discount * 10000), 0.75) - quantile_cont(round(l_discount * 10000), 0.25)) / 10000, 9) AS iqr FROM lineitem GROUP BY 1")
def ag_robust_iqr(spark, sf):
    r = runs.robust(load(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "k"), ["k"], F.col("l_discount"))
    return r.select("k", "n", *(F.round(c, 9).alias(c) for c in ("mean", "median", "iqr")))


@query("SELECT event_type, round(avg(value), 6) AS mean_score, round(quantile_disc(value, 0.5), 6) AS median_score, count(*) FILTER (user_id % 3 = 0) AS leakage_samples, round(avg(value) FILTER (user_id % 3 = 0), 6) AS mean_leakage, round(avg(value) FILTER (NOT user_id % 3 = 0), 6) AS mean_non_leakage FROM events GROUP BY 1")
def ag_shape_parts(spark, sf):
    s = traces.shape_summary(load(spark, sf, "events"), ["event_type"], "value", F.col("user_id") % 3 == 0)
    return s.select("event_type", F.round("mean_score", 6).alias("mean_score"), F.round("median_score", 6).alias("median_score"), "leakage_samples", F.round("mean_leakage", 6).alias("mean_leakage"), F.round("mean_non_leakage", 6).alias("mean_non_leakage"))


@query("""WITH s AS (SELECT l_orderkey AS k, l_linenumber * 100 + l_suppkey % 100 AS pos, l_discount AS x, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS g, l_partkey AS p FROM lineitem), d AS (SELECT *, row_number() OVER (PARTITION BY k, pos ORDER BY x, g, p) AS n FROM s), o AS (SELECT k, pos, x, g FROM d WHERE n = 1),
b AS (SELECT *, g = 1 AND coalesce(lag(g) OVER (PARTITION BY k ORDER BY pos), 0) = 0 AS b FROM o), m AS (SELECT k, min(x) FILTER (b) AS least FROM b GROUP BY k), t(threshold) AS (VALUES (0.0::DOUBLE), (0.03::DOUBLE), (0.07::DOUBLE), (0.5::DOUBLE))
SELECT threshold, count(*) AS samples, count(*) FILTER (least IS NULL OR least >= threshold) AS full_hits, round(count(*) FILTER (least IS NULL OR least >= threshold) / count(*), 9) AS full_recall FROM m, t GROUP BY threshold""")
def ag_full_recall(spark, sf):
    o = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.col("l_linenumber") * 100 + F.col("l_suppkey") % 100).alias("pos"), F.col("l_discount").alias("score"), F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("gold"), "l_partkey")
    one = o.groupBy("sample_id", "pos").agg(F.min(F.struct("score", "gold", "l_partkey")).alias("v")).select("sample_id", "pos", "v.score", "v.gold")
    t = spark.createDataFrame([(0.0,), (0.03,), (0.07,), (0.5,)], "threshold double")
    return traces.full_recall(one, t).withColumn("full_recall", F.round("full_recall", 9))


PAIR_SQL = """x AS (SELECT vec_id, list_transform(embedding[1:40], lambda v: v::DOUBLE) AS blind, list_transform(embedding[25:64], lambda v: v::DOUBLE) AS told FROM embeddings),
g AS (SELECT vec_id, i - 1 AS i, greatest(0, told[i] - blind[i]) AS d FROM x, range(1, 41) r(i)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d DESC, i) AS n FROM g)"""


def scored(spark, sf):
    part = lambda start, n: F.slice(F.col("embedding").cast("array<double>"), start, n)
    return load(spark, sf, "embeddings").select("vec_id", part(1, 40).alias("blind"), part(25, 40).alias("told"))


@query(f"WITH {PAIR_SQL} SELECT vec_id, string_agg('t' || i, '' ORDER BY i) AS text FROM r WHERE NOT (n <= 2 AND d > 0) GROUP BY vec_id")
def fn_pcs_filter_text(spark, sf):
    """A trace of forty tokens without the two that the told context raises most."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(F.lit("t"), i.cast("string")))
    return scored(spark, sf).select("vec_id", traces.filtered_text(tokens, F.col("blind"), F.col("told"))["text"].alias("text"))


@query(f"WITH {PAIR_SQL}, f AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN told[1:39] ELSE list_transform(told, lambda v: v / 2) END AS filtered, blind, told FROM x) SELECT vec_id, round(list_avg(told) - list_avg(blind), 9) AS galg, CASE WHEN len(filtered) = 40 THEN round(list_avg(filtered) - list_avg(blind), 9) END AS lf_galg FROM f")
def fn_galg_lf(spark, sf):
    f = F.when(F.col("vec_id") % 3 == 0, F.slice("told", 1, 39)).otherwise(F.transform("told", lambda v: v / 2))
    g = scored(spark, sf).select("vec_id", traces.answer_gains(F.col("blind"), F.col("told"), f).alias("g"))
    return g.select("vec_id", F.round("g.galg", 9).alias("galg"), F.round("g.lf_galg", 9).alias("lf_galg"))


@query("""WITH s AS (SELECT o_custkey AS k, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 90 AS BIGINT) AS e, CAST(o_orderkey AS VARCHAR) AS note FROM orders),
y AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e, note ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s WHERE e > s), z AS (SELECT *, sum(CASE WHEN b IS NULL OR s >= b THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e, note ROWS UNBOUNDED PRECEDING) AS g FROM y)
SELECT k, min(s) AS "start", max(e) AS "end", string_agg(note, ',' ORDER BY s, e, note) AS notes FROM z GROUP BY k, g""")
def win_merge_notes(spark, sf):
    day = F.datediff(F.col("o_orderdate"), F.lit("1992-01-01")).cast("long")
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("k"), day.alias("start"), (day + F.col("o_orderkey") % 90).alias("end"), F.col("o_orderkey").cast("string").alias("note"))
    return traces.merge_notes(o, "k").withColumn("notes", F.array_join("notes", ","))


@query("SELECT o_orderkey, CAST((9223372036854775000::HUGEINT + o_orderkey) % 9223372036854775808::HUGEINT AS BIGINT) AS seed FROM orders")
def fn_seed_index(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", jobs.seed_of_index(F.col("o_orderkey"), 9223372036854775000).alias("seed"))


@query(r"""SELECT item_id, text || ' ' || chr(10) || 'Given the ground truth answer is $\boxed{' || item_id || '}$.' AS prompt FROM benchmark""")
def prj_prompt_cal(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", text.context_prompt(F.col("text"), F.col("item_id").cast("string"))[0].alias("prompt"))


@query("""WITH f AS (SELECT o_custkey AS k, min(o_orderkey) AS first FROM orders GROUP BY 1) SELECT o_orderkey, first, first % 2 = 0 AS ok FROM orders JOIN f ON k = o_custkey""")
def ag_dedup_fan_back(spark, sf):
    """Orders of a customer share the job of the first; its result comes back to all."""
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("position"))
    done = jobs.shared_jobs(o).select("sample_id", F.col("position").alias("first"), (F.col("position") % 2 == 0).alias("ok"))
    return jobs.fan_back(o, done).select(F.col("position").alias("o_orderkey"), "first", "ok")


THINK_SQL = "t AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN ' a <think> ' || text || ' </think> b ' WHEN 1 THEN text || ' </think> tail ' WHEN 2 THEN '<think> ' || text ELSE text END AS c FROM conversations)"


def thoughts(spark, sf):
    t = F.col("turn") % 4
    c = F.when(t == 0, F.concat(F.lit(" a <think> "), "text", F.lit(" </think> b "))).when(t == 1, F.concat("text", F.lit(" </think> tail "))).when(t == 2, F.concat(F.lit("<think> "), "text")).otherwise(F.col("text"))
    return load(spark, sf, "conversations").select("conv_id", "turn", c.alias("c"))


@query(f"""WITH {THINK_SQL} SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'a  b' ELSE trim(c) END AS split_content, CASE turn % 4 WHEN 0 THEN trim(text) END AS split_reasoning, CASE turn % 4 WHEN 0 THEN 'b' ELSE trim(c) END AS answer,
CASE turn % 4 WHEN 0 THEN trim('a  ' || text) WHEN 1 THEN trim(text) END AS closing, CASE turn % 4 WHEN 0 THEN ' a <think> ' || text || ' ' WHEN 1 THEN text || ' ' WHEN 2 THEN ' ' || text ELSE text END AS reasoning FROM t""")
def fn_think_variants(spark, sf):
    none, c = F.lit(None).cast("string"), F.col("c")
    r = thoughts(spark, sf).select("conv_id", "turn", text.split_reasoning(c).alias("s"), text.think_and_answer(c)["answer"].alias("answer"), text.split_closing(c, none)["reasoning"].alias("closing"), text.reasoning_of(c, none).alias("reasoning"))
    return r.select("conv_id", "turn", F.col("s.content").alias("split_content"), F.col("s.reasoning").alias("split_reasoning"), "answer", "closing", "reasoning")
