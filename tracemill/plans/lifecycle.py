"""Registered queries of the job layer, of parsing and of event folds, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions import text, vectors
from tracemill.operators import events, jobs, spans, traces
from tracemill.plans.catalogue import load, query

# ---- parsing

CONTEXT_SQL = r"""c AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'Take \boxed{' || item_id || '} or \boxed{x' || item_id || '}.' WHEN 1 THEN 'So. Given the ground truth answer is ' || item_id || '. ' || chr(10) ELSE text END AS context FROM benchmark)"""


def contexts(spark, sf):
    i = F.col("item_id").cast("string")
    c = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("Take \\boxed{"), i, F.lit("} or \\boxed{x"), i, F.lit("}."))).when(F.col("item_id") % 3 == 1, F.concat(F.lit("So. Given the ground truth answer is "), i, F.lit(". \n"))).otherwise(F.col("text"))
    return load(spark, sf, "benchmark").select("item_id", c.alias("context"))


@query(rf"""WITH {CONTEXT_SQL} SELECT item_id, CASE WHEN contains(context, '\boxed') THEN regexp_extract(context, '.*\\boxed\{{([^{{}}]*)\}}', 1) WHEN contains(context, 'truth answer is') THEN trim(regexp_extract(context, '(?s)truth answer is(.*)', 1), ' .' || chr(10)) END AS answer FROM c""")
def prj_ctx_parse(spark, sf):
    return contexts(spark, sf).select("item_id", text.context_answer(F.col("context")).alias("answer"))


@query(r"""WITH k AS (SELECT p_partkey, replace(p_name, ' ', '-') || '-' || CASE p_partkey % 5 WHEN 0 THEN 'multihop-reasoning' WHEN 1 THEN 'science' WHEN 2 THEN 'logic' WHEN 3 THEN 'math' ELSE 'other' END AS key FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN regexp_replace(key, '-(multihop-reasoning|science|logic|math)$', '') ELSE '' END AS model, regexp_extract(key, '(multihop-reasoning|science|logic|math)$', 1) AS domain FROM k""")
def prj_split_key(spark, sf):
    p = F.col("p_partkey") % 5
    key = F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-"), F.when(p == 0, "multihop-reasoning").when(p == 1, "science").when(p == 2, "logic").when(p == 3, "math").otherwise("other"))
    return load(spark, sf, "part").select("p_partkey", text.split_key(key).alias("k")).select("p_partkey", "k.*")


@query(r"""WITH b AS (SELECT conv_id, turn, repeat(' ', CAST(turn % 3 AS INTEGER)) || chr(10) || CASE WHEN turn % 4 = 3 THEN '' ELSE text END || ' ' || chr(9) AS t FROM conversations), s AS (SELECT *, length(t) AS e, length(t) - length(ltrim(t, ' ' || chr(10) || chr(9))) AS a FROM b)
SELECT conv_id, turn, CASE WHEN trim(t, ' ' || chr(10) || chr(9)) = '' THEN e ELSE a END AS "start", CASE WHEN trim(t, ' ' || chr(10) || chr(9)) = '' THEN e ELSE length(rtrim(t, ' ' || chr(10) || chr(9))) END AS "end" FROM s""")
def fn_trim_span(spark, sf):
    t = F.concat(F.repeat(F.lit(" "), (F.col("turn") % 3).cast("int")), F.lit("\n"), F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("text")), F.lit(" \t"))
    rows = load(spark, sf, "conversations").select("conv_id", "turn", t.alias("t"))
    return rows.select("conv_id", "turn", text.trim_span(F.col("t"), F.lit(0), F.length("t")).alias("s")).select("conv_id", "turn", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query("SELECT doc_id, strpos(text, lang || ' ') - 1 AS at FROM documents")
def fn_first_idx(spark, sf):
    return load(spark, sf, "documents").select("doc_id", text.first_index(F.col("text"), F.concat("lang", F.lit(" "))).cast("long").alias("at"))


PARTS = "[substr(text, 9, 7), substr(text, 3, 4), substr(text, 20, 5)]"


def parts():
    return F.array(*(F.substring("text", a, n) for a, n in ((9, 7), (3, 4), (20, 5))))


@query(f"SELECT item_id, CASE WHEN item_id % 4 = 0 THEN text ELSE substr(text, 1, strpos(text, {PARTS}[1]) - 1 + length({PARTS}[1])) END AS cut FROM benchmark")
def fn_prefix_cut(spark, sf):
    none = F.when(F.col("item_id") % 4 == 0, F.array().cast("array<string>")).otherwise(parts())
    return load(spark, sf, "benchmark").select("item_id", text.prefix_cut(F.col("text"), none).alias("cut"))


@query(f"SELECT item_id, array_to_string(list_transform(list_sort(list_transform(range(1, 4), lambda i: {{'at': strpos(text, {PARTS}[i]), 'i': i, 's': {PARTS}[i]}})), lambda x: x.s), '|') AS sorted FROM benchmark")
def srt_spans(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", F.array_join(text.by_position(parts(), F.col("text")), "|").alias("sorted"))


WORDS5 = r"regexp_extract_all(text, '[a-z]+')[1:12]"


@query(f"SELECT item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct({WORDS5}), lambda w: {{'at': list_position({WORDS5}, w), 'w': w}})), lambda x: x.w), ' ') AS words FROM benchmark")
def ag_dedup_spans(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", F.array_join(text.distinct_spans(F.slice(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)), 1, 12)), " ").alias("words"))


JUDGED_SQL = r"""j AS (SELECT item_id, text, regexp_extract_all(text, '[a-z]{4,}') AS w FROM benchmark), r AS (SELECT *, CASE item_id % 6
  WHEN 0 THEN 'Found: ["' || w[3] || '", " ' || w[1] || ' ", "", "' || w[3] || '"] as asked' WHEN 1 THEN '["' || w[1] || '", 7]' WHEN 2 THEN '["' || w[2] || 'qqq"]' WHEN 3 THEN 'nothing found' WHEN 4 THEN 'None: [ ]' ELSE '["' || w[1] || '", null]' END AS reply FROM j)"""


@query(rf"""WITH {JUDGED_SQL} SELECT item_id, CASE item_id % 6 WHEN 0 THEN CASE WHEN w[1] = w[3] THEN w[1] WHEN strpos(text, w[1]) < strpos(text, w[3]) THEN w[1] || '|' || w[3] WHEN strpos(text, w[1]) = strpos(text, w[3]) THEN w[3] || '|' || w[1] ELSE w[3] || '|' || w[1] END WHEN 4 THEN '' END AS spans,
CASE item_id % 6 WHEN 1 THEN 'not_strings' WHEN 2 THEN 'not_copied' WHEN 3 THEN 'no_array' WHEN 5 THEN 'not_strings' END AS error FROM r""")
def fn_parse_spans(spark, sf):
    w = F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))
    i, q = F.col("item_id") % 6, F.lit('"')
    reply = (
        F.when(i == 0, F.concat(F.lit('Found: ["'), w[2], F.lit('", " '), w[0], F.lit(' ", "", "'), w[2], F.lit('"] as asked'))).when(i == 1, F.concat(F.lit('["'), w[0], F.lit('", 7]'))).when(i == 2, F.concat(F.lit('["'), w[1], F.lit("qqq"), q, F.lit("]")))
        .when(i == 3, "nothing found").when(i == 4, "None: [ ]").otherwise(F.concat(F.lit('["'), w[0], F.lit('", null]')))
    )
    rows = load(spark, sf, "benchmark").select("item_id", text.parse_spans(reply, F.col("text")).alias("p"))
    return rows.select("item_id", F.array_join("p.spans", "|").alias("spans"), "p.error")


@query(r"""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN trim(role) WHEN turn % 4 = 1 THEN CAST(conv_id AS VARCHAR) WHEN turn % 4 = 2 THEN 'b' || turn END AS answer FROM conversations""")
def fn_parse_answer(spark, sf):
    t = F.col("turn") % 4
    i = F.col("conv_id").cast("string")
    solution = F.when(t == 1, F.concat("text", F.lit(" #### "), i, F.lit(" "))).when(t == 2, F.concat(F.lit("so \\boxed{a} and \\boxed{b"), F.col("turn").cast("string"), F.lit("}"))).otherwise(F.lit("none"))
    return load(spark, sf, "conversations").select("conv_id", "turn", text.parse_answer(F.when(t == 0, F.concat(F.lit(" "), "role", F.lit("\n"))), solution, "#### ").alias("answer"))


@query(r"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN ' ' || conv_id WHEN 1 THEN ' ' || role WHEN 2 THEN NULL ELSE ' }' END AS truth FROM conversations""")
def fn_ground_truth(spark, sf):
    t = F.col("turn") % 4
    answer = F.when(t == 0, F.concat(F.lit("\\boxed{ "), F.col("conv_id").cast("string"), F.lit("}"))).when(t == 2, F.lit("See Another Answer below"))
    content = F.when(t == 1, F.concat(F.lit("x \\boxed{"), "role", F.lit("} \\boxed{no}"))).otherwise(F.lit("y \\boxed{}}"))
    return load(spark, sf, "conversations").select("conv_id", "turn", text.ground_truth(answer, content).alias("truth"))


@query(r"""WITH b AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '\boxed{a{' || conv_id || '}c} \boxed{z}' WHEN 1 THEN '\boxed{}}' WHEN 2 THEN '\boxed{open {' WHEN 3 THEN text ELSE 'so \boxed{} end' END AS t FROM conversations)
SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN regexp_extract(t, '\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}', 1) WHEN 1 THEN '}' WHEN 4 THEN '' END AS box FROM b""")
def fn_boxed_first_edge(spark, sf):
    t = F.col("turn") % 5
    c = F.when(t == 0, F.concat(F.lit("\\boxed{a{"), F.col("conv_id").cast("string"), F.lit("}c} \\boxed{z}"))).when(t == 1, F.lit("\\boxed{}}")).when(t == 2, F.lit("\\boxed{open {")).when(t == 3, F.col("text")).otherwise(F.lit("so \\boxed{} end"))
    return load(spark, sf, "conversations").select("conv_id", "turn", text.boxed_first(c).alias("box"))


@query(r"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'r ' || role ELSE ' <think> r ' || role END AS response FROM conversations""")
def fn_think_dedup(spark, sf):
    prompt = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("<think>\n"))).otherwise(F.col("text"))
    return load(spark, sf, "conversations").select("conv_id", "turn", text.think_dedup(prompt, F.concat(F.lit(" <think> r "), "role")).alias("response"))


@query("""WITH p AS (SELECT item_id, text AS a, coalesce(lead(text) OVER (ORDER BY item_id), '') AS b FROM benchmark)
SELECT item_id, CAST(coalesce((SELECT max(i) FROM (SELECT unnest(range(0, least(length(a), length(b)) + 1)) AS i) WHERE substr(a, 1, i) = substr(b, 1, i)), 0) AS INTEGER) AS head, CAST(coalesce((SELECT max(i) FROM (SELECT unnest(range(0, least(length(a), length(b)) + 1)) AS i) WHERE right(a, i) = right(b, i)), 0) AS INTEGER) AS tail FROM p""")
def fn_common_len(spark, sf):
    ranked = jobs.with_rank(load(spark, sf, "benchmark").select("item_id", F.col("text").alias("a")), ["item_id"])
    after = ranked.select((F.col("rn") - 1).alias("rn"), F.col("a").alias("b"))
    p = ranked.join(after, "rn", "left").withColumn("b", F.coalesce("b", F.lit("")))
    return p.select("item_id", text.common_length(F.col("a"), F.col("b")).alias("head"), text.common_length(F.col("a"), F.col("b"), True).alias("tail"))


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN '1,3,20' ELSE array_to_string(list_sort(list_distinct([1, 3, p_size])), ',') END AS grid FROM part")
def set_union_grid(spark, sf):
    raw = F.concat(F.lit("3, "), F.col("p_size").cast("string"), F.lit(",,1,3,-2,0"))
    return load(spark, sf, "part").select("p_partkey", F.array_join(text.int_grid(raw, 20).cast("array<string>"), ",").alias("grid"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 1 ELSE 5 END AS n, CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE p_retailprice END AS top, CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE p_retailprice * 2 / 4 END AS third FROM part")
def fn_linspace(spark, sf):
    t = vectors.linspace(F.when(F.col("p_size") % 7 == 0, F.lit(-1.0)).otherwise(F.col("p_retailprice")), 5)
    return load(spark, sf, "part").select("p_partkey", F.size(t).alias("n"), F.element_at(t, -1).alias("top"), F.when(F.size(t) == 5, F.element_at(t, 3)).otherwise(0.0).alias("third"))


@query("""SELECT event_id, '{"a": "é", "k": ' || json_extract_string(props, '$.k') || ', "z": {"b": [1, 2], "c": null}}' AS canonical FROM events""")
def fn_canonical_json(spark, sf):
    raw = F.concat(F.lit('{"z":{"c":null,"b":[1,2]}, "k":'), F.get_json_object("props", "$.k"), F.lit(',"a":"\\u00e9"}'))
    return load(spark, sf, "events").select("event_id", text.canonical_json(raw).alias("canonical"))


@query("""SELECT event_id, sha256('{"event_id": ' || event_id || ', "kind": "' || event_type || '"}') AS id FROM events""")
def fn_digest(spark, sf):
    raw = F.to_json(F.struct(F.col("event_type").alias("kind"), "event_id"))
    return load(spark, sf, "events").select("event_id", F.sha2(text.canonical_json(raw), 256).alias("id"))


@query("SELECT n_nationkey, n_regionkey AS r, 'new' AS state, n_name AS name FROM nation")
def fn_map_merge(spark, sf):
    old = F.create_map(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("state"), F.lit("old"))
    new = F.create_map(F.lit("state"), F.lit("new"), F.lit("name"), F.col("n_name"))
    m = load(spark, sf, "nation").select("n_nationkey", traces.merged(old, new).alias("m"))
    return m.select("n_nationkey", F.col("m")["r"].cast("int").alias("r"), F.col("m")["state"].alias("state"), F.col("m")["name"].alias("name"))


CHAT_SQL = """m AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts, count(*) AS n FROM conversations GROUP BY conv_id)"""


def chats(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    c = load(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return c.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("m"))


@query(f"""WITH {CHAT_SQL} SELECT conv_id, 'system' || CASE WHEN n > 1 AND roles[1] = 'system' THEN '' WHEN n > 1 THEN ',' || roles[1] ELSE '' END || CASE WHEN n > 2 THEN ',' || array_to_string(roles[2:n - 1], ',') ELSE '' END AS roles, 'Be precise.' AS first FROM m""")
def fn_question_messages(spark, sf):
    q = chats(spark, sf).select("conv_id", text.question_messages(F.col("m"), "Be precise.").alias("q"))
    return q.select("conv_id", F.array_join(F.transform("q", lambda x: x["role"]), ",").alias("roles"), F.col("q")[0]["content"].alias("first"))


@query("""SELECT conv_id, string_agg(CASE WHEN turn = last THEN text || ' [told]' ELSE text END, '|' ORDER BY turn) AS contents FROM (SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE last IS NOT NULL GROUP BY conv_id""")
def fn_context_messages(spark, sf):
    some = chats(spark, sf).where(F.exists("m", lambda x: x["role"] == "user"))
    return some.select("conv_id", F.array_join(F.transform(text.with_context(F.col("m"), F.lit(" [told]")), lambda x: x["content"]), "|").alias("contents"))


@query("SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn) || chr(10) || '<|assistant|>' || chr(10) AS prompt FROM conversations GROUP BY conv_id")
def fn_chat_template(spark, sf):
    return chats(spark, sf).select("conv_id", text.chat_template(F.col("m")).alias("prompt"))


@query("""WITH n AS (SELECT n_nationkey, lower(substr(n_name, 1, 2)) AS needle FROM nation), p AS (SELECT item_id, n_nationkey, length(needle) AS w, string_split(text, needle) AS parts FROM benchmark, n),
k AS (SELECT *, unnest(range(1, len(parts))) AS i FROM p) SELECT item_id, n_nationkey, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * w AS BIGINT) AS "start", CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + i * w AS BIGINT) AS "end" FROM k""")
def fn_find_all_short(spark, sf):
    needles = load(spark, sf, "nation").select("n_nationkey", F.lower(F.substring("n_name", 1, 2)).alias("needle"))
    return spans.occurrences(load(spark, sf, "benchmark"), needles, key="item_id", text="text", needle_key="n_nationkey", needle="needle")


# ---- jobs

RAW_SQL = """raw AS (SELECT o_orderkey AS idx, CASE o_orderkey % 8 WHEN 0 THEN '{"question": "q' || o_orderkey || '", "ground_truth": 0}' WHEN 1 THEN '{"question": "q", "ground_truth": "42."}' WHEN 2 THEN '{"question": "  ", "ground_truth": 1}' WHEN 3 THEN '{"question": "q", "ground_truth": true}'
  WHEN 4 THEN '{"question": "q", "ground_truth": " "}' WHEN 5 THEN '{"question": 5, "ground_truth": 1}' WHEN 6 THEN '[1]' ELSE '{"question": "q", "ground_truth": [1]}' END AS line FROM orders)"""


def raw_lines(spark, sf):
    k = F.col("o_orderkey")
    first = F.concat(F.lit('{"question": "q'), k.cast("string"), F.lit('", "ground_truth": 0}'))
    others = ['{"question": "q", "ground_truth": "42."}', '{"question": "  ", "ground_truth": 1}', '{"question": "q", "ground_truth": true}', '{"question": "q", "ground_truth": " "}', '{"question": 5, "ground_truth": 1}', "[1]", '{"question": "q", "ground_truth": [1]}']
    line = F.when(k % 8 == 0, first)
    for i, x in enumerate(others, 1):
        line = line.when(k % 8 == i, x)
    return load(spark, sf, "orders").select(k.alias("idx"), line.alias("line"))


STATE_SQL = """CASE WHEN NOT json_type(line) = 'OBJECT' THEN 'no object' WHEN json_type(line, '$.question') <> 'VARCHAR' OR trim(json_extract_string(line, '$.question')) = '' THEN 'question' WHEN json_type(line, '$.ground_truth') NOT IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE') THEN 'answer kind' WHEN trim(json_extract_string(line, '$.ground_truth')) = '' THEN 'answer empty' END"""


@query(f"WITH {RAW_SQL}, s AS (SELECT *, {STATE_SQL} AS reason FROM raw) SELECT idx, CASE WHEN reason IS NULL THEN 'ready' ELSE 'skipped' END AS status, reason FROM s")
def src_validate(spark, sf):
    return jobs.prepare(raw_lines(spark, sf)).select("idx", "status", "reason")


@query(f"""WITH {RAW_SQL}, s AS (SELECT *, {STATE_SQL} AS reason FROM (SELECT * FROM raw ORDER BY idx LIMIT 500)) SELECT idx, json_extract_string(line, '$.ground_truth') AS ground_truth, 'Given the ground truth answer is ' || json_extract_string(line, '$.ground_truth') AS privileged_context,
json_extract_string(line, '$.question') || chr(10) || chr(10) || 'Explain step by step. Given the ground truth answer is ' || json_extract_string(line, '$.ground_truth') AS prompt_w_answer FROM s WHERE reason IS NULL""")
def prj_format_v3(spark, sf):
    return jobs.prepare(raw_lines(spark, sf), limit=500, instruction="Explain step by step.").where("status = 'ready'").select("idx", "ground_truth", "privileged_context", "prompt_w_answer")


RECORD_SQL = "records AS (SELECT l_orderkey * 10 + l_linenumber AS position, CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'success' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'skipped' ELSE 'success' END END AS status, CASE l_linestatus WHEN 'F' THEN 'eos' ELSE 'length' END AS finish_reason FROM lineitem)"


def records(spark, sf):
    status = F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "success").when(F.col("l_linenumber") % 2 == 0, "skipped").otherwise("success")
    return load(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), status.alias("status"), F.when(F.col("l_linestatus") == "F", "eos").otherwise("length").alias("finish_reason"))


@query(f"WITH {RECORD_SQL} SELECT 'detail' AS file, count(*) AS n, CAST(sum(position) AS BIGINT) AS positions FROM records UNION ALL SELECT 'sft', count(*), CAST(sum(position) AS BIGINT) FROM records WHERE status = 'success' AND finish_reason = 'eos'")
def snk_dual(spark, sf):
    both = jobs.exports(records(spark, sf), require_eos=True)
    one, two = (d.agg(F.lit(name).alias("file"), F.count(F.lit(1)).alias("n"), F.sum("position").alias("positions")) for d, name in zip(both, ("detail", "sft")))
    return one.unionByName(two)


@query(f"WITH {RECORD_SQL} SELECT * FROM records WHERE status IN ('success', 'skipped')")
def flt_ready(spark, sf):
    return jobs.ready(records(spark, sf))


@query(f"WITH {RECORD_SQL} SELECT row_number() OVER (ORDER BY position) AS line, position FROM records")
def srt_restore(spark, sf):
    r = jobs.with_rank(records(spark, sf).select("position"), ["position"])
    return r.select(F.col("rn").alias("line"), "position")


@query("SELECT o_orderkey, o_custkey % 7 = o_orderkey % 7 AS equal FROM orders WHERE o_orderkey % 3 = 0")
def jn_agree(spark, sf):
    o = load(spark, sf, "orders")
    return jobs.agreement(o.select("o_orderkey", (F.col("o_custkey") % 7).alias("v")), o.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_orderkey") % 7).alias("v")), "o_orderkey", "v")


@query("SELECT c_custkey, n_nationkey, n_name AS detector FROM customer JOIN nation ON c_nationkey = n_nationkey")
def jn_config(spark, sf):
    d = load(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("detector"))
    return jobs.with_detector(load(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), F.broadcast(d), "n_nationkey")


@query("WITH b AS (SELECT n_nationkey AS block, row_number() OVER (ORDER BY n_nationkey) - 1 AS layer FROM nation WHERE n_nationkey % 2 = 1) SELECT p_partkey, layer, block FROM part JOIN b ON p_size % 12 = layer")
def jn_layer_map(spark, sf):
    heads = load(spark, sf, "part").select("p_partkey", (F.col("p_size") % 12).alias("layer"))
    return jobs.map_layers(heads, load(spark, sf, "nation").where("n_nationkey % 2 = 1").select(F.col("n_nationkey").alias("block")))


@query("SELECT r_name AS model, item_id FROM region, benchmark")
def jn_cross_models(spark, sf):
    return traces.for_each_model(load(spark, sf, "benchmark").select("item_id"), load(spark, sf, "region").select(F.col("r_name").alias("model")))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def jn_ledger(spark, sf):
    return jobs.not_done(load(spark, sf, "customer").select("c_custkey"), load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def jn_anti_index(spark, sf):
    return jobs.not_done(load(spark, sf, "orders").select("o_orderkey"), load(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT o_custkey % 5 AS batch_size, round(sum(l_quantity) / sum(l_linenumber), 6) AS tokens_per_second, round(count(*) / sum(l_linenumber), 6) AS samples_per_second FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def ag_token_ratio(spark, sf):
    j = load(spark, sf, "lineitem").join(load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    r = traces.rates(j, [(F.col("o_custkey") % 5).alias("batch_size")], F.col("l_quantity"), F.col("l_linenumber"))
    return r.select("batch_size", *(F.round(c, 6).alias(c) for c in ("tokens_per_second", "samples_per_second")))


@query("WITH r AS (SELECT s_nationkey AS batch_size, s_acctbal + 2000 AS tokens, s_suppkey + 1 AS seconds FROM supplier), g AS (SELECT batch_size, count(*) AS n, sum(tokens) / sum(seconds) AS rate FROM r GROUP BY 1) SELECT batch_size, rate FROM g WHERE n = 1 ORDER BY rate DESC, batch_size LIMIT 1")
def ag_best_batch(spark, sf):
    r = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("batch_size"), (F.col("s_acctbal") + 2000).alias("tokens"), (F.col("s_suppkey") + 1).alias("seconds"))
    return jobs.best_batch(r, 1)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) = count(DISTINCT user_id) AS distinct_ FROM events GROUP BY 1")
def set_membership(spark, sf):
    return traces.distinctness(load(spark, sf, "events"), ["event_type"], "user_id").toDF("event_type", "n", "users", "distinct_")


@query("SELECT l_orderkey, bool_or(l_quantity > 40) AS predicted, bool_or(l_quantity > 40) AND bool_or(l_discount > 0.05) AS both_ FROM lineitem GROUP BY 1")
def set_pred_mask(spark, sf):
    return traces.token_masks(load(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_quantity") > 40, F.col("l_discount") > 0.05).withColumnRenamed("both", "both_")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 250 OFFSET 100")
def lim_slice(spark, sf):
    return jobs.ordered_slice(load(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 100, 350)


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 75")
def lim_max(spark, sf):
    return traces.first_valid(load(spark, sf, "orders"), F.col("o_totalprice") > 1000, ["o_orderkey"], 75).select("o_orderkey")


@query("SELECT item_id FROM benchmark ORDER BY item_id LIMIT 20")
def src_gsm(spark, sf):
    return load(spark, sf, "benchmark").select("item_id").orderBy("item_id").limit(20)


@query("SELECT event_id AS idx FROM events WHERE event_id < 1000")
def src_quality(spark, sf):
    return load(spark, sf, "events").select(F.col("event_id").alias("idx")).where("idx < 1000")


@query("WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY sha256('42:' || o_orderkey), o_orderkey) AS rn FROM orders) SELECT o_orderkey FROM (SELECT * FROM o WHERE rn > 50 AND rn <= 600 AND o_totalprice > 1000 ORDER BY rn LIMIT 200)")
def src_hf(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return traces.seeded_examples(o, "o_orderkey", 50, 600, F.col("o_totalprice") > 1000, 200).select("o_orderkey")


@query("SELECT p_partkey, p_retailprice AS score FROM part ORDER BY p_retailprice, p_partkey LIMIT 10")
def srt_lowest(spark, sf):
    return traces.lowest(load(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("score")), "score", "p_partkey", 10)


@query("SELECT doc_id, len(w) AS n FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Z][a-z]+')[1:5], lambda x: length(x) > 8) AS w FROM documents) WHERE len(w) > 0")
def flt_nonempty_spans(spark, sf):
    w = F.filter(F.slice(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)), 1, 5), lambda x: F.length(x) > 8)
    return traces.with_spans(load(spark, sf, "documents").select("doc_id", w.alias("w")), "w").select("doc_id", F.size("w").cast("long").alias("n"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars <= 2000 AND contains(text, ' the ') AND n_chars > 20")
def flt_len(spark, sf):
    d = load(spark, sf, "documents")
    return traces.fit_for_training(d, F.col("n_chars"), 2000, F.contains("text", F.lit(" the ")), F.col("n_chars") > 20).select("doc_id", "n_chars")


@query("SELECT p_partkey, p_brand AS model FROM part WHERE p_size >= 10 AND p_type IS NOT NULL AND p_brand = 'Brand#1'")
def flt_experiment(spark, sf):
    p = traces.measured(load(spark, sf, "part"), model="Brand#1", lowest_full_recall=10, model_col="p_brand", precision="p_type", recall="p_partkey", full_recall="p_size")
    return p.select("p_partkey", F.col("p_brand").alias("model"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount >= 0.05")
def flt_threshold(spark, sf):
    return load(spark, sf, "lineitem").where(traces.leaks(F.col("l_discount"), 0.05)).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, greatest(0, l_linenumber - (l_quantity::INT - 1) // 2) AS start FROM lineitem")
def win_backtrack(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", traces.backtrack_start(F.col("l_linenumber"), F.col("l_quantity")).alias("start"))


@query("""SELECT event_id, min(event_id) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS first_safe FROM events""")
def win_first_tempsafe(spark, sf):
    return traces.first_safe(load(spark, sf, "events"), "user_id", "event_id", F.col("event_type") == "click", 5).select("event_id", "first_safe")


@query("SELECT vec_id, round(embedding[1]::DOUBLE + embedding[6]::DOUBLE + embedding[64]::DOUBLE, 9) AS mass FROM embeddings")
def fn_attn_mass(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.select("vec_id", F.round(vectors.attention_mass(F.col("embedding").cast("array<double>"), F.array(F.lit(0), F.lit(5), F.lit(63), F.lit(80))), 9).alias("mass"))


@query("""WITH t AS (SELECT vec_id, i, CASE WHEN embedding[i + 1] >= 0.1 THEN 1 ELSE 0 END AS h, CASE WHEN (i + vec_id) % 9 < 3 AND vec_id % 5 > 0 THEN 1 ELSE 0 END AS g FROM embeddings, range(64) r(i)),
o AS (SELECT *, h = 1 AND coalesce(lag(h) OVER w, 0) = 0 AS ho, g = 1 AND coalesce(lag(g) OVER w, 0) = 0 AS go FROM t WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
s AS (SELECT *, sum(ho::INT) OVER (PARTITION BY vec_id ORDER BY i) AS span FROM o), p AS (SELECT vec_id, span, bool_or(go) AS ok FROM s WHERE h = 1 GROUP BY 1, 2),
pr AS (SELECT vec_id, count(*) AS m, count(*) FILTER (ok) AS rightn FROM p GROUP BY 1), gr AS (SELECT vec_id, count(*) FILTER (go) AS n, count(*) FILTER (go AND h = 1) AS found, sum(h * g) AS both_, sum(h) AS predicted FROM s GROUP BY 1)
SELECT vec_id, found::INT AS detected_gold_spans, (n - found)::INT AS missed_gold_spans, n::INT AS total_gold_spans, coalesce(rightn, 0)::INT AS correct_pred_spans, (coalesce(m, 0) - coalesce(rightn, 0))::INT AS false_pred_spans, coalesce(m, 0)::INT AS total_pred_spans, both_::INT AS correct_pred_tokens, predicted::INT AS predicted_tokens,
coalesce(rightn, 0) / greatest(coalesce(m, 0), 1) AS precision, found / greatest(n, 1) AS recall, CASE WHEN found = n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS full_recall FROM gr LEFT JOIN pr USING (vec_id)""")
def fn_span_metrics(spark, sf):
    e = load(spark, sf, "embeddings")
    gold = F.transform("embedding", lambda v, i: F.when(((i + F.col("vec_id")) % 9 < 3) & (F.col("vec_id") % 5 > 0), 1).otherwise(0))
    return e.select("vec_id", gold.alias("g"), "embedding").select("vec_id", spans.sample_metrics(F.col("embedding"), F.col("g"), F.lit(0.1).cast("float")).alias("m")).select("vec_id", "m.*")


# ---- repair events: those of an order are its lines, each starting at quantity // 5 with as many tokens as its line number

EVENT_SQL = "ev AS (SELECT l_orderkey AS k, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS t, l_quantity::INT // 5 AS s, l_linenumber::INT AS n FROM lineitem)"


def repairs(spark, sf):
    e = F.struct((F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("t"), F.floor(F.col("l_quantity").cast("int") / 5).cast("int").alias("start"), F.col("l_linenumber").cast("int").alias("n"))
    return load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(e)).alias("events"))


@query(f"""WITH {EVENT_SQL}, p AS (SELECT k, i, (SELECT arg_max(s + n, t) FROM ev e WHERE e.k = o.k AND e.s <= i) AS last_end FROM (SELECT DISTINCT k FROM ev) o, range(12) r(i))
SELECT k AS l_orderkey, string_agg(CASE WHEN last_end > i THEN '1' ELSE '0' END, '' ORDER BY i) AS mask FROM p GROUP BY k""")
def ev_masks_lines(spark, sf):
    return repairs(spark, sf).select("l_orderkey", F.array_join(events.mask(F.col("events"), F.lit(12)).cast("array<string>"), "").alias("mask"))


@query(f"""WITH {EVENT_SQL}, v AS (SELECT *, least(12, coalesce(min(s) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 12)) AS lim FROM ev)
SELECT k AS l_orderkey, s AS "start", least(s + n, lim)::INT AS "end", s + n <= lim AS whole FROM v WHERE s < least(s + n, lim)""")
def ev_visible(spark, sf):
    return repairs(spark, sf).select("l_orderkey", F.explode(events.visible(F.col("events"), F.lit(12))).alias("v")).select("l_orderkey", "v.*")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_suppkey END AS first_id FROM lineitem")
def ev_compat(spark, sf):
    after = F.when(F.col("l_linenumber") % 2 == 0, F.struct(F.array("l_partkey").alias("token_ids")))
    e = F.struct(after.alias("after"), F.when(F.col("l_linenumber") % 2 == 1, F.array("l_suppkey")).alias("replacement_token_ids"))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", events.replaced(e)[0].alias("first_id"))


@query(f"""WITH w AS (SELECT item_id, text, {PARTS} AS p FROM benchmark), s AS (SELECT item_id, text, p, unnest(range(0, 3)) AS stage FROM w)
SELECT item_id, stage::INT AS stage, substr(text, 1, strpos(text, p[stage + 1]) - 1 + length(p[stage + 1])) AS text, p[stage + 1] AS span FROM s WHERE stage < 2 OR item_id % 2 = 0 AND stage < 0 UNION ALL SELECT item_id, 2, text, '' FROM w WHERE item_id % 2 = 0""")
def ev_stage_unroll(spark, sf):
    some = F.when(F.col("item_id") % 2 == 0, F.slice(parts(), 1, 2)).otherwise(parts())
    rows = load(spark, sf, "benchmark").select("item_id", F.explode(events.stages(F.col("text"), some, 2)).alias("s"))
    return rows.select("item_id", "s.stage", "s.text", F.coalesce(F.try_element_at("s.spans", F.lit(1)), F.lit("")).alias("span"))
