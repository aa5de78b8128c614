import json
import random
import time
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracemill.functions import text, vectors
from tracemill.operators import events, jobs, literals, spans
from tracemill.sources.versions import Store


def one(spark, c, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(c.alias("x")).first().x


def test_occurrences_step_by_length_and_start_anywhere(spark):
    docs = spark.createDataFrame([(1, "go go go go go go go"), (2, "prefix-alpha beta gamma delta"), (3, None), (4, ""), (5, "aaaaa é aa")], "d int, t string")
    needles = spark.createDataFrame([("g", "go go go go"), ("b", "alpha beta gamma"), ("s", "aa"), ("n", None), ("e", ""), ("s2", "aa")], "n string, t string")
    got = spans.occurrences(docs, needles, key="d", text="t", needle_key="n", needle="t")
    want = {(1, "g", 0, 11), (2, "b", 7, 23)} | {(5, n, s, s + 2) for n in ("s", "s2") for s in (0, 2, 8)}
    assert {tuple(r) for r in got.select("d", "n", "start", "end").collect()} == want
    assert spans.occurrences(docs, needles.limit(0), key="d", text="t", needle_key="n", needle="t").count() == 0
    assert spans.occurrences(docs.limit(0), needles, key="d", text="t", needle_key="n", needle="t").count() == 0


def test_needles_meet_texts_by_inner_words_and_by_first_characters(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha beta gamma")], "d int, t string")
    needles = spark.createDataFrame([(i, w) for i, w in enumerate("alpha beta gamma pha eta mm".split())], "n int, t string")
    got = {tuple(r) for r in spans.occurrences(docs, needles, key="d", text="t", needle_key="n", needle="t").select("n", "start").collect()}
    assert got == {(0, 0), (1, 6), (2, 11), (3, 2), (4, 7), (5, 13)}
    r = random.Random(8)
    words = ["a", "b", "é", "\\E.*", "\U0001f600", "the", "a\u00a0b", "\n"]
    make = lambda n: "".join(r.choice(words) + r.choice(["", " ", "  ", "\t"]) for _ in range(n))
    texts, wanted = [(i % 30, make(25)) for i in range(40)] + [(3, "the the")] * 2, [(i, make(r.randint(1, 5))) for i in range(60)]
    expected = []
    for d, t in texts:
        for n, x in wanted:
            at = t.find(x)
            while at >= 0:
                expected.append((d, n, at, at + len(x)))
                at = t.find(x, at + len(x))
    found = spans.occurrences(spark.createDataFrame(texts, "d int, t string"), spark.createDataFrame(wanted, "n int, t string"), key="d", text="t", needle_key="n", needle="t")
    rows = sorted(map(tuple, found.select("d", "n", "start", "end").collect()))
    assert rows == sorted(expected)
    monkeypatch.setattr(literals, "BROADCAST_WORDS", 2)  # more words than are broadcast
    found = spans.occurrences(spark.createDataFrame(texts, "d int, t string"), spark.createDataFrame(wanted, "n int, t string"), key="d", text="t", needle_key="n", needle="t")
    assert sorted(map(tuple, found.select("d", "n", "start", "end").collect())) == rows


def test_vector_functions_in_time_proportional_to_length(spark):
    took = {}
    for n in (500, 4000):
        df = spark.range(8).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.rand(1) + i / n).alias("x"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i % 3).cast("double")).alias("y"))
        fs = [vectors.js_divergence(F.col("x"), F.col("y")), vectors.contrast_score(F.col("x"), F.col("y")), vectors.variation(F.col("x"))]
        df.agg(*(F.sum(f) for f in fs)).collect()
        t = time.time()
        df.agg(*(F.sum(f) for f in fs)).collect()
        took[n] = time.time() - t
    assert took[4000] < 20 * max(took[500], 0.05)


def test_vectors_of_null_and_empty(spark):
    none, empty = F.lit(None).cast("array<double>"), F.array().cast("array<double>")
    assert one(spark, vectors.variation(empty)) == 0.0 and one(spark, vectors.variation(none)) is None
    assert one(spark, vectors.median_normal(empty)) == [] and one(spark, vectors.js_divergence(none, none)) is None
    assert one(spark, vectors.attention_mass(empty, F.array(F.lit(0)))) == 0.0


def test_validation_of_samples(spark):
    good = ['{"question": "q", "ground_truth": 0}', '{"question": "q", "ground_truth": 0.5}', '{"question": "q", "ground_truth": "42."}']
    bad = ['{"question": "q", "ground_truth": null}', '{"question": "q", "ground_truth": ""}', '{"question": "q", "ground_truth": []}', '{"question": "q", "ground_truth": {}}', '{"question": "q", "ground_truth": true}', '{"question": "q", "ground_truth": NaN}', '{"question": "q"}', '{"question": null, "ground_truth": 1}', '{"ground_truth": 1}', "[]", "null", "", "{", None]
    lines = spark.createDataFrame([*enumerate([*good, *bad])], "idx long, line string")
    blank = sum(not x for x in bad)
    got = jobs.prepare(lines).orderBy("idx").collect()
    assert [r.status for r in got] == ["ready"] * 3 + ["skipped"] * (len(bad) - blank)
    assert [r.ground_truth for r in got[:3]] == ["0", "0.5", "42."] and all(r.reason and r.question is None for r in got[3:])
    assert [r.status for r in jobs.prepare(lines.where("idx >= 2"), limit=2).collect()] == ["ready", "skipped"]
    for _ in range(5):
        with pytest.raises(PySparkException, match="sample 3: answer kind"):
            jobs.strict(jobs.prepare(lines.repartition(7))).collect()
    with pytest.raises(PySparkException, match="Invalid JSON on line 8"):
        jobs.prepare(lines.repartition(7), malformed="raise").collect()


def test_samples_are_read_as_python_reads_them(spark):
    line = '{"question": "q", "ground_truth": %s}'
    given = [line % x for x in ("1.0", "-0.0", "1E-7", "1e999", "123456789012345678901234567890", '"\\u00e9"')] + [line % 1 + " tail", line % 1 + line % 2, '{"question": "q", "ground_truth": 1, "ground_truth": 2}', '"text"']
    got = {r.idx: r for r in jobs.prepare(spark.createDataFrame([*enumerate(given)], "idx long, line string")).collect()}
    assert [got[i].ground_truth for i in (0, 1, 2, 4, 5, 8)] == ["1.0", "-0.0", "1e-07", "123456789012345678901234567890", "é", "2"]
    assert {i: got[i].reason for i in (3, 6, 7, 9)} == {3: "answer not finite", 6: "malformed", 7: "malformed", 9: "no object"}
    assert got[0].prompt_wo_answer == "q\n\nExplain your solution step by step."


def test_exports_in_input_order(spark, tmp_path):
    rows = [(3, "success", "eos"), (1, "success", "length"), (2, "skipped", None), (0, "error", None)]
    r = spark.createDataFrame(rows, "position int, status string, finish_reason string").repartition(3)
    store = Store(spark, str(tmp_path / "s"))
    assert jobs.write_exports(r, store) == {"success": 2, "error": 1, "pending": 0, "skipped": 1, "sft": 1}
    lines = "".join(p.read_text() for x in store.head().tables["detail"]["paths"] for p in sorted(Path(x).glob("part-*")))
    assert [json.loads(x)["position"] for x in lines.splitlines()] == [0, 1, 2, 3]
    assert jobs.write_exports(r, store, ready_only=True)["error"] == 0 and [x.position for x in store.read("detail").orderBy("position").collect()] == [1, 2, 3]
    before = store.head()
    fault = r.withColumn("status", F.when(F.col("position") == 2, F.raise_error(F.lit("interrupted"))).otherwise(F.col("status")))
    with pytest.raises(PySparkException, match="interrupted"):
        jobs.write_exports(fault, store)
    assert store.head() == before and [x.position for x in store.read("training").collect()] == [3]
    store.sweep()
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == sorted(["_log", *(Path(p).name for e in before.tables.values() for p in e["paths"])])
    config = {"model": "m", "temperature": 0.6}
    assert jobs.fingerprint(config) == jobs.fingerprint({**config, "devices": [0, 1]}) != jobs.fingerprint({**config, "temperature": 1})


def test_lookups_that_must_succeed(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    with pytest.raises(PySparkException):
        jobs.with_detector(rows, spark.createDataFrame([("a", 1)], "k string, top int"), "k").collect()
    with pytest.raises(PySparkException):
        jobs.map_layers(spark.createDataFrame([(5,)], "layer int"), spark.createDataFrame([(1,)], "block int")).collect()


def test_parsing_of_null_and_empty(spark):
    null = F.lit(None).cast("string")
    assert one(spark, text.parse_spans(null, F.lit("x"))["error"]) == "no_array" and one(spark, text.parse_spans(F.lit('["a]'), F.lit("a]"))["error"]) == "not_strings"
    for raw in ('["a"] and ["b"]', '["a"] tail ]', '["a", null]', '{"a": 1} ]'):
        assert one(spark, text.parse_spans(F.lit(raw), F.lit("a"))["error"]) == ("no_array" if "[" not in raw else "not_strings")
    assert one(spark, text.parse_spans(F.lit('say ["x, null, y", "a", "a"]'), F.lit("a x, null, y"))["spans"]) == ["a", "x, null, y"]
    assert one(spark, text.parse_spans(F.lit('["a\\n"]'), F.lit("b a"))["spans"]) == ["a"]
    assert one(spark, text.trim_span(F.lit("  "), F.lit(0), F.lit(2))).asDict() == {"start": 2, "end": 2}
    assert one(spark, text.context_answer(null)) is None and one(spark, text.context_answer(F.lit("no marker"))) is None
    assert one(spark, text.ground_truth(F.lit(""), F.lit(""))) is None and one(spark, text.parse_answer(null, null, "####")) is None
    assert one(spark, text.common_length(F.lit(""), F.lit("a"))) == 0 and one(spark, text.common_length(F.lit("ab"), F.lit("abc"))) == 2 and one(spark, text.common_length(F.lit("xabc"), F.lit("abc"), True)) == 3
    assert one(spark, text.canonical_json(F.lit('{"b": NaN}'))) is None and one(spark, text.canonical_json(F.lit('{"b":1,"a":[]}'))) == '{"a": [], "b": 1}'
    with pytest.raises(PySparkException):
        one(spark, text.with_context(F.array(F.struct(F.lit("system").alias("role"), F.lit("x").alias("content"))), F.lit("c")))


def test_events_of_nothing(spark):
    none = F.array().cast("array<struct<start:int,n:int>>")
    assert one(spark, events.mask(none, F.lit(3))) == [0, 0, 0] and one(spark, events.mask(none, F.lit(0))) == [] and one(spark, events.visible(none, F.lit(3))) == []


def test_sample_metrics_without_spans(spark):
    empty = F.array().cast("array<double>")
    for s, g in ((empty, empty), (F.array(F.lit(0.1)), F.array(F.lit(0.0)))):
        m = one(spark, spans.sample_metrics(s, g, F.lit(0.5)))
        assert (m.precision, m.recall, m.full_recall, m.total_pred_spans) == (0, 0, 1, 0)


def test_sweeps_equal_every_token_with_every_span(spark):
    r = random.Random(11)
    toks, points = [], []
    for k in [*range(20), None]:
        at = 0
        for pos in range(r.randint(0, 12)):
            at += r.randint(0, 2)
            end = at + r.randint(1, 4)
            toks.append((k, pos, at, end))
            at = end
        points += [(k, i, s, s + r.randint(0, 9)) for i, s in enumerate(r.randint(0, 40) for _ in range(r.randint(0, 4)))]
    t, p = spark.createDataFrame(toks, "k int, pos int, start int, end int"), spark.createDataFrame(points, "k int, i int, start int, end int")
    same = lambda a, b: a[0] == b[0] is not None
    want = sorted(x for x in toks if any(same(x, y) and x[3] > y[2] and x[2] < y[3] for y in points))
    assert sorted(tuple(x) for x in spans.overlapping(t, p.where("k is not null"), "k").collect()) == want
    for ending in (True, False):
        got = {(x.k, x.i): x.token for x in spans.first_token(t, p, "k", "start", ending=ending).collect()}
        assert got == {y[:2]: min((x[1] for x in toks if same(x, y) and (x[3] > y[2] if ending else x[2] >= y[2])), default=None) for y in points}
    firsts = spans.first_after(t, p.where("i = 0").select("k", "end"), "k", "end").collect()
    assert len(firsts) == sum(y[1] == 0 for y in points)
    assert spans.overlapping(t.limit(0), p, "k").count() == 0 and spans.overlapping(t, p.limit(0), "k").count() == 0
