import difflib
import json
import random
import threading

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import events, jobs, runs, sampling, traces
from tracemill.sources import documents, jsonl, reports
from tracemill.sources.versions import Conflict, Files, Store
from tracemill.streaming.keyed import KeyedTable


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


# ---- versions


def test_a_failed_commit_leaves_the_old_table(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.head().version == 0 and store.versions() == []
    with pytest.raises(KeyError):
        store.read("t")
    store.commit({"t": spark.range(2000), "u": spark.range(3)}, meta={"a": 1})
    broken = spark.range(100).withColumn("id", F.when(F.col("id") == 99, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(PySparkException):
        store.commit({"u": spark.range(1), "t": broken})
    assert (store.read("t").count(), store.read("u").count(), store.head().meta) == (2000, 3, {"a": 1})
    old = store.head()
    store.commit({"t": spark.range(0)})
    assert store.read("t").count() == 0 and store.read("u").count() == 3 and store.read("t", old).count() == 2000
    assert len(store.sweep(keep=1)) == 1 and store.read("t").count() == 0 and store.versions() == [2]


def test_of_two_writers_one_wins_and_none_is_lost(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    head = store.commit({"t": spark.range(1)})
    store.commit({"t": spark.range(2)}, expect=head.version)
    with pytest.raises(Conflict):
        store.commit({"t": spark.range(3)}, expect=head.version)
    assert store.read("t").count() == 2
    path = f"{store.root}/x.json"
    won = []
    def put(i):  # noqa: E306
        try:
            Files(spark).put(path, str(i))
            won.append(i)
        except Conflict:
            pass
    threads = [threading.Thread(target=put, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and Files(spark).read(path) == str(won[0])


def test_documents_merge_one_key_and_retry(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    row = lambda k, n: spark.createDataFrame([(k, n)], "key string, n int")
    documents.merge_documents(store, "c", row("a", 1))
    real, other = Store.publish, []

    def publish(self, entries, **options):
        if not other:
            other.append(1)
            documents.merge_documents(Store(spark, store.root), "c", row("b", 2))  # another writer comes first
        return real(self, entries, **options)

    monkeypatch.setattr(Store, "publish", publish)
    documents.merge_documents(store, "c", row("a", 3))
    documents.merge_documents(store, "c", row(None, 4))
    documents.merge_documents(store, "c", row(None, 5))
    assert sorted(map(tuple, store.read("c").collect()), key=str) == [("a", 3), ("b", 2), (None, 5)]
    with pytest.raises(ValueError):
        documents.merge_documents(store, "c", row("a", 1).union(row("a", 2)))


def test_scores_are_bound_to_their_method(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    documents.save_scores(store, spark.range(2), model="m", method="cv", used=4)
    assert documents.load_scores(store, model="m", method="cv").count() == 2
    with pytest.warns(UserWarning, match="not of other"):
        documents.load_scores(store, model="other", method="cv")
    with pytest.raises(ValueError, match="make them again"):
        documents.load_scores(store, model="m", method="mass")


def test_json_documents(spark, tmp_path):
    path = str(tmp_path / "d.json")
    assert documents.read_json(spark, path) == {}
    documents.write_json(spark, path, {"é": [1]})
    documents.write_json(spark, path, {"é": [2]})
    assert documents.read_json(spark, path) == {"é": [2]} and "é" in (tmp_path / "d.json").read_text()


def test_keyed_table_rewrites_only_the_buckets_of_a_batch(spark, tmp_path):
    table = KeyedTable(Store(spark, str(tmp_path / "s")), "rows", ["k"], buckets=8)
    rows = lambda ks, seq: spark.createDataFrame([(k, "success", 1, seq) for k in ks], "k long, status string, attempts long, seq long")
    table.apply(rows(range(200), 0), 0)
    files = lambda: {str(p): p.stat().st_size for p in (tmp_path / "s").rglob("*.parquet")}
    first = files()
    assert len(table.apply(rows([5], 1), 1)) == 1
    new = {k: v for k, v in files().items() if k not in first}
    assert len(new) == 1 and sum(new.values()) < sum(first.values()) / 3
    held = files()
    assert table.apply(rows([5, 6], 1), 1) == [] and files() == held and table.batch() == 1
    got = {r.k: r.attempts for r in table.read().collect()}
    assert len(got) == 200 and got[5] == 2 and got[6] == 1
    table.store.sweep()
    assert {r.k: r.attempts for r in table.read().collect()} == got
    assert table.apply(rows([], 2), 2) == [] and table.batch() == 2 and table.read().count() == 200
    assert table.snapshot("k", require_eos=False)["sft"] == 200


def test_upsert_ties_do_not_hang_on_order(spark):
    rows = [(1, 5, "b"), (1, 5, "a"), (None, 1, "x"), (None, 2, "y")]
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, "k int, seq int, v string").withColumn("attempts", F.lit(1)).repartition(3)
        assert {(r.k, r.v, r.attempts) for r in jobs.upsert(df.limit(0), df, ["k"]).collect()} == {(1, "b", 2), (None, "y", 2)}


# ---- readers


@pytest.mark.parametrize("size", ["7b", "64b", "128m"])
def test_line_numbers_for_any_split(spark, tmp_path, size):
    r = random.Random(2)
    want, at = [], 0
    for name in ("a.txt", "b.txt", "c.txt", "empty.txt"):
        lines = [] if name == "empty.txt" else ["x" * r.choice([0, 0, 1, 5, 30]) + "é" * r.randint(0, 2) for _ in range(40)] + ["last"]
        (tmp_path / name).write_bytes(("\r\n" if name == "b.txt" else "\n").join(lines).encode() + (b"" if name == "c.txt" else b"\n" if lines else b""))
        want += [(at + i, i, x, name == "c.txt" and i == 40) for i, x in enumerate(lines)]
        at += len(lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = [(r.idx, r.at, r.line, r.torn) for r in jsonl.numbered(spark, str(tmp_path)).orderBy("idx").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(a, b, c.rstrip("\n"), d) for a, b, c, d in got] == want


def test_the_first_bad_line_raises_whatever_the_tasks(spark):
    lines = spark.range(2000).repartition(16).select(F.col("id").alias("idx"), F.when(F.col("id").isin(490, 1001, 1500), "{").otherwise('{"a": 1}').alias("line"))
    for _ in range(10):
        with pytest.raises(PySparkException, match="line 490"):
            jsonl.strict(lines, "a long").collect()
        with pytest.raises(PySparkException, match="line 490"):
            jsonl.torn_tail(lines, "a long").collect()
    assert jsonl.strict(lines.where("idx < 490"), "a long").count() == 490


def test_resuming_an_output(spark, tmp_path):
    put = lambda s: (tmp_path / "out.jsonl").write_text(s)
    read = lambda: sorted(r.sample_index for r in jsonl.resumed(spark, str(tmp_path / "out.jsonl"), "sample_index long").collect())
    row = '{"sample_index": %s}\n'
    put(row % 0 + row % 2 + '{"sample_index": 1}')
    assert read() == [0, 2]
    put(row % 0 + row % 2 + row % 1)
    assert read() == [0, 1, 2]
    for text, said in ((row % 0 + row % 1 + row % 0, "index on line 2"), (row % 0 + row % -1 + row % 0, "index on line 1"), ("{\n" + row % 0, "bad JSON on line 0"), (row % "null", "index on line 0")):
        put(text)
        with pytest.raises(PySparkException, match=said):
            read()
    put("")
    assert read() == []


ARRAYS = ['[]', ' [1, "a,]\\"[", {"k": [1, {"x": "}"}]} , null]\n', '["é\\n"]', "[1.0, -0.0]", '[[], [[]], "\\\\"]']


@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_array_elements_are_found_in_any_pieces(chunk):
    for text in ARRAYS:
        pieces = [text[i : i + chunk] for i in range(0, len(text), chunk)]
        got = list(jsonl._elements((p, i == len(pieces) - 1) for i, p in enumerate(pieces)))
        assert [json.loads(x) for x in got] == json.loads(text)
    for text in ("", "{}", "[1", "[1]]", '["a]', "1", "[1] x"):
        with pytest.raises(ValueError):
            list(jsonl._elements((c, i == len(text) - 1) for i, c in enumerate(text)))


def test_arrays_and_lines_as_samples(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.jsonl"
    a.write_text('[{"q": 1},\n\n {"q": "é"}]')
    b.write_text('\n{"q": 1}\n \n{"q": 2}')
    read = lambda p, **o: sorted((r.idx, json.loads(r.line)["q"]) for r in jsonl.samples(spark, str(p), **o).collect())
    assert read(a) == [(0, 1), (1, "é")] and read(b) == [(1, 1), (3, 2)] and read(b, limit=3) == [(1, 1)]
    assert read(b, completed=spark.createDataFrame([(1,)], "idx long")) == [(3, 2)]
    for bad in ('[{"q": NaN}]', "[1,]", '[{"q": 1} {"q": 2}]', "[,]"):
        a.write_text(bad)
        with pytest.raises(PySparkException, match="Invalid JSON in element"):
            read(a)


def test_experiments(spark, tmp_path):
    put = lambda p, rows: (p.parent.mkdir(parents=True, exist_ok=True), p.write_text("\n".join(map(json.dumps, rows))))
    a, b, c = tmp_path / "first run" / "m.jsonl", tmp_path / "output" / "second.jsonl", tmp_path / "third" / "m.jsonl"
    put(a, [{"model": "m", "precision": 0.5, "recall": 1.0, "full_recall": 0.9}, {"model": "n", "precision": 0.1, "recall": 0.2, "full_recall": 0.95}, {"model": "m", "recall": 0.3, "full_recall": 1.0}])
    put(b, [{"model": "m", "precision": 0.7, "recall": 0.6, "full_recall": 0.91, "note": "x"}])
    put(c, [{"model": "m", "precision": 0.2, "recall": 0.9}])
    read = lambda **o: sorted((r.experiment, r.model, r.precision) for r in reports.experiments(spark, [str(x) for x in (a, b, c)], **o).collect())
    assert read() == [("first run", "m", 0.5), ("first run", "n", 0.1), ("second", "m", 0.7), ("third", "m", 0.2)]
    assert read(model="m", lowest_full_recall=0.9) == [("first run", "m", 0.5), ("second", "m", 0.7)]
    c.write_text("{")
    with pytest.raises(Exception, match="Malformed|MALFORMED"):
        read()


# ---- repairs


def test_matching_blocks_equal_the_standard_alignment():
    r = random.Random(6)
    for n in (0, 1, 5, 40):
        for _ in range(60):
            a, b = ([r.randint(0, r.choice([1, 4, 20])) for _ in range(r.randint(0, n))] for _ in "ab")
            want = [tuple(x) for x in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_matching_blocks()][:-1]
            assert events.matching_blocks(a, b) == want


def plain_masks(ids, baseline, evs):
    mask, unmatched, history = [0] * len(baseline), 0, list(ids)
    for e in reversed(evs):
        history = history[: e["start"]] + e["before"]
        a, b = e["start"], e["start"] + len(e["before"])
        if not e["before"]:
            continue
        for block in difflib.SequenceMatcher(a=history, b=baseline, autojunk=False).get_matching_blocks():
            if block.a <= a and b <= block.a + block.size:
                mask[block.b + a - block.a : block.b + b - block.a] = [1] * (b - a)
                break
        else:
            unmatched += 1
    return mask, unmatched


def test_undone_repairs_equal_brute_force(spark):
    r = random.Random(9)
    rows = []
    for k in range(80):
        ids = [r.randint(0, 3) for _ in range(r.randint(0, 12))]
        evs = [{"start": r.randint(0, len(ids)), "before": [r.randint(0, 3) for _ in range(r.randint(0, 3))]} for _ in range(r.randint(0, 4))]
        rows.append((k, ids, [x for x in ids if r.random() < 0.8], evs))
    df = spark.createDataFrame(rows, "k int, ids array<bigint>, base array<bigint>, ev array<struct<start:int,before:array<bigint>>>")
    got = {x.k: (list(x.m.mask), x.m.unmatched) for x in df.select("k", events.baseline_mask(F.col("ev"), F.col("ids"), F.col("base")).alias("m")).collect()}
    assert got == {k: plain_masks(ids, base, evs) for k, ids, base, evs in rows}
    assert one(spark, events.baseline_mask(F.lit(None).cast("array<struct<start:int,before:array<bigint>>>"), F.lit(None).cast("array<bigint>"), F.array(F.lit(1)))).asDict() == {"mask": [0], "unmatched": 0}
    assert one(spark, events.baseline_mask(F.lit(None).cast("array<struct<start:int,before:array<bigint>>>"), F.array(F.lit(1)), F.lit(None).cast("array<bigint>"))).asDict() == {"mask": [], "unmatched": 0}


def test_masks_and_visible_ranges_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(k, n, [(r.randint(0, 10), r.randint(0, 4)) for _ in range(r.randint(0, 5))]) for k, n in ((k, r.randint(0, 9)) for k in range(80))]
    df = spark.createDataFrame(rows, "k int, n int, ev array<struct<start:int,n:int>>")
    for x in df.select("k", "n", "ev", events.mask(F.col("ev"), F.col("n")).alias("m"), events.visible(F.col("ev"), F.col("n")).alias("v")).collect():
        mask = [0] * x.n
        for s, m in x.ev:
            s = min(s, x.n)
            e = min(s + m, x.n)
            mask[s:] = [1] * (e - s) + [0] * (x.n - e)
        limit, shown = x.n, []
        for s, m in reversed(x.ev):
            if s < min(s + m, limit):
                shown.insert(0, (s, min(s + m, limit), s + m <= limit))
            limit = min(limit, s)
        assert list(x.m) == mask and [tuple(v) for v in x.v] == shown
    with pytest.raises(PySparkException, match="negative start"):
        one(spark, events.mask(F.array(F.struct(F.lit(-1).alias("start"), F.lit(1).alias("n"))), F.lit(3)))


# ---- sampling and reports


def test_token_sampling(spark):
    x = F.array(*(F.lit(float(v)) for v in (1, 3, 2, 3, 0)))
    at = lambda u, **o: one(spark, sampling.sample_token(x, F.lit(float(u)), **o))
    assert one(spark, sampling.sample_token(x, F.lit(None), greedy=True)) == 1
    assert {at(u / 20, temperature=1.0, top_k=1) for u in range(20)} == {1, 3}  # equal to the first
    assert {at(u / 200, temperature=1.0) for u in range(200)} == {0, 1, 2, 3, 4}
    assert {at(u / 20, temperature=1.0, top_p=0.0) for u in range(20)} == {1}
    assert {at(u / 20, temperature=1.0, top_p=0.5) for u in range(20)} == {1, 3}  # the token that crosses stays
    assert at(0.999999, temperature=0.01) == 3
    null = F.lit(None).cast("array<double>")
    assert one(spark, sampling.sample_token(null, F.lit(0.5))) is None and one(spark, sampling.sample_token(F.array().cast("array<double>"), F.lit(0.5))) is None and one(spark, sampling.sample_token(x, F.lit(None))) is None
    with pytest.raises(ValueError):
        sampling.sample_token(x, F.lit(0.5), temperature=0.0)
    got = spark.range(4000).select(sampling.sample_token(F.array(F.lit(0.0), F.lit(0.0)), sampling.uniform(F.lit(1), F.col("id")), temperature=1.0).alias("t")).agg(F.avg("t")).first()[0]
    assert abs(got - 0.5) < 0.03


def test_runs_of_empty_and_null(spark):
    df = spark.createDataFrame([("a", None), ("a", 0.25), (None, 0.75)], "m string, v double")
    got = {(r.level, r.m): (r.n, r.mean, r.q50) for r in runs.across(df, [("m",), ()], F.col("v")).collect()}
    assert got == {(0, "a"): (1, 0.25, 0.25), (0, None): (1, 0.75, 0.75), (1, None): (2, 0.5, 0.5)}
    assert runs.across(df.limit(0), [("m",)], F.col("v")).count() == 0


# ---- runs and traces


def test_a_run_is_bound_to_its_settings_and_inputs(spark, tmp_path):
    store, rows = Store(spark, str(tmp_path / "s")), spark.range(5).withColumn("v", F.lit(None).cast("string"))
    config = {"model": "m", "temperature": 0.6, "devices": [0]}
    with pytest.raises(ValueError):
        jobs.open_run(store, config, rows, resume=True)
    mark = jobs.open_run(store, config, rows)
    with pytest.raises(FileExistsError):
        jobs.open_run(store, config, rows)
    assert jobs.open_run(store, {**config, "devices": [1, 2]}, rows.repartition(3), resume=True) == mark
    for other, data in (({**config, "temperature": 1}, rows), (config, rows.limit(4)), (config, rows.union(rows.limit(1)))):
        with pytest.raises(ValueError, match="differ"):
            jobs.open_run(store, other, data, resume=True)
    store.commit({"t": rows})
    store.sweep()
    assert jobs.open_run(store, config, rows, resume=True) == mark
    assert jobs.table_digest(rows.limit(0)) == "0:0:0"


def test_shared_jobs_fan_back(spark):
    rows = spark.createDataFrame([("a", 2), ("b", 1), ("a", 0), (None, 3)], "sample_id string, position int")
    shared = jobs.shared_jobs(rows)
    assert sorted(map(tuple, shared.collect()), key=str) == [("a", 0), ("b", 1), (None, 3)]
    back = jobs.fan_back(rows, shared.where("sample_id = 'a'").withColumn("status", F.lit("ok")))
    assert sorted((r.position, r.status) for r in back.collect() if r.status) == [(0, "ok"), (2, "ok")] and back.count() == 4


def test_filters_of_null_and_empty(spark):
    rows = spark.createDataFrame([(1, []), (2, None), (3, ["x"])], "k int, s array<string>")
    ks = lambda df: sorted(r.k for r in df.collect())
    assert ks(traces.with_spans(rows, "s")) == [3] and ks(traces.with_spans(rows, "s", keep_missing=True)) == [2, 3]
    assert ks(traces.fit_for_training(rows, F.col("k"), 2, F.col("s").isNotNull())) == [1]
    assert one(spark, traces.leaks(F.lit(0.5), 0.5)) and not one(spark, traces.leaks(F.lit(0.5), 0.5, strict=True))
    assert one(spark, traces.backtrack_start(F.lit(1), 9)) == 0 and one(spark, traces.backtrack_start(F.lit(9), 4)) == 8
    got = traces.for_each_model(rows.select("k"), spark.range(2).withColumnRenamed("id", "m"))
    assert got.count() == 6
    with pytest.raises(ValueError):
        traces.for_each_model(rows, spark.range(5), most=4)
    empty = F.create_map().cast("map<string,string>")
    assert one(spark, traces.merged(F.lit(None).cast("map<string,string>"), F.create_map(F.lit("a"), F.lit("b")))) == {"a": "b"} and one(spark, traces.merged(empty, empty)) == {}


def test_batches_and_heads(spark):
    got = {r.id: r.batch for r in traces.batches(spark.range(10).repartition(3), ["id"], 4).collect()}
    assert got == {i: i // 4 for i in range(10)}
    assert traces.batches(spark.range(0), ["id"], 4).count() == 0
    mass = spark.createDataFrame([(0, 0, 1.0), (1, 2, 2.0)], "layer int, head int, mass double")
    assert traces.known_heads(mass, spark.createDataFrame([(1, 2)], "layer int, head int")).count() == 1
    with pytest.raises(PySparkException, match="no head 3 in layer 0"):
        traces.known_heads(mass, spark.createDataFrame([(0, 3)], "layer int, head int")).collect()
    with pytest.raises(PySparkException, match="the grid is empty"):
        one(spark, text.int_grid(F.lit("0,-1,")))


def test_figures_of_nothing(spark):
    rows = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, None), ("b", None, True)], "k string, s double, leak boolean")
    (r,) = traces.shape_summary(rows, ["k"], "s", F.col("leak")).collect()
    assert (r.mean_score, r.median_score, r.leakage_samples, r.mean_leakage, r.mean_non_leakage) == (2.0, 1.0, 1, 1.0, 3.0)
    scores = spark.createDataFrame([(1, 0, 0.9, 1), (1, 1, 0.1, 1), (1, 2, 0.0, 0), (1, 3, 0.4, 1), (2, 0, 0.0, 0)], "sample_id int, pos int, score double, gold int")
    got = {x.threshold: x.full_hits for x in traces.full_recall(scores, spark.createDataFrame([(0.4,), (0.5,)], "threshold double")).collect()}
    assert got == {0.4: 2, 0.5: 1}
    none = F.array().cast("array<double>")
    assert one(spark, traces.answer_gains(none, none, F.lit(None).cast("array<double>"))).asDict() == {"galg": None, "lf_galg": None}
    assert one(spark, traces.filtered_text(F.array(F.lit("a")), none, none)) is None
    assert traces.rates(spark.range(2), [F.lit(1).alias("k")], F.lit(4), F.lit(0)).first().tokens_per_second is None


def test_think_variants_of_null_and_blank(spark):
    null = F.lit(None).cast("string")
    assert one(spark, text.split_reasoning(null)).asDict() == {"content": None, "reasoning": None}
    assert one(spark, text.split_reasoning(F.lit("<think> </think> x <think>y</think>"))).asDict() == {"content": "x <think>y</think>", "reasoning": None}
    assert one(spark, text.think_and_answer(F.lit(" a<think> b </think> c "))).asDict() == {"reasoning": "b", "answer": "c"}
    assert one(spark, text.split_closing(null, F.lit(" r "))).asDict() == {"content": "", "reasoning": "r"}
    assert one(spark, text.split_closing(F.lit("<think>r</think> c</think>"), F.lit(""))).asDict() == {"content": "c</think>", "reasoning": "r"}
    assert one(spark, text.reasoning_of(F.lit("<think>a<think>b</think>c"), null)) == "b"


def test_notes_of_overlapping_spans(spark):
    rows = [(1, 0, 4, "a"), (1, 3, 6, None), (1, 6, 8, "b"), (1, 5, 5, "no"), (1, 7, 9, "c")]
    got = traces.merge_notes(spark.createDataFrame(rows, "k int, start int, end int, note string"), "k").orderBy("start").collect()
    assert [(r.start, r.end, list(r.notes)) for r in got] == [(0, 6, ["a"]), (6, 9, ["b", "c"])]
