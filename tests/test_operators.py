import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import jobs, repair, rules, spans
from tracemill.sources import jsonl
from tracemill.sources.versions import Store
from tracemill.streaming import ingest
from tracemill.streaming.keyed import KeyedTable


def lines(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "idx long, line string")


def test_readers_of_broken_lines(spark):
    rows = ['{"a": 1}', "", '{"a": 2}', "{torn", '{"a": NaN}', '{"a": 3}']
    assert [tuple(r) for r in jsonl.loose(lines(spark, rows), "a long").orderBy("idx").collect()] == [(0, 1), (2, 2), (5, 3)]
    assert [r.a for r in jsonl.prefix(lines(spark, rows), "a long").orderBy("idx").collect()] == [1, 2]
    with pytest.raises(Exception, match="bad JSON on line 3"):
        jsonl.strict(lines(spark, rows), "a long").collect()
    assert [r.a for r in jsonl.torn_tail(lines(spark, rows[:4]), "a long").orderBy("idx").collect()] == [1, 2]
    with pytest.raises(Exception, match="before the last line"):
        jsonl.torn_tail(lines(spark, rows), "a long").collect()


def test_file_round_trip(spark, tmp_path):
    jsonl.write(spark.createDataFrame([(2, "b"), (1, "a")], "n long, t string"), str(tmp_path / "x"), order_by="n")
    found = jsonl.strict(jsonl.indexed_lines(spark, str(tmp_path / "x")), "n long, t string").orderBy("idx")
    assert [(r.n, r.t) for r in found.collect()] == [(1, "a"), (2, "b")]


def test_upsert_adds_attempts_and_keeps_the_latest(spark):
    kind = "k long, status string, attempts int, seq long"
    old, new = spark.createDataFrame([(1, "error", 2, 0), (2, "success", 1, 0)], kind), spark.createDataFrame([(1, "success", 1, 1)], kind)
    assert {(r.k, r.status, r.attempts) for r in jobs.upsert(old, new, ["k"]).collect()} == {(1, "success", 3), (2, "success", 1)}
    assert jobs.insert_ignore(old, new.withColumn("k", F.col("k") + 1), ["k"]).count() == 2


def test_null_keys_match(spark):
    rows = spark.createDataFrame([(None, "p"), ("m", "p"), ("m", "q"), ("m", "q")], "model string, prompt string")
    done = spark.createDataFrame([(None, "p"), ("m", "p")], "model string, prompt string")
    assert [tuple(r) for r in jobs.not_done(rows, done, ["model", "prompt"]).collect()] == [("m", "q")] * 2


def test_merge_of_islands_is_the_mask(spark):
    mask = [(k, p) for k in range(3) for p in range(30) if (p * 7 + k * 5) % 11 < 6]
    runs = spans.islands(spark.createDataFrame(mask, "k long, pos int"), "k")
    merged = spans.merge_spans(runs.select("k", F.col("start_token").alias("start"), F.col("end_token").alias("end")), "k").collect()
    assert sorted((r.k, p) for r in merged for p in range(r.start, r.end)) == sorted(mask)


@pytest.mark.parametrize(("value", "first", "every", "escaped"), [
    (r"\boxed{1} \boxed{2}", "1", ["1", "2"], ["1", "2"]), (r"a \boxed{x{y}z}", "x{y}z", ["x{y}z"], ["x{y}z"]), (r"\boxed{a\boxed{b}}", r"a\boxed{b}", [r"a\boxed{b}"], [r"a\boxed{b}", "b"]),
    (r"\boxed{open", None, [], []), (r"\boxed{}", "", [""], [""]), (r"\boxed{a\}b}", "a\\", ["a\\"], [r"a\}b"]), ("none", None, [], []),
])
def test_boxes(spark, value, first, every, escaped):
    r = spark.createDataFrame([(value,)], "t string").select(text.boxed_first(F.col("t")).alias("a"), text.boxed_all(F.col("t")).alias("b"), text.boxed_all_escaped(F.col("t")).alias("c")).first()
    assert (r.a, list(r.b), list(r.c)) == (first, every, escaped)


def test_text_functions(spark):
    df = spark.createDataFrame([("m/Some Model/", "q: x y x", "x", "  a\n\tb ", "<B>z</B><a>y</a>")], "p string, q string, part string, w string, r string")
    pair = text.parse_pair(F.col("r"), "a", "b")
    r = df.select(text.model_key(F.col("p")), text.without_first(F.col("q"), F.col("part")), text.normal_space(F.col("w")), text.strip(F.col("w")), pair["status"]).first()
    assert tuple(r) == ("some_Model", "q:  y x", "a b", "a\n\tb", "order")


class Scripted(repair.FakeBackend):
    """Leaks at the given positions until a clean token was placed there."""

    def __init__(self, leaks=(), always=False):
        super().__init__(eos=frozenset({99}))
        self.leaks, self.always = set(leaks), always

    def privileged(self, seed, prompt, ids):
        return len(ids) + 1

    def clean(self, seed, prompt, ids):
        return 1000 + len(ids)

    def mass(self, seed, prompt, ids, token):
        return float(self.always or len(ids) in self.leaks)


def test_repair_replaces_the_window():
    config = repair.RepairConfig(window=5, max_new_tokens=12)
    got = repair.decode(Scripted({6}), config, 0, "p")
    event = got["events"][0]
    assert (event["detected_index"], event["start_index"], event["removed_token_ids"]) == (6, 4, [5, 6, 7])
    assert got["token_ids"][6] == 1006 and len(got["token_ids"]) == 12 and got["finish_reason"] == "length"
    assert repair.decode(Scripted(), config, 0, "p")["events"] == []


def test_repair_that_cannot_converge_is_an_error_row(spark):
    config = repair.RepairConfig(max_new_tokens=200, max_repair_steps=10)
    with pytest.raises(RuntimeError):
        repair.decode(Scripted(always=True), config, 0, "p")
    df = spark.createDataFrame([(1, "p", 0)], "sample_id long, prompt string, seed long")
    r = repair.generate(df, lambda: repair.FakeBackend(), repair.RepairConfig(threshold=0.0, max_new_tokens=200, max_repair_steps=5)).first()
    assert r.status == "error" and r.attempts == 2 and "did not converge" in r.error


def test_repair_is_the_same_for_any_partitioning(spark):
    df = spark.createDataFrame([(i, f"p{i}", i) for i in range(20)], "sample_id long, prompt string, seed long")
    run = lambda n: sorted(map(str, repair.generate(df.repartition(n), repair.FakeBackend, repair.RepairConfig()).collect()))
    assert run(1) == run(7)


def test_rules(spark):
    got = rules.learn(spark.createDataFrame([(0, "the answer is 42"), (1, "the answer is 7"), (2, "short"), (3, "the  answer is 42"), (4, None)], "seq long, span string")).collect()
    best = got[0]
    assert best.kind == "generalized" and best.support == 3 and list(best.examples) == ["the answer is 42", "the answer is 7"] and best.words == ["answer", "is", "the"]
    assert [(r.kind, r.support) for r in got[1:]] == [("exact", 2), ("exact", 1)]
    found = rules.apply(spark.createDataFrame([(1, "so the answer is 9 ok")], "k long, t string"), spark.createDataFrame(got), key="k", text_col="t")
    assert [(r.start, r.end) for r in found.collect()] == [(3, 18)]
    assert len(rules.learn(spark.createDataFrame([(0, "the answer is 42")], "seq long, span string"), exact_only=True).collect()) == 1


def test_general_patterns_have_whole_words_and_bounded_values():
    assert text.general_pattern("no value here") is None
    p = text.general_pattern("so 5 it is")
    assert re.search(p, "and so  77 it\nis.") and not re.search(p, "also 5 it is") and not re.search(p, "so 5 it isn")
    assert not re.search(text.general_pattern("see \\boxed{1} now"), "see \\boxed{" + "x" * 81 + "} now")
    assert text.needed_words("x5 is 12y or 3", values=True) == ["is", "or"] and text.needed_words("a b a", values=False) == ["a", "b"]


def test_rules_equal_every_pattern_on_every_text(spark):
    r = random.Random(4)
    words = ["the", "answer", "is", "42", "7.5", "(so)", "don't", "é", "$x$", "**b**", "\\boxed{3}"]
    make = lambda n: "".join(r.choice(words) + r.choice([" ", "  ", "\n", ", "]) for _ in range(n))
    spans_ = spark.createDataFrame([(i, make(r.randint(1, 4))) for i in range(40)] + [(99, "...  ...")], "seq long, span string")
    texts = [(i % 25, make(12)) for i in range(30)] + [(7, None), (8, "")]
    learned = rules.learn(spans_, least_chars=1, least_words=0)
    assert {True, False} == {bool(x.words) for x in learned.collect()}
    want = set()
    for k, t in texts:
        for p in learned.collect():
            for m in re.finditer(p.pattern, t or ""):
                piece = m.group()
                a, b = m.start() + len(piece) - len(piece.lstrip()), m.end() - len(piece) + len(piece.rstrip())
                want |= {(k, a, b)} if a < b else set()
    df = spark.createDataFrame(texts, "k long, t string")
    assert {tuple(x) for x in rules.apply(df, learned, key="k", text_col="t").collect()} == want
    assert {tuple(x) for x in rules.apply(df, learned.drop("words"), key="k", text_col="t").collect()} == want
    assert rules.apply(df, learned.limit(0), key="k", text_col="t").count() == 0


def test_stream_upserts_once_over_restarts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put = lambda n, rows: Path(source, f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
    start = lambda: ingest.upsert_stream(spark, str(source), "k long, status string, attempts int", str(tmp_path / "t"), str(tmp_path / "c"), ["k"]).awaitTermination()
    put(0, [{"k": 1, "status": "error", "attempts": 1}, {"k": 2, "status": "success", "attempts": 1}])
    start()
    put(1, [{"k": 1, "status": "success", "attempts": 2}])
    start()
    start()
    rows = KeyedTable(Store(spark, str(tmp_path / "t")), "rows", ["k"]).read().collect()
    assert {(r.k, r.status, r.attempts) for r in rows} == {(1, "success", 3), (2, "success", 1)}
