import random

import numpy as np

from tests.llm.data import documents
from tracemill.llm import compact_windows as cw


def test_windows_equal_brute_force():
    r = np.random.default_rng(2)
    for n, high in ((0, 9), (5, 9), (40, 1000), (120, 1000), (120, 12), (300, 3)):
        for _ in range(20):
            g = r.integers(1, high, n).astype(np.uint32)
            if n > 60:
                g[r.integers(0, n, 3)] = 0
            least = 10
            want = {s: s + int(g[s : s + least].argmin()) for s in range(n - least + 1) if g[s : s + least].all()}
            c, low = cw.compact_windows(g, least)
            assert low.tolist() == [s for s in want if want.get(s - 1) != want[s]]
            assert c.tolist() == [want[s] for s in low.tolist()]


def word_sets(rows):
    """Of each row the words in passages alike with one of another row, each from its first to its last shared shingle, by all pairs of passages."""
    out = [set() for _ in rows]
    grams = [[tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in rows]
    windows = [[set(g[s : s + 46]) for s in range(len(g) - 45)] for g in grams]
    for i, own in enumerate(windows):
        for j, others in enumerate(windows):
            for s, x in enumerate(own):
                for y in others if i != j else ():
                    both = x & y
                    if 100 * len(both) >= 80 * len(x | y):
                        at = [k for k in range(s, s + 46) if grams[i][k] in both]
                        out[i].update(range(at[0], at[-1] + 5))
    return out


def components(rows):
    """Least row reachable from each through alike passages, by all pairs of passages."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    windows = [{frozenset(tuple(w[i : i + 5]) for i in range(s, s + 46)) for s in range(len(w) - 49)} for w in rows]
    for i, own in enumerate(windows):
        for j in range(i):
            if find(i) != find(j) and any(100 * len(x & y) >= 80 * len(x | y) for x in own for y in windows[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in range(len(rows))}


def test_spans_equal_all_pairs_of_passages(spark):
    r = random.Random(5)
    base = [passage(30 + k, 90, 400) for k in range(5)]
    common = passage(40, 20, 400)
    rows = []
    for k in range(16):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            at = r.randrange(len(w))
            w[at : at + r.choice([0, 1, 1, 2])] = [f"new{k}x{at}"] * r.choice([0, 1, 1])
        rows.append(passage(1000 + k, r.randrange(5, 40), 400) + w + common + passage(2000 + k, r.randrange(40), 400))
    rows += [["of"] * 130, ["of"] * 300, ["the", "of"] * 70, ["of", "the", "in"] * 60, passage(50, 60, 400) + ["of"] * 80, ["the"] * 60, common * 6, passage(51, 30, 400) + common * 4]
    want = word_sets(rows)
    data = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in cw.repeated_passages(data).collect()}
    found = [{k for s in got[i].spans.split(",") if s for k in range(*map(int, s.split("-")))} for i in range(len(rows))]
    assert all(x <= y for x, y in zip(found, want))  # nothing but what all pairs show
    assert sum(map(len, found)) >= 0.97 * sum(map(len, want))
    for x in got.values():
        assert x.n_dup_words == len(found[x.doc_id]) and x.n_words == len(rows[x.doc_id])
    assert {i: x.component_id for i, x in got.items()} == components(rows)


def passage(seed, n, words=900):
    r = random.Random(seed)
    return [f"w{r.randrange(words)}x" for _ in range(n)]


def test_finds_verbatim_and_near_passages_only(spark):
    shared, other = passage(1, 70), passage(2, 120)
    edited = list(other)
    edited[60] = "changed"
    rows = [
        passage(10, 200) + shared + passage(11, 90), passage(12, 40) + shared + passage(13, 300), passage(14, 60) + other, edited + passage(15, 60), passage(16, 400), passage(17, 30), shared[:44] + passage(18, 80), shared[5:65],  # 44 words are 40 of 52 shingles, 45 would be 41 of 51
    ]
    docs = documents(spark, [*map(" ".join, rows), " ".join(rows[0]), None, "", "short"])
    out = cw.repeated_passages(docs)
    assert out.count() == docs.count()
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    span = lambda i: [tuple(map(int, s.split("-"))) for s in got[i][0].spans.split(",") if s]
    assert span(0) == span(8) == [(0, 360)]  # the whole text is repeated
    assert span(1) == [(40, 110)] and span(7) == [(0, 60)]
    (a, b), = span(2)
    assert a <= 62 and b >= 178
    (a, b), = span(3)
    assert a <= 2 and b >= 118
    assert span(4) == span(5) == span(6) == span(9) == span(11) == []
    assert all(r.n_dup_words == sum(b - a for a, b in span(i)) for i, rs in got.items() for r in rs)


def test_one_passage_in_every_text(spark):
    shared = passage(3, 64)
    rows = [" ".join(passage(100 + i, 30) + shared + passage(900 + i, 30)) for i in range(60)]
    out = cw.repeated_passages(documents(spark, rows)).collect()
    assert sum(r.spans.split("-")[0].isdigit() and r.n_dup_words >= 64 for r in out) == len(out) - 1  # but the row of another text


def found(left, right):
    a, b = (cw.Profile(cw.Sequences().one(" ".join(x))) for x in (left, right))
    (ka, ca, _), (kb, cb, _) = (cw.cells(t.x, np.zeros(len(t.x), bool)) for t in (a, b))
    x, y = cw.passages(a, b, sorted(set(cb[np.isin(kb, ka)].tolist())))
    return [(p, q + 4) for p, q in x], [(p, q + 4) for p, q in y]


def test_narrower_passages_in_a_stretch_that_fails():
    for seed, (one, gap, two) in enumerate([(60, 16, 89), (70, 20, 110), (150, 50, 230)]):
        x, y = passage(40 + seed, one, 10**6), passage(50 + seed, two, 10**6)
        left, right = (x + passage(60 + 2 * seed + k, gap, 10**6) + y for k in (0, 1))
        assert found(left, right) == ([(0, one), (one + gap, len(left))],) * 2


def test_ends_behind_one_changed_word():
    left = passage(70, 100, 10**6)
    for at in (8, 91):
        right = [*left[:at], "changed", *left[at + 1 :]]
        assert found(left, right) == ([(0, 100)],) * 2


def test_passage_whose_minima_have_other_hubs(spark):
    shared = passage(90, 60, 10**6)
    rows = [passage(200 + 8 * n + k, 60, 10**6) + shared[k : k + 20] + passage(400 + 8 * n + k, 60, 10**6) for n in range(3) for k in range(0, 41, 8)]
    rows += [passage(600 + i, 50, 10**6) + shared + passage(700 + i, 50, 10**6) for i in range(2)]
    data = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.spans for r in cw.repeated_passages(data).collect()}
    assert got[len(rows) - 2] == got[len(rows) - 1] == "50-110"


def test_every_copy_in_a_hub(spark):
    shared = passage(80, 60, 10**6)
    twice = shared + passage(81, 200, 10**6) + shared
    for rows in ([twice, shared], [shared, twice]):
        data = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id long, text string").coalesce(1)
        got = {r.doc_id: r.spans for r in cw.repeated_passages(data).collect()}
        assert got == {rows.index(twice): "0-60,260-320", rows.index(shared): "0-60"}


def test_empty(spark):
    assert cw.repeated_passages(documents(spark, []).limit(0)).count() == 0


def test_long_text_and_clashing_columns(spark):
    shared = " ".join(passage(95, 60, 10**6))
    rows = [" ".join(passage(96, 60_000, 3000)) + " " + shared, shared + " tail", "x" * 300_000, None]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in cw.repeated_passages(docs).collect()}
    assert got[0].spans == "60000-60060" and got[1].spans == "0-60" and got[0].component_id == got[1].component_id == 0
    assert got[2].spans == got[3].spans == "" and got[3].n_words == 0 and got[2].component_id == 2


def test_repeated_rows_and_null_ids(spark):
    shared = " ".join(passage(97, 70, 10**6))
    rows = [(5, shared), (5, shared), (None, shared + " x"), (None, shared + " x"), (8, "other " + shared), (None, "short"), (None, None)]
    got = cw.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.component_id, r.n_dup_words > 0) for r in got if r.n_words >= 50 and r.doc_id) == [(5, 5, True), (5, 5, True), (8, 5, True)]
    assert [r.component_id for r in got if r.doc_id is None and r.n_words >= 50] == [5, 5] and len(got) == len(rows)


def test_keys_of_many_texts_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(cw, "FEW", 3)
    monkeypatch.setattr(cw, "BLOCK", 4)
    line = passage(98, 30, 10**6)  # a line of 30 words in every text is no passage
    rows = [passage(300 + i, 40, 10**6) + line + passage(500 + i, 40, 10**6) for i in range(30)]
    rows += [rows[7][:20] + passage(700, 5, 10**6) + rows[7][20:], passage(701, 40, 10**6) + rows[9][20:]]
    data = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in cw.repeated_passages(data).collect()}
    assert {i for i, r in got.items() if r.spans} == {7, 9, 30, 31} and got[30].component_id == 7 and got[31].component_id == 9


def test_distinct_shingles_among_some_equal_brute_force():
    r = np.random.default_rng(4)
    for n, high in ((46, 9), (60, 1000), (200, 30), (200, 4), (30, 9)):
        x = r.integers(1, high, n).astype(np.uint64)
        t, those = cw.Profile(x), x % 3 == 0
        assert t.distinct_of(those).tolist() == [len({*x[s : s + 46][those[s : s + 46]].tolist()}) for s in range(n - 45)]


def test_changed_copies_of_a_passage_make_no_pairs_of_texts(spark, monkeypatch):
    """Each text has changes of its own in every passage, so that none is alike with another; two share one passage as it is."""
    asked, verified = [], cw._verified
    monkeypatch.setattr(cw, "_verified", lambda pairs, rows: asked.append(pairs.count()) or verified(pairs, rows))
    base, rows = passage(110, 400, 10**6), []
    for i in range(40):
        w = list(base)
        for at in range(i % 7, len(w), 18):
            w[at] = f"own{i}x{at}"
        rows.append(w)
    rows[33][200:260] = rows[21][200:260] = base[200:260]
    data = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in cw.repeated_passages(data).collect()}
    want = word_sets([rows[i][140:320] for i in (21, 33)])
    for i, words in zip((21, 33), want):
        assert {k for s in got[i].spans.split(",") for k in range(*map(int, s.split("-")))} == {k + 140 for k in words}
    assert {i for i, r in got.items() if r.spans} == {21, 33} and got[33].component_id == 21
    assert asked[1] <= 2  # all pairs of texts that share a key before


def test_shared_shingles_of_cells_equal_brute_force():
    r = np.random.default_rng(6)
    for high in (3, 40, 10**6):
        around, place = [], []
        for _ in range(12):
            before, behind = r.integers(0, 46, 2)
            around.append(r.integers(1, high, before + behind + 1).astype(np.uint32))
            place.append(before)
        least = np.array([min([len({*a[s : s + 46].tolist()}) for s in range(max(0, len(a) - 45))], default=0) for a in around])
        x, _, bits, valid = cw._passages_of_cells([a.tobytes() for a in around], np.array(place), least)
        for i, own in enumerate(around):
            at = lambda k, s: {*around[k][max(0, s - 45 + place[k]) : s + 1 + place[k]].tolist()}
            assert valid[i].tolist() == [0 <= s - 45 + place[i] and s + place[i] < len(own) for s in range(46)]
            for j in range(i + 1):
                masks = {}
                for v, m in zip(x[j].tolist(), bits[j].tolist()):
                    masks[v] = masks.get(v, 0) | m * (v > 0)
                both = cw._counts(np.array([[masks.get(v, 0) & m for v, m in zip(x[i].tolist(), bits[i].tolist())]], np.uint64))[0]
                assert both.tolist() == [len(at(i, s) & at(j, s)) for s in range(46)]


def test_links_of_a_cell_show_all_its_alike_passages():
    """Two texts have the left of what is around a cell as it is, a third has its right with two changes; all are one component."""
    import pyarrow as pa

    r = np.random.default_rng(8)
    new = lambda: r.integers(1, 1 << 32, 91).astype(np.uint32)
    around = [new() for _ in range(4)]
    for other in around[1:3]:
        other[:61] = around[0][:61]
    around[3][[k for k in range(42, 91) if k not in (50, 70)]] = [around[0][k] for k in range(42, 91) if k not in (50, 70)]
    flag = [True, False, False, False]
    columns = {"class": [10, 11, 12, 13], "c": [45] * 4, "comp": [1] * 4, "place": [45] * 4, "least": [46] * 4, "role": [2, 1, 1, 1], "ask": flag, "held": [not x for x in flag], "around": [a.tobytes() for a in around]}
    out = cw._meet(2)(pa.table(columns)).to_pylist()
    assert sorted((x["l"], x["r"], x["c"]) for x in out) == [(10, 11, 45), (10, 12, 45), (10, 13, 45)]
