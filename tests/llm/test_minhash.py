import random
import re

from pyspark.sql import functions as F

from tests.llm.data import documents, texts
from tracemill.llm import minhash


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def plain(rows, k):
    """Components of (key, id, text) rows by all pairs."""
    sets = {key: shingles(t, k) for key, _, t in rows}
    root = {key: key for key in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, ia, _ in rows:
        for b, ib, _ in rows:
            if a < b and sets[a] and sets[b] and (100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) or ia == ib is not None):
                root[find(a)] = find(b)
    low = {}
    for key, i, _ in rows:
        if i is not None:
            low[find(key)] = min(i, low.get(find(key), i))
    return {key: (len(sets[key]), low.get(find(key))) for key in sets}


def check(spark, docs, k):
    rows = [(n, r.doc_id, r.text) for n, r in enumerate(docs.select("doc_id", "text").collect())]
    want = sorted(((i, t or "", *plain_) for (n, i, t), plain_ in zip(rows, plain(rows, k).values())), key=str)
    out = minhash.near_duplicates(docs, shingle=k).select("row.doc_id", F.coalesce("row.text", F.lit("")).alias("t"), "n_shingles", "component_id", "kept", "first").cache()
    got = out.collect()
    assert sorted(((r.doc_id, r.t, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in got)
    return got


def test_components_equal_all_pairs(spark):
    for k in (2, 5):
        check(spark, documents(spark), k)


def test_chains_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MINOR_BLOCK", 3)
    monkeypatch.setattr(minhash, "MAJOR_BLOCK", 4)
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    now = [word() for _ in range(60)]
    chain = []
    for _ in range(40):  # neighbours are alike, the ends are not
        now = list(now)
        now[r.randrange(60)] = word()
        chain.append(" ".join(now))
    family = [word() for _ in range(80)]
    for _ in range(40):
        w = list(family)
        for _ in range(r.randint(1, 12)):
            w[r.randrange(80)] = word()
        chain.append(" ".join(w))
    got = check(spark, spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string"), 2)
    assert sum(x.first for x in got) == len({x.component_id for x in got})


def test_empty_and_single(spark):
    assert minhash.near_duplicates(documents(spark, []).limit(0)).count() == 0
    rows = minhash.near_duplicates(documents(spark, ["only"])).collect()
    assert len(rows) == 1 and rows[0].kept and rows[0].first


def test_connected_components_on_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 100), (60, 61), (61, 60)], "l long, r long")
    got = dict(minhash.connected_components(edges).collect())
    assert got == {**{i: 0 for i in range(51)}, 60: 60, 61: 60}
