import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.data import documents, texts
from tracemill.llm import bpe, decontam, fertility, langid, pii, quality_qda, token_counts, url_filter

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def rows_by_text(docs, out, columns):
    """Counter of output tuples by position of the id; ids repeat, so as multisets."""
    return Counter(tuple(r[c] for c in columns) for r in out.collect())


def expected(docs, f):
    return Counter((r.doc_id, *f(r.text)) for r in docs.select("doc_id", "text").collect())


# ---- byte-level BPE


def test_bpe_equals_tiktoken_and_round_trips(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_TOKENS", 3000)
    docs = documents(spark)
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def reference(text):
        ids = own.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    out = bpe.digest_tokens(bpe.encode(docs))
    assert sorted(bpe.digest_tokens(bpe.encode(docs, decoded=True)).collect(), key=str) == sorted(out.collect(), key=str)
    assert rows_by_text(docs, out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == expected(docs, reference)


def test_bpe_empty_table_and_bad_ids(spark):
    assert bpe.encode(documents(spark, []).limit(0)).count() == 0
    bad = spark.createDataFrame([(1, (60_000).to_bytes(4, "little")), (2, None)], "doc_id long, ids binary")
    assert {r.decoded for r in bpe.decode(bad).collect()} == {None}


def test_varints():
    import numpy as np

    x = np.array([0, 1, 127, 128, 16383, 16384, 2_097_151, 2_097_152, 2**28 - 1])
    assert bpe.from_varints(bpe.to_varints(x)).tolist() == x.tolist()
    assert len(bpe.from_varints(b"")) == 0


# ---- PII


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def base_spans(text):
    found = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m.group())]
    return sorted(found)


PERSONAL = [
    "mail a.b@c.de, x@y.z.@q.w and @no.com or a@b", "1.2.3.4.5.6.7.8 0255.1.1.001 256.1.1.1 1.2.3", "card 4111 1111 1111 1111 or 4111-1111-1111-1112 and 4111111111111111 79927398713",
    "\U0001f600 call +1 (212) 555-0100 now, +49 30 1234567 89 or +1234", 'token = "f0ddae3b09ae356cbefecdd3232fa5489bb400d6" and key sk-abcdefgh12345678ijklmnop99', "no\x00thing \u0661\u0662\u0663 @ . + 1",
    "a.b@c.de" * 30, "+1" + "-" * 400 + "2", "9" * 500 + ".1.1.1",
]


def test_pii_base_spans_equal_brute_force(spark):
    docs = documents(spark, texts() + PERSONAL * 3)

    def reference(text):
        spans = base_spans(text)
        kinds = Counter(k for _, _, k, _ in spans)
        line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        return *(kinds[k] for k in ("email", "ip", "card", "phone")), hashlib.sha256(line.encode()).hexdigest()

    out = pii.digest_spans(pii.find_pii(docs))
    assert rows_by_text(docs, out, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]) == expected(docs, reference)
    by_text = {r.text: r.spans for r in out.join(docs.select("doc_id", "text"), "doc_id").collect()}
    for text in PERSONAL:
        assert {f"{k}:{a}:{b}" for a, _, k, b in base_spans(text)} <= set(by_text[text].split(","))
    assert "secret:9:49" in by_text[PERSONAL[4]]


def test_pii_redaction(spark):
    docs = spark.createDataFrame([(1, "to a@b.cd or +1 212 555 0100."), (2, "clean"), (3, None)], "doc_id long, text string")
    out = pii.find_pii(docs, keep_rows=True).select("row.doc_id", F.expr(pii.redact("row.text", "spans")).alias("t"))
    assert dict(out.collect()) == {1: "to <EMAIL> or <PHONE>.", 2: "clean", 3: None}


def test_pii_empty_table(spark):
    assert pii.digest_spans(pii.find_pii(documents(spark, []).limit(0))).count() == 0


def test_em_learns_reliabilities():
    good, bad = (1, 1, 1, 1, 0, 1), (-1, -1, -1, 0, 0, -1)
    post = pii.estimate([("card", good, 50), ("card", bad, 50), ("card", (1, 1, -1, 0, 0, 1), 5)])
    assert post[0] > 0.95 and post[1] < 0.05 and post[2] > 0.5


def test_labelers_vote_by_their_lists(spark):
    rows = ["Call Sophie in Lyon: +33 1 23 45 67 89", "id +33 1 23 45 67 89", "marie.x@y.zz", "xmariex@y.zz", "card 4111-1111-1111-1111", "card 411-11111-11111111", "ip 010.1.1.1 or 10.1.1.1"]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    found = pii.candidates(df, F.col("text")).select("id", F.explode("spans").alias("s")).select("id", "s.*").collect()
    votes = lambda i, kind, name: [r[name] for r in found if r.id == i and r.kind == kind]
    assert votes(0, "phone", "people") == [1] and votes(1, "phone", "people") == [0]
    assert votes(2, "email", "people") == [1] and votes(3, "email", "people") == [0]
    assert votes(4, "card", "form") == [1] and votes(5, "card", "form") == [-1] and votes(6, "ip", "form") == [-1, 1]


def test_added_spans_are_those_of_the_classifier(spark):
    docs = documents(spark, texts() + PERSONAL * 2)
    found = pii.candidates(docs.select("text"), F.col("text"))
    weights = pii.train(found)
    value = lambda s: sum(w * x for w, x in zip(weights, [*(s[v] for v in pii.VOTES), s["size"] / 4, s.digit_share / 4, *(float(s.kind == k) for k, _, _ in pii.KINDS)])) + weights[-1]
    want = Counter()
    for r in found.collect():
        base = [s for s in r.spans if s.ok]
        extra = [s for s in r.spans if not s.ok and value(s) >= 0 and not any(b.start < s.end and s.start < b.end for b in base)]
        want[tuple(sorted((s.start, s.end, s.kind) for s in (*base, *extra)))] += 1
    got = Counter(tuple(sorted((s.start, s.end, s.kind) for s in r.spans)) for r in pii.find_pii(docs).collect())
    assert got == want and any(not s.base for r in pii.find_pii(docs).collect() for s in r.spans)


# ---- decontamination


def doc_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_decontamination_equals_brute_force(spark):
    base = texts()
    items = [(str(i), t) for i, t in enumerate(base[:9])] + [("s", "le la"), ("n", None), (None, base[20]), ("0", base[0]), ("e", "...")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    mixed = [*base, f"intro {base[4]} outro {base[0]}", f"{base[1]}", "Le, LA!"]
    docs = documents(spark, mixed)
    windows = {}
    for item, text in items:
        w = doc_words(text)
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)

    def reference(text):
        w = doc_words(text)
        hit, found = set(), set()
        for n in {len(p) for p in windows}:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= {x for x in windows[p] if x is not None}
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)

    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for most in (decontam.MAX_WINDOWS, 40):  # in one pass and in several
        out = decontam.digest_hits(decontam.find_benchmark(docs, bench, max_windows=most))
        assert rows_by_text(docs, out, columns) == expected(docs, reference)
    assert decontam.find_benchmark(docs.limit(0), bench).count() == 0
    assert decontam.digest_hits(decontam.find_benchmark(docs, bench.limit(0))).where("contaminated").count() == 0


# ---- quality rules and token counts


def test_fertility_base_columns_equal_brute_force(spark):
    docs = documents(spark)

    def reference(text):
        text = text or ""
        w = BLANK.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if BLANK.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed

    out = fertility.fertility_rules(docs)
    assert rows_by_text(docs, out, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]) == expected(docs, reference)
    assert out.where("base_failed and kept").count() == 0
    assert fertility.fertility_rules(docs.limit(0)).count() == 0


def test_fertility_figures_equal_brute_force(spark):
    import math

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(fertility.VOCABULARY))
    docs = documents(spark, [t for t in texts() if not t or len(t) < 20_000])

    def reference(text):
        ids = [i for w in BLANK.findall(text or "") for i in model.encode(w)]
        n, count = len(ids), Counter(ids)
        entropy = -sum(c / n * math.log2(c / n) for c in count.values()) if n else 0.0
        chars = sum(map(len, BLANK.findall(text or "")))
        return n, chars / n if n else 0.0, sum(map(model.is_byte, ids)) / n if n else 0.0, entropy / math.log2(n) if n > 1 else 0.0

    want = sorted((str(r.doc_id), *(round(x, 9) for x in reference(r.text))) for r in docs.select("doc_id", "text").collect())
    got = sorted((str(r.doc_id), r.n_tokens, *(round(x, 9) for x in (r.chars_per_token, r.byte_share, abs(r.entropy)))) for r in fertility.fertility_rules(docs).collect())
    assert got == want


def test_fertility_without_languages_and_at_the_edge_of_a_band(spark):
    fine = " ".join(texts(seed=1, n=9)[k] or "" for k in (1, 2, 4, 5))
    rows = [(i, fine, None) for i in range(30)]  # all alike: every document lies on its band's median
    out = fertility.fertility_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len({r.band for r in out}) == 1 and out[0].band.startswith("script:") and all(r.kept for r in out)


def test_fertility_bands_equal_brute_force(spark):
    docs = documents(spark)
    rows = fertility.fertility_rules(docs).collect()
    bands = {}
    for r in rows:
        if not r.base_failed:
            bands.setdefault(r.band, []).append(r)
    grid = lambda x: int(x * fertility.GRID + 0.5)
    for r in rows:
        want = []
        for c, least in fertility.LEAST_WIDTH.items():
            if r.band not in bands:
                continue
            v = sorted(grid(x[c]) for x in bands[r.band])
            q = [v[(len(v) * k + 3) // 4 - 1] / fertility.GRID for k in (1, 2, 3)]
            width = max(least, fertility.BAND_IQRS * (q[2] - q[0]))
            if r[c] > q[1] + width:
                want.append(f"{c}_high")
            elif r[c] < q[1] - width and c != "byte_share":
                want.append(f"{c}_low")
        assert r.reasons == ",".join(want) and r.kept == (not r.base_failed and not want)


def test_fertility_rejects_odd_text_only(spark):
    fine = [" ".join(texts(seed=s, n=9)[k] or "" for k in (1, 2, 4, 5)) for s in range(40)]
    odd = " ".join(f"\ue000\ue001{chr(0xE100 + i)}" for i in range(300))
    out = fertility.fertility_rules(spark.createDataFrame([(i, t, "en") for i, t in enumerate([*fine, odd])], "doc_id long, text string, lang string"))
    kept = {r.doc_id: (r.kept, r.base_failed, r.reasons) for r in out.collect()}
    assert kept[40][0] is False and kept[40][1] is False and "byte_share_high" in kept[40][2]
    assert sum(kept[i][0] for i in range(40)) >= 38


def test_token_counts_equal_plain_forward_scores(spark):
    docs = documents(spark)
    logp, byte, longest = model = token_counts.unigram(public_tokenizers.path(token_counts.VOCABULARY))
    memo = {}

    def count(word):
        if word not in memo:
            text = token_counts.MARK + word
            best = [(0.0, 0)]
            for end in range(1, len(text) + 1):
                ways = [(best[a][0] + logp[text[a:end]], -best[a][1] - 1) for a in range(max(0, end - longest), end) if text[a:end] in logp]
                if text[end - 1] not in logp:
                    b = len(text[end - 1].encode())
                    ways.append((best[end - 1][0] + b * byte, -best[end - 1][1] - b))
                s, n = max(ways)
                best.append((s, -n))
            memo[word] = best[-1][1]
        return memo[word]

    def reference(text):
        w = BLANK.findall(text or "")
        return len(w), sum(map(count, w))

    assert rows_by_text(docs, token_counts.count_tokens(docs), ["doc_id", "n_words", "n_tokens"]) == expected(docs, reference)
    assert token_counts.trie_counts([], model) == {}
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


# ---- language ID and quality classifier


def test_language_id_labels_mixed_text(spark):
    rows = [(i, t, None if t is None else "fr" if i % 3 == 0 else "en") for i, t in enumerate(texts(n=240)[:240])]
    en, fr = " ".join(t for _, t, x in rows[1:12] if x == "en"), " ".join(t for _, t, x in rows[:20] if x == "fr")
    rows += [(1000, None, "en"), (1001, "123 !?", None), (1002, f"{en} {fr} {fr} {fr}", None), (1003, "漢字", None), (1004, "", "fr"), (None, en, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn_languages(docs)
    out = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert len(out) == len(rows) and model.langs == ["en", "fr"]
    assert out[1000].lang_pred == out[1001].lang_pred == out[1004].lang_pred == "und"
    assert out[1003].lang_pred in ("en", "fr")
    assert [s.lang for s in out[1002].lang_spans] == ["en", "fr"] and out[1002].lang_pred == "fr"
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i].lang_pred == rows[i][2] for i in held) >= 0.95 * len(held)
    assert all(out[i].held_out for i in held) and all(0 <= r.score <= 1 for r in out.values())
    nobody = langid.learn_languages(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nobody).collect()} == {"und"}


def plain_model(rows):
    """Word score by language, counted n-gram by n-gram, and its languages."""
    import math

    count, total, script = Counter(), Counter(), Counter()
    for i, text, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 5:
            for w in langid.words_of(text):
                script[lang, "latin"] += 1
                for k, g in plain_grams(w.decode()):
                    count[lang, k, g] += 1
                    total[lang, k] += 1
    langs = sorted({x for x, _ in script})

    def score(word):
        out = []
        for lang in langs:
            logs = [math.log((count[lang, k, g] + langid.SMOOTHING) / (total[lang, k] + langid.SMOOTHING * langid.BUCKETS)) for k, g in plain_grams(word)]
            out.append(sum(logs) / len(langid.ORDERS))
        return [x - max(out) for x in out]

    return score, langs


def plain_grams(word):
    padded, mask = f" {word} ", (1 << 64) - 1
    for k, n in enumerate(langid.ORDERS):
        for i in range(len(padded) - n + 1):
            h = 0
            for c in padded[i : i + n]:
                h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) & mask
                h ^= h >> 29
            yield k, h % langid.BUCKETS


@pytest.mark.parametrize("megabytes", [512, 1, 0])
def test_word_scores_equal_brute_force(spark, monkeypatch, megabytes):
    monkeypatch.setattr(langid, "MODEL_MB", megabytes)  # all languages full, one full, one full
    rows = [(i, t, ["en", "fr", "xx", "en-a"][i % 4]) for i, t in enumerate(texts(n=80)[:80])]
    model = langid.learn_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    score, langs = plain_model(rows)
    assert model.langs == langs and len(model.rare) == (0 if megabytes == 512 else 3)
    words = [w.decode() for w in dict.fromkeys(langid.words_of(rows[3][1] + " zzz a être"))]
    got = model.word_scores(words)
    for w, own in zip(words, got.tolist()):
        assert own == pytest.approx(score(w), abs=1e-4)


def test_many_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_MB", 2)
    monkeypatch.setattr(langid, "CELLS", 200_000)
    good = [(i, t, "fr" if i % 3 == 0 else "en") for i, t in enumerate(texts(n=240)[:240])]
    dirty = [(1000 + i, f"w{i} of{i} x", f"dirty{i}") for i in range(400)]
    docs = spark.createDataFrame([*good, *dirty], "doc_id long, text string, lang string")
    model = langid.learn_languages(docs)
    assert len(model.langs) > 300 and len(model.full) == 2
    out = {r.doc_id: r.lang_pred for r in langid.identify(docs.where("doc_id < 1000"), model).collect()}
    assert sum(out[i] == lang for i, _, lang in good) >= 0.9 * len(good)


def test_language_id_edges(spark):
    rows = documents(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr"))
    model = langid.learn_languages(rows)
    got = langid.identify(rows, model).collect()  # columns with the names used inside, a very long text, repeated rows, a null id
    assert len(got) == rows.count() and all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    long = spark.createDataFrame([(1, "the and of " * 40_000), (2, "the and of " * 40_000)], "doc_id long, text string")
    assert {len(r.lang_spans) for r in langid.identify(long, model).collect()} == {1}
    assert langid.identify(rows.limit(0), model).count() == 0


def test_viterbi_equals_plain(spark):
    import itertools

    import numpy as np

    model = langid.LanguageModel(["a", "b", "c"], np.ones((3, len(langid.ORDERS) * langid.BUCKETS + langid.N_SCRIPTS)))
    r = np.random.default_rng(1)
    scores = r.normal(0, 3, (50, 3))
    rows = [r.integers(0, 50, n) for n in (0, 1, 7, 30, 7, 400)]
    for row, path in zip(rows, model.paths(rows, scores, 2.0)):
        assert len(path) == len(row)
        if not len(row):
            continue
        value = lambda p: sum(scores[w, s] for w, s in zip(row, p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = [0.0] * 3
        for t, w in enumerate(row):  # the best value of a path to each language, one word at a time
            best = [scores[w, s] + (max(best[q] - 2.0 * (q != s) for q in range(3)) if t else 0.0) for s in range(3)]
        assert value(path.tolist()) == pytest.approx(max(best))
        if len(row) <= 7:
            assert max(best) == pytest.approx(max(map(value, itertools.product(range(3), repeat=len(row)))))


def test_quality_scores_equal_plain_discriminant(spark):
    import numpy as np

    good = [" ".join(x or "" for x in texts(seed=s, n=9)[1:6]) for s in range(50)]
    bad = [" ".join(w.upper() + "!!" * (s % 3) for w in t.split()) + "\n\n1 2 3" * (s % 5) for s, t in enumerate(good[:40])]
    rows = [*enumerate([*good, *bad]), (500, None), (501, "x" * 200_000), (502, "")]
    labels = {i: int(i < 50) for i in range(90)}
    out = quality_qda.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()
    known = [(np.array(quality_qda.features(t)), labels[i]) for i, t in rows if i in labels and zlib.crc32(str(i).encode()) % 5]
    parts = {k: np.array([x for x, y in known if y == k]) for k in (0, 1)}
    n, d = len(known), len(quality_qda.FEATURES)
    cov = {k: np.cov(x, rowvar=False, bias=True) for k, x in parts.items()}
    pooled = sum(len(parts[k]) * cov[k] for k in parts) / n
    scale = np.maximum(np.array([x for x, _ in known]).std(0), 1e-6)
    logs = {}
    for k, x in parts.items():
        s = (0.9 * cov[k] + 0.1 * pooled) / np.outer(scale, scale)
        s = 0.98 * s + 0.02 * max(np.trace(s) / d, 1e-3) * np.eye(d)
        inverse, det = np.linalg.inv(s), np.linalg.slogdet(s)[1]
        logs[k] = lambda v, m=x.mean(0), i=inverse, det=det, share=len(x) / n: np.log(share) - 0.5 * (det + ((v - m) / scale) @ i @ ((v - m) / scale))
    for r in out:
        v = np.array(quality_qda.features(dict(rows)[r.doc_id]))
        want = 1 / (1 + np.exp(np.clip(logs[0](v) - logs[1](v), -500, 500)))
        assert r.score == pytest.approx(want, abs=1e-6) and r.predicted == (r.score >= 0.3)


def test_quality_classifier_held_out(spark):
    good = [" ".join(x or "" for x in texts(seed=s, n=9)[1:6]) for s in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in t.split()) for t in good[:30]]
    rows = list(enumerate([*good, *bad, None, ""]))
    labels = [(i, 1 if i < 60 else 0) for i in range(90)] + [(3, None), (None, 1), (5000, 1), (4, 1)]
    docs = documents(spark, [t for _, t in rows])
    out = quality_qda.score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(out) == len(rows) + 3 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 90]
    assert held and all(r.predicted == (r.doc_id < 60) for r in held)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    none = quality_qda.score_quality(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_qda.score_quality(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


# ---- url filter


URLS = ["http://Example.com/en/x", "https://www.example.com/en/", "http://m.example.com/en/?q", "http://a.net/es/1", "http://net/es/", "http://telecom/", "http://x.com", "http://x.com/", "ftp://example.com/enx", None, "", "no scheme", "http://", "http:///en/", "http://a..net/fr/#top", "http://www.example.com/en/a://b", "http://example.com:80/en/", "HTTP://É.net/fr/x", "http://b.c.d/x/yz", "http://d/x/y"]


def test_url_filter_equals_brute_force(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("c.d", "/x", "allow"), ("d", "/x/y", "block"), ("d", "/x/y", "allow"), (None, "/", "block"), ("d", None, None)]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 7)], "page_id long, url string, host string").repartition(3)

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        fits = [(len(h + (p or "")), len(h), v == "block", h + p, v) for h, p, v in rules if h and v and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[3], best[4] if best else "allow"

    want = Counter((i, *judge(u)) for i, u in enumerate(URLS * 7))
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    for n in (1, 3, 16):
        out = url_filter.filter_urls(pages, frame, buckets=n)
        assert Counter(tuple(r) for r in out.collect()) == want
    assert url_filter.filter_urls(pages.limit(0), frame).count() == 0
    assert url_filter.filter_urls(pages, frame.limit(0)).where("rule is not null").count() == 0
