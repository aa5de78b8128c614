import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.data import documents, texts
from tests.llm.test_text_operators import expected, rows_by_text
from tracemill.llm import bpe_merges, fim, importance

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# ---- importance resampling


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def runs_of(text):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(rows, goal, percent=5, least=20):
    """Sorted output rows by the contract, one feature at a time."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in side for f in runs_of(x)) for side in ([x for _, x in rows], goal))
    big, aim = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * big / ((s[b] + 1) * aim)))
    out = []
    for i, text in rows:
        f = runs_of(text)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(sha(f"42:{'' if i is None else i}")[:8], 16)
        out.append([i, len(words_of(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize("size", [90, 1 << 16])
def test_resample_equals_brute_force(spark, size):
    docs = documents(spark)
    goal = documents(spark, texts(seed=4, n=20) + ["Ça été un deux trois", None])
    out = importance.resample(docs, goal, percent=40, chunk_bytes=size)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, out.collect())) == plain_resample(rows, [r.text for r in goal.select("text").collect()], percent=40)


def test_resample_of_empty_tables(spark):
    none = documents(spark, []).limit(0)
    assert importance.resample(none, documents(spark)).count() == 0
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, importance.resample(docs, none).collect())) == plain_resample(rows, [])


def test_resample_ties_go_to_the_smaller_id(spark):
    import pyspark.sql.functions as F

    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(i, text) for i in (4, 4, 4, 9)], "doc_id long, text string")
    tied = spark.range(7, -1, -1).select(F.col("id"), F.lit(30).cast("long").alias("n_words"), F.lit(1).cast("long").alias("n_features"), F.lit(5).cast("long").alias("weight"), F.lit(8).cast("long").alias("score"))
    assert {r.id: r.rank for r in importance.ranked(tied, 3).collect()} == {0: 1, 1: 2, 2: 3, **dict.fromkeys(range(3, 8))}
    ranks = [r["rank"] for r in importance.resample(docs, docs, percent=75).collect()]
    assert sorted(r for r in ranks if r) == [1, 2, 3]


def test_chunks_own_every_run_once():
    r = random.Random(5)
    for size in (1, 7, 40):
        text = "".join(r.choice("ab é-. Z9") for _ in range(400))
        raw, got = text.encode(), Counter()
        parts = list(importance.cut(raw, size, 2))
        assert b"".join(p[:own] for p, own in parts) == raw
        for part, own in parts:
            w, mine = words_of(part.decode()), len(words_of(part[:own].decode()))
            got.update(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(min(mine, len(w) - n + 1)))
        assert got == Counter(runs_of(text))


def test_checksums_of_runs():
    import numpy as np

    parts = [b"", b"a", b"of", b"x" * 64, b"y" * 65, "é".encode() * 5000]
    for a in parts:
        for b in parts:
            x, y, n = np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)])
            assert int(importance.crc_after(x, y, n)[0]) == zlib.crc32(a + b)


# ---- fill-in-the-middle

UNITS = {"char": lambda t: list(t), "word": lambda t: re.findall(r"^[ \t-\r]+(?:[^ \t-\r]+[ \t-\r]*)?|[^ \t-\r]+[ \t-\r]*", t), "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t)}


def plain_fim(i, text, unit="char"):
    text = text or ""
    digest = sha(f"1:{'' if i is None else i}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    parts = UNITS[unit](text)
    if unit == "word" and text and text[0] in " \t\n\r\v\f" and len(parts[0].strip(" \t\n\r\v\f")):
        blank = len(parts[0]) - len(parts[0].lstrip(" \t\n\r\v\f"))
        parts = [parts[0][:blank], parts[0][blank:], *parts[1:]]
    n = len(parts)
    low, high = sorted(x % (n + 1) for x in h[:2])
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(parts[:low]), "".join(parts[low:high]), "".join(parts[high:])
    if h[3] % 100 < 20:
        return n, "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}"


MARKED = ["a<P>b", "<S>", "x" * 62 + "<M>" + "y" * 90, "<P", "P> <<S <M", " leading blanks", "\n\n\nlines\n\n"]


@pytest.mark.parametrize("unit,size", [("char", 1 << 16), ("char", 64), ("word", 64), ("line", 50), ("word", 1 << 16)])
def test_fim_equals_brute_force(spark, unit, size):
    docs = documents(spark, [t for t in texts() if size > 100 or not t or len(t) < 5000] + MARKED)
    made = fim.fill_in_middle(docs, unit=unit, chunk_bytes=size)
    want = Counter((r.doc_id, *plain_fim(r.doc_id, r.text, unit)) for r in docs.select("doc_id", "text").collect())
    assert Counter(map(tuple, made.collect())) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_fim_digest_restores_every_text(spark):
    docs = documents(spark, texts() + MARKED)
    out = fim.digest_forms(fim.fill_in_middle(docs, chunk_bytes=8000))
    want = Counter((r.doc_id, *(p := plain_fim(r.doc_id, r.text))[:4], sha(p[4]), sha(r.text or "")) for r in docs.select("doc_id", "text").collect())
    assert Counter(map(tuple, out.collect())) == want
    assert fim.digest_forms(fim.fill_in_middle(documents(spark, []).limit(0))).count() == 0
    with pytest.raises(Exception, match="no unit"):
        fim.fill_in_middle(docs, unit="page").collect()


# ---- byte-pair encoding by backtracking

ODD = ["<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext", "՘x ꟎1 \U000107bb!", " 　  x\r\n\t\ty", "\U0001f600\U0001f468‍\U0001f469", "'s 'T we'll've", "\x00\x01\x7f\x80\xad", "lowlowlow " * 50, "ab" * 5000, " " * 3000 + "x"]


def test_merges_equal_the_library(spark):
    docs = documents(spark, texts() + ODD)
    own = Tokenizer.from_file(public_tokenizers.path(bpe_merges.VOCABULARY))

    def reference(text):
        ids = own.encode(text or "", add_special_tokens=False).ids
        return len(ids), sha(",".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False))

    out = bpe_merges.digest_tokens(bpe_merges.encode(docs, decoded=True))
    assert rows_by_text(docs, out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == expected(docs, reference)
    apart = bpe_merges.digest_tokens(bpe_merges.encode(docs))
    assert sorted(apart.collect(), key=str) == sorted(out.collect(), key=str)


def test_every_token_and_random_words_equal_the_library():
    path = public_tokenizers.path(bpe_merges.VOCABULARY)
    merges, own = bpe_merges.load(path), Tokenizer.from_file(path)
    letter = {b: c for c, b in bpe_merges.byte_letters().items()}
    ids = lambda raw: [t.id for t in own.model.tokenize("".join(letter[b] for b in raw))]
    for raw in merges.tokens[:50256]:
        assert merges.encode(raw) == ids(raw)
    r = random.Random(1)
    for _ in range(3000):
        raw = b"".join(r.choice(merges.tokens[:50256])[: r.randint(1, 5)] for _ in range(r.randint(1, 9)))
        assert merges.encode(raw) == ids(raw)
        raw = bytes(r.choice(b"aab") for _ in range(r.randint(1, 40)))
        assert merges.encode(raw) == ids(raw)


def test_characters_split_as_in_the_library():
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    find = bpe_merges.splitter(public_tokenizers.PATTERN, bpe_merges.odd_letters())
    for block in range(0, 0x110000, 0x800):
        points = [c for c in range(block, block + 0x800) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{chr(c)}1{chr(c)}! {chr(c)}{chr(c)}\n" for c in points)
        ends, at = [], 0
        for w in find(text):
            ends.append((at, at := at + len(w)))
        assert ends == [o for _, o in split(text)]


def test_decoding_of_odd_ids(spark):
    rows = [(1, [0, 50_257]), (2, None), (3, []), (4, [-1]), (5, [None, 3]), (6, [50_256, 64]), (7, [447])]
    out = {r.doc_id: r.decoded for r in bpe_merges.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    own = Tokenizer.from_file(public_tokenizers.path(bpe_merges.VOCABULARY))
    assert out == {1: None, 2: None, 3: "", 4: None, 5: None, 6: own.decode([50_256, 64], skip_special_tokens=False), 7: own.decode([447], skip_special_tokens=False)}
    assert bpe_merges.encode(documents(spark, []).limit(0)).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="plain byte-level"):
        bpe_merges.Merges(public_tokenizers.path("word_bpe_49k.json"))
