import hashlib

import corpus_pipeline
import public_tokenizers
import tiktoken

from tests.llm.data import texts
from tests.llm.test_minhash import plain
from tests.llm.test_text_operators import base_spans, doc_words
from tracemill.llm import bpe


def test_stages_equal_brute_force(spark, tmp_path):
    rows = [t for t in texts() if t is None or len(t) < 5000]
    secret = [t for t in rows if t and len(doc_words(t)) > 60][:2]
    rows += [f"{" ".join(reversed(secret[0].split()))} reach me at me@site.example.com today", f"{rows[2]} {secret[1]}"]
    docs = [(i, t, "fr" if i % 3 == 0 else "en", "s", len(t or "")) for i, t in enumerate(rows)] + [(2, rows[2], "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, secret[1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frames, now = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    for _, f in corpus_pipeline.STAGES:
        frames.append(now)
        now = f(spark, now, str(tmp_path)).cache()
        now.count()
    frames.append(now)
    assert all(f.columns == columns for f in frames[:-1])
    rows_of = lambda f: [(r.doc_id, r.text) for r in f.collect()]
    languages, unique, clean, private = map(rows_of, frames[1:5])
    assert {t for _, t in languages} <= {t for t in rows if any(map(str.isalpha, t or ""))}
    comps = plain([(n, i, t) for n, (i, t) in enumerate(languages)], 5)
    want = {}
    for n, (i, _) in enumerate(languages):
        size, low = comps[n]
        want.setdefault((low,) if size else ("empty", n), i)
    assert len(unique) == len(want) and {i for i, _ in unique} == {k[0] if k[0] != "empty" else i for k, i in want.items()}
    window = {tuple(doc_words(secret[1])[i : i + 10]) for i in range(len(doc_words(secret[1])) - 9)}
    hit = lambda t: any(tuple(doc_words(t)[i : i + 10]) in window for i in range(len(doc_words(t))))
    assert sorted(clean) == sorted((i, t) for i, t in unique if not hit(t)) and len(clean) < len(unique)
    assert [i for i, _ in sorted(private)] == [i for i, _ in sorted(clean)] and not any(base_spans(t) for _, t in private)
    assert any("<EMAIL>" in t for _, t in private)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    told = {r.doc_id: r for r in now.collect()}
    for i, t in private:
        assert told[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in own.encode_ordinary(t))).hexdigest()
        assert told[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
