"""Token counts by a unigram model over a trie of pre-tokens.

The vocabulary is public; a piece's log-probability follows Zipf's law in its rank. Distinct
pre-tokens of a slice form a trie, walked in sorted order: the forward scores of a prefix (best
score and fewest tokens of its segmentations) stay on a stack and are computed once for all words below
it; each terminal stores its count. Characters outside the vocabulary cost one token for each UTF-8 byte.
"""

from __future__ import annotations

import math

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import slices

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
CACHE_WORDS = 300_000
#: What a byte of an unknown character costs beyond the rarest piece.
BYTE_PENALTY = 2.0


def unigram(path: str) -> tuple[dict[str, float], float, int]:
    """(log-probability by piece, that of a fallback byte, longest piece) of a sentencepiece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    total = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
    logp = {p: -math.log(i + 1) - total for i, p in enumerate(pieces)}
    return logp, min(logp.values()) - BYTE_PENALTY, max(map(len, logp))


def trie_counts(words, model) -> dict[str, int]:
    """Token count of every distinct word by one walk over their trie; a word is marked in front."""
    logp, byte, longest = model
    get = logp.get
    out: dict[str, int] = {}
    score, count, before = [0.0], [0], ""
    for word in sorted(set(words)):
        text = MARK + word
        same = 0
        for a, b in zip(text, before):
            if a != b:
                break
            same += 1
        del score[same + 1 :], count[same + 1 :]
        for end in range(same + 1, len(text) + 1):
            c = text[end - 1]
            best = most = None
            for start in range(max(0, end - longest), end):
                p = get(text[start:end])
                if p is not None:
                    s = score[start] + p
                    if best is None or s > best or s == best and count[start] + 1 < most:
                        best, most = s, count[start] + 1
            if c not in logp:
                width = len(c.encode())
                s = score[end - 1] + width * byte
                if best is None or s > best:
                    best, most = s, count[end - 1] + width
            score.append(best)
            count.append(most)
        out[word] = count[-1]
        before = text
    return out


def _count(path):
    def run(batches):
        import pyarrow as pa

        model, known = unigram(path), {}
        for batch in slices(batches):
            split = [(x or "").encode().split() for x in batch.column("text").to_pylist()]
            if len(known) > CACHE_WORDS:
                known.clear()
            new = {w for ws in split for w in ws if w not in known}
            counts = trie_counts([w.decode() for w in new], model)
            known.update((w, counts[w.decode()]) for w in new)
            keys = [i for i, f in enumerate(batch.schema) if f.name != "text"]
            schema = pa.schema([*(batch.schema.field(i) for i in keys), ("n_words", pa.int64()), ("n_tokens", pa.int64())])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keys), pa.array([len(ws) for ws in split], pa.int64()), pa.array([sum(map(known.__getitem__, ws)) for ws in split], pa.int64())], schema=schema)

    return run


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id_col, n_words, n_tokens) for each row: pre-tokens between ASCII blanks and their unigram tokens.

    Null and blank texts have 0 of both. Other columns are dropped; repeated rows are counted each.
    Equal scores: the segmentation of fewer tokens counts.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")) if id_col != "text" else docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema[0], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(_count(vocabulary or public_tokenizers.path(VOCABULARY)), schema)
