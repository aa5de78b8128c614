"""Quality rules by tokeniser fertility.

A public vocabulary measures each text: characters a token, the share of byte-fallback tokens and the
entropy of its tokens (in bits, divided by the most that so many tokens can have). Bands for each
language (the dominant script where the language is null) come from the quartiles over all
documents: a text outside its band is rejected. Words are tokenised once for each task that sees
them; the cache is emptied when full.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, stage

VOCABULARY = "piece_bpe_32k.model"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Widths of the bands in interquartile ranges, and the least half-widths.
BAND_IQRS = 3.5
LEAST_WIDTH = {"chars_per_token": 0.1, "byte_share": 0.05, "entropy": 0.2}
CACHE_WORDS = 300_000
#: Steps in one unit of a statistic, for quartiles; as many bands at most are broadcast, more are joined by shuffle.
GRID, BROADCAST_BANDS = 10_000, 100_000
#: First code points of scripts, ascending, and their names.
SCRIPTS = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "southeast"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other")]

STATS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "script": "string", "n_tokens": "bigint", "chars_per_token": "double", "byte_share": "double", "entropy": "double"}


def repeated_words(ids) -> int:
    """Words in three-word windows found twice or more; ids: an integer array of words."""
    import numpy as np

    n = len(ids)
    if n < 4:
        return 0
    k = int(ids.max()) + 1
    if k < 2_000_000:
        key = (ids[:-2].astype(np.int64) * k + ids[1:-1]) * k + ids[2:]
    else:
        key = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].reshape(-1)
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= hit
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


class Tokens:
    """Token ids of words by a sentencepiece model with byte fallback, remembered for a bounded number of words."""

    def __init__(self, path: str):
        import numpy as np
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.index: dict[bytes, int] = {}
        self.pieces: list = []

    def ids(self, words: list[bytes]):
        """Indexes of words into self.pieces."""
        import numpy as np

        if len(self.index) > CACHE_WORDS:
            self.index, self.pieces = {}, []
        index = self.index
        new = [w for w in dict.fromkeys(words) if w not in index]
        if new:
            for w, p in zip(new, self.model.encode([w.decode() for w in new], num_threads=1)):
                index[w] = len(self.pieces)
                self.pieces.append(np.array(p, np.int32))
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))


def _measure(path: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        tokens = Tokens(path)
        starts = np.array([a for a, _ in SCRIPTS])
        for batch in slices(batches):
            out: dict[str, list] = {name: [] for name in STATS}
            for text in batch.column("text").to_pylist():
                text = text or ""
                raw = text.encode()
                words = raw.split()
                ids = tokens.ids(words)
                letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                letters = letters[(letters > 0x7F) | ((letters | 32) >= 97) & ((letters | 32) <= 122)]
                script = SCRIPTS[int(np.bincount(np.searchsorted(starts, letters, "right") - 1).argmax())][1] if len(letters) else "none"
                piece = np.concatenate([tokens.pieces[i] for i in ids.tolist()]) if len(words) else np.empty(0, np.int32)
                n = len(piece)
                ordered = np.sort(piece)
                count = np.diff(np.flatnonzero(ordered[1:] != ordered[:-1]), prepend=-1, append=n - 1) if n else np.empty(0)
                entropy = float(np.log2(n) - (count * np.log2(count)).sum() / n) if n else 0.0
                chars = sum(len(w) for w in words) if text.isascii() else len(text) - sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
                for name, value in zip(out, (len(words), chars, sum(text.count(c) for c in SYMBOLS), duplicate_lines(text), repeated_words(ids), script, n, chars / n if n else 0.0, float(tokens.is_byte[piece].mean()) if n else 0.0, entropy / np.log2(n) if n > 1 else 0.0)):
                    out[name].append(value)
            keys = [i for i, f in enumerate(batch.schema) if f.name != "text"]
            kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keys), *(pa.array(out[c], kinds[k]) for c, k in STATS.items())], names=[*(batch.schema.field(i).name for i in keys), *STATS])

    return run


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", vocabulary: str | None = None) -> DataFrame:
    """One row for each document with its id, lang and STATS; null texts count as empty."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.col(text_col).alias("text"))
    kept = f"id {rows.schema['id'].dataType.simpleString()}, lang string, " + ", ".join(f"{c} {k}" for c, k in STATS.items())
    return rows.mapInArrow(_measure(vocabulary or public_tokenizers.path(VOCABULARY)), kept)


def quartiles(stats: DataFrame, columns: list[str]) -> DataFrame:
    """(band, q_ and each column: its three quartiles in the band), exact for values rounded to GRID steps.

    A quartile is the least value that as large a share of the rows does not exceed; values are counted before
    they are shuffled, so that a band of any size brings one row a distinct value.
    """
    value = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.round(F.col(c) * GRID).cast("long").alias("v")) for c in columns))).alias("x")
    counts = stats.select("band", value).groupBy("band", "x.name", "x.v").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("band", "name")
    counts = counts.withColumn("upto", F.sum("n").over(own.orderBy("v"))).withColumn("all", F.sum("n").over(own))
    least = lambda c, quarter: F.min(F.when((F.col("name") == c) & (4 * F.col("upto") >= quarter * F.col("all")), F.col("v"))) / GRID
    return counts.groupBy("band").agg(*(F.array(*(least(c, q) for q in (1, 2, 3))).alias(f"q_{c}") for c in columns))


def fertility_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", vocabulary: str | None = None, iqrs: float = BAND_IQRS) -> DataFrame:
    """Judge each document by base rules and by the fertility band of its language or script.

    Returns id_col, STATS, band (language or script), base_failed, reasons (of the bands missed) and
    kept, a row for each input row. Texts that are null or hold no word fail the base rules and shape no
    band; bands use every other document. Other input columns are dropped. vocabulary: path of
    a sentencepiece model with byte fallback.
    """
    stats = stage(measure(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, vocabulary=vocabulary), "fertility")
    stats = stats.withColumn("band", F.coalesce("lang", F.concat(F.lit("script:"), "script")))
    sound = (F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words"))
    bands = stage(quartiles(stats.where(sound), list(LEAST_WIDTH)), "bands")
    few = bands.count() <= BROADCAST_BANDS
    judged = stats.join(F.broadcast(bands) if few else bands, "band", "left")
    reasons = []
    for c, least in LEAST_WIDTH.items():
        q = F.col(f"q_{c}")
        width = F.greatest(F.lit(least), iqrs * (q[2] - q[0]))
        high = F.when(F.col(c) > q[1] + width, F.lit(f"{c}_high"))
        low = F.when(F.col(c) < q[1] - width, F.lit(f"{c}_low"))
        reasons += [high] if c == "byte_share" else [high, low]
    judged = judged.withColumn("base_failed", ~sound).withColumn("reasons", F.concat_ws(",", *reasons))
    return judged.select(F.col("id").alias(id_col), *STATS, "band", "base_failed", "reasons", (sound & (F.col("reasons") == "")).alias("kept"))
