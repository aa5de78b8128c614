"""Language identification of mixed texts: script ranges, then Viterbi over per-word scores.

Per-language probabilities of hashed character n-grams score each distinct word of a slice. The
script of a word's first letter leaves as candidates only the languages written in it. Viterbi over a
document's words pays a penalty for every change of language, so its best path labels spans; the
language with most letters on it is the document's.
"""

from __future__ import annotations

from array import array
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fertility import SCRIPTS
from .shared import held_out_py, slices

ORDERS, BUCKETS = (2, 3, 4), 1 << 15
SWITCH_PENALTY = 8.0
SCRIPT_SHARE = 0.01
SMOOTHING = 0.5
#: Languages with a full row of numbers take as much memory at most; those learned from fewest words beyond it keep only the numbers that they have.
MODEL_MB = 512
#: Scores of words by language that a slice of texts has at once; one text may exceed it.
CELLS = 16_000_000
UNKNOWN = "und"
#: ASCII but letters to blanks; the rest of UTF-8 stays.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(LETTERS).split()


def first_letter(word: str) -> int:
    """Code point of the first letter, or -1."""
    return next((ord(c) for c in word if c.isalpha()), -1)


def scripts(words: list[str]):
    """Index into SCRIPTS of each word's first letter; -1 without a letter."""
    import numpy as np

    names = list(dict.fromkeys(n for _, n in SCRIPTS))
    number = np.array([names.index(n) for _, n in SCRIPTS])
    c = np.array([first_letter(w) for w in words], np.int64)
    at = number[np.maximum(np.searchsorted([a for a, _ in SCRIPTS], c, "right") - 1, 0)] if len(c) else c
    return np.where(c < 0, -1, at)


N_SCRIPTS = len({n for _, n in SCRIPTS})


def grams(words: list[str]):
    """(word number, bucket) arrays of each order's n-grams, with one blank at either end of a word."""
    import numpy as np

    c = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = c == 32
    word = np.cumsum(blank) - 1
    for k, n in enumerate(ORDERS):
        if len(c) < n:
            continue
        size = len(c) - n + 1
        h = np.zeros(size, np.uint64)
        ok = np.ones(size, bool)
        for i in range(n):
            h = (h ^ c[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < i < n - 1:
                ok &= ~blank[i : i + size]
        if n == 2:
            ok &= ~(blank[:size] & blank[1 : 1 + size])
        yield word[:size][ok], (h[ok] % np.uint64(BUCKETS)).astype(np.int64) + k * BUCKETS


def _train(batches):
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    total: dict = {}
    for batch in slices(batches):
        seen: dict[str, Counter] = {}
        for i, lang, text in zip(batch.column("id").to_pylist(), batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if not held_out_py(i):
                seen.setdefault(lang, Counter()).update(words_of(text))
        for lang, count in seen.items():
            ws = [w.decode() for w in count]
            weight = np.fromiter(count.values(), np.float64, len(ws))
            sums = total.setdefault(lang, np.zeros(len(ORDERS) * BUCKETS + N_SCRIPTS))
            if not ws:
                continue
            for word, bucket in grams(ws):
                sums[: len(ORDERS) * BUCKETS] += np.bincount(bucket, weight[word], len(ORDERS) * BUCKETS)
            s = scripts(ws)
            sums[len(ORDERS) * BUCKETS :] += np.bincount(s[s >= 0], weight[s >= 0], N_SCRIPTS)
    for lang, sums in total.items():
        at = np.flatnonzero(sums)
        at = at if len(at) else np.array([0])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at])], names=["lang", "at", "value"])


class LanguageModel:
    """Log-probabilities of n-gram buckets and the scripts of each language.

    sums has a row for each of langs. rare: (language, places, numbers) of languages without a row: what is not among the places is 0.
    Both kinds score alike.
    """

    def __init__(self, langs: list[str], sums, rare: list | None = None):
        import numpy as np

        n, full, rare = len(ORDERS) * BUCKETS, langs, sorted(rare or [], key=lambda r: r[0])
        self.langs = sorted([*langs, *(r[0] for r in rare)])
        place = {x: i for i, x in enumerate(self.langs)}
        self.full = [place[x] for x in full]
        grams_, script = sums[:, :n].reshape(len(full), len(ORDERS), BUCKETS), np.zeros((len(self.langs), N_SCRIPTS))
        script[self.full] = sums[:, n:]
        p = (grams_ + SMOOTHING) / (grams_.sum(2, keepdims=True) + SMOOTHING * BUCKETS)
        self.logp = np.log(p).reshape(len(full), n).astype(np.float32)
        # a rare language's number by order for a bucket that it lacks, and what each of its buckets has beyond that, in order of buckets
        self.rare, self.least = [place[r[0]] for r in rare], np.zeros((len(rare), len(ORDERS)))
        owner, bucket, more = ([np.empty(0, k)] for k in (np.int32, np.int32, np.float32))
        for i, (_, at, value) in enumerate(rare):
            at, value = np.asarray(at), np.asarray(value, float)
            script[self.rare[i], at[at >= n] - n] = value[at >= n]
            at, value = at[at < n], value[at < n]
            self.least[i] = np.log(SMOOTHING / (np.bincount(at // BUCKETS, value, len(ORDERS)) + SMOOTHING * BUCKETS))
            owner.append(np.full(len(at), i, np.int32))
            bucket.append(at.astype(np.int32))
            more.append(np.log((value + SMOOTHING) / SMOOTHING).astype(np.float32))
        owner, bucket, more = map(np.concatenate, (owner, bucket, more))
        order = np.argsort(bucket, kind="stable")
        self.owner, self.more = owner[order], more[order]
        self.begin = np.searchsorted(bucket[order], np.arange(n + 1)) if rare else None
        self.writes = script >= SCRIPT_SHARE * np.maximum(script.sum(1, keepdims=True), 1)

    def slice_bytes(self) -> int:
        """Bytes of text that are scored at once: there are fewer words than half of them."""
        return max(4096, min(8 << 20, 2 * CELLS // max(1, len(self.langs))))

    def _add_rare(self, out, word, bucket):
        """Add the scores of rare languages for n-grams (word number, bucket) to out, words by rare languages."""
        import numpy as np

        for a in range(0, len(word), 1 << 16):
            w, b = word[a : a + (1 << 16)], bucket[a : a + (1 << 16)]
            first, size = self.begin[b], self.begin[b + 1] - self.begin[b]
            at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            np.add.at(out, (np.repeat(w, size), self.owner[at]), self.more[at])
            np.add.at(out, w, self.least[:, b // BUCKETS].T)

    def word_scores(self, words: list[str]):
        """(words x languages) scores, 0 for the best candidate, less for others; NaN-free."""
        import numpy as np

        out, rare = np.zeros((len(words), len(self.langs))), np.zeros((len(words), len(self.rare)))
        for word, bucket in grams(words):
            for i, place in enumerate(self.full):
                out[:, place] += np.bincount(word, self.logp[i][bucket], len(words))
            if self.rare:
                self._add_rare(rare, word, bucket)
        out[:, self.rare] = rare
        out /= len(ORDERS)
        s = scripts(words)
        candidate = self.writes[:, np.maximum(s, 0)].T
        none = ~candidate.any(1)  # no learned language is written so: every language fits as well
        out[none] = 0
        candidate[none] = True
        out = np.where(candidate, out, -1e3)
        return out - out.max(1, keepdims=True)

    def paths(self, rows: list, scores, penalty: float) -> list:
        """Viterbi for all documents of a slice side by side; rows: arrays of word numbers."""
        import numpy as np

        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        size = np.array([len(rows[i]) for i in order])
        start = np.concatenate([[0], np.cumsum(size)])
        flat = np.concatenate([rows[i] for i in order]) if len(order) else np.empty(0, int)
        back = np.empty((len(flat), len(self.langs)), np.int16)
        own = np.arange(len(self.langs), dtype=np.int16)
        best = np.zeros((len(order), len(self.langs)))
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(longest), "left")  # documents longer than t
        for t in range(longest):
            k = active[t]
            at = start[:k] + t
            b = best[:k]
            top = b.argmax(1)
            change = b[np.arange(k), top] - penalty
            stay = b >= change[:, None]
            back[at] = np.where(stay, own, top[:, None])
            best[:k] = np.where(stay, b, change[:, None]) + scores[flat[at]]
        state = best.argmax(1)
        path = np.empty(len(flat), np.int16)
        for t in range(longest - 1, -1, -1):
            k = active[t]
            at = start[:k] + t
            path[at] = state[:k]
            state[:k] = back[at, state[:k]]
        out: list = [None] * len(rows)
        for j, i in enumerate(order):
            out[i] = path[start[j] : start[j + 1]]
        return out


def _predict(shared, penalty):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        model: LanguageModel = shared.value
        for batch in slices(batches, max_bytes=model.slice_bytes()):
            index: dict[bytes, int] = {}
            rows = []
            for text in batch.column("text").to_pylist():
                ws = words_of(text)
                rows.append(np.fromiter((index.setdefault(w, len(index)) for w in ws), np.int64, len(ws)))
            words = [w.decode() for w in index]
            spoken = scripts(words) >= 0
            letters = np.fromiter((sum(map(str.isalpha, w)) for w in words), np.int64, len(words))
            rows = [r[spoken[r]] for r in rows]
            pred, score, spans = [], [], []
            if model.langs and words:
                paths = model.paths(rows, model.word_scores(words), penalty)
            for k, row in enumerate(rows):
                if not len(row) or not model.langs:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    spans.append([])
                    continue
                path = paths[k]
                share = np.bincount(path, letters[row], len(model.langs))
                pred.append(model.langs[int(share.argmax())])
                score.append(float(share.max() / share.sum()))
                cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                spans.append([{"lang": model.langs[path[a]], "start": a, "end": b} for a, b in zip(cuts, cuts[1:])])
            keys = [i for i, f in enumerate(batch.schema) if f.name == "id"]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            whole = pa.types.is_struct(batch.schema.field("id").type)
            held = pa.nulls(batch.num_rows, pa.bool_()) if whole else pa.array([held_out_py(x) for x in batch.column("id").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keys), held, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)], names=["id", "held_out", "lang_pred", "score", "lang_spans"])

    return run


def learn_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Model of all rows with a language whose crc32(id as text) mod 5 is not 0.

    Counts are summed by Spark; at most len(ORDERS) * BUCKETS + scripts numbers a language reach the
    driver. Languages that MODEL_MB can't hold in full, the least of them, keep only the numbers that are not 0, so that a column with many wrong languages
    costs little more than their words.
    """
    import numpy as np

    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sums = known.mapInArrow(_train, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    width = len(ORDERS) * BUCKETS + N_SCRIPTS
    places, numbers = defaultdict(lambda: array("i")), defaultdict(lambda: array("d"))
    for r in sums.toLocalIterator():
        places[r.lang].append(r["at"])
        numbers[r.lang].append(r.value)
    by_size = sorted(places, key=lambda x: (-sum(numbers[x]), x))
    full = sorted(by_size[: max(1, (MODEL_MB << 20) // (width * 8))])
    dense = np.zeros((len(full), width))
    for row, x in zip(dense, full):
        row[places[x]] = numbers[x]
    return LanguageModel(full, dense, [(x, places[x], numbers[x]) for x in by_size if x not in set(full)])


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """(id_col, held_out, lang_pred, score, lang_spans) for each row.

    score: the letters of lang_pred's spans over all letters. Spans are ranges of the words that have
    a letter. Null texts, texts without a letter, and all texts if no language was learned are `und`
    with score 0; ties go to the first language by name. Other columns are dropped; id_col may be a
    struct of whole rows, and held_out is null then.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, lang_spans array<struct<lang:string,start:int,end:int>>"
    return rows.mapInArrow(_predict(shared, penalty), made).withColumnRenamed("id", id_col)
