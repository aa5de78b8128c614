"""Importance resampling of documents towards a target: hashed n-gram features, chunks that overlap, Gumbel top-k.

A text above CHUNK_BYTES is cut between words; a chunk carries the first n - 1 words of what follows and owns the features that
start at its own words, so that chunks of one long text are counted in parallel and no feature is lost or counted twice.
Counts of buckets are summed in each task before they are shuffled; the model is one number for each bucket, whatever
the input. A second pass sums the gains of each chunk, and those of a document's chunks.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import give_back, hold, partitions, slices, stage, unstage

BUCKETS, LONGEST, CHUNK_BYTES = 10_000, 3, 1 << 16
#: Words that a task keeps by number before it starts anew.
CACHE_WORDS = 500_000
#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest becomes a blank.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
NOT_WORD = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
TABLED = 64


@lru_cache(1)
def _shifts():
    """For each number of zero bytes up to TABLED, what each byte of a checksum becomes when they are appended."""
    import numpy as np

    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    at = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = [at]
    for _ in range(TABLED):
        at = (at >> np.uint32(8)) ^ one[at & np.uint32(255)]
        out.append(at)
    return np.stack(out)


def crc_after(first, second, length):
    """crc32 of two strings one after the other, from that of each and the length of the second; arrays."""
    import numpy as np

    table, x, left = _shifts(), first, length
    while True:
        n = np.minimum(left, TABLED)
        x = table[n, 0, x & np.uint32(255)] ^ table[n, 1, (x >> np.uint32(8)) & np.uint32(255)] ^ table[n, 2, (x >> np.uint32(16)) & np.uint32(255)] ^ table[n, 3, x >> np.uint32(24)]
        left = left - n
        if not left.any():
            return x ^ second


class _Known(dict):
    """Number of each word seen, with its checksum, that of the word and a blank, and its length."""

    def __init__(self):
        self.plain, self.spaced, self.length = [], [], []

    def __missing__(self, word):
        import zlib

        n = self[word] = len(self)
        crc = zlib.crc32(word)
        self.plain.append(crc)
        self.spaced.append(zlib.crc32(b" ", crc))
        self.length.append(len(word))
        return n


def _features(buckets: int, longest: int):
    """Generator over slices of (batch, for each length of a run (bucket, valid) at each word, first word of each row, own words of each row)."""

    def run(batches):
        import numpy as np

        known = _Known()
        for batch in slices(batches, "bytes", 4 << 20):
            if len(known) > CACHE_WORDS:
                known = _Known()
            index, sizes, own = [], [], []
            for raw, limit in zip(batch.column("bytes").to_pylist(), batch.column("own").to_pylist()):
                words = raw.translate(PLAIN).split() if raw else []
                index.extend(map(known.__getitem__, words))
                sizes.append(len(words))
                own.append(len(words) if limit is None else len(raw[:limit].translate(PLAIN).split()))
            at = np.array(index, np.int64)
            plain, spaced, length = (np.array(x, k)[at] for x, k in ((known.plain, np.uint32), (known.spaced, np.uint32), (known.length, np.int64)))
            size, own = np.array(sizes, np.int64), np.array(own, np.int64)
            first = np.cumsum(size) - size
            place = np.arange(len(at)) - np.repeat(first, size)
            mine, room = place < np.repeat(own, size), np.repeat(size, size) - place
            runs, before = [(plain % np.uint32(buckets), mine)], spaced
            for n in range(2, longest + 1):
                k = max(len(at) - n + 1, 0)
                held, end = before[:k], slice(n - 1, n - 1 + k)
                bucket = np.zeros(len(at), np.uint32)
                bucket[:k] = crc_after(held, plain[end], length[end]) % np.uint32(buckets)
                runs.append((bucket, mine & (room >= n)))
                before = crc_after(held, spaced[end], length[end] + 1)
            yield batch, runs, first, own

    return run


def _count(buckets, longest):
    features = _features(buckets, longest)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for _, runs, _, _ in features(batches):
            for bucket, valid in runs:
                total += np.bincount(bucket[valid], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], names=["bucket", "n"])
        give_back()

    return run


def _weigh(gains, longest):
    features = _features(len(gains), longest)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        gain = np.array(gains, np.int64)
        for batch, runs, first, own in features(batches):
            n = sum((valid.astype(np.int64) for _, valid in runs), np.zeros(0, np.int64) if not runs else 0)
            weight = sum(gain[bucket] * valid for bucket, valid in runs)
            n, weight = (np.concatenate([[0], np.cumsum(x)]) for x in (n, weight))
            last = first + own
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(own, pa.int64()), pa.array(n[last] - n[first], pa.int64()), pa.array(weight[last] - weight[first], pa.int64())], names=["key", "id", "n_words", "n_features", "weight"])
        give_back()

    return run


def cut(text: bytes, size: int, carried: int):
    """(chunk with what it carries, bytes of its own) of a text: cuts lie at the first place between words after size bytes."""
    start = 0
    while start < len(text):
        gap = NOT_WORD.search(text, min(start + size, len(text)))
        end = stop = gap.start() if gap else len(text)
        for _ in range(carried):
            word = WORD.search(text, stop)
            stop = word.end() if word else stop
        yield text[start:stop], end - start
        start = end


def _cut(size, carried):
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "bytes"):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("bytes").to_pylist()):
                parts = list(cut(text, size, carried))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.int32())], names=["key", "no", "bytes", "own"])

    return run


class Chunks:
    """Rows of texts as chunks: a short text is its own and stays where it is, chunks of long ones are staged and dealt to all tasks."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, carried: int):
        self.spark = docs.sparkSession
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("bytes"))
        self.kind = rows.schema["id"].dataType.simpleString()
        none, long_ = F.lit(None), F.coalesce(F.octet_length("bytes"), F.lit(0)) > size
        self.short = rows.where(~long_).select(none.cast("long").alias("key"), "id", "bytes", none.cast("int").alias("own"))
        whole = rows.where(long_).select(F.monotonically_increasing_id().alias("key"), "id", "bytes")
        self.texts = stage(whole, "long-texts")
        self.parts = stage(self.texts.select("key", "bytes").mapInArrow(_cut(size, carried), "key bigint, no int, bytes binary, own int").repartition(partitions(self.spark), "key", "no"), "chunks")

    def all(self) -> DataFrame:
        return self.short.unionByName(self.parts.select("key", F.lit(None).cast(self.kind).alias("id"), "bytes", "own"))

    def release(self):
        unstage(self.texts, self.parts)


def bucket_counts(chunks: Chunks, buckets: int, longest: int) -> list[int]:
    """Features of all rows by bucket; the list has one number for each bucket, whatever the input."""
    parts = chunks.all().mapInArrow(_count(buckets, longest), "bucket int, n bigint")
    out = [0] * buckets
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def log_gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the natural logarithm of how much likelier each bucket is in the target, one feature added to each bucket."""
    size, aim = sum(source) + len(source), sum(target) + len(target)
    return [math.floor(1000 * math.log((t + 1) * size / ((s + 1) * aim))) for s, t in zip(source, target)]


def noise(id_: Column, seed: str) -> Column:
    """Thousandths of a Gumbel number made from the seed and the id; a null id counts as an empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """scored, whose rows lie in ranges of falling score, with rank for the first rows drawn and null for the rest.

    Ranges are staged in order and counted; only ranges that begin within the draw are numbered, each on its own.
    """
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), "n_features", "weight"]
    spark = scored.sparkSession
    ranges = stage(scored.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()), "ranges")
    hold(ranges)
    before, total = [], 0
    for part, n in sorted(ranges.groupBy("part").count().collect()):  # a row for each partition
        before.append((part, total))
        total += n
    within = F.broadcast(spark.createDataFrame([b for b in before if b[1] < drawn], "part int, before long"))
    numbered = ranges.join(within, "part").withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")).drop("before")
    rest = ranges.join(within, "part", "left_anti").withColumn("rank", F.lit(None).cast("long"))
    return numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest).drop("part")


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, percent: int = 5, least_words: int = 20, seed: str = "42", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank) of each row; rank is null where a document is not drawn.

    percent of the documents of at least least_words words are drawn without replacement, in proportion to their importance weights
    (highest weight plus Gumbel noise). Null and empty texts have no feature, weight 0, and are never drawn; ids may repeat or be null
    (rows are scored each; ties go to the smaller id, null ids last, then to fewer features). Without documents nothing comes; with an empty
    target all of the target's buckets count one feature. Other columns are dropped.
    """
    chunks, goal = Chunks(docs, id_col, text_col, chunk_bytes, longest - 1), Chunks(target.withColumn(" id", F.lit(0)), " id", target_text, chunk_bytes, longest - 1)
    gains = log_gains(bucket_counts(chunks, buckets, longest), bucket_counts(goal, buckets, longest))
    goal.release()
    made = f"key bigint, id {chunks.kind}, n_words bigint, n_features bigint, weight bigint"
    sums = chunks.all().mapInArrow(_weigh(gains, longest), made)
    figures = ["n_words", "n_features", "weight"]
    parts = stage(sums, "chunk-weights")
    whole = parts.where("key is not null").groupBy("key").agg(*(F.sum(c).alias(c) for c in figures)).join(chunks.texts.select("key", "id"), "key")
    both = parts.where("key is null").select("id", *figures).unionByName(whole.select("id", *figures))
    scored = stage(both.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scored")
    chunks.release()
    unstage(parts)
    hold(scored)
    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    out = ranked(scored.where(able), drawn).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), *figures, "score", "rank")
