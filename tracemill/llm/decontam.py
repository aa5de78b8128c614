"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words and a block is two of them. All ten-word windows of the benchmark are the
patterns of one table; items of fewer words form a table for their length. At a position, the block
that ends there gives a shift: how far the window may move before any pattern could end. A word that no
pattern holds moves the window past itself. Shift 0 selects the bucket of the patterns that end in this
block, and a direct comparison confirms the occurrence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, stage

WINDOW = 10
#: Windows in one table on the executors; more are searched in several passes.
MAX_WINDOWS = 1_000_000
#: A-Z lower-cased; other ASCII but digits and letters to blanks; UTF-8 bytes above stay.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


class WuManber:
    """Shift and suffix tables of patterns (tuples of words) to sets of item ids."""

    def __init__(self, patterns: dict[tuple, set]):
        self.ids: dict[bytes, int] = {}
        self.items = list(patterns.values())
        lengths: dict[int, dict] = {}
        for k, words in enumerate(patterns):
            row = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            lengths.setdefault(len(row), []).append((row, k))
        self.tables = []
        for m, rows in lengths.items():
            block = min(2, m)
            shift, suffix = {}, {}
            for row, k in rows:
                for end in range(block, m + 1):
                    key = self.key(row, end - 1, block)
                    shift[key] = min(shift.get(key, m), m - end)
                suffix.setdefault(self.key(row, m - 1, block), []).append((row, k))
            self.tables.append((m, block, shift, suffix))

    @staticmethod
    def key(row, i, block):
        return row[i] if block == 1 else row[i - 1] << 32 | row[i]

    def find(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """All occurrences: (start, end) word ranges and the ids of their items."""
        get = self.ids.get
        row = [get(w, 0) for w in text_words]
        n, spans, items = len(row), [], set()
        for m, block, shift, suffix in self.tables:
            far, i = m - block + 1, m - 1
            while i < n:
                b = row[i]
                if not b:
                    i += m
                    continue
                key = b if block == 1 else row[i - 1] << 32 | b
                step = shift.get(key, far)
                if step:
                    i += step
                    continue
                for pattern, k in suffix[key]:
                    if row[i - m + 1 : i + 1] == pattern:
                        spans.append((i - m + 1, i + 1))
                        items |= self.items[k]
                i += 1
        return spans, items


def merge(spans):
    """Sorted union of half-open ranges."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """(pattern array<binary>, item string): one row for each window of each item."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            out = {"pattern": [], "item": []}
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                own = words(text)
                for p in {tuple(own[i : i + window]) for i in range(max(1, len(own) - window + 1))} if own else ():
                    out["pattern"].append(list(p))
                    out["item"].append(item)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("pattern", pa.list_(pa.binary())), ("item", pa.string())]))

    return benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(run, "pattern array<binary>, item string")


def _search(table, acc: bool):
    def run(batches):
        import pyarrow as pa

        finder = WuManber(table.value)
        schema = None
        for batch in slices(batches):
            before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()) if acc else iter(lambda: ((), ()), None)
            spans, items, n_words = [], [], []
            for text, (was, had) in zip(batch.column("text").to_pylist(), before):
                own = words(text)
                found, ids = finder.find(own)
                spans.append([list(x) for x in merge([*map(tuple, was or ()), *found])])
                items.append(sorted({*(had or ()), *(x for x in ids if x is not None)}))
                n_words.append(len(own))
            keep = [i for i, f in enumerate(batch.schema) if f.name in ("id", "text")]
            schema = schema or pa.schema([*(batch.schema.field(i) for i in keep), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string())), ("n_words", pa.int64())])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(spans, schema.field("spans").type), pa.array(items, schema.field("items").type), pa.array(n_words, pa.int64())], schema=schema)

    return run


def find_benchmark(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Word ranges of documents that occur in benchmark items.

    Returns id, text, spans (merged [start, end) word ranges), items (sorted ids, as strings) and
    n_words for each input row. Null or wordless texts have no words and no hits; null or
    wordless items have no windows; items with a null id hit words but are not listed; repeated items
    or rows change nothing. Other input columns are dropped; id_col may be a struct of whole rows. The windows of at most max_windows
    rows are broadcast at a time; a larger benchmark is searched in several passes, each
    written to the shared folder.
    """
    windows = item_windows(benchmark, item_col, item_text_col, window)
    sc, spark = docs.sparkSession.sparkContext, docs.sparkSession
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = out.schema["id"].dataType.simpleString()
    made = f"id {id_type}, text string, spans array<array<int>>, items array<string>, n_words bigint"
    count = windows.count()
    passes = max(1, -(-count // max_windows))
    if passes > 1:
        windows = stage(windows.withColumn("pass", F.pmod(F.xxhash64("pattern"), F.lit(passes))), "windows")
    for i in range(passes):
        rows = windows.where(F.col("pass") == i) if passes > 1 else windows
        table: dict[tuple, set] = {}
        for r in rows.toLocalIterator():
            table.setdefault(tuple(map(bytes, r.pattern)), set()).add(r.item)
        if i:
            out = stage(out, "decontam")
        out = out.mapInArrow(_search(sc.broadcast(table), i > 0), made)
    return out


def digest_hits(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of find_benchmark's rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
