"""Fill-in-the-middle transformation of texts, cut by the units of chunks that overlap.

A text is a row of chunks of bytes, each with the last bytes of the one before. Whether a unit begins at a byte is told by that byte and the one before
it, so units are counted in each chunk alone; running sums of the counts say which chunk owns a cut's rank, and only that
chunk is scanned again for the place of the cut. A text of one chunk stays in its task. Chunks of longer texts are staged and dealt to all
tasks, so that a long text is counted and cut by many; its pieces then meet in the order of the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import give_back, hold, partitions, slices, stage, unstage

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
CHUNK_BYTES = 1 << 16
#: Bytes of the chunk before that a chunk carries: one for units, one more for marks.
OVERLAP = 2


def begins(data, unit: str):
    """True where a unit begins, by each byte and the one before; data[0] begins one in any case."""
    import numpy as np

    out = np.empty(len(data), bool)
    out[:1] = True
    before, now = data[:-1], data[1:]
    if unit == "char":
        out[1:] = (now & 0xC0) != 0x80
    elif unit == "word":
        blank = (data == 32) | (data >= 9) & (data <= 13)
        out[1:] = blank[:-1] & ~blank[1:]
    elif unit == "line":
        out[1:] = before == 10
    else:
        raise ValueError(f"no unit {unit}")
    return out


def count_units(chunk: bytes, lead: int, unit: str) -> int:
    """Units that begin in a chunk after its lead bytes."""
    import numpy as np

    return int(begins(np.frombuffer(chunk, np.uint8), unit)[lead:].sum())


def find_unit(chunk: bytes, lead: int, unit: str, rank: int) -> int:
    """Byte of a chunk, its lead not counted, at which its unit of the rank (from 0) begins."""
    import numpy as np

    return int(np.flatnonzero(begins(np.frombuffer(chunk, np.uint8), unit)[lead:])[rank])


def arrange(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = (x.encode() for x in MARKS)
    if form == "psm":
        return p + prefix + s + suffix + m + middle
    if form == "spm":
        return s + suffix + p + prefix + m + middle
    return prefix + middle + suffix


def _form(plain: Column, plain_from: int, spm_below: int) -> Column:
    return F.when(plain | (F.col("h3") % 100 >= plain_from), "plain").when(F.col("h4") % 100 < spm_below, "spm").otherwise("psm")


def _short(unit, plain_from, spm_below):
    """Texts of one chunk: it owns both cuts."""

    def run(batches):
        import pyarrow as pa

        marks = [m.encode() for m in MARKS]
        for batch in slices(batches, "bytes"):
            rows = []
            for raw, *h in zip(*(batch.column(c).to_pylist() for c in ("bytes", "h1", "h2", "h3", "h4"))):
                text = raw or b""
                n = count_units(text, 0, unit)
                low, high = sorted(x % (n + 1) for x in h[:2])
                if not text or h[2] % 100 >= plain_from or any(m in text for m in marks):
                    rows.append((n, "plain", None, None, text))
                    continue
                a, b = (len(text) if r == n else find_unit(text, 0, unit, r) for r in (low, high))
                form = "spm" if h[3] % 100 < spm_below else "psm"
                rows.append((n, form, low, high - low, arrange(form, text[:a], text[a:b], text[b:])))
            columns = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())))], names=["id", "n", "form", "n_prefix", "n_middle", "output"])
        give_back()

    return run


def _counted(unit):
    def run(batches):
        import pyarrow as pa

        marks = [m.encode() for m in MARKS]
        for batch in slices(batches, "bytes"):
            rows = [(count_units(raw, lead, unit), any(m in raw for m in marks)) for raw, lead in zip(batch.column("bytes").to_pylist(), batch.column("lead").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("no"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], names=["key", "no", "units", "marked"])

    return run


def _places(unit):
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "bytes"):
            found = [find_unit(raw, lead, unit, rank) for raw, lead, rank in zip(*(batch.column(c).to_pylist() for c in ("bytes", "lead", "rank")))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("no"), batch.column("cut"), pa.array(found, pa.int64())], names=["key", "no", "cut", "place"])

    return run


def _joined(batches):
    """One row for each key from its pieces, which come in the order of the output."""
    import pyarrow as pa

    def made():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["key", "output"])

    key, held = None, []
    for batch in slices(batches, "piece"):
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist()):
            if k != key and held:
                yield made()
                held = []
            key = k
            held.append(piece)
    if held:
        yield made()
    give_back()


def _long(rows: DataFrame, unit: str, size: int, plain_from: int, spm_below: int) -> DataFrame:
    """Texts of several chunks, all staged once as chunks."""
    n = partitions(rows.sparkSession)
    texts = rows.select(F.monotonically_increasing_id().alias("key"), "*")
    lead = F.least(F.col("no") * size, F.lit(OVERLAP)).cast("int")
    chunked = texts.select("key", "id", "h1", "h2", "h3", "h4", "bytes", F.explode(F.sequence(F.lit(0), F.expr(f"cast((octet_length(bytes) - 1) div {size} as int)"))).alias("no"))
    chunks = stage(chunked.select("key", "no", F.when(F.col("no") == 0, F.struct("id", "h1", "h2", "h3", "h4")).alias("head"), lead.alias("lead"), F.substring("bytes", F.col("no") * size + 1 - lead, size + lead).alias("bytes")).repartition(n, "key", "no"), "fim-chunks")
    counted = stage(chunks.select("key", "no", "lead", "bytes").mapInArrow(_counted(unit), "key bigint, no int, units bigint, marked boolean"), "fim-counts")
    before = Window.partitionBy("key").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.withColumn("before", F.coalesce(F.sum("units").over(before), F.lit(0)))
    total = counted.groupBy("key").agg(F.sum("units").alias("n"), F.max("marked").alias("marked"))
    heads = chunks.where("no = 0").select("key", "head.*").join(total, "key")
    ranks = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    plans = stage(heads.select("key", "id", "n", _form(F.col("marked"), plain_from, spm_below).alias("form"), F.least(*ranks).alias("low"), F.greatest(*ranks).alias("high")), "fim-plans")
    wanted = plans.select("key", "n", F.explode(F.array(F.struct(F.lit(0).alias("cut"), F.col("low").alias("at")), F.struct(F.lit(1).alias("cut"), F.col("high").alias("at")))).alias("w")).select("key", "n", "w.*")
    owned = sums.join(wanted, "key").where("before <= at and at < before + units").select("key", "no", "cut", (F.col("at") - F.col("before")).alias("rank"))
    found = chunks.select("key", "no", "lead", "bytes").join(owned, ["key", "no"]).mapInArrow(_places(unit), "key bigint, no int, cut int, place bigint")
    place = F.col("no").cast("long") * size + F.col("place")
    cuts = found.groupBy("key").agg(*(F.max(F.when(F.col("cut") == i, place)).alias(name) for i, name in enumerate(("a", "b"))))
    end = F.lit(1 << 40)  # a rank of n lies after all bytes
    decided = stage(plans.join(cuts, "key", "left").withColumns({"a": F.coalesce("a", end), "b": F.coalesce("b", end)}), "fim-cuts")
    body = F.expr("substring(bytes, lead + 1)")
    first = F.col("no").cast("long") * size
    local = lambda c: F.least(F.greatest(F.col(c) - first, F.lit(0)), F.lit(size)).cast("int")
    parts = chunks.select("key", "no", body.alias("body")).join(decided, "key").withColumns({"x": local("a"), "y": local("b")})
    piece = lambda order, raw: F.struct(order.cast("int").alias("order"), raw.alias("piece"))
    of = lambda psm, spm, plain: F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(plain)
    mark = lambda i, m: piece(F.lit(i), F.when((F.col("no") == 0) & (F.col("form") != "plain"), F.lit(m.encode())))
    pieces = F.array(
        mark_at(of, mark, PREFIX), mark_at(of, mark, SUFFIX), mark(4, MIDDLE),
        piece(of(F.lit(1), F.lit(3), F.lit(1)), F.when(F.col("x") > 0, F.expr("substring(body, 1, x)"))),
        piece(of(F.lit(5), F.lit(5), F.lit(2)), F.when(F.col("y") > F.col("x"), F.expr("substring(body, x + 1, y - x)"))),
        piece(of(F.lit(3), F.lit(1), F.lit(3)), F.when(F.col("y") < F.octet_length("body"), F.expr("substring(body, y + 1)"))),
    )
    laid = parts.select("key", "no", F.explode(pieces).alias("p")).where("p.piece is not null").select("key", "p.order", "no", "p.piece")
    texts = laid.repartition(n, "key").sortWithinPartitions("key", "order", "no").select("key", "piece").mapInArrow(_joined, "key bigint, output binary")
    cut = F.col("form") != "plain"
    unstage(counted, plans)
    hold(chunks, decided)
    return decided.join(texts, "key").select("id", "n", "form", F.when(cut, F.col("low")).alias("n_prefix"), F.when(cut, F.col("high") - F.col("low")).alias("n_middle"), "output")


def mark_at(of, mark, m: str) -> Column:
    """The mark before the prefix or the suffix, by form: the part that comes first has its mark at 0, the other at 2."""
    first, second = mark(0, m), mark(2, m)
    return of(first, second, first) if m == PREFIX else of(second, first, second)


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: str = "1", plain_from: int = 90, spm_below: int = 20, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id_col, n, form, n_prefix, n_middle, output) of each row; n counts units ("char": code points, "word", "line"), output is a text.

    Two cuts and the form follow from seed and id alone. Form plain (null numbers of units) leaves a text as it is: empty texts, those that hold a mark, and
    those whose number is plain_from or more. Null texts count as empty; a null id as an empty string; equal ids are cut alike. The first unit begins with the
    text; an empty table gives an empty table; other columns are dropped.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"), *h)
    fits = F.octet_length("bytes") <= chunk_bytes
    kind = rows.schema["id"].dataType.simpleString()
    short = rows.where(fits).mapInArrow(_short(unit, plain_from, spm_below), f"id {kind}, n bigint, form string, n_prefix bigint, n_middle bigint, output binary")
    both = short.unionByName(_long(rows.where(~fits), unit, chunk_bytes, plain_from, spm_below))
    return both.select(F.col("id").alias(id_col), "n", "form", "n_prefix", "n_middle", F.col("output").cast("string").alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text from which an output of the form was made."""
    cut_at = lambda mark, side: F.substring_index(output, mark, side)
    middle = cut_at(MIDDLE, -1)
    between = lambda first, last: F.substring_index(F.substring_index(output, last, 1), first, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest_forms(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns for units of code points: lengths of prefix and middle, hashes of the output and of the text restored from it."""
    text = restore(F.col("output"), F.col("form"))
    return made.select(id_col, "n", "form", F.col("n_prefix").alias("prefix_chars"), F.col("n_middle").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))
