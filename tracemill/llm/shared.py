"""Helpers that every operator of this subpackage uses: shared tables and bounded Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Removes a query's shuffle files when it ends; a staged table needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Holds while a table is staged: rows of an Arrow batch, as a batch of 10,000 whole texts is held several times over.
STAGING = {CLEANUP: "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
#: Rows of a task go to one bucket: its writer takes them as they come, without a sort.
BUCKETED = {**STAGING, "spark.sql.maxConcurrentOutputFileWriters": "4"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's own.

    Where neither is set a temporary folder is made, in local mode only.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tracemill-"))
    return sc.getCheckpointDir()


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet (in folders by a column, if given) in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    held = {k: spark.conf.get(k, None) for k in STAGING}
    for k, v in STAGING.items():
        spark.conf.set(k, v)
    try:
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


#: A row's number is that of the task that read it, shifted by as many bits, and its place in that task.
PLACE_BITS = 33


def stage_by_task(df: DataFrame, name: str) -> DataFrame:
    """Stage df (rid: monotonically_increasing_id, and other columns) in buckets of p, the task that numbered a row.

    A task writes one file, so nothing is shuffled; what is joined by p afterwards finds these rows without moving them.
    """
    spark = df.sparkSession
    path, table = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", f"staged_{uuid.uuid4().hex}"
    held = {k: spark.conf.get(k, None) for k in BUCKETED}
    for k, v in BUCKETED.items():
        spark.conf.set(k, v)
    try:
        if "p" not in df.columns:
            df = df.withColumn("p", F.shiftright("rid", PLACE_BITS))
        df.write.option("compression", "zstd").option("path", path).bucketBy(partitions(spark), "p").saveAsTable(table)
        out = spark.table(table)
        spark.sql(f"DROP TABLE {table}")  # the files stay
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out._staged_path = path
    return out


def marked_rows(rows: DataFrame, every: DataFrame, marks: DataFrame, *columns: str) -> DataFrame:
    """Rows (rid, p) that have a mark (rid, columns), with its columns. Rows stay in their buckets: the marks of a task's rows come to them as one array by place.

    every: (rid) of all rows that were numbered, so that places have no gaps. An array is as long as its task had rows. Of a rid's marks one counts; they should be equal.
    """
    wide = marks.select("rid", F.struct(*columns, F.lit(True).alias("there")).alias("mark")).dropDuplicates(["rid"])
    place = F.col("rid").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    placed = every.select("rid").join(wide, "rid", "left").select(F.shiftright("rid", PLACE_BITS).alias("p"), F.struct(place.alias("place"), "mark").alias("m"))
    arrays = placed.groupBy("p").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["mark"]).alias("marks"))
    found = rows.join(arrays.hint("shuffle_hash"), "p").withColumn("mark", F.get("marks", place.cast("int"))).where("mark.there")
    return found.select(*rows.columns, *(f"mark.{c}" for c in columns))


#: Staged tables that a frame handed out still reads.
_HELD: list[DataFrame] = []


def hold(*frames: DataFrame) -> None:
    """Keep staged tables until release(), as a result that is not computed yet reads them."""
    _HELD.extend(frames)


def release() -> None:
    """Delete the tables held for results handed out so far, all of which must have been written by now."""
    unstage(*_HELD)
    _HELD.clear()


def unstage(*frames: DataFrame, part: str = "") -> None:
    """Delete staged tables, or one folder of them, that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches, column: str = "text", max_bytes: int = 8 << 20):
    """Split Arrow batches so that a slice's column holds about max_bytes at most (one row may exceed it)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


class Words:
    """64-bit hashes of the words of a column of texts, vectorised over all its bytes.

    Words are what lies between ASCII blanks, A-Z lower-cased. A word's hash is a polynomial over random values of its bytes, mixed
    with its length.
    """

    PIECE, BASE = 1 << 16, 0x9E3779B97F4A7C15

    def __init__(self):
        import numpy as np

        self.of = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.of[65:91] = self.of[97:123]
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.power = self.back = np.ones(1, np.uint64)

    def powers(self, n: int):
        import numpy as np

        if len(self.power) < n:
            for name, base in (("power", self.BASE), ("back", pow(self.BASE, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.power[:n], self.back

    def __call__(self, column):
        """(hashes of all words, index of each row's first word and, at the end, the number of words); null is empty."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pc.fill_null(column.cast(pa.large_string()), "")
        offset = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = (np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8))[offset[0] : offset[-1]]
        offset = offset - offset[0]
        edge = self.blank[data]
        begin = ~edge
        inner = offset[(offset > 0) & (offset < len(data))]
        split = np.zeros(len(data) + 1, bool)
        split[inner] = True
        begin[1:] &= edge[:-1] | split[1:-1]
        end = ~edge
        end[:-1] &= edge[1:] | split[1:-1]
        start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
        out = np.empty(len(start), np.uint64)
        a = 0
        while a < len(start):  # pieces of whole words bound the memory
            b = max(a + 1, int(np.searchsorted(stop, start[a] + self.PIECE, "right")))
            low, high = int(start[a]), int(stop[b - 1])
            power, back = self.powers(high - low)
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum(self.of[data[low:high]] * power, out=total[1:])
            i, j = start[a:b] - low, stop[a:b] - low
            out[a:b] = mix((total[j] - total[i]) * back[i] + (j - i).astype(np.uint64))
            a = b
        return out, np.searchsorted(start, offset)


def mix(x):
    """A bijection of 64-bit integers that spreads every bit."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Hand freed memory back to the system at a task's end, as an idle Python worker stays."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def held_out_py(doc_id) -> bool:
    """crc32 of the id as text, modulo 5, is 0; a null id is held out."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0
