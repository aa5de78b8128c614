"""JSON sources: each reader keeps the physical line number and the reason a line was refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT = ["file", "_start"]


def numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, idx, at, line, torn) of text files: idx counts the physical lines of all files in the order of their names, at those of a file.

    Every split of a file counts its own lines first; a line's number is the lines of the splits before its own and its place there, so
    numbers are the same for any size of splits. Lines end with a line feed, as do those before a carriage return, which goes. A last line without its
    end is torn, even if it can be parsed; blank lines count.
    """
    held = spark.read.option("lineSep", "\n").text(path)
    rows = held.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.col("_metadata.file_size").alias("_size"), F.monotonically_increasing_id().alias("_row"), "value")
    splits = rows.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"), F.sum(F.octet_length("value") + 1).alias("_bytes"), F.max("_size").alias("_size"))
    within = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    splits = splits.withColumns({"_before": F.coalesce(F.sum("_n").over(within), F.lit(0)), "_lines": F.sum("_n").over(whole), "_torn": F.sum("_bytes").over(whole) > F.col("_size")})
    files = splits.groupBy("file").agg(F.max("_lines").alias("_lines"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = files.select("file", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_base"))
    found = rows.drop("_size").join(splits.join(files, "file").drop("_n", "_bytes", "_size"), SPLIT)
    at = F.col("_before") + F.col("_row") - F.col("_first")
    return found.select("file", (F.col("_base") + at).alias("idx"), at.alias("at"), F.regexp_replace("value", r"\r$", "").alias("line"), (F.col("_torn") & (at == F.col("_lines") - 1)).alias("torn"))


def indexed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx, line) of text files; idx is the physical line number, blank lines included."""
    return numbered(spark, path).select("idx", "line")


#: Bytes of an array's text that a task holds beside one element.
CHUNK = 1 << 20


def _elements(chunks):
    """Texts of the elements of a JSON array that comes in pieces; only brackets, quotes and commas are looked at."""
    import re

    mark = re.compile(r'["\\[\]{},]|\S')
    inside = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
    held, at, start, depth, state = "", 0, 0, 0, "begin"  # begin, value (inside the array), end
    many = last = False
    for piece, final in chunks:
        held, at, start = held[start:] + piece, at - start, 0
        while True:
            m = mark.search(held, at)
            if not m:
                at = len(held)
                break
            c = m.group()
            if state == "end":
                raise ValueError("text after the array")
            if c == '"' and state == "value":
                close = inside.match(held, m.end())
                if not close and not final:
                    at = m.start()
                    break
                if not close:
                    raise ValueError("a string without an end")
                at = close.end()
                continue
            at = m.end()
            if state == "begin":
                if c != "[":
                    raise ValueError("the file must hold an array")
                state, start = "value", at
            elif c in "[{":
                depth += 1
            elif c in "]}" and depth:
                depth -= 1
            elif c in ",]" and not depth:
                own = held[start : m.start()].strip()
                if own or c == "," or many:
                    yield own
                many, start = True, at
                state = "end" if c == "]" else state
        if state != "value":
            start = at
    if state != "end":
        raise ValueError("an array without an end")


def _read_arrays(frames):
    import codecs
    import json

    import pandas as pd
    from pyarrow import fs

    def no_constant(name):
        raise ValueError(f"invalid constant {name}")

    def chunks(source):
        decode, piece = codecs.getincrementaldecoder("utf-8")().decode, source.read(CHUNK)
        while piece:
            after = source.read(CHUNK)
            yield decode(piece, not after), not after
            piece = after

    for frame in frames:
        for path in frame["path"]:
            system, place = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
            rows, idx = [], 0
            with system.open_input_stream(place) as source:
                try:
                    for text in _elements(chunks(source)):
                        json.loads(text, parse_constant=no_constant)
                        rows.append((path, idx, text))
                        idx += 1
                        if len(rows) >= 1000:
                            yield pd.DataFrame(rows, columns=["file", "idx", "value"])
                            rows = []
                except (ValueError, RecursionError) as e:
                    raise ValueError(f"Invalid JSON in element {idx} of {path}: {e}") from e
            if rows:
                yield pd.DataFrame(rows, columns=["file", "idx", "value"])


def array_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, idx, value: JSON text) of files that hold one JSON array each; idx is an element's place in its file's array.

    A task reads a file as a stream and holds one element at a time. Anything but one array raises, as does an element that is no JSON, NaN and Infinity included. Spark
    lists the files, tasks open them by their address.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    spread = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInPandas(_read_arrays, "file string, idx bigint, value string")


def samples(spark: SparkSession, path: str, limit: int | None = None, completed: DataFrame | None = None) -> DataFrame:
    """(idx, line) of a .json array, or else of JSON lines without the blank ones, which count; limit is one of numbers, completed (idx) leaves out."""
    if path.lower().endswith(".json"):
        rows = array_elements(spark, path).select("idx", F.col("value").alias("line"))
    else:
        rows = indexed_lines(spark, path).where(F.rlike("line", F.lit(r"(?U)\S")))
    rows = rows if limit is None else rows.where(F.col("idx") < limit)
    return rows if completed is None else rows.join(completed.select("idx"), "idx", "left_anti")


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """(idx, line, row, bad): row is null where a non-blank line isn't an object of the schema; NaN and Infinity are refused."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowNonNumericNumbers": "false"}
    full = T.StructType([*T.StructType.fromDDL(schema), T.StructField("_bad", T.StringType())])
    kept = lines.where(F.trim("line") != "")
    out = kept.withColumn("row", F.from_json("line", full, options))
    return out.withColumn("bad", F.col("row").isNull() | F.col("row._bad").isNotNull()).withColumn("row", F.when(~F.col("bad"), F.struct(*(f"row.{f.name}" for f in full.fields[:-1]))))


def raise_first(rows: DataFrame, bad: Column, order: str, message: Column, kept: str) -> DataFrame:
    """rows whose column kept raises on the first bad row by order, and on no other: which error is seen doesn't hang on the order of tasks.

    Bad rows are looked for in a pass of its own; their first number is the one row that the other rows meet.
    """
    first = rows.where(bad).agg(F.min(order).alias("_first"))
    fault = F.when(F.col(order) == F.col("_first"), F.raise_error(message)).otherwise(F.col(kept))
    return rows.join(F.broadcast(first)).withColumn(kept, fault).drop("_first")


def strict(lines: DataFrame, schema: str) -> DataFrame:
    """Rows in line order; the first bad line raises when it is read."""
    rows = raise_first(parsed(lines, schema), F.col("bad"), "idx", F.concat(F.lit("bad JSON on line "), F.col("idx").cast("string")), "row")
    return rows.select("idx", "row").select("idx", "row.*")


def loose(lines: DataFrame, schema: str) -> DataFrame:
    """Rows without any bad line."""
    return parsed(lines, schema).where(~F.col("bad")).select("idx", "row.*")


def prefix(lines: DataFrame, schema: str) -> DataFrame:
    """Rows before the first bad line."""
    rows = parsed(lines, schema)
    first = rows.where("bad").agg(F.min("idx").alias("first_bad"))
    return rows.join(F.broadcast(first)).where("first_bad is null or idx < first_bad").select("idx", "row.*")


def torn_tail(lines: DataFrame, schema: str) -> DataFrame:
    """Rows without a bad last line; another bad line raises, the first of them."""
    rows = parsed(lines, schema)
    last = rows.agg(F.max("idx").alias("_last"))
    rows = rows.join(F.broadcast(last)).where("not bad or idx < _last").drop("_last")
    return raise_first(rows, F.col("bad"), "idx", F.concat(F.lit("bad JSON before the last line, on line "), F.col("idx").cast("string")), "row").select("idx", "row").select("idx", "row.*")


def resumed(spark: SparkSession, path: str | list[str], schema: str, index: str = "sample_index") -> DataFrame:
    """Rows of an output that a writer may have left in the middle of a line: (idx, columns of schema), torn last lines left out.

    The first other line that is no JSON raises, as does the first whose index is negative, no whole number (null), or on an earlier line too.
    """
    rows = parsed(numbered(spark, path).where(~F.col("torn")).select("idx", "line"), schema)
    key = F.col(f"row.{index}")
    again = F.row_number().over(Window.partitionBy(key).orderBy("idx")) > 1
    rows = rows.withColumn("_wrong", ~F.col("bad") & (key.isNull() | (key < 0) | again))
    said = F.concat(F.when(F.col("bad"), "bad JSON").otherwise("invalid or repeated index"), F.lit(" on line "), F.col("idx").cast("string"))
    return raise_first(rows, F.col("bad") | F.col("_wrong"), "idx", said, "row").select("idx", "row").select("idx", "row.*")


def write(df: DataFrame, path: str, overwrite: bool = False, order_by: str | None = None) -> None:
    """JSON lines in part files; order_by sorts them, so part order is row order."""
    out = df.orderBy(order_by) if order_by else df
    out.write.mode("overwrite" if overwrite else "append").json(path)
