"""Keyed, resumable jobs: identities, fan-out, pending work, upsert, export and splits."""

from __future__ import annotations

import json
import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.sources import jsonl
from tracemill.sources.versions import Conflict, Store, workspace


def sample_id(*parts: Column) -> Column:
    """sha256 of a JSON object of the parts, in the order given."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def seed_of(digest: Column, seed: int = 0) -> Column:
    """(seed + first 64 bits of a hex digest) modulo 2**63 - 1."""
    head = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return ((head + F.lit(seed)) % F.lit(2**63 - 1).cast("decimal(20,0)")).cast("long")


def seed_of_index(index: Column, seed: int = 0) -> Column:
    """(seed + index) modulo 2**63."""
    return F.pmod(F.lit(seed).cast("decimal(20,0)") + index, F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")


def fan_out(df: DataFrame, traces: int, index: str = "source_index") -> DataFrame:
    """Each row once for each trace, with trace_index and position."""
    out = df.withColumn("trace_index", F.explode(F.sequence(F.lit(0), F.lit(traces - 1))))
    return out.withColumn("position", F.col(index) * traces + F.col("trace_index"))


def with_results(inputs: DataFrame, results: DataFrame, run_id: str) -> DataFrame:
    """Inputs with the results of one run; inputs without one stay."""
    return inputs.join(results.where(F.col("run_id") == run_id).drop("run_id"), "sample_id", "left")


def pending(inputs: DataFrame, results: DataFrame, run_id: str) -> DataFrame:
    """One job for each valid sample_id without a success, at its first position."""
    rows = with_results(inputs, results, run_id).where("validation_error is null and (status is null or status <> 'success')")
    return rows.groupBy("sample_id").agg(F.min("position").alias("position"))


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in done; null keys match null keys, repeated rows stay."""
    d = done.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    return rows.join(d, reduce(lambda a, b: a & b, (rows[k].eqNullSafe(d[f"_{k}"]) for k in keys)), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Latest values by order for each key, of equal ones the greatest as JSON text; attempts add up. Null keys equal each other."""
    both = old.unionByName(new, allowMissingColumns=True)
    values = [c for c in both.columns if c not in (*keys, "attempts")]
    v = F.struct(*values)
    out = both.groupBy(*keys).agg(F.max_by(v, F.struct(order, F.to_json(v))).alias("v"), F.sum("attempts").alias("attempts"))
    return out.select(*keys, "v.*", "attempts")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(not_done(new.dropDuplicates(keys), old, keys))


def eligible(df: DataFrame, require_eos: bool = True) -> DataFrame:
    ok = F.col("status") == "success"
    return df.where(ok & (F.col("finish_reason") == "eos") if require_eos else ok)


def seeded_order(key: Column, seed: int = 42) -> Column:
    """Deterministic shuffle key; promises repeatability, not another library's permutation."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def split(df: DataFrame, key: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """test, val and train by a seeded order of all rows; sizes round half to even."""
    ranked = with_rank(df.withColumn("_o", seeded_order(F.col(key), seed)), ["_o", key])
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    part = F.bround(F.lit(share) * F.col("_n"))
    return ranked.join(F.broadcast(n)).withColumn("split", F.when(F.col("rn") <= part, "test").when(F.col("rn") <= 2 * part, "val").otherwise("train")).drop("_o", "_n", "rn")


def with_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """Global 1-based rank `rn` without one task for all rows: range partitions, counts, then ranks within each.

    The sorted ranges are checkpointed, so that counts and rows come from the same ones. Rows that order leaves equal get ranks in any order.
    """
    spark = df.sparkSession
    workspace(spark, "rank")  # sets a checkpoint folder where there is none
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint()
    place = F.monotonically_increasing_id()
    numbered = dealt.withColumns({"_part": F.shiftright(place, 33).cast("int"), "rn": place.bitwiseAND(F.lit((1 << 33) - 1)) + 1})
    starts, total = [], 0
    for part, count in sorted(numbered.groupBy("_part").count().collect()):  # a row for each partition
        starts.append((part, total))
        total += count
    starts = F.broadcast(spark.createDataFrame(starts, "_part int, _start long"))
    return numbered.join(starts, "_part").withColumn("rn", F.col("rn") + F.col("_start")).drop("_part", "_start")


def shard(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Contiguous shards of equal size, the last one shorter."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    return with_rank(df, order).join(F.broadcast(n)).withColumn("shard", F.floor((F.col("rn") - 1) / F.ceil(F.col("_n") / shards))).drop("_n", "rn")


# Fixed value: what a prompt asks for.
INSTRUCTION = "Explain your solution step by step."


def _fields(question: str, answer: str):
    def no_constant(name):
        raise ValueError(name)

    def read(line):
        try:
            row = json.loads(line, parse_constant=no_constant)
        except (ValueError, RecursionError):
            return "malformed", None, None
        if not isinstance(row, dict):
            return "no object", None, None
        q, a = row.get(question), row.get(answer)
        if not isinstance(q, str) or not q.strip():
            return "question", None, None
        if a is None or isinstance(a, (dict, list, bool)):
            return "answer kind", None, None
        if isinstance(a, float) and not math.isfinite(a):
            return "answer not finite", None, None
        return (None, q, str(a)) if str(a).strip() else ("answer empty", None, None)

    @F.pandas_udf("struct<reason:string,question:string,answer:string>")
    def fields(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(x) for x in lines], columns=["reason", "question", "answer"])

    return fields


def prepare(lines: DataFrame, *, line: str = "line", question: str = "question", answer: str = "ground_truth", limit: int | None = None, order: str = "idx", instruction: str = INSTRUCTION, malformed: str = "skip") -> DataFrame:
    """lines (order, JSON text) with status, reason and the prepared columns; invalid rows stay, as skipped with a reason.

    A question is a string with a character that is not white space, an answer a string or a finite number, 0 included, written as Python writes it. null,
    booleans, arrays, objects and blank strings are refused, as are rows that are no JSON object; of a repeated key the last value counts. Blank and null lines are no rows.
    A line that is no JSON at all (text after the value, NaN and Infinity included) is skipped too, or with malformed="raise" the first one raises. limit counts invalid rows too.
    """
    rows = lines.where(F.rlike(line, F.lit(r"(?U)\S")))
    rows = rows.orderBy(order).limit(limit) if limit is not None else rows
    rows = rows.withColumn("_f", _fields(question, answer)(line))
    if malformed == "raise":
        rows = jsonl.raise_first(rows, F.col("_f.reason") == "malformed", order, F.concat(F.lit("Invalid JSON on line "), F.col(order).cast("string")), "_f")
    ok, q, a = F.col("_f.reason").isNull(), F.col("_f.question"), F.col("_f.answer")
    clean, context = F.concat(q, F.lit("\n\n" + instruction)), F.concat(F.lit("Given the ground truth answer is "), a)
    made = {"question": q, "ground_truth": a, "prompt_wo_answer": clean, "prompt_w_answer": F.concat(clean, F.lit(" "), context), "privileged_context": context}
    return rows.select(*lines.columns, F.when(ok, "ready").otherwise("skipped").alias("status"), F.col("_f.reason").alias("reason"), *(F.when(ok, c).alias(n) for n, c in made.items()))


def strict(prepared: DataFrame, order: str = "idx") -> DataFrame:
    """Prepared rows; the first skipped one raises when it is read."""
    message = F.concat(F.lit("sample "), F.col(order).cast("string"), F.lit(": "), F.col("reason"))
    return jsonl.raise_first(prepared, F.col("status") == "skipped", order, message, "status").select(*prepared.columns)


def ready(df: DataFrame) -> DataFrame:
    """Rows that a live snapshot shows: success and skipped ones."""
    return df.where(F.col("status").isin("success", "skipped"))


def exports(records: DataFrame, require_eos: bool = True, ready_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(detail rows, training rows): all records, or those of a live snapshot, and the eligible ones among them."""
    shown = ready(records) if ready_only else records
    return shown, eligible(shown, require_eos)


def write_exports(records: DataFrame, store: Store, *, order: str = "position", **options) -> dict[str, int]:
    """Commit tables detail and training, JSON lines in input order, as one version of a store; returns rows of each status and `sft`.

    The records are computed once, into a table that both files and the counts are read from. A failed export leaves readers both old tables.
    """
    expect = store.head().version
    shown, _ = exports(records, **options)
    held = store.write(shown, "records")
    try:
        rows = store.spark.read.schema(shown.schema).parquet(*held["paths"])
        good = eligible(rows, options.get("require_eos", True))
        store.commit({"detail": rows, "training": good}, expect=expect, format="json", order_by=order)
        counts = {r.status: r.n for r in rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {**{s: 0 for s in ("success", "error", "pending", "skipped")}, **counts, "sft": good.count()}
    finally:
        store.files.delete(held["paths"][0])


def fingerprint(config: dict, ignored: tuple = ("devices", "batch_size", "limit", "max_retries")) -> str:
    """sha256 of the settings that change results, as canonical JSON."""
    import hashlib

    kept = {k: v for k, v in config.items() if k not in ignored}
    return hashlib.sha256(json.dumps(kept, ensure_ascii=False, sort_keys=True, allow_nan=False).encode()).hexdigest()


def table_digest(rows: DataFrame) -> str:
    """A digest of the rows of a table as a multiset, whatever their order and partitioning."""
    line = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns))), {"ignoreNullFields": "false"})
    n, *sums = rows.select(line.alias("x")).agg(F.count(F.lit(1)), *(F.sum(F.xxhash64("x", F.lit(i)).cast("decimal(38,0)")) for i in (0, 1))).first()
    return f"{n}:{sums[0] or 0}:{sums[1] or 0}"


def open_run(store: Store, config: dict, inputs: DataFrame, resume: bool = False) -> str:
    """Bind a store to the settings and inputs of a run, and return their fingerprint.

    A store that is bound already raises FileExistsError, unless it is resumed; resuming one that is bound to other settings or inputs, or to none, raises ValueError. Of two that open a new store
    at once one gets it, the other FileExistsError.
    """
    mark, path = fingerprint({"settings": fingerprint(config), "inputs": table_digest(inputs)}, ()), f"{store.root}/_run.json"
    if resume:
        if not store.files.exists(path) or json.loads(store.files.read(path))["fingerprint"] != mark:
            raise ValueError("settings or inputs differ from those of the run, or there is none: use a new store")
        return mark
    try:
        store.files.put(path, json.dumps({"fingerprint": mark, "config": config}, ensure_ascii=False, sort_keys=True))
    except Conflict:
        raise FileExistsError("the store holds a run: resume it or use a new store") from None
    return mark


def shared_jobs(inputs: DataFrame, key: str = "sample_id", order: str = "position") -> DataFrame:
    """One row, the first by order, for each key among inputs: rows of equal keys share a job."""
    columns = [c for c in inputs.columns if c != key]
    return inputs.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("v")).select(key, "v.*")


def fan_back(inputs: DataFrame, results: DataFrame, key: str = "sample_id") -> DataFrame:
    """Every input row with the result of its shared job; columns of the results are null where there is none."""
    return inputs.join(results.drop(*(c for c in results.columns if c != key and c in inputs.columns)), key, "left")


def with_detector(rows: DataFrame, detectors: DataFrame, key: str) -> DataFrame:
    """Rows with their detector; a key without one raises when it is read. Detectors are one row a model."""
    found = rows.join(detectors.withColumn("_known", F.lit(True)), key, "left")
    fault = F.raise_error(F.concat(F.lit("no detector for "), F.col(key).cast("string")))
    return found.withColumn(key, F.when(F.col("_known").isNull(), fault).otherwise(F.col(key))).drop("_known")


def map_layers(heads: DataFrame, blocks: DataFrame) -> DataFrame:
    """heads (layer: ordinal of an attention block) with the block's own index; a head of no block raises. blocks: one row for each layer of a model."""
    order = blocks.select(F.col("block"), (F.row_number().over(Window.orderBy("block")) - 1).alias("layer"))
    found = heads.join(order, "layer", "left")
    return found.withColumn("block", F.coalesce("block", F.raise_error(F.lit("no attention block")).cast("int")))


def agreement(one: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """(key, equal) of rows in both."""
    return one.join(other.select(key, F.col(value).alias("_other")), key).select(key, F.col(value).eqNullSafe(F.col("_other")).alias("equal"))


def best_batch(runs: DataFrame, repeats: int) -> DataFrame:
    """The batch size of the highest summed rate among those with all repeats; the smaller size of equals."""
    rates = runs.groupBy("batch_size").agg(F.count(F.lit(1)).alias("n"), (F.sum("tokens") / F.sum("seconds")).alias("rate")).where(F.col("n") == repeats)
    return rates.orderBy(F.desc("rate"), "batch_size").limit(1).select("batch_size", "rate")


def ordered_slice(df: DataFrame, order: list[str], start: int, end: int) -> DataFrame:
    """Rows start..end - 1 in an order that names each row; fewer where the table ends."""
    return df.orderBy(*order).offset(start).limit(max(end - start, 0))
