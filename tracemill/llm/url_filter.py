"""URL filters as a sort-merge range join.

A rule is a (host, path) pair. Host labels are reversed (`www.example.com` becomes
`com.example.www.`), so "this host and all its subdomains" is a prefix, and a prefix is an
interval of the sorted keys. Urls and rules are dealt to buckets by key ranges, sorted, and swept
once: the sweep keeps the stack of the rule hosts whose interval is open, which are nested.
Only the sampled bucket bounds go through the driver (a fixed number a bucket). A rule goes to every
bucket its interval meets. Bounds include path and a hash of the row id, so one hot host, or even
one hot url, is spread over many buckets.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = "\U0010ffff"
BOUNDS_PER_BUCKET = 50


def host_path(url):
    """Columns (host, path) of a url column; both empty for null or where `://` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def reversed_host(host):
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit(".")))


def _sweep(default):
    def run(batches):
        import pyarrow as pa

        stack, bucket, key, opened = [], None, None, []
        for batch in batches:
            cols = batch.to_pydict()
            out = {"id": [], "host": [], "path": [], "rule": [], "verdict": []}
            for b, k, kind, path, host, verdict, row in zip(*(cols[c] for c in ("bucket", "rkey", "kind", "path", "host", "verdict", "id"))):
                if b != bucket:
                    stack, bucket, key = [], b, None
                if k != key:
                    while stack and not k.startswith(stack[-1][0]):
                        stack.pop()
                    key = k
                    opened = stack[::-1]
                if kind == 0:
                    if not stack or stack[-1][0] != k:
                        stack.append((k, host, {}, []))
                        opened = stack[::-1]
                    rules = stack[-1][2]
                    if rules.get(path) != "block":  # of two verdicts for one rule, block holds
                        rules[path] = verdict
                    if len(path) not in stack[-1][3]:
                        stack[-1][3].append(len(path))
                        stack[-1][3].sort(reverse=True)
                    continue
                best = None
                for _, rule_host, rules, sizes in opened:
                    for n in sizes:
                        if n <= len(path) and path[:n] in rules:
                            found = (len(rule_host) + n, len(rule_host), rule_host + path[:n], rules[path[:n]])
                            best = max(best, found) if best else found
                            break
                out["id"].append(row)
                out["host"].append(host)
                out["path"].append(path)
                out["rule"].append(best[2] if best else None)
                out["verdict"].append(best[3] if best else default)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("id", batch.schema.field("id").type), *((c, pa.string()) for c in ("host", "path", "rule", "verdict"))]))

    return run


def _bucket_urls(bounds):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys = zip(batch.column("rkey").to_pylist(), batch.column("path").to_pylist(), batch.column("salt").to_pylist())
            yield batch.append_column("bucket", pa.array([bisect_right(bounds, k) for k in keys], pa.int32()))

    return run


def _bucket_rules(bounds):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at, to = [], []
            for i, k in enumerate(batch.column("rkey").to_pylist()):
                for b in range(bisect_right(bounds, (k, "", -(2**63))), bisect_right(bounds, (k + LAST, "", 0)) + 1):
                    at.append(i)
                    to.append(b)
            yield batch.take(pa.array(at, pa.int32())).append_column("bucket", pa.array(to, pa.int32()))

    return run


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", buckets: int | None = None) -> DataFrame:
    """Judge each row's url by the longest fitting rule.

    rules has host, path, verdict. Returns id_col, host, path, rule (host + path of the rule, or
    null) and verdict (default where none fits), one row for each input row; other input columns are
    dropped, so clashing names do no harm. Null urls and urls without `://` have empty host and path
    and get the default. Rules with a null host or verdict are void, a null path is empty. The longest
    rule string wins, of equal ones the longer host; two verdicts for one rule: block. Host labels
    compare whole (`com` does not fit `telecom`). Empty tables give empty results.
    """
    spark: SparkSession = pages.sparkSession
    n = buckets or partitions(spark)
    host, path = host_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("rkey", reversed_host(F.col("host"))).withColumn("salt", F.xxhash64("id"))
    total = pages.select(url_col).count()
    share = min(1.0, 2.0 * n * BOUNDS_PER_BUCKET / max(total, 1))
    seen = sorted((r.rkey, r.path, r.salt) for r in urls.select("rkey", "path", "salt").sample(False, share, 7).collect())  # places bounds only
    bounds = sorted({seen[len(seen) * i // n] for i in range(1, n)}) if seen else []
    rule_host = F.translate("host", UPPER, LOWER)
    ruled = rules.where("host is not null and verdict is not null").select(rule_host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").withColumn("rkey", reversed_host(F.col("host"))).where("rkey <> ''").select("rkey", "path", "host", "verdict")
    ruled = ruled.mapInArrow(_bucket_rules(bounds), T.StructType([*ruled.schema, T.StructField("bucket", T.IntegerType())]))
    id_type = urls.schema["id"].dataType
    judged = urls.mapInArrow(_bucket_urls(bounds), T.StructType([*urls.schema, T.StructField("bucket", T.IntegerType())]))
    events = judged.select("bucket", "rkey", F.lit(1).alias("kind"), "path", "host", F.lit(None).cast("string").alias("verdict"), "id").unionByName(ruled.select("bucket", "rkey", F.lit(0).alias("kind"), "path", "host", "verdict", F.lit(None).cast(id_type).alias("id")))
    swept = events.repartition(n, "bucket").sortWithinPartitions("bucket", "rkey", "kind").mapInArrow(_sweep(default), f"id {id_type.simpleString()}, host string, path string, rule string, verdict string")
    return swept.withColumnRenamed("id", id_col)
