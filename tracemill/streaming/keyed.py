"""A keyed table of hash buckets: a batch rewrites the buckets of its keys and no other, once, however often it is run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import jobs
from tracemill.sources.versions import Store

BUCKETS = 64


class KeyedTable:
    """Latest values by key, with attempts summed up. A manifest names the folder of each bucket and the last batch.

    The number of buckets is fixed when the first batch comes. Rows need a column seq that orders the versions of a key; equal ones go by their values.
    """

    def __init__(self, store: Store, name: str, keys: list[str], buckets: int = BUCKETS):
        self.store, self.name, self.keys, self.buckets = store, name, keys, buckets

    def _entry(self, head) -> dict:
        return head.tables.get(self.name) or {"paths": [], "format": "parquet", "schema": None, "buckets": {}, "count": self.buckets, "batch": -1}

    def apply(self, batch: DataFrame, batch_id: int) -> list[int]:
        """Upsert a batch and return the buckets written. A batch not above the last one changes no file. Batches are numbered upwards."""
        head = self.store.head()
        entry = self._entry(head)
        if batch_id <= entry["batch"]:
            return []
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(entry["count"])).cast("int")
        new = batch.withColumn("_bucket", bucket)
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # a row for each bucket at most
        paths = {b: entry["buckets"][str(b)] for b in touched if str(b) in entry["buckets"]}
        old = self.store.read(self.name, head).limit(0) if entry["schema"] else batch.limit(0)
        if paths:
            old = self.store.spark.read.schema(old.schema).parquet(*paths.values())
        merged = jobs.upsert(old, batch, self.keys)
        out = self.store.write(merged.withColumn("_bucket", bucket).repartition("_bucket"), self.name, by="_bucket")
        folder = out["paths"][0]
        there = {int(n[8:]) for n in self.store.files.names(folder) if n.startswith("_bucket=")}
        held = {**entry["buckets"], **{str(b): f"{folder}/_bucket={b}" for b in sorted(there)}}
        fields = [f for f in out["schema"]["fields"] if f["name"] != "_bucket"]
        self.store.publish({self.name: {**entry, "buckets": held, "paths": list(held.values()), "schema": {**out["schema"], "fields": fields}, "batch": batch_id}}, expect=head.version)
        return touched

    def read(self) -> DataFrame:
        return self.store.read(self.name)

    def batch(self) -> int:
        return self._entry(self.store.head())["batch"]

    def snapshot(self, order: str, *, final: bool = False, require_eos: bool = True) -> dict[str, int]:
        """Show the rows so far as tables detail and training: while batches come success and skipped rows alone, final all of them; both in input order."""
        return jobs.write_exports(self.read(), self.store, order=order, require_eos=require_eos, ready_only=not final)
