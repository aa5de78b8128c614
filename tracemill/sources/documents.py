"""Small JSON documents: whole files, documents merged by key under compare-and-swap, and score tables bound to what made them."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.sources.versions import Conflict, Files, Store


def read_json(spark: SparkSession, path: str) -> dict:
    """A document; {} where there is no file."""
    files = Files(spark)
    return json.loads(files.read(path)) if files.exists(path) else {}


def write_json(spark: SparkSession, path: str, value) -> None:
    """Write a document in readable form; the old one stays until the new one is whole."""
    Files(spark).put(path, json.dumps(value, ensure_ascii=False, indent=2) + "\n", replace=True)


def merge_documents(store: Store, name: str, changes: DataFrame, key: str = "key", attempts: int = 5) -> int:
    """Put the rows of changes (one a key) in place of those of a table with equal keys; the others stay. Returns the new version.

    The table is read, merged and written against one version; if another writer came first all of that is done again, so no change is lost.
    Null keys equal each other; a table that is not there yet starts empty; repeated keys in changes raise ValueError. After attempts Conflict is raised.
    """
    if changes.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("a key is changed twice")
    for left in range(attempts - 1, -1, -1):
        head = store.head()
        new = changes
        if name in head.tables:
            old, keys = store.read(name, head), changes.select(F.col(key).alias("_key"))
            new = old.join(keys, old[key].eqNullSafe(keys["_key"]), "left_anti").unionByName(changes, allowMissingColumns=True)
        try:
            return store.commit({name: new}, expect=head.version).version
        except Conflict:
            if not left:
                raise
    raise ValueError("no attempt was allowed")


def save_scores(store: Store, scores: DataFrame, *, model: str, method: str, used: int) -> None:
    """Keep a table of scores with the model and the method that made it."""
    store.commit({"scores": scores}, meta={"model": model, "score_method": method, "used": used})


def load_scores(store: Store, *, model: str, method: str) -> DataFrame:
    """The scores kept: another model is warned of, another method raises ValueError."""
    head = store.head()
    if head.meta.get("model") != model:
        warnings.warn(f"scores are of {head.meta.get('model')}, not of {model}", UserWarning, stacklevel=2)
    if head.meta.get("score_method") != method:
        raise ValueError(f"scores were made by {head.meta.get('score_method')!r}, not by {method!r}: make them again")
    return store.read("scores", head)
