"""MinHash near-deduplication with exact confirmation.

Documents with equal shingle sets form a class, found by a digest of the set; one document stands for its
class. Universal hash minima are banded; in each bucket every class is paired with the smallest one (a star, never all
pairs), signatures rule out most pairs, and full sets confirm the rest. Connected components come from
alternating large-star and small-star. Only buckets whose members still lie in
several components can hide a link that no star showed: these are compared in blocks of bounded
size between components alone, by signature and then on full sets, and only true links leave a block.
Each step ends in a table in the shared folder, so a lost executor repeats one step at most. Rows are found again by the task
that numbered them, so that only texts in a pair are ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hold, marked_rows, mix, slices, stage, stage_by_task, unstage

BANDS, ROWS = 40, 6
SIMILARITY = 80
#: Estimates this far below the threshold are ruled out: over five standard errors at 240 minima.
SLACK = 14
#: Members of a block of texts that ask, and those of the largest component; blocks of signatures (480 bytes each) hold SIGNATURES times as many.
MINOR_BLOCK, MAJOR_BLOCK = 256, 512
SIGNATURES = 8
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def coefficients(n: int = BANDS * ROWS, seed: int = 20_240_501):
    """(a, b) of n multiply-add-shift hashes; a is odd."""
    import numpy as np

    r = np.random.default_rng(seed)
    return r.integers(0, 2**63, n, dtype=np.uint64) * 2 + 1, r.integers(0, 2**63, n, dtype=np.uint64)


class Shingler:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text; word hashes are remembered, boundedly."""

    def __init__(self, k: int, limit: int = 300_000):
        self.k, self.limit, self.known = k, limit, {}

    def words(self, text):
        import numpy as np
        import xxhash

        if len(self.known) > self.limit:
            self.known.clear()
        known, ws = self.known, (text or "").encode().translate(LOWER).split()
        for w in set(ws):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))

    def __call__(self, text):
        import numpy as np

        h = self.words(text)
        if not len(h):
            return h
        k = min(self.k, len(h))  # a text of fewer words is one shingle; its length is part of the hash
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
        return np.unique(out)


def signature(shingles, a, b):
    """Minima of all hashes over a non-empty set, as uint32."""
    import numpy as np

    x = shingles >> np.uint64(32)
    out = None
    for i in range(0, len(x), 2048):
        low = ((x[i : i + 2048, None] * a + b) >> np.uint64(32)).min(0)
        out = low if out is None else np.minimum(out, low)
    return out.astype(np.uint32)


def bands(sig):
    """Band keys; the band's number is part of the key."""
    import numpy as np

    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def _sketch(k, text_at):
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        shingle, (a, b) = Shingler(k), coefficients()
        for whole in batches:
            for batch in slices([whole.append_column("text", pc.struct_field(whole.column("row"), text_at))]):
                n, digest, sig, keys = [], [], [], []
                for text in batch.column("text").to_pylist():
                    s = shingle(text)
                    m = signature(s, a, b) if len(s) else None
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sig.append(m.astype(np.uint16).tobytes() if len(s) else None)
                    keys.append(bands(m) if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("row"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["rid", "row", "n_shingles", "digest", "sig", "bands"])

    return run


def _alike(batches):
    """Keep pairs whose signatures don't rule out the threshold."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows == 0:
            continue
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("lsig", "rsig"))
        keep = 100 * (left == right).sum(1) >= (SIMILARITY - SLACK) * left.shape[1]
        yield batch.select(["l", "r"]).filter(pa.array(keep))


def _confirm(k):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        shingle = Shingler(k)
        for batch in slices(slices(batches, "ltext"), "rtext"):
            keep, before, left = [], None, None
            for a, b in zip(batch.column("ltext").to_pylist(), batch.column("rtext").to_pylist()):
                if a != before:
                    before, left = a, shingle(a)
                right = shingle(b)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= SIMILARITY * (len(left) + len(right) - both))
            yield batch.select(["l", "r"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block_hopes(table):
    """The members of a block whose signature does not rule out one that they would be compared with, in another component."""
    import numpy as np
    import pyarrow as pa

    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(table.num_rows, -1)
    comp, role = (table.column(c).to_numpy() for c in ("comp", "role"))
    hope, others = np.zeros(len(role), bool), np.flatnonzero(role != 0)
    theirs = sig[others]
    for x in np.flatnonzero(role != 1).tolist():
        met = others[(100 * (theirs == sig[x]).sum(1) >= (SIMILARITY - SLACK) * sig.shape[1]) & (comp[others] != comp[x])]
        if len(met):
            hope[x] = hope[met] = True
    return table.select(["key", "rep", "comp"]).filter(pa.array(hope))


def _block_links(k):
    """Links of members with role 0 or 2 to members with role 1 or 2 of another component, none twice between two components."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        shingle, sets = Shingler(k), {}
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(table.num_rows, -1)
        ids, comp, role = (table.column(c).to_numpy() for c in ("rep", "comp", "role"))
        texts = table.column("text")
        root: dict = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        def full(i):
            if ids[i] not in sets:
                sets[ids[i]] = shingle(texts[i].as_py())
            return sets[ids[i]]

        l, r = [], []
        others = np.flatnonzero(role != 0)
        theirs = sig[others]
        for x in np.flatnonzero(role != 1).tolist():
            for y in others[100 * (theirs == sig[x]).sum(1) >= (SIMILARITY - SLACK) * sig.shape[1]].tolist():
                if role[y] == 2 and y <= x:  # met from the other side
                    continue
                p, q = find(int(comp[x])), find(int(comp[y]))
                if p == q:
                    continue
                one, two = full(x), full(y)
                both = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * both >= SIMILARITY * (len(one) + len(two) - both):
                    root[p] = q
                    l.append(int(min(ids[x], ids[y])))
                    r.append(int(max(ids[x], ids[y])))
        return pa.table({"l": pa.array(l, pa.int64()), "r": pa.array(r, pa.int64())})

    return run


def needed_rows(rows: DataFrame, every: DataFrame, rids: DataFrame, columns: tuple = ()) -> DataFrame:
    """The rows (or some columns) of a set of rids out of a table staged by task, staged; no other row moves. every: as in marked_rows()."""
    out = marked_rows(rows, every, rids)
    return stage(out.selectExpr(*columns) if columns else out.drop("p"), "needed")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs (l, r) whose full sets pass; only texts in a pair are moved."""
    pairs = stage(pairs, "pairs")
    texts = needed_rows(texts, texts, pairs.select(F.explode(F.array("l", "r")).alias("rid")))
    left, right = texts.select(F.col("rid").alias("l"), F.col("text").alias("ltext")), texts.select(F.col("rid").alias("r"), F.col("text").alias("rtext"))
    links = stage(pairs.join(left, "l").join(right, "r").select("l", "r", "ltext", "rtext").mapInArrow(_confirm(k), "l bigint, r bigint"), "links")
    unstage(pairs, texts)
    return links


def connected_components(edges: DataFrame, l: str = "l", r: str = "r") -> DataFrame:
    """(node, component): the smallest node reachable from each node of an edge list of integers.

    Alternates large-star and small-star until the edges no longer change; each round is written
    to the shared folder. Loops and repeated edges are harmless; nodes without an edge to another are absent.
    """
    now = stage(edges.select(F.greatest(l, r).alias("u"), F.least(l, r).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stage(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct("u", "v"))).otherwise(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small = stage(small, "small")
        unstage(now, large)
        now = small
        was, mark = mark, now.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def deal(dealt: DataFrame, by, minor) -> DataFrame:
    """dealt (key, majors, minors: numbers of blocks, and other columns) with (i, j, role) of each place in a block.

    Each minor row meets each other row of its key in a block (i, j): as one that asks (role 0) or is told (1), both (2) where one
    block holds the key. Major rows do not meet each other.
    """
    block = F.pmod(by, F.when(minor, F.col("minors")).otherwise(F.col("majors"))).cast("int")
    place = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(role).alias("role"))
    last = F.col("minors") - 1
    asks = F.transform(F.sequence(F.lit(0), F.col("majors") + last), lambda j: place(F.col("block"), j, 0))
    told = F.transform(F.sequence(F.lit(0), last), lambda i: place(i, F.when(minor, F.col("majors") + F.col("block")).otherwise(F.col("block")), 1))
    single = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(minor, 2).otherwise(1).alias("role")))
    places = F.when((F.col("majors") <= 1) & (F.col("minors") == 1), single).when(minor, F.concat(asks, told)).otherwise(told)
    return dealt.withColumn("block", block).select("*", F.explode(places).alias("at")).select("*", "at.*").drop("at", "block", "majors", "minors")


def _blocks(placed: DataFrame, times: int = 1) -> DataFrame:
    """(key, i, j, role, rep, comp): members (key, rep, comp) of buckets of several components, in blocks.

    The largest component of a bucket is not compared with itself: blocks of the others meet its blocks and each other. Bands often
    gather the same members again: of buckets with equal sums of two hashes of their members one is compared.
    """
    prints = [F.sum(F.xxhash64("rep", F.lit(i)).cast("decimal(20,0)")).alias(f"print{i}") for i in (0, 1)]
    sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), *prints)
    sizes = sizes.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.max("c").alias("most"), F.sum("c").alias("m"), *(F.sum(f"print{i}").alias(f"print{i}") for i in (0, 1))).where("most < m")
    sizes = sizes.groupBy("m", "print0", "print1").agg(F.min_by(F.struct("key", "major", "most"), "key").alias("one")).select("one.*", "m")
    counts = sizes.select("key", "major", F.ceil(F.col("most") / (times * MAJOR_BLOCK)).cast("int").alias("majors"), F.ceil((F.col("m") - F.col("most")) / (times * MINOR_BLOCK)).cast("int").alias("minors"))
    return deal(placed.join(counts, "key"), F.xxhash64("rep"), F.col("comp") != F.col("major")).select("key", "i", "j", "role", "rep", "comp")


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(sketches, told), both staged: told has rid, id, n_shingles, class_id, component_id, kept and first of each row of sketches."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row"))
    made = f"rid bigint, row {rows.schema['row'].dataType.simpleString()}, n_shingles bigint, digest binary, sig binary, bands array<bigint>"
    sketches = stage_by_task(rows.mapInArrow(_sketch(shingle, docs.columns.index(text_col)), made), "sketches")
    named = sketches.select("rid", F.col("row")[id_col].cast("long").alias("id"), "n_shingles", "digest")
    texts = sketches.select("rid", "p", F.col("row")[text_col].alias("text"))
    signed_texts = sketches.select("rid", "p", "sig", F.col("row")[text_col].alias("text"))
    classes = stage(named.where("digest is not null").groupBy("digest").agg(F.min("rid").alias("rep"), F.min("id").alias("class_id")), "classes")
    reps = stage_by_task(marked_rows(sketches.select("rid", "p", "sig", "bands"), sketches, classes.select(F.col("rep").alias("rid"))), "reps")
    signatures = lambda rids: needed_rows(reps.select("rid", "p", "sig"), sketches, rids)
    keyed = reps.select(F.explode("bands").alias("key"), F.col("rid").alias("rep"))
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    member = stage(keyed.join(buckets.hint("shuffle_hash"), "key"), "members")

    star = stage(member.where("rep <> hub").select(F.col("hub").alias("l"), F.col("rep").alias("r")).distinct(), "star")
    sigs = signatures(star.select(F.explode(F.array("l", "r")).alias("rid")))
    signed = star.join(sigs.toDF("l", "lsig"), "l").join(sigs.toDF("r", "rsig"), "r")
    first = _confirmed(signed.select("l", "r", "lsig", "rsig").mapInArrow(_alike, "l bigint, r bigint"), texts, shingle)
    unstage(star, sigs)
    comp = connected_components(first)

    # A link that no star showed lies in a bucket whose members are in several components, the hub aside.
    placed = member.where("n > 2 and rep <> hub").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    dealt = stage(_blocks(placed, SIGNATURES), "dealt")
    # Signatures alone name the members of a bucket that may have a link; only their texts are moved.
    sigs = signatures(dealt.select(F.col("rep").alias("rid")))
    signed = dealt.join(sigs.withColumnRenamed("rid", "rep"), "rep").groupBy("key", "i", "j")
    hopes = stage(signed.applyInArrow(_block_hopes, "key bigint, rep bigint, comp bigint").distinct(), "hopes")
    unstage(dealt, sigs)
    again = stage(_blocks(hopes), "again")
    held = needed_rows(signed_texts, sketches, again.select(F.col("rep").alias("rid")))
    second = stage(again.join(held.withColumnRenamed("rid", "rep"), "rep").groupBy("key", "i", "j").applyInArrow(_block_links(shingle), "l bigint, r bigint").distinct(), "links2")
    unstage(hopes, again, held, member, reps, comp)

    shared = named.where("digest is not null and id is not null").join(classes, "digest").select("id", "rep").distinct()
    twice = shared.groupBy("id").agg(F.min("rep").alias("l"), F.count(F.lit(1)).alias("n")).where("n > 1")
    links = first.unionByName(second).unionByName(shared.join(twice, "id").where("rep <> l").select("l", F.col("rep").alias("r")))
    comp = connected_components(links)

    placed = named.join(classes, "digest", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("component", "rep", "rid"))
    placed = stage(placed.select("rid", "id", "n_shingles", "class_id", "root"), "placed")
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
    roots = placed.groupBy("root").agg(lead.alias("lead")).select("root", F.col("lead.id").alias("component_id"), F.col("lead.rid").alias("leader"))
    told = placed.join(roots, "root").select("rid", "id", "n_shingles", F.coalesce("class_id", "id").alias("class_id"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), (F.col("rid") == F.col("leader")).alias("first"))
    told = stage(told, "told")
    unstage(first, second, classes, comp, placed)
    return sketches, told


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2) -> DataFrame:
    """Link documents with 100 * |A and B| >= 80 * |A or B| over sets of shingle-word shingles.

    Returns, for each input row: row (a struct of its columns, whatever their names), n_shingles,
    component_id (the smallest id reachable by links, itself included), kept (id = component_id), class_id
    (smallest id with an equal set) and first (true for one row of each component, of its smallest id). Null and wordless texts have an empty
    set and link with nothing. A text of fewer words than a shingle is one shingle. Rows of
    one id are linked. A row with a null id takes part; where a component has no id, component_id is
    null and kept is true for all of it. Ids are integers. The result reads tables that release() deletes.
    """
    sketches, told = _groups(docs, id_col, text_col, shingle)
    hold(sketches, told)
    return marked_rows(sketches.select("rid", "p", "row", "n_shingles"), told, told, "class_id", "component_id", "kept", "first").drop("rid", "p")


def duplicate_ids(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2) -> DataFrame:
    """As near_duplicates(), with the id alone in place of the row: no text is read again."""
    sketches, told = _groups(docs, id_col, text_col, shingle)
    unstage(sketches)
    hold(told)
    return told.select(F.col("id").alias(id_col), "n_shingles", "class_id", "component_id", "kept", "first")


def unique_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2) -> DataFrame:
    """The rows of docs of which first is true in near_duplicates()."""
    sketches, told = _groups(docs, id_col, text_col, shingle)
    hold(sketches, told)
    return marked_rows(sketches.select("rid", "p", "row"), told, told.where("first").select("rid")).select("row.*")
