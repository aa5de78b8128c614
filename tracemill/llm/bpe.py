"""Byte-level BPE encoding by a global shuffle of distinct words, and decoding by the token-byte table.

A task splits its texts and collects blocks of documents. A block's pre-tokens, exploded with their positions, are
kept as a dictionary of distinct words and, for each document, the sequence of dictionary numbers (by falling
frequency, as variable-length bytes): position i of the sequence is pre-token i. Dictionary rows are
shuffled and sorted by word, so each distinct word of the corpus is encoded once, however many blocks
hold it, and a frequent word is one row a block. Ids return to their block, many words to a row, by a second
shuffle and are set in place by position.
"""

from __future__ import annotations

import base64

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, hold, partitions, slices, stage, unstage

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: A block ends at as many pre-tokens or distinct words.
BLOCK_TOKENS, BLOCK_WORDS = 4_000_000, 400_000
#: After as many words a task packs what it has encoded, one row for each block.
PACKED_WORDS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def to_varints(x):
    """Little-endian base-128 bytes of non-negative integers below 2**28."""
    import numpy as np

    x = np.asarray(x, np.uint32)
    size = 1 + (x >= 1 << 7) + (x >= 1 << 14) + (x >= 1 << 21)
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(x) else 0, np.uint8)
    for i in range(4):
        there = size > i
        out[(end - size)[there] + i] = ((x[there] >> np.uint32(7 * i)) & 0x7F) | np.where(size[there] > i + 1, 0x80, 0)
    return out.tobytes()


def from_varints(raw: bytes):
    import numpy as np

    b = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(b < 0x80)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for i in range(4):
        there = first + i <= last
        out[there] |= (b[first[there] + i].astype(np.int64) & 0x7F) << (7 * i)
    return out


def _split(pattern):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        task, number = TaskContext.get().partitionId() << 24, 0
        index, ids, seqs, tokens = {}, [], [], 0
        kind = None

        def block():
            nonlocal index, ids, seqs, tokens, number
            count = np.bincount(np.concatenate(seqs), minlength=len(index)) if index else np.empty(0, np.int64)
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            key = task + number
            words = list(index)
            schema = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("word", pa.binary()), ("id", kind), ("seq", pa.binary())])
            for a in range(0, len(words), 100_000):
                part = words[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.int64()), pa.array(rank[a : a + len(part)], pa.int32()), pa.array([w.encode() for w in part], pa.binary()), pa.nulls(len(part), kind), pa.nulls(len(part), pa.binary())], schema=schema)
            for a in range(0, len(ids), 2000):
                part = ids[a : a + 2000]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.int64()), pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.binary()), pa.array(part, kind), pa.array([to_varints(rank[s]) for s in seqs[a : a + 2000]], pa.binary())], schema=schema)
            index, ids, seqs, tokens, number = {}, [], [], 0, number + 1

        for batch in slices(batches):
            kind = batch.column("id").type
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                found = find(text) if text else ()
                put = index.setdefault
                seqs.append(np.fromiter((put(w, len(index)) for w in found), np.int32, len(found)))
                ids.append(i)
                tokens += len(found)
                if tokens >= BLOCK_TOKENS or len(index) >= BLOCK_WORDS:
                    yield from block()
        if ids:
            yield from block()
        give_back()

    return run


def _encode_words(path, pattern):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import tiktoken

        ranks = read_ranks(path)
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        kind = np.uint16 if max(ranks.values()) < 1 << 16 else np.uint32
        before, ids, held, count = None, b"", {}, 0

        def packed():
            rows = [(block, to_varints(at), to_varints([len(x) // kind().itemsize for x in parts]), b"".join(parts)) for block, (at, parts) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "at", "sizes", "ids"])

        for batch in batches:
            for block, at, word in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "word"))):
                if word != before:
                    before, ids = word, np.array(encode(word), kind).tobytes()
                own = held.get(block)
                if own is None:
                    own = held[block] = ([], [])
                own[0].append(at)
                own[1].append(ids)
            count += batch.num_rows
            if count >= PACKED_WORDS:
                count = 0
                yield packed()
        if held:
            yield packed()
        give_back()

    return run


def _assemble(kind):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        block, parts, table = None, [], None
        for batch in slices(batches, "seq", 2 << 20):
            blocks = batch.column("block").to_numpy()
            keys = batch.column("id")
            at, sizes, packed, seqs = (batch.column(c).to_pylist() for c in ("at", "sizes", "ids", "seq"))
            rows, n, ids = [], [], []
            for i in range(batch.num_rows):
                if blocks[i] != block:
                    block, parts, table = blocks[i], [], None
                if seqs[i] is None:
                    parts.append((from_varints(at[i]), from_varints(sizes[i]), np.frombuffer(packed[i], kind)))
                    continue
                if table is None:  # all words of a block sort before its documents
                    flat = np.concatenate([p[2] for p in parts]) if parts else np.empty(0, kind)
                    place, own = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in (0, 1))
                    size, start = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                    size[place], start[place] = own, np.cumsum(own) - own
                    table, parts = (flat, size, start), []
                flat, size, start = table
                seq = from_varints(seqs[i])
                own = size[seq]
                end = np.cumsum(own)
                place = np.repeat(start[seq] - (end - own), own) + np.arange(int(end[-1]) if len(end) else 0)
                rows.append(i)
                n.append(len(place))
                ids.append(flat[place].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    return run


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, decoded: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids) for each row; ids: little-endian unsigned 32-bit integers.

    With decoded, a column decoded as that of decode() follows, made where the ids are set in place.
    Equals ordinary encoding of each match of pattern, without special tokens. Null and empty
    texts have no ids. Ids may repeat or be null; other columns are dropped. vocabulary: path of a rank file.
    """
    spark = docs.sparkSession
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    blocks = stage(rows.mapInArrow(_split(pattern), f"block bigint, at int, word binary, id {kind}, seq binary").withColumn("part", F.col("seq").isNotNull().cast("int")), "pretokens", by="part")
    n = partitions(spark)
    words = blocks.where("part = 0").select("block", "at", "word").repartition(n, "word").sortWithinPartitions("word")
    coded = stage(words.mapInArrow(_encode_words(path, pattern), "block bigint, at binary, sizes binary, ids binary"), "words")
    unstage(blocks, part="part=0")
    hold(blocks, coded)
    none = F.lit(None).cast("binary")
    both = coded.select("block", F.lit(0).alias("part"), "at", "sizes", "ids", F.lit(None).cast(kind).alias("id"), none.alias("seq")).unionByName(blocks.where("part = 1").select("block", "part", none.alias("at"), none.alias("sizes"), none.alias("ids"), "id", "seq"))
    ordered = both.repartition(n, "block").sortWithinPartitions("block", "part")
    wide = "u2" if max(read_ranks(path).values()) < 1 << 16 else "u4"
    place, bytes_of = _assemble(wide), _decode(path)
    made = f"id {kind}, n_tokens bigint, ids binary"
    if decoded:
        return ordered.mapInArrow(lambda batches: bytes_of(place(batches)), f"{made}, decoded binary").withColumnRenamed("id", id_col)
    return ordered.mapInArrow(place, made).withColumnRenamed("id", id_col)


def _decode(path):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = {i: b for b, i in read_ranks(path).items()}
        for batch in slices(batches, "ids"):
            out = []
            for raw in batch.column("ids").to_pylist():
                try:
                    out.append(None if raw is None else b"".join(map(table.__getitem__, np.frombuffer(raw, "<u4").tolist())))
                except KeyError:
                    out.append(None)
            yield batch.append_column("decoded", pa.array(out, pa.binary()))

    return run


def decode(encoded: DataFrame, *, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """encoded with a column decoded: the bytes of its ids, looked up in the vocabulary's table of token bytes.

    Null ids, and ids outside the vocabulary, decode to null. The table has one row for each rank of the
    file, whatever the data.
    """
    rows = encoded.withColumnRenamed(ids_col, "ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded binary"
    return rows.mapInArrow(_decode(vocabulary or public_tokenizers.path(VOCABULARY)), schema).withColumnRenamed("ids", ids_col)


def digest_tokens(encoded: DataFrame, id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """The contract's columns: hashes of the ids and of the bytes that they decode to."""
    whole = encoded if "decoded" in encoded.columns else decode(encoded, vocabulary=vocabulary)
    return whole.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
