"""Byte-pair encoding by backtracking over longest matches, and decoding by a table of offsets.

An automaton over all tokens gives the longest token at each place of a pre-token. A token is taken if it may stand beside the one
before it, that is if merging the bytes of both in the order of the ranks would never have joined them across their border; else the next shorter
token is tried, and a place from which nothing leads on is marked and left backwards. Every accepted prefix is then the exact result of
the merges, and each place is passed once for each token that begins there.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, slices

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens that a task keeps encoded before it starts anew.
CACHE_WORDS = 300_000


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Tokens, merges and what follows from them, read from a tokenizer's JSON file.

    tokens: bytes of each id (None where there is no token). shorter: the next shorter token that begins a token. A token that the merges themselves would
    write otherwise never stands in an encoding and is not matched.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec)
        byte, model = byte_letters(), spec["model"]
        vocab = {bytes(map(byte.__getitem__, s)): i for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [None] * (1 + max([*vocab.values(), *self.special.values()]))
        for b, i in vocab.items():
            self.tokens[i] = b
        for s, i in self.special.items():
            self.tokens[i] = s.encode()
        self.rank, self.made, self.beside = {}, {}, {}
        sound = {b: i for b, i in vocab.items() if len(b) == 1}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        for rank, (a, b) in enumerate(tuple(bytes(map(byte.__getitem__, x)) for x in pair) for pair in pairs):
            x, y = vocab[a], vocab[b]
            whole = vocab[a + b]
            if a + b not in sound and a in sound and b in sound and self._stand(x, y):
                sound[a + b] = whole
                self.made[whole] = (rank, x, y)
            self.rank[x, y] = rank
        self._index(sound)

    def _index(self, sound: dict[bytes, int]):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        self.shorter = {}
        for b, i in sound.items():
            self.find.add_word(b.decode("latin-1"), i)
            self.shorter[i] = next((sound[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in sound), None)
        if sound:
            self.find.make_automaton()
        self.size = {i: len(b) for b, i in sound.items()}

    def _edge(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """(token, rank that made it, rank that uses it up) of all that ever lay at a token's right (side 2) or left (side 1) edge, latest first."""
        out, used = [], float("inf")
        while True:
            made = self.made.get(token)
            out.append((token, made[0] if made else -1, used))
            if not made:
                return out
            used, token = made[0], made[side]

    def _stand(self, a: int, b: int) -> bool:
        """True if no merge joins a piece at a's right edge with one at b's left edge while both are there.

        Equal ranks go from left to right: a's own merge comes before one across the border, that before b's own.
        """
        left, right = self._edge(a, 2), self._edge(b, 1)
        i = j = 0
        while True:
            (x, born_x, used_x), (y, born_y, used_y) = left[i], right[j]
            across = self.rank.get((x, y))
            if across is not None and across < used_x and across <= used_y:
                return False
            if born_x > born_y:
                i += 1
            elif born_y >= 0:
                j += 1
            else:
                return True

    def may_stand(self, a: int, b: int) -> bool:
        known = self.beside.get((a, b))
        if known is None:
            if len(self.beside) > 2_000_000:
                self.beside.clear()
            known = self.beside[a, b] = self._stand(a, b)
        return known

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one pre-token."""
        longest, size, shorter = [None] * len(word), self.size, self.shorter
        for end, token in self.find.iter(word.decode("latin-1")):
            longest[end - size[token] + 1] = token  # longer ones end later
        out, at, n = [], 0, len(word)
        dead = bytearray(n + 1)
        token = longest[0] if n else None
        while at < n:
            while token is not None and (dead[at + size[token]] or out and not self.may_stand(out[-1], token)):
                token = shorter[token]
            if token is None:
                if not out:
                    raise ValueError("a byte without a token")
                dead[at] = 1
                last = out.pop()
                at, token = at - size[last], shorter[last]
                continue
            out.append(token)
            at += size[token]
            token = longest[at] if at < n else None
        return out


def _check(spec: dict):
    """Raise for what this encoder does not do: other models than byte-level merges, or rewriting before them."""
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    wrong = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += [t["content"] for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or spec["normalizer"] or wrong:
        raise ValueError(f"not a plain byte-level merge vocabulary: {wrong}")


@lru_cache(2)
def load(path: str) -> Merges:
    """One for each worker process."""
    return Merges(path)


def _ranges(points) -> str:
    """Code points as the inside of a character class."""
    out = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(1)
def odd_letters() -> tuple[str, str, str]:
    """Characters whose class the tokenizers library and the regex module see differently, as they follow different versions of Unicode.

    (letters, numbers, neither) in the library's view, each as the inside of a character class. The library splits a probe of each character.
    """
    import regex
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    letter, number, blank = (regex.compile(p).match for p in (r"\p{L}", r"\p{N}", r"\s"))
    out = ([], [], [])
    for block in range(0x80, 0x110000, 0x1000):
        points = [c for c in range(block, min(block + 0x1000, 0x110000)) if not 0xD800 <= c < 0xE000]
        starts = {a for _, (a, _) in split("".join(f"a{chr(c)}1{chr(c)}!{chr(c)}\n" for c in points))}
        for i, c in enumerate(points):
            theirs = 0 if 7 * i + 1 not in starts else 1 if 7 * i + 3 not in starts else 2 if 7 * i + 5 not in starts else 3
            ours = 0 if letter(chr(c)) else 1 if number(chr(c)) else 3 if blank(chr(c)) else 2
            if theirs != ours:
                if 3 in (theirs, ours):
                    raise ValueError("blanks differ between the libraries")
                out[theirs].append(c)
    return tuple(map(_ranges, out))


def splitter(pattern: str, odd: tuple[str, str, str]):
    """Function from a text to its pre-tokens, as the tokenizers library splits."""
    import regex

    find = regex.compile(pattern).findall
    every = "".join(odd)
    if not every:
        return find
    classes = {r"\p{L}": rf"\p{{L}}{odd[0]}", r"\p{N}": rf"\p{{N}}{odd[1]}"}
    less = {r"\p{L}": odd[1] + odd[2], r"\p{N}": odd[0] + odd[2]}
    one = {k: f"[[{classes[k]}]--[{less[k]}]]" if less[k] else f"[{classes[k]}]" for k in classes}
    other = rf"[^\s{one[r'\p{L}']}{one[r'\p{N}']}]"
    exact = pattern.replace(r"[^\s\p{L}\p{N}]", other).replace(r" ?\p{L}+", f" ?{one[r'\p{L}']}+").replace(r" ?\p{N}+", f" ?{one[r'\p{N}']}+")
    slow = regex.compile(exact, regex.V1).findall
    doubtful, first = re.compile(f"[{every}]").search, re.compile(f"[\\U{int(min(re.findall('U([0-9a-f]{8})', every)), 16):08x}-\\U0010ffff]").search
    return lambda text: slow(text) if not text.isascii() and first(text) and doubtful(text) else find(text)


class _Known(dict):
    """Place of each pre-token seen in a growing list of ids."""

    def __init__(self, merges: Merges):
        self.merges, self.ids, self.start = merges, array("i"), array("q", [0])
        for s, i in merges.special.items():
            self.put((s,), [i])

    def put(self, word, ids):
        n = self[word] = len(self.start) - 1
        self.ids.extend(ids)
        self.start.append(len(self.ids))
        return n

    def __missing__(self, word):
        return self.put(word, self.merges.encode(word.encode()))


def _encode(path, pattern, odd):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        merges, find = load(path), splitter(pattern, odd)
        marks = re.compile(f"({'|'.join(map(re.escape, sorted(merges.special, key=len, reverse=True)))})") if merges.special else None
        known = _Known(merges)
        for batch in slices(batches):
            if len(known) > CACHE_WORDS:
                known = _Known(merges)
            place, sizes = array("q"), []
            for text in batch.column("text").to_pylist():
                before = len(place)
                parts = marks.split(text) if text and marks else [text or ""]
                for i, part in enumerate(parts):
                    if i % 2:
                        place.append(known[(part,)])
                    elif part:
                        place.extend(map(known.__getitem__, find(part)))
                sizes.append(len(place) - before)
            start, flat, at = np.array(known.start), np.array(known.ids, np.int32), np.array(place, np.int64)
            size = start[at + 1] - start[at]
            end = np.concatenate([[0], np.cumsum(size)])
            ids = flat[np.repeat(start[at] - end[:-1], size) + np.arange(end[-1])]
            offset = end[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offset), pa.int64()), pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array(ids, pa.int32()))], names=["id", "n_tokens", "ids"])
        give_back()

    return run


def _decode(path):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        tokens = load(path).tokens
        flat = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)
        start = np.cumsum([0, *(len(t or b"") for t in tokens)])
        there = np.array([t is not None for t in tokens])
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                out = []
                for row in batch.column("ids"):
                    ids = row.values.to_numpy(zero_copy_only=False) if row.is_valid else None
                    if ids is None or len(ids) and (ids.dtype.kind == "f" or ids.min() < 0 or ids.max() >= len(there) or not there[ids].all()):
                        out.append(None)
                        continue
                    size = start[ids + 1] - start[ids] if len(ids) else np.zeros(0, np.int64)
                    end = np.cumsum(size)
                    place = np.repeat(start[ids] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)
                    out.append(flat[place].tobytes().decode("utf-8", "replace"))
                yield batch.append_column("decoded", pa.array(out, pa.string()))

    return run


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, decoded: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids: array of int) for each row, as the tokenizers library encodes without adding special tokens.

    The strings of special tokens in a text become those tokens. With decoded, a column decoded as that of decode(). Null and empty texts have no ids. Ids of rows may repeat or be
    null; other columns are dropped; an empty table gives an empty table. vocabulary: path of a byte-level tokenizer's JSON file; another kind raises ValueError.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    coded, bytes_of = _encode(path, pattern, odd_letters()), _decode(path)
    made = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, ids array<int>"
    if decoded:
        out = rows.mapInArrow(lambda batches: bytes_of(coded(batches)), f"{made}, decoded string")
    else:
        out = rows.mapInArrow(coded, made)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, *, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """encoded with a column decoded: the text of its ids, special tokens included; bytes that are no UTF-8 become U+FFFD.

    Null ids, and arrays with a null or with a number outside the vocabulary, decode to null. The bytes of all tokens lie one after the other, and a table of offsets
    says where each begins; its size is that of the vocabulary.
    """
    rows = encoded.withColumnRenamed(ids_col, "ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded string"
    return rows.mapInArrow(_decode(vocabulary or public_tokenizers.path(VOCABULARY)), schema).withColumnRenamed("ids", ids_col)


def digest_tokens(encoded: DataFrame, id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """The contract's columns: hashes of the ids in decimal and of the text that they decode to."""
    whole = encoded if "decoded" in encoded.columns else decode(encoded, vocabulary=vocabulary)
    line = F.array_join(F.col("ids").cast("array<string>"), ",")
    return whole.select(id_col, "n_tokens", F.sha2(line, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
