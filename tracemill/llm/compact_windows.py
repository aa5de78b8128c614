"""Near-duplicate passages by compact windows of min-hashes.

A text is a sequence of hashed five-word shingles, a passage is a window of LEAST words. For each hash function the
Cartesian tree of the sequence has one node for each position that is the minimum of some passage: its compact window is an interval
of passages that share the minimum. The intervals of the ROWS hash functions of a band are joined: each cell of the join is a group of
passages that share ROWS minima, and its key is equal for cells of other texts with the same minima. Texts of a key
propose pairs: all with the least of them, a star. Every passage on the diagonals of a pair is then verified on full shingle
sets (Jaccard 0.8). What a star can't show, a passage that fails with its hub or a key whose texts are still
in several components, is left to a second round. Shingles around such cells that no other text has there rule out most of their passages; the cells left
are compared in blocks by the shingles around them; links that show all alike passages of each cell that failed, and one between two components, leave a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .minhash import connected_components, deal, needed_rows as _needed
from .shared import Words, hold, marked_rows, mix, slices, stage, stage_by_task, unstage

SHINGLE, LEAST, SIMILARITY = 5, 50, 80
#: Bands of minima: a passage pair at similarity s shares a key with probability 1 - (1 - s**ROWS)**BANDS.
ROWS, BANDS = 3, 5
ELEMENTS = LEAST - SHINGLE + 1
#: Equal shingles of a diagonal near an anchor: two alike passages share 41 shingles and have two changes at most, so that one stretch has as many.
AGREE = 13
#: Of two alike passages without a repeated shingle, the shingles in both.
COMMON = -(-2 * SIMILARITY * ELEMENTS // (100 + SIMILARITY))
#: Cells of a block in the second round, and the closest links that a cell which is not held leaves in a block beside those that show more of its passages or join components.
BLOCK, FEW = 512, 2
#: Cells of a bucket of their shingles, of which there are some ten times as many.
BUCKET = 1 << 14


class Sequences:
    """Hashes of the shingles of each text of a column in order; a shingle begins at each word but a text's last four."""

    def __init__(self, k: int = SHINGLE):
        import numpy as np

        self.k, self.words = k, Words()
        self.factor = np.random.default_rng(5).integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, column):
        """(shingles at all words, first word of each row, with the end): the last k - 1 of a row's are not its own."""
        import numpy as np

        h, first = self.words(column)
        n = max(0, len(h) - self.k + 1)
        out = h[:n] * self.factor[0]
        for i in range(1, self.k):
            out += h[i : i + n] * self.factor[i]
        return mix(out), first

    def one(self, text):
        import pyarrow as pa

        x, _ = self(pa.array([text], pa.large_string()))
        return x


def hashed(x, i: int):
    """Universal hash i of the high halves of shingles; never 0, which marks the ends of texts."""
    import numpy as np

    a, b = np.random.default_rng(1000 + i).integers(1, 1 << 32, 2, dtype=np.uint32)
    return (x * (a | np.uint32(1)) + b) | np.uint32(1)


def compact_windows(g, least: int = ELEMENTS):
    """(c, low), ascending: g[c] is the minimum, the leftmost one, of the windows of least that begin at low or later, up to the next low.

    c is a node of the Cartesian tree of g, and the windows that begin there lie in its subtree. Zeros in g separate
    texts: no window holds one. Each other window is in exactly one interval.
    """
    import numpy as np

    n = len(g)
    if n < least:
        return np.empty((2, 0), np.int64)
    tables = [g]
    p = least.bit_length() - 1
    for q in range(p):
        tables.append(np.minimum(tables[-1][: -(1 << q)], tables[-1][1 << q :]))
    edge = np.zeros(least - 1, g.dtype)
    least_of = np.minimum(tables[p][: n - least + 1], tables[p][least - (1 << p) : n - (1 << p) + 1])
    high = np.concatenate([edge, least_of, edge])
    for q in range(p):  # of the windows that hold a position, the largest minimum
        high = np.maximum(high[: -(1 << q)], high[1 << q :])
    high = np.maximum(high[: len(high) - (least - (1 << p))], high[least - (1 << p) :])
    c = np.flatnonzero((high == g) & (g > 0))
    own, low, far = g[c], c.copy(), np.maximum(c - least + 1, 0)
    for q in range(p, -1, -1):  # the subtree's left end, no further than a window that holds c
        at = low - (1 << q)
        go = at >= far
        go &= tables[q][np.maximum(at, 0)] > own
        low[go] = at[go]
    keep = (low <= n - least) & (least_of[np.minimum(low, n - least)] == own)  # else none of its windows has it as the leftmost minimum
    return np.stack([c[keep], low[keep]])


def cells(x, gap):
    """(key, c, at) of all cells: passages from at on share ROWS minima, the first of which is at c; gap marks positions without a shingle."""
    import numpy as np

    out, x = [], (x >> np.uint64(32)).astype(np.uint32)
    for band in range(BANDS):
        nodes = []
        for i in range(band * ROWS, band * ROWS + ROWS):
            g = hashed(x, i)
            g[gap] = 0
            nodes.append((g, *compact_windows(g)))
        begun = np.zeros((ROWS + 1, len(x)), np.int32)
        for i, (_, _, low) in enumerate(nodes):
            begun[i, low] = begun[ROWS, low] = 1
        at = np.flatnonzero(begun[ROWS])
        key, first = np.full(len(at), band + 1, np.uint64), None
        for i, (g, c, _) in enumerate(nodes):  # each passage is in the last interval that has begun
            own = c[np.cumsum(begun[i])[at] - 1]
            first = own if first is None else first
            key = mix(key * np.uint64(Words.BASE) + g[own])
        out.append((key, first, at))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def gaps(first, n: int):
    """True for the last SHINGLE - 1 words of each row, where no shingle of its own begins."""
    import numpy as np

    gap = np.zeros(n + SHINGLE, bool)
    for i in range(1, SHINGLE):
        at = first[1:] - i
        gap[at[at >= 0]] = True
    return gap[:n]


def _rows(batches):
    """rid, id and text with the number of words and a 64-bit hash: equal for texts of equal words, null under LEAST words."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    words = Words()
    for whole in batches:
        for batch in slices([whole], max_bytes=4 << 20):
            h, first = words(batch.column("text"))
            raw, n = h.tobytes(), np.diff(first)
            kind = [int.from_bytes(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=8).digest(), "little", signed=True) if b - a >= LEAST else None for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "id", "text")), pa.array(n, pa.int64()), pa.array(kind, pa.int64())], names=["rid", "id", "text", "n_words", "hash"])


def _cells(batches):
    import numpy as np
    import pyarrow as pa

    sequences = Sequences()
    for whole in batches:
        for batch in slices([whole], max_bytes=384 << 10):
            x, first = sequences(batch.column("text"))
            key, c, at = cells(x, gaps(first, len(x)))
            row = np.searchsorted(first, at, "right") - 1
            key = (key >> np.uint64(16)).astype(np.int64)  # six bytes: what meets by chance is verified like the rest
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("class").take(pa.array(row)), pa.array((c - first[row]).astype(np.int32))], names=["key", "class", "c"])


class Recent:
    """Sequences of the texts met last, by class, up to a bounded size."""

    def __init__(self, most: int = 32 << 20):
        self.sequences, self.most, self.held, self.size = Sequences(), most, {}, 0

    def __call__(self, key, text):
        found = self.held.pop(key, None)
        if found is None:
            found = Profile(self.sequences.one(text))
            self.size += found.size
        self.held[key] = found
        while self.size > self.most and len(self.held) > 1:
            self.size -= self.held.pop(next(iter(self.held))).size
        return found


class Profile:
    """A text's shingles, their places in order of value, and the number of distinct shingles of each passage."""

    def __init__(self, x):
        import numpy as np

        self.x, n = x, len(x)
        self.order = np.argsort(x, kind="stable")
        self.value = x[self.order]
        self.size = 40 * n + 1000
        fresh = np.ones(n + 1, bool)
        fresh[1:-1] = x[1:] != x[:-1]
        self.begins, self.ends = fresh[:-1], fresh[1:]  # of runs of one shingle
        again = np.flatnonzero(self.value[1:] == self.value[:-1])
        late, early = self.order[again + 1], self.order[again]
        near = late - early < ELEMENTS
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, np.maximum(late[near] - ELEMENTS + 1, 0), 1)
        np.add.at(change, early[near] + 1, -1)
        self.distinct = ELEMENTS - np.cumsum(change)[: max(0, n - ELEMENTS + 1)]

    def distinct_of(self, those):
        """Of each passage the distinct shingles among those, which hold all places of a shingle or none."""
        import numpy as np

        n, at = len(self.distinct), self.order[those[self.order]]
        again = np.zeros(len(at), bool)
        again[1:] = self.x[at[1:]] == self.x[at[:-1]]
        before = np.where(again, np.roll(at, 1), -1)
        begin, end = np.maximum(at - ELEMENTS, before) + 1, np.minimum(at, n - 1)  # passages of which it is the first place
        fit = (begin <= end) & (end >= 0)
        begin, end = np.maximum(begin[fit], 0), end[fit]
        return np.cumsum(np.bincount(begin, minlength=n + 1) - np.bincount(end + 1, minlength=n + 1))[:n]

    def covered(self, at):
        """True at the shingles of the passages that begin in at."""
        import numpy as np

        n = len(self.x)
        return np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(at + ELEMENTS, minlength=n + 1))[:n] > 0

    def beside(self, cs):
        """True at the shingles of the passages that hold one of the places cs."""
        import numpy as np

        n, wide = len(self.x), ELEMENTS - 1
        return np.cumsum(np.bincount(np.maximum(cs - wide, 0), minlength=n + 1) - np.bincount(np.minimum(cs + wide + 1, n), minlength=n + 1))[:n] > 0


def alike(a: Profile, b: Profile, d: int, low: int, high: int):
    """For each passage of a that begins in low..high - 1: is it alike with that of b which begins d earlier? Both exist."""
    import numpy as np

    x = a.x[low : high + ELEMENTS - 1]
    same = x == b.x[low - d : high - d + ELEMENTS - 1]
    total = np.cumsum(np.concatenate([[0], same]))
    left, right = a.distinct[low:high], b.distinct[low - d : high - d]
    least = left.min() == ELEMENTS and right.min() == ELEMENTS
    both = total[ELEMENTS:] - total[:-ELEMENTS]
    if least and (both * 9 >= ELEMENTS * 8).all():  # equal places alone suffice
        return np.ones(high - low, bool)
    # occurrences in b, no further than a passage from the diagonal
    at, right_at = np.searchsorted(b.value, x, "left"), np.searchsorted(b.value, x, "right")
    count = right_at - at
    p = np.repeat(np.arange(low, low + len(x)), count)
    q = b.order[np.repeat(at - np.cumsum(count) + count, count) + np.arange(len(p))] + d
    # of the passages from low on, those that hold the shingle on both sides
    begin, end = np.maximum(np.maximum(p, q) - ELEMENTS + 1, low), np.minimum(np.minimum(p, q), high - 1)
    fit = begin <= end
    value, begin, end = a.x[p[fit]], begin[fit], end[fit]
    order = np.lexsort((begin, value))
    value, begin, end = value[order], begin[order], end[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    if not new.all():  # a shingle counts once in a passage: its intervals are united
        group, wide = np.cumsum(new) - 1, len(a.x) + 1
        reach = np.maximum.accumulate(end + group * wide) - group * wide
        begin[1:] = np.where(new[1:], begin[1:], np.maximum(begin[1:], reach[:-1] + 1))
        fit = begin <= end
        begin, end = begin[fit], end[fit]
    n = high - low + 1
    both = np.cumsum(np.bincount(begin - low, minlength=n) - np.bincount(end - low + 1, minlength=n))[: n - 1]
    return 100 * both >= SIMILARITY * (left + right - both)


def runs(flags):
    """[begin, end) of the runs of True."""
    import numpy as np

    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2).tolist()


def hopeful(a: Profile, b: Profile):
    """Positions of b in a passage of which the shingles that a has nowhere don't rule out a passage that is alike."""
    import numpy as np

    at = np.minimum(np.searchsorted(a.value, b.x), len(a.value) - 1)
    total = np.cumsum(np.concatenate([[0], a.value[at] == b.x]))
    passage = (100 * (total[ELEMENTS:] - total[:-ELEMENTS]) >= SIMILARITY * ELEMENTS) | (b.distinct < ELEMENTS)
    sums = np.concatenate([[0], np.cumsum(passage)])
    c = np.arange(len(b.x))
    return sums[np.minimum(c, len(passage) - 1) + 1] > sums[np.maximum(c - ELEMENTS + 1, 0)]


def passages(a: Profile, b: Profile, anchors):
    """Ranges [begin, end) of shingles of a, and of b, in passages that are alike with one of the other text, on diagonals through the anchors.

    anchors: positions in b; each names the diagonals through all places of its shingle in a. The passages that hold the
    anchor are verified, and from them on those beyond, as long as they are alike. An anchor that is in an alike passage on both sides
    asks for no diagonal, and surroundings that were compared without success are not compared again. Runs of one shingle are
    aligned where they begin and where they end. A diagonal must hold
    AGREE equal shingles near the anchor: of two alike passages one diagonal has as many.
    """
    import numpy as np

    n, m, wide = len(a.distinct), len(b.distinct), ELEMENTS - 1
    held = np.zeros(len(a.x), bool), np.zeros(len(b.x), bool)
    anchors = np.asarray(anchors)
    anchors = anchors[hopeful(a, b)[anchors]]
    if not len(anchors):
        return [], []
    # passages of one shingle are alike whatever their alignment
    pure = [(t.distinct == 1, t.x[: len(t.distinct)]) for t in (a, b)]
    if pure[0][0].any() and pure[1][0].any():
        for i in (0, 1):
            same = pure[i][0] & np.isin(pure[i][1], pure[1 - i][1][pure[1 - i][0]])
            for begin, end in runs(same):
                held[i][begin : end + wide] = True
    failed, across = set(), np.arange(2 * wide + 1)
    padded = [np.concatenate([np.full(wide, end, np.uint64), t.x, np.full(wide, end, np.uint64)]) for t, end in ((a, 0), (b, 1))]
    begins, ends = np.flatnonzero(b.begins), np.flatnonzero(b.ends)
    aligned = {(c, False) for c in begins[np.searchsorted(begins, anchors, "right") - 1].tolist()}
    aligned |= {(c, True) for c in ends[np.searchsorted(ends, anchors)].tolist() if not b.begins[c]}
    aligned = sorted(aligned)
    values = b.x[[c for c, _ in aligned]]
    bounds = zip(np.searchsorted(a.value, values, "left").tolist(), np.searchsorted(a.value, values, "right").tolist())
    for (c, last), (left, right) in zip(aligned, bounds):
        if right - left == 1 and held[1][c] and held[0][a.order[left]]:
            continue
        places = a.order[left:right]
        places = places[(a.ends if last else a.begins)[places]]
        if held[1][c]:
            places = places[~held[0][places]]
        own = padded[1][c : c + 2 * wide + 1]
        places = places[(padded[0][places[:, None] + across] == own).sum(1) >= AGREE]
        if not len(places):
            continue
        own = own.tobytes()
        for p in places.tolist():
            if held[0][p] and held[1][c]:
                continue
            around = hash(padded[0][p : p + 2 * wide + 1].tobytes()), hash(own)
            if around in failed:
                continue
            d = p - c
            first, final = max(0, d), min(n, m + d)
            low, high = max(first, p - wide), min(final, p + 1)
            if low >= high:
                continue
            good = alike(a, b, d, low, high)
            if not good.any():
                failed.add(around)
                continue
            parts = [(low, good)]
            edge, x, more = good[0], low, 4 * ELEMENTS
            while edge and x > first:
                z = max(first, x - more)
                parts.append((z, alike(a, b, d, z, x)))
                edge, x, more = parts[-1][1][0], z, 2 * more
            edge, y, more = good[-1], high, 4 * ELEMENTS
            while edge and y < final:
                z = min(final, y + more)
                parts.append((y, alike(a, b, d, y, z)))
                edge, y, more = parts[-1][1][-1], z, 2 * more
            for begin, end in runs(np.concatenate([flags for _, flags in sorted(parts, key=lambda part: part[0])])):
                begin, end = begin + x, end + x + wide  # shingles; the range ends with shared ones on each side
                for i, (t, u, shift) in enumerate(((a.x[begin:end], b.x[begin - d : end - d], 0), (b.x[begin - d : end - d], a.x[begin:end], d))):
                    head, tail = (t[:ELEMENTS, None] == u[:ELEMENTS]).any(1), (t[-ELEMENTS:, None] == u[-ELEMENTS:]).any(1)
                    held[i][begin - shift + int(head.argmax()) : end - shift - int(tail[::-1].argmax())] = True
            if not (held[0][p] and held[1][c]):
                failed.add(around)
    return runs(held[0]), runs(held[1])


def _verify(batches):
    """Of each pair (l, r) that has alike passages their ranges in both texts."""
    import pyarrow as pa

    kind = pa.list_(pa.list_(pa.int32()))
    profile = Recent()
    for batch in slices(slices(batches, "ltext"), "rtext"):
        rows, left, right = [], [], []
        for i, (l, r, ltext, rtext, anchors) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("l", "r", "ltext", "rtext", "anchors")))):
            x, y = passages(profile(l, ltext), profile(r, rtext), anchors)
            if x:
                rows.append(i)
                left.append(x)
                right.append(y)
        keep = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("l").take(keep), batch.column("r").take(keep), pa.array(left, kind), pa.array(right, kind)], names=["l", "r", "left", "right"])


def _marks(buckets: int):
    """The distinct shingles beside the cells of a class by bucket: 63 bits of each and one that marks those in a passage with a repeated shingle."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        profile = Recent(0)
        for batch in slices(batches):
            bucket, owner, out = [], [], []
            for own, cs, text in zip(*(batch.column(c).to_pylist() for c in ("class", "cs", "text"))):
                t = profile(own, text)
                poor = t.covered(np.flatnonzero(t.distinct < ELEMENTS))
                marks = np.unique((t.x & ~np.uint64(1) | poor)[t.beside(np.array(cs))])
                marks = marks[np.append(marks[1:] >> np.uint64(1) != marks[:-1] >> np.uint64(1), True)]
                of = (mix(marks >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(buckets + 1))
                for i in np.flatnonzero(np.diff(cuts)).tolist():
                    bucket.append(i)
                    owner.append(own)
                    out.append(marks[order[cuts[i] : cuts[i + 1]]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(owner, pa.int64()), pa.array(out, pa.binary())], names=["bucket", "class", "marks"])

    return run


def _shared(table):
    """The marks of a bucket that several classes have, by class; a shingle is marked for all if it is for one."""
    import numpy as np
    import pyarrow as pa

    own = [np.frombuffer(x, np.uint64) for x in table.column("marks").to_pylist()]
    value, owner = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    begin = np.flatnonzero(np.append(True, value[1:] >> np.uint64(1) != value[:-1] >> np.uint64(1)))
    count = np.diff(np.append(begin, len(value)))
    keep = np.repeat(count > 1, count)
    value, owner = np.repeat(value[begin + count - 1], count)[keep], owner[keep]
    value = value[np.argsort(owner, kind="stable")]
    cuts = np.cumsum([0, *np.bincount(owner, minlength=len(own))]).tolist()
    return pa.table({"class": table.column("class"), "marks": pa.array([value[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})


def _hopeful(batches):
    """The cells (class, c) in a passage of which the shingles that no other class has beside its cells don't rule out an alike one."""
    import numpy as np
    import pyarrow as pa

    profile = Recent(0)
    for batch in slices(batches):
        owner, at = [], []
        for own, cs, text, marks in zip(*(batch.column(c).to_pylist() for c in ("class", "cs", "text", "marks"))):
            t, cs, known = profile(own, text), np.array(cs), np.sort(np.frombuffer(b"".join(marks), np.uint64))
            if not len(known):
                continue
            found = known[np.minimum(np.searchsorted(known >> np.uint64(1), t.x >> np.uint64(1)), len(known) - 1)]
            there = found >> np.uint64(1) == t.x >> np.uint64(1)
            left = t.distinct - t.distinct_of(~there)
            poor = np.cumsum(np.concatenate([[0], there & (found & np.uint64(1) > 0)]))
            hope = (100 * left >= SIMILARITY * t.distinct) & ((left >= COMMON) | (poor[ELEMENTS:] > poor[:-ELEMENTS]))
            total, last = np.concatenate([[0], np.cumsum(hope)]), len(hope) - 1
            cs = cs[total[np.minimum(cs, last) + 1] > total[np.maximum(cs - ELEMENTS + 1, 0)]]
            owner += [own] * len(cs)
            at += cs.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(at, pa.int32())], names=["class", "c"])


def _around(batches):
    """For each place of a text 32 bits of each shingle around it, where it is among them, and the fewest distinct shingles of a passage that holds it."""
    import numpy as np
    import pyarrow as pa

    wide, profile = ELEMENTS - 1, Recent(0)
    for batch in slices(batches):
        out = {name: [] for name in ("class", "c", "around", "place", "least")}
        for own, text, cs in zip(*(batch.column(c).to_pylist() for c in ("class", "text", "cs"))):
            t = profile(own, text)
            bits = (t.x >> np.uint64(32)).astype(np.uint32)
            for c in cs:
                out["around"].append(bits[max(0, c - wide) : c + wide + 1].tobytes())
                out["place"].append(min(c, wide))
                out["least"].append(int(t.distinct[max(0, c - wide) : c + 1].min()))
                out["class"].append(own)
                out["c"].append(c)
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


def _meet(few: int):
    """Links of cells with role 0 or 2 to cells with role 1 or 2 whose surroundings have alike passages on their diagonal: for each that asks and is not held the closest few
    and what more its alike passages take, else none twice between two components.

    A passage is a bit of 46, those that hold the cell. A place has the bits of the passages in which it is the first of its shingle, so that the bits which two
    cells have of a shingle are the passages that share it, and their sums over all shingles are the sizes of intersections.
    """

    def run(table):
        import numpy as np
        import pyarrow as pa

        own, c, comp, place, least, role, ask, held = (table.column(x).to_numpy() for x in ("class", "c", "comp", "place", "least", "role", "ask", "held"))
        out = set()
        _, root = np.unique(comp, return_inverse=True)
        told, asks = np.flatnonzero(role != 0), np.flatnonzero((role != 1) & ask)
        if len(told):
            asks = asks[~held[asks] | (root[asks] != root[told[0]]) | (root[told] != root[told[0]]).any()]
        if len(told) and len(asks):
            x, fresh, bits, valid = _passages_of_cells(table.column("around").to_pylist(), place, least)
            sizes = _counts(bits)
            known = np.unique(x[asks])
            at = np.minimum(np.searchsorted(known, x), len(known) - 1)
            at = np.where((known[at] == x) & (x > 0), at + 1, 0)  # 0 is no shingle of a cell that asks
            single, bits_told, at_told, own_told, least_told = np.zeros((len(told), 96), np.int64), bits[told], at[told], own[told], least[told]
            single[:, : x.shape[1]] = at_told * fresh[told]  # each shingle once
            seen, masks, flags = np.zeros(len(known) + 1, np.uint8), np.zeros(len(known) + 1, np.uint64), np.empty(single.shape, np.uint8)
            for i in asks.tolist():
                others = np.flatnonzero((own_told != own[i]) & ((root[told] != root[i]) | ~held[i]))
                if not len(others):
                    continue
                np.add.at(masks, at[i], bits[i])
                seen[at[i]] = 1
                seen[0] = masks[0] = 0
                some = flags[: len(others)]
                np.take(seen, single if len(others) == len(told) else single[others], out=some, mode="clip")
                total = some.view(np.uint64).sum(1) * np.uint64(0x0101010101010101) >> np.uint64(56)  # of bytes
                both, lesser = np.maximum(least_told[others], least[i]), least_told[others] + least[i]
                others = others[(100 * total >= SIMILARITY * both) & ((100 + SIMILARITY) * total >= SIMILARITY * lesser)]
                both = _counts(masks[at_told[others]] & bits_told[others])
                seen[at[i]] = masks[at[i]] = 0
                others = told[others]
                good = (100 * both >= SIMILARITY * (sizes[others] + sizes[i] - both)) & valid[others] & valid[i]
                fit = good.any(1)
                fit[fit] = ((x[others[fit]] == x[i]) & (x[i] > 0)).sum(1) >= AGREE  # passages() asks for as much
                others, both, good = others[fit], both[fit], good[fit]
                order = np.argsort(-(both * good).max(1), kind="stable")
                others, good = others[order], good[order]
                links, shown = 0, np.full(good.shape[1], held[i])
                for j, passages_ in zip(others.tolist(), good):
                    if root[j] == root[i] and (held[i] or links >= few) and not (passages_ & ~shown).any():
                        continue
                    links += 1
                    shown |= passages_
                    root[root == root[i]] = root[j]
                    out.add((int(own[i]), int(own[j]), int(c[j])) if own[i] < own[j] else (int(own[j]), int(own[i]), int(c[i])))
        l, r, at = zip(*out) if out else ((), (), ())
        return pa.table({"l": pa.array(l, pa.int64()), "r": pa.array(r, pa.int64()), "c": pa.array(at, pa.int32())})

    return run


def _passages_of_cells(around, place, least):
    """(shingles around each cell in columns, 0 where there is none; first places of a shingle; bits of the passages in which a place is the first of its shingle; passages that exist)."""
    import numpy as np

    wide, size = ELEMENTS - 1, np.array([len(a) // 4 for a in around])
    row = np.repeat(np.arange(len(around)), size)
    column = np.arange(len(row)) - np.repeat(np.cumsum(size) - size - wide + place, size)
    x = np.zeros((len(around), 2 * wide + 1), np.int64)
    x[row, column] = np.frombuffer(b"".join(around), np.uint32).astype(np.int64) + 1
    before = np.full(x.shape, -1)  # the place of the same shingle before; only where a passage repeats one
    poor = np.flatnonzero(least < ELEMENTS)
    both = np.sort(x[poor] << 7 | np.arange(x.shape[1]), axis=1)
    again = both[:, 1:] >> 7 == both[:, :-1] >> 7
    r, k = np.nonzero(again)
    before[poor[r], both[r, k + 1] & 127] = both[r, k] & 127
    q = np.arange(x.shape[1])
    first, last = np.maximum(np.maximum(before, q - ELEMENTS) + 1, 0), np.minimum(q, wide)
    ones = np.array([(1 << k) - 1 for k in range(ELEMENTS + 1)], np.uint64)
    bits = np.where((x > 0) & (first <= last), ones[last + 1] & ~ones[np.minimum(first, ELEMENTS)], 0).astype(np.uint64)
    begin = (wide - place)[:, None]
    start = np.arange(ELEMENTS)
    return x, before < 0, bits, (start >= begin) & (start + wide < begin + size[:, None])


def _counts(bits):
    """Of each row of 46-bit numbers how many have each bit."""
    import numpy as np

    spread = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]  # a byte for each bit
    of = np.ascontiguousarray(bits).view(np.uint8).reshape(*bits.shape, 8)[:, :, : -(-ELEMENTS // 8)]
    return np.ascontiguousarray(spread[of].sum(1)).view(np.uint8)[:, :ELEMENTS].astype(np.int64)


def _merge(batches):
    """Ranges of shingles of a class as merged word ranges."""
    import pyarrow as pa

    for batch in batches:
        dup, out = [], []
        for n, copies, found in zip(*(batch.column(c).to_pylist() for c in ("n", "copies", "found"))):
            merged: list = []
            for a, b in [(0, n)] if copies > 1 else sorted((a, b + SHINGLE - 1) for a, b in found):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            dup.append(sum(b - a for a, b in merged))
            out.append(",".join(f"{a}-{b}" for a, b in merged))
        yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(dup, pa.int64()), pa.array(out, pa.string())], names=["class", "n_dup_words", "spans"])


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (l, r, anchors) of classes with alike passages; only texts of a pair are moved."""
    pairs = stage(pairs, "pairs")
    texts = _texts(pairs.select(F.explode(F.array("l", "r")).alias("class")), rows)
    joined = pairs.join(texts.toDF("l", "ltext"), "l").join(texts.toDF("r", "rtext"), "r").select("l", "r", "ltext", "rtext", "anchors")
    out = stage(joined.mapInArrow(_verify, "l bigint, r bigint, left array<array<int>>, right array<array<int>>"), "links")
    unstage(pairs, texts)
    return out


def _texts(needed: DataFrame, rows: DataFrame) -> DataFrame:
    """(class, text) of the classes needed, staged."""
    return _needed(rows.select("rid", "p", "text"), rows, needed.select(F.col("class").alias("rid")), columns=("rid as class", "text"))


def _open(cells: DataFrame) -> DataFrame:
    """The cells (key, class, c, comp, held) of keys whose classes are in several components, or of which one is not held; ask: not held, or not in the component of the key's least class."""
    own = Window.partitionBy("key")
    first, last = F.min("class").over(own).alias("first"), F.max("class").over(own).alias("last")
    state = (F.min("comp").over(own).alias("comp0"), F.max("comp").over(own).alias("comp1"), F.min("held").over(own).alias("all"), F.min(F.struct("class", "comp")).over(own)["comp"].alias("main"))
    out = cells.select("*", first, last, *state).where("first < last and (comp0 < comp1 or not all)")
    return out.select("key", "class", "c", "comp", "held", (~F.col("held") | (F.col("comp") != F.col("main"))).alias("ask"))


def _met(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """(l, r, anchors) of the classes that cells (key, class, c, comp, held) of one key link, as in _meet(); every cell meets those that ask.

    Cells in no passage that can be alike with another's drop out before: too many shingles there are no other class's.
    """
    places = cells.groupBy("class").agg(F.collect_set("c").alias("cs"))
    texts = _texts(places.select("class"), rows)
    spots = stage(places.join(texts, "class"), "spots")
    buckets = 1 + (spots.agg(F.sum(F.size("cs"))).first()[0] or 0) // BUCKET
    marks = spots.mapInArrow(_marks(buckets), "bucket int, class bigint, marks binary").groupBy("bucket").applyInArrow(_shared, "class bigint, marks binary")
    marks = marks.groupBy("class").agg(F.collect_list("marks").alias("marks"))
    hopeful = spots.join(marks, "class").mapInArrow(_hopeful, "class bigint, c int")
    left = stage(_open(cells.join(hopeful, ["class", "c"])), "left")
    near = left.groupBy("class").agg(F.collect_set("c").alias("cs")).join(texts, "class").mapInArrow(_around, "class bigint, c int, around binary, place int, least int")
    counts = left.groupBy("key").agg(F.count_if("ask").alias("asks"), F.count(F.lit(1)).alias("m"))
    counts = counts.select("key", F.ceil(F.col("asks") / BLOCK).cast("int").alias("minors"), F.ceil((F.col("m") - F.col("asks")) / BLOCK).cast("int").alias("majors"))
    dealt = deal(left.join(counts, "key").join(near, ["class", "c"]), F.xxhash64("class", "c"), F.col("ask"))
    met = stage(dealt.groupBy("key", "i", "j").applyInArrow(_meet(FEW), "l bigint, r bigint, c int").groupBy("l", "r").agg(F.array_sort(F.collect_set("c")).alias("anchors")), "met")
    unstage(texts, spots, left)
    return met


def _sides(links: DataFrame) -> DataFrame:
    """(class, found): all ranges of alike passages of each class."""
    sides = links.select(F.col("l").alias("class"), F.col("left").alias("found")).unionByName(links.select(F.col("r").alias("class"), F.col("right").alias("found")))
    return sides.groupBy("class").agg(F.array_distinct(F.flatten(F.collect_set("found"))).alias("found"))


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of LEAST words that occur, nearly alike, in another row.

    A passage is LEAST words in a row; two are alike where their sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    Returns id_col, n_words, n_dup_words, spans (merged word ranges `a-b`, b exclusive, comma-joined, of all passages
    that are alike with one of another row, each from its first to its last shared shingle) and component_id (the smallest id reachable through rows that have alike
    passages, itself included), one row for each input row. Words are those between ASCII blanks, A-Z lower-cased. Null, empty and
    texts under LEAST words have no passages. Rows of equal words repeat each other's whole text; repeats inside one
    row do not count. A row with a null id takes part; a component without any id has a null component_id. Other columns are
    dropped. Ids are integers. Candidates come from min-hashes: an alike pair of passages at similarity 0.8 meets in a key with probability
    0.97, equal ones always. Texts are told apart by 64-bit hashes.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = stage_by_task(rows.mapInArrow(_rows, "rid bigint, id bigint, text string, n_words bigint, hash bigint"), "rows")
    classes = stage(rows.where("hash is not null").groupBy("hash").agg(F.min("rid").alias("class"), F.min("id").alias("low_id"), F.max("n_words").alias("n"), F.count(F.lit(1)).alias("copies")), "classes")
    reps = marked_rows(rows.select("rid", "p", "text"), rows, classes.select(F.col("class").alias("rid"))).select(F.col("rid").alias("class"), "text")
    # All cells move once. The least class of a key that several have is its hub.
    own = Window.partitionBy("key")
    keyed = reps.mapInArrow(_cells, "key bigint, class bigint, c int").select("*", F.min("class").over(own).alias("hub"), F.max("class").over(own).alias("last")).where("hub < last")
    third = F.max((F.col("class") != F.col("hub")) & (F.col("class") != F.col("last"))).over(own).alias("third")
    members = stage(keyed.select("key", "class", "c", "hub", third).dropDuplicates(["key", "class", "c"]), "members")
    pairs = members.where("class <> hub").groupBy(F.col("hub").alias("l"), F.col("class").alias("r")).agg(F.array_sort(F.collect_set("c")).alias("anchors"))
    first = _verified(pairs, rows)

    # What the star can't show: a cell whose passages failed with the hub's, or classes of a key in several components.
    # Where a key has two classes, they are the star.
    comp = connected_components(first)
    covered = F.exists("found", lambda x: (x[0] <= F.col("c")) & (F.col("c") < x[1]))
    placed = members.where("third").join(_sides(first), "class", "left").select("key", "class", "c", "hub", F.coalesce(covered, F.lit(False)).alias("held"))
    placed = placed.join(comp.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("component", "class")).drop("component")
    open_ = stage(_open(placed.where("class <> hub").drop("hub")), "open")
    met = _met(open_, rows)
    second = _verified(met, rows)
    unstage(members, open_, met, comp)

    links = first.unionByName(second)
    comp = connected_components(links)
    placed = classes.join(comp.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("component", "class"))
    roots = placed.groupBy("root").agg(F.min("low_id").alias("component_id"))
    found = placed.join(_sides(links), "class", "left").where("found is not null or copies > 1").select("class", "n", "copies", "found").mapInArrow(_merge, "class bigint, n_dup_words bigint, spans string")
    told = stage(placed.join(roots, "root").select("class", "hash", "component_id").join(found, "class", "left").drop("class"), "told")
    unstage(first, second, comp, classes)
    hold(rows, told)
    out = rows.select("id", "hash", "n_words").join(told, "hash", "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_dup_words", F.lit(0)).alias("n_dup_words"), F.coalesce("spans", F.lit("")).alias("spans"), F.when(F.col("hash").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
