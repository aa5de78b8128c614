"""Small documents with every awkward case, and plain references."""

import random

EN = "the and of to in that it is was for on with as are this from by they have not or were which".split()
FR = "le la les des une est dans pour que qui avec sur pas au ce être même très où déjà".split()


def texts(seed=3, n=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [r.choice(EN if i % 3 else FR) + r.choice(["", "", "er", "ation", "ble"]) for _ in range(r.randint(1, 140))]
        out.append(" ".join(words).capitalize() + ("." if i % 2 else "\n") + " ".join(words[:7]))
    base = out[5] + " " + out[8]
    w = base.split()
    out += [base, base, " ".join(w[:-2]), " ".join(["new", *w]), " ".join(w[: len(w) // 2]), out[3], out[3]]
    out += [None, "", " \n\t ", "one", "ONE", "one two", "Ça été 漢字 かな \U0001f600 don't  we'll\u00a0x  ", "a@b.cd " * 4000, "x" * 60_000, "1" * 30_000, "é" * 20_000, "1 " * 9_000]
    return out


CLASH = ["id", "rid", "row", "spans", "block", "at", "word", "ids", "seq", "n_words", "label", "x", "sig", "kind", "host", "path", "rule", "bucket", "lang", "score"]


def documents(spark, rows=None):
    """doc_id, text and extra columns with the names that operators use inside; ids repeat and one is null."""
    rows = texts() if rows is None else rows
    data = [(i, t, *("extra" for _ in CLASH)) for i, t in enumerate(rows)]
    if len(data) > 4:
        data += [data[2], data[2], (None, "nobody's text of no id", *data[0][2:])]
    return spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH)).repartition(5)
