"""Personal data by weak supervision, in DataFrame and SQL functions alone.

Patterns propose candidate spans; six labelers (form, checksum or range, gazetteer of what a span holds, names and places beside it, left context,
edges) vote on each for, against or not at all. Spark counts the vote patterns over all documents; expectation
maximisation on these counts (their number is bounded by kinds times vote values, not by the data)
estimates each labeler's reliability, and its posteriors train a logistic span classifier that is
applied as one SQL expression. Spans that pass their kind's base rule always stay.

Java's matcher gives no positions, so a span's place is summed from the pieces between matches. The
patterns are possessive and start only where a run starts, so time stays linear in a text and the stack flat.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hold, stage

#: Kind, what a text must hold, pattern. The first four are the base kinds, in their order.
KINDS = [
    ("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", "[0-9]\\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", "[0-9]", r"[0-9](?:[\x20-]?+[0-9])++"),
    ("phone", "\\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("secret", "[0-9]", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{24,}+"),
]
VOTES = ["form", "proof", "gazetteer", "people", "context", "edges"]
#: Common given names, and cities and countries, each in a word.
NAMES = """
James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Margaret Mark Sandra Paul Ashley Steven Emily Andrew Donna George Michelle Kevin Carol Brian Amanda Edward Laura 
Jean Marie Pierre Jacques Philippe Nathalie Isabelle Sophie Julien Nicolas Camille Claire Luc Hans Peter Klaus Wolfgang Sabine Petra Monika Ursula Anna Stefan Andreas Jürgen Heike Juan José Carlos Luis Antonio Manuel Javier María Carmen Ana Isabel Lucía Pedro Miguel Pablo 
Marco Giuseppe Giovanni Francesca Giulia Luca Chiara Ivan Olga Natalia Dmitri Sergei Elena Tatiana Mohammed Ahmed Fatima Ali Omar Aisha Wei Li Hiroshi Yuki Raj Priya Chen
"""
PLACES = """
London Paris Berlin Madrid Rome Vienna Lisbon Dublin Brussels Amsterdam Zurich Geneva Munich Hamburg Frankfurt Cologne Lyon Marseille Toulouse Barcelona Valencia Seville Milan Naples Turin Warsaw Prague Budapest Athens Stockholm Oslo Copenhagen Helsinki Moscow Istanbul Cairo Delhi Mumbai Tokyo Beijing Shanghai Sydney Toronto Montreal Chicago Boston Seattle Houston Dallas Denver Miami 
France Germany Spain Italy Portugal Austria Switzerland Belgium Netherlands Poland Sweden Norway Denmark Finland Ireland England Scotland Canada Mexico Brazil Argentina India China Japan Australia Russia Turkey Egypt Greece
"""
DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
LUHN = "aggregate(sequence(1, length({d})), 0, (a, i) -> a + if((length({d}) - i) % 2 = 1, 2 * int(substr({d}, i, 1)) - if(int(substr({d}, i, 1)) > 4, 9, 0), int(substr({d}, i, 1)))) % 10 = 0"
OCTETS = r"'^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:[.]|$)){4}$'"
#: Base rule of each kind over x.m, the matched text.
RULES = {
    "email": "true",
    "ip": f"x.m rlike {OCTETS}",
    "card": f"length({DIGITS}) between 14 and 19 and if(length({DIGITS}) between 14 and 19, {LUHN.format(d=DIGITS)}, false)",
    "phone": f"length({DIGITS}) between 10 and 15",
    "secret": "false",
}
#: Votes by kind: 1, 0 or -1. How a span is written, whatever it holds.
FORM = {
    "email": "if(x.m rlike '^[A-Za-z0-9](?:.*[A-Za-z0-9])?@' and not x.m rlike '[.][.]', 1, -1)",
    "ip": "if(x.m rlike '^(?:0|[1-9][0-9]*)(?:[.](?:0|[1-9][0-9]*)){3}$', 1, -1)",
    "card": "if(x.m rlike '^(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2,3}(?: [0-9]{1,3})?|[0-9]{4}(?:-[0-9]{4}){2,3}(?:-[0-9]{1,3})?)$', 1, -1)",
    "phone": "if(x.m rlike '^[+][0-9]{1,3}[ .-]?[(]?[0-9]' and not x.m rlike '[^0-9]{3}', 1, -1)",
    "secret": "if(length(x.m) >= 32, 1, -1)",
}
#: What its digits or letters prove.
PROOF = {
    "email": "if(length(x.m) <= 254, 1, -1)",
    "ip": f"if(x.m rlike {OCTETS}, 1, -1)",
    "card": f"case when length({DIGITS}) not between 13 and 19 then -1 when {LUHN.format(d=DIGITS)} then 1 else 0 end",
    "phone": f"if(length({DIGITS}) between 10 and 15, 1, -1)",
    "secret": "if(x.m rlike '[0-9].*[0-9].*[0-9].*[0-9]' and x.m rlike '[A-Za-z].*[A-Za-z].*[A-Za-z].*[A-Za-z]', 1, -1)",
}
#: Lists of what may stand in a span: common top-level domains, issuer digits, calling codes, key prefixes and digest lengths.
GAZETTEER = {
    "email": "if(lower(x.m) rlike '[.](?:com|org|net|edu|gov|info|biz|io|de|fr|es|uk|it|nl|eu|us|ca|ch|at|be|jp|cn|in|br|mx|ru|pl)$', 1, 0)",
    "ip": "if(x.m rlike '^0*(?:0|127|22[4-9]|2[3-5][0-9])[.]', -1, 1)",
    "card": f"case when length({DIGITS}) < 13 then -1 when {DIGITS} rlike '^(?:4|5[1-5]|2[2-7]|3[47]|6)' then 1 else 0 end",
    "phone": "if(x.m rlike '^[+](?:1|7|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-9]|8[0-9]|9[0-9])', 1, -1)",
    "secret": "if(x.m rlike '^(?:sk|pk|gh[pousr]|xox[abprs]|AKIA|eyJ|AIza)' or (x.m rlike '^[0-9A-Fa-f]+$' and length(x.m) in (32, 40, 64)), 1, -1)",
}
#: A given name in an address, or a given name or a place close before a span.
NAMED, LOCAL = "\\b(?:" + "|".join((NAMES + PLACES).split()) + ")\\b", "(?:^|[._+-])(?:" + "|".join(NAMES.lower().split()) + ")(?:[._+0-9-]|@)"
PEOPLE = {k: f"if(right(x.p, {{chars}}) rlike '{NAMED}'" + (f" or lower(x.m) rlike '{LOCAL}'" if k == "email" else "") + ", 1, 0)" for k, _, _ in KINDS}
CONTEXT = {
    "email": "mail|contact|contacto|kontakt|write to|from:|to:",
    "ip": "\\bip\\b|host|server|address|addr",
    "card": "card|visa|credit|account|iban|konto|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|cell",
    "secret": "token|secret|api|key|passw|credential|bearer",
}
AGAINST = "version|section|isbn|issn|page|rfc|commit|sha-?[0-9]*\\b|md5|checksum"
CONTEXT_CHARS, PEOPLE_CHARS = 24, 60
FEATURES = [*VOTES, "size", "digit_share", *(f"is_{k}" for k, _, _ in KINDS)]
SPAN = "struct<start:int,end:int,kind:string,ok:boolean,form:int,proof:int,gazetteer:int,people:int,context:int,edges:int,size:int,digit_share:int>"


def _candidates(kind: str, number: int) -> str:
    """SQL: spans of one kind from its columns m (matches) and p (pieces between)."""
    rule = RULES[kind]
    left = f"lower(right(x.p, {CONTEXT_CHARS}))"
    span = f"""named_struct('start', a.pos + length(x.p), 'end', a.pos + length(x.p) + length(x.m), 'kind', '{kind}', 'ok', coalesce({rule}, false),
      'form', {FORM[kind]}, 'proof', {PROOF[kind]}, 'gazetteer', {GAZETTEER[kind]}, 'people', {PEOPLE[kind].format(chars=PEOPLE_CHARS)},
      'context', case when {left} rlike '{CONTEXT[kind]}' then 1 when {left} rlike '{AGAINST}' then -1 else 0 end,
      'edges', if(right(x.p, 1) rlike '[A-Za-z0-9]' or left(x.q, 1) rlike '[A-Za-z0-9]', -1, 1),
      'size', int(least(4, length(x.m) div 10)), 'digit_share', int(4 * length({DIGITS}) div length(x.m)))"""
    rows = f"transform(m{number}, (m, i) -> named_struct('m', m, 'p', p{number}[i], 'q', p{number}[i + 1]))"
    return f"aggregate({rows}, named_struct('pos', 0, 'out', cast(array() as array<{SPAN}>)), (a, x) -> named_struct('pos', a.pos + length(x.p) + length(x.m), 'out', concat(a.out, array({span}))), a -> a.out)".replace("\\b", "\\\\b")


def candidates(rows: DataFrame, text) -> DataFrame:
    """rows with a column `spans`: every candidate span with its votes; null texts have none."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<string>")
    held = {}
    for i, (_, needs, pattern) in enumerate(KINDS):
        there = F.contains(text, F.lit("@")) if needs == "@" else text.rlike(needs)
        held[f"m{i}"] = F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    out = rows.select("*", *(c.alias(k) for k, c in held.items()))
    out = out.select("*", *(F.when(F.size(f"m{i}") > 0, F.split(text, pattern, -1)).otherwise(none).alias(f"p{i}") for i, (_, _, pattern) in enumerate(KINDS)))
    return out.select(*rows.columns, F.expr("concat(" + ", ".join(_candidates(k, i) for i, (k, _, _) in enumerate(KINDS)) + ")").alias("spans"))


def estimate(counts: list[tuple[str, tuple, int]], rounds: int = 60) -> list[float]:
    """Posterior of a true span for each (kind, votes, count), by EM over all of them.

    A labeler's reliability is its distribution over votes given truth, shared by kinds; each kind has
    its own share of true spans. Starts from labelers that are right in four of five votes.
    """
    n = len(VOTES)
    given = [[{1: 0.64, 0: 0.2, -1: 0.16}, {1: 0.16, 0: 0.2, -1: 0.64}] for _ in range(n)]
    prior = {k: 0.5 for k, _, _ in counts}
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for kind, votes, _ in counts:
            yes, no = math.log(prior[kind]), math.log(1 - prior[kind])
            for j, v in enumerate(votes):
                yes += math.log(given[j][0][v])
                no += math.log(given[j][1][v])
            post.append(1 / (1 + math.exp(max(-500.0, min(500.0, no - yes)))))
        for kind in prior:
            own = [(p, c) for (k, _, c), p in zip(counts, post) if k == kind]
            prior[kind] = min(0.999, max(0.001, (sum(p * c for p, c in own) + 1) / (sum(c for _, c in own) + 2)))
        for j in range(n):
            for side in (0, 1):
                mass = {v: 1.0 for v in (1, 0, -1)}
                for (_, votes, c), p in zip(counts, post):
                    mass[votes[j]] += c * (p if side == 0 else 1 - p)
                given[j][side] = {v: m / sum(mass.values()) for v, m in mass.items()}
    return post


def fit(rows: list[tuple[list[float], float, int]], rounds: int = 300, decay: float = 1e-3) -> list[float]:
    """Weights (last: bias) of a logistic model of soft labels by gradient steps; rows: features, label, count."""
    size = len(FEATURES) + 1
    w = [0.0] * size
    total = sum(c for _, _, c in rows) or 1
    for step in range(rounds):
        grad = [decay * x for x in w]
        for x, y, c in rows:
            z = w[-1] + sum(a * b for a, b in zip(w, x))
            d = c / total * (1 / (1 + math.exp(max(-500.0, min(500.0, -z)))) - y)
            for i, b in enumerate(x):
                grad[i] += d * b
            grad[-1] += d
        rate = 2.0 / (1 + step / 100)
        w = [a - rate * g for a, g in zip(w, grad)]
    return w


def train(found: DataFrame) -> list[float]:
    """Classifier weights from a table with `spans`."""
    keys = ["kind", *VOTES, "size", "digit_share"]
    grouped = found.select(F.explode("spans").alias("s")).groupBy(*(F.col("s")[k].alias(k) for k in keys)).agg(F.count(F.lit(1)).alias("n")).orderBy(*keys).collect()
    if not grouped:
        return [0.0] * len(FEATURES) + [-1.0]
    post = estimate([(r.kind, tuple(r[v] for v in VOTES), r.n) for r in grouped])
    return fit([([*(float(r[v]) for v in VOTES), r["size"] / 4, r.digit_share / 4, *(float(r.kind == k) for k, _, _ in KINDS)], p, r.n) for r, p in zip(grouped, post)])


def classified(weights: list[float], threshold: float = 0.5) -> str:
    """SQL: the spans that stay, as (start, rank, kind, end, base), sorted."""
    value = [*(f"s.{v}" for v in VOTES), "s.size / 4", "s.digit_share / 4", *(f"int(s.kind = '{k}')" for k, _, _ in KINDS)]
    z = " + ".join(f"({w!r}D) * ({v})" for w, v in zip(weights, value)) + f" + ({weights[-1]!r}D)"
    rank = "case s.kind " + " ".join(f"when '{k}' then {i}" for i, (k, _, _) in enumerate(KINDS)) + " end"
    base = "filter(spans, s -> s.ok)"
    added = f"filter(spans, s -> not s.ok and 1 / (1 + exp(-({z}))) >= {threshold} and not exists({base}, b -> b.start < s.end and s.start < b.end))"
    return f"sort_array(transform(concat({base}, {added}), s -> named_struct('start', s.start, 'rank', {rank}, 'kind', s.kind, 'end', s.end, 'base', s.ok)))"


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, keep_rows: bool = False) -> DataFrame:
    """Spans of personal data: row (struct of id_col, or of all input columns with keep_rows) and spans.

    spans: sorted (start, rank, kind, end, base), code points, end exclusive; base marks those of
    the base rules. An added span never overlaps a base one. Null and empty texts have none. One row
    for each input row, repeated ones too; any column names may clash. An empty table trains a model that adds nothing.
    """
    row = F.struct("*") if keep_rows else F.struct(id_col)
    found = stage(candidates(docs.select(row.alias("row"), F.col(text_col).alias("text")), F.col("text")).select("row", "spans"), "pii")
    hold(found)
    return found.select("row", F.expr(classified(train(found), threshold)).alias("spans"))


def digest_spans(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of find_pii's rows; counts and base_sha256 are of base spans."""
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = "filter(spans, s -> s.base)"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k, _, _ in KINDS[:4]]
    return found.select(F.col("row")[id_col].alias(id_col), *counts, F.sha2(F.expr(joined.format(base)), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))


def redact(text: str, spans: str) -> str:
    """SQL: text with each span (overlapping ones together) replaced by the kind in angle brackets."""
    return f"""aggregate({spans}, named_struct('pos', 0, 'out', ''),
      (a, s) -> named_struct('pos', greatest(a.pos, s.end), 'out', if(s.start >= a.pos, concat(a.out, substr({text}, a.pos + 1, s.start - a.pos), '<', upper(s.kind), '>'), a.out)),
      a -> concat(a.out, substr({text}, a.pos + 1)))"""
