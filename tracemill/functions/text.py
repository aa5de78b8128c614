"""Column functions over answers, think blocks, tagged replies and prompts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strip(c: Column) -> Column:
    """Remove all white space at both ends (trim removes blanks alone)."""
    return F.regexp_replace(c, r"^(?U:\s)+|(?U:\s)+$", "")


def normal_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U:\s)+", " "))


def boxed_first(c: Column) -> Column:
    """Content of the first balanced \\boxed{...}, "}" for \\boxed{}}; null without one."""
    at = F.locate("\\boxed{", c)
    tail = F.substr(c, at + 7)
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
    step = lambda a, ch: F.when(a["depth"] == 0, a).otherwise(F.struct((a["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)).alias("depth"), (a["n"] + 1).alias("n")))
    end = F.aggregate(F.split(tail, ""), start, step)
    return F.when((at > 0) & F.startswith(tail, F.lit("}}")), "}").when((at > 0) & (end["depth"] == 0), F.substring(tail, F.lit(1), end["n"] - 1))


def _blocks(text: str, escapes: bool, nested: bool) -> list[str]:
    out, at = [], 0
    while (at := text.find("\\boxed{", at)) >= 0:
        depth, i = 1, at + 7
        while i < len(text) and depth:
            if escapes and text[i] == "\\" and i + 1 < len(text) and text[i + 1] in "{}":
                i += 2
                continue
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            i += 1
        if not depth:
            out.append(text[at + 7 : i - 1])
        at = i if not nested and not depth else at + 7
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def boxed_all(s: pd.Series) -> pd.Series:
    """Every balanced block; the search goes on after a block, so nested ones are not reported."""
    return s.map(lambda t: None if t is None else _blocks(t, False, False))


@F.pandas_udf(T.ArrayType(T.StringType()))
def boxed_all_escaped(s: pd.Series) -> pd.Series:
    """Every balanced block, nested ones too; \\{ and \\} are plain text."""
    return s.map(lambda t: None if t is None else _blocks(t, True, True))


def unbox(c: Column) -> Column:
    """Unwrap blocks without inner braces; empty ones stay."""
    return F.regexp_replace(c, r"\\boxed\{([^{}]+)\}", "$1")


def normal_answer(c: Column) -> Column:
    """Last block or the text, without surrounding $ signs and any white space."""
    last = F.coalesce(F.try_element_at(boxed_all(c), F.lit(-1)), c)
    return F.regexp_replace(F.regexp_replace(strip(last), r"^\$(.*)\$$", "$1"), r"(?U:\s)", "")


def think(c: Column) -> Column:
    """Text of the first think block, stripped; null without one."""
    return F.when(c.rlike(r"(?s)<think>.*?</think>"), strip(F.regexp_extract(c, r"(?s)<think>(.*?)</think>", 1)))


def without_think(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def split_reasoning(c: Column) -> Column:
    """(content, reasoning): the first think block, null if absent or blank, and the text around it, both stripped."""
    found = think(c)
    around = strip(F.regexp_replace(c, r"(?s)^(.*?)<think>.*?</think>", "$1"))
    return F.struct(F.when(found.isNull(), strip(c)).otherwise(around).alias("content"), F.when(found != "", found).alias("reasoning"))


def think_and_answer(c: Column) -> Column:
    """(reasoning, answer): the first think block and what follows it, stripped; without a block an empty one and the whole text."""
    found = think(c)
    rest = F.regexp_extract(c, r"(?s)<think>.*?</think>(.*)$", 1)
    return F.struct(F.coalesce(found, F.when(c.isNotNull(), F.lit(""))).alias("reasoning"), strip(F.when(found.isNull(), c).otherwise(rest)).alias("answer"))


def split_closing(content: Column, reasoning: Column) -> Column:
    """(content, reasoning) of a reply whose reasoning, if none came apart, ends at a closing tag alone; a blank reasoning is null."""
    text, own = F.coalesce(content, F.lit("")), F.when(reasoning != "", reasoning)
    at = F.locate("</think>", text)
    cut = own.isNull() & (at > 0)
    before = F.replace(F.substring(text, F.lit(1), at - 1), F.lit("<think>"), F.lit(""))
    found = strip(F.when(cut, before).otherwise(own))
    return F.struct(F.when(cut, strip(F.substr(text, at + 8))).otherwise(text).alias("content"), F.when(found != "", found).alias("reasoning"))


def reasoning_of(content: Column, reasoning: Column) -> Column:
    """A message's own reasoning, else its content up to the closing tag, from behind the last opening tag if it begins with one."""
    head = F.substring_index(content, "</think>", 1)
    return F.coalesce(F.when(reasoning != "", reasoning), F.when(F.startswith(head, F.lit("<think>")), F.substring_index(head, "<think>", -1)).otherwise(head))


def join_think(reasoning: Column, content: Column) -> Column:
    return F.concat(F.lit("<think>\n"), reasoning, F.lit("\n</think>\n"), content)


def tagged(c: Column, tag: str, greedy: bool = False) -> Column:
    """Stripped content between <tag> and </tag>, any case; null if absent or empty."""
    got = strip(F.regexp_extract(c, rf"(?is)<{tag}>(.*{'' if greedy else '?'})</{tag}>", 1))
    return F.when(got != "", got)


def parse_pair(c: Column, first: str, second: str) -> Column:
    """Struct (first, second, status): both blocks present, non-empty and in order, else status says what is wrong."""
    a, b = tagged(c, first), tagged(c, second)
    at = lambda t: F.locate(f"<{t.lower()}>", F.lower(c))
    status = F.when(a.isNull(), f"no {first}").when(b.isNull(), f"no {second}").when(at(first) > at(second), "order").otherwise("ok")
    return F.struct(a.alias(first), b.alias(second), status.alias("status"))


def without_first(c: Column, part: Column) -> Column:
    """c without the first occurrence of part; null where part is absent."""
    at = F.instr(c, part)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.substr(c, at + F.length(part))))


def context_from(prompt: Column, marker: str, given: Column | None = None) -> Column:
    """given, else the prompt from the marker to its end; null without either."""
    at = F.locate(marker, prompt)
    found = F.when(at > 0, F.substr(prompt, at))
    return found if given is None else F.coalesce(given, found)


def model_key(c: Column) -> Column:
    """Base name of a path, odd characters as _, first letter lower."""
    name = F.regexp_replace(F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1), r"[^A-Za-z0-9._-]+", "_")
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substr(name, F.lit(2)))


def context_prompt(question: Column, answer: Column) -> tuple[Column, Column]:
    """(prompt with the boxed answer, the context alone) of a calibration sample."""
    told = F.concat(F.lit("Given the ground truth answer is $\\boxed{"), answer, F.lit("}$."))
    return F.concat(question, F.lit(" \n"), told), F.concat(F.lit("\n"), told)


def distinct_spans(spans: Column) -> Column:
    """Different non-blank spans, stripped, in the order of their first occurrence."""
    return F.array_distinct(F.filter(F.transform(spans, strip), lambda s: s != ""))


def prompt_pair(question: Column, answer: Column) -> tuple[Column, Column, Column]:
    """(prompt without the answer, context with it, prompt with it)."""
    context = F.concat(F.lit("\nThe answer is $"), answer, F.lit("$."))
    plain = F.concat(question, F.lit("\n\nExplain step by step."))
    return plain, context, F.concat(plain, context)


# What counts as a value in a phrase, and the pattern that a rule puts in its place.
VALUE = r"(\\boxed\{[^{}]*\}|\$[^$\n]{1,120}\$|\*\*[^*\n]{1,80}\*\*|[-+]?\d[\d,./:%-]*)"
OPEN_VALUE = r"(?:\\boxed\{[^{}]{1,80}\}|\$[^$\n]{1,120}\$|\*\*[^*\n]{1,80}\*\*|[-+]?\d[\d,./:%-]*)"


def _whole(inner: str) -> str:
    return rf"(?<!\w){inner}(?!\w)"


def _literal(text: str) -> str:
    return r"\s+".join(map(re.escape, text.split(" ")))


def exact_pattern(text: str) -> str:
    """Pattern (of Python's re) of a phrase in normal space: whole words, any white space between them."""
    return _whole(_literal(text))


def general_pattern(text: str) -> str | None:
    """Pattern of a phrase with its values (numbers, math, boxes, bold) left open; None without a value."""
    parts = re.split(VALUE, text)  # literals at even places, values between them
    return _whole(OPEN_VALUE.join(map(_literal, parts[::2]))) if len(parts) > 1 else None


def needed_words(text: str, values: bool) -> list[str]:
    """Words that a match of a phrase's pattern holds as whole words; with values, those of the general pattern.

    A word that touches a value may go on in it and does not count.
    """
    if not values:
        return sorted(set(re.findall(r"\w+", text)))
    parts = re.split(VALUE, text)[::2]
    out = set()
    for i, part in enumerate(parts):
        for m in re.finditer(r"\w+", part):
            if not (i and m.start() == 0) and not (i < len(parts) - 1 and m.end() == len(part)):
                out.add(m.group())
    return sorted(out)


# The marker of a context and the names of domains.
CONTEXT_MARKER = "Given the ground truth answer is"
DOMAINS = ("multihop-reasoning", "science", "logic", "math")


def last_box(c: Column) -> Column:
    return F.try_element_at(boxed_all_escaped(c), F.lit(-1))


def context_answer(context: Column) -> Column:
    """Last box of a context, else what follows its marker without outer blanks, dots, tabs and line ends; null without either."""
    at = F.locate(CONTEXT_MARKER, context)
    rest = F.substr(context, at + len(CONTEXT_MARKER))
    return F.coalesce(last_box(context), F.when(at > 0, F.regexp_replace(rest, r"^[ .\n\t]+|[ .\n\t]+$", "")))


def parse_answer(answer: Column, solution: Column, splitter: str) -> Column:
    """The answer field, else what follows the last splitter of the solution, else its last box, else null."""
    tail = strip(F.element_at(F.split(solution, re.escape(splitter)), -1)) if splitter else F.lit(None)
    return F.when(answer.isNotNull(), strip(answer)).when(F.contains(solution, F.lit(splitter)) & F.lit(bool(splitter)), tail).otherwise(last_box(solution))


def ground_truth(answer: Column, content: Column) -> Column:
    """A blank and the answer (the first box of the content where it is null), unboxed; null where empty or "another answer"."""
    raw = F.coalesce(answer, boxed_first(content))
    box = boxed_first(raw)
    plain = F.when(F.coalesce(F.length(box), F.lit(0)) > 0, box).otherwise(raw)
    return F.when((F.length(raw) > 0) & ~F.contains(F.lower(raw), F.lit("another answer")), F.concat(F.lit(" "), strip(plain)))


def trim_span(text: Column, start: Column, end: Column) -> Column:
    """(start, end) of a half-open span without white space at its ends; a blank span shrinks to its end."""
    part = F.substr(text, start + 1, end - start)
    first = start + F.length(part) - F.length(F.regexp_replace(part, r"^(?U:\s)+", ""))
    rest = F.regexp_replace(part, r"^(?U:\s)+", "")
    return F.struct(first.alias("start"), (end - F.length(rest) + F.length(F.regexp_replace(rest, r"(?U:\s)+$", ""))).alias("end"))


def first_index(text: Column, part: Column) -> Column:
    """0-based position of the first occurrence, -1 without one."""
    return F.instr(text, part) - 1


def prefix_cut(response: Column, spans: Column) -> Column:
    """The response up to the end of its first span; all of it without spans."""
    first = F.try_element_at(spans, F.lit(1))
    return F.when(first.isNull(), response).otherwise(F.substring(response, F.lit(1), first_index(response, first) + F.length(first)))


def by_position(spans: Column, response: Column) -> Column:
    """Spans by the position of their first occurrence, equal ones in given order."""
    keyed = F.transform(spans, lambda s, i: F.struct(F.instr(response, s).alias("at"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


@F.pandas_udf(T.StructType().add("values", T.ArrayType(T.StringType())).add("error", T.StringType()))
def json_strings(s: pd.Series) -> pd.DataFrame:
    """Stripped strings of a JSON array that lies between the first opening and the last closing bracket; error is no_array or not_strings."""
    import json

    rows = []
    for t in s:
        a, b = (t.find("["), t.rfind("]")) if t is not None else (-1, -1)
        if a < 0 or b < a:
            rows.append((None, "no_array"))
            continue
        try:
            values = json.loads(t[a : b + 1])
        except (ValueError, RecursionError):
            values = None
        good = isinstance(values, list) and all(isinstance(v, str) for v in values)
        rows.append(([v.strip() for v in values], None) if good else (None, "not_strings"))
    return pd.DataFrame(rows, columns=["values", "error"])


def parse_spans(judged: Column, response: Column) -> Column:
    """(spans, error) of a reply with a JSON array of strings copied from the response.

    Spans are stripped, blank ones dropped, distinct and by first position. error is null, no_array, not_strings (other elements, or text that is no
    JSON between the outer brackets) or not_copied, and spans are null with an error. A null reply has no array, a null response no spans.
    """
    read = json_strings(judged)
    values = F.filter(read["values"], lambda s: s != "")
    copied = F.forall(values, lambda s: F.contains(response, s))
    error = F.coalesce(read["error"], F.when(~F.coalesce(copied, F.lit(False)), F.lit("not_copied")))
    return F.struct(F.when(error.isNull(), by_position(F.array_distinct(values), response)).alias("spans"), error.alias("error"))


def think_dedup(prompt: Column, response: Column) -> Column:
    """The response without a leading <think> and the white space around it, where the prompt already ends with one."""
    both = F.endswith(strip(prompt), F.lit("<think>")) & F.rlike(response, F.lit(r"^(?U:\s)*<think>"))
    return F.when(both, F.regexp_replace(response, r"^(?U:\s)*<think>(?U:\s)*", "")).otherwise(response)


def split_key(c: Column) -> Column:
    """(model, domain) of a key that ends in -domain; both empty without a known domain."""
    pattern = "^(.*)-(" + "|".join(DOMAINS) + ")$"
    return F.struct(F.regexp_extract(c, pattern, 1).alias("model"), F.regexp_extract(c, pattern, 2).alias("domain"))


def common_length(left: Column, right: Column, from_end: bool = False) -> Column:
    """Length of the common prefix, or suffix."""
    a, b = (F.reverse(left), F.reverse(right)) if from_end else (left, right)
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.when(F.least(F.length(left), F.length(right)) == 0, F.lit(0)).otherwise(F.when(at == 0, F.size(same)).otherwise(at - 1)).cast("int")


def int_grid(c: Column, most: int | None = None) -> Column:
    """Ascending distinct positive integers of a comma-joined list, clamped to most; a list without one raises."""
    values = F.filter(F.transform(F.filter(F.split(c, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int")), lambda v: v > 0)
    grid = F.array_sort(F.array_distinct(F.transform(values, lambda v: F.least(v, F.lit(most))) if most else values))
    return F.when(F.size(values) == 0, F.raise_error(F.lit("the grid is empty")).cast("array<int>")).otherwise(grid)


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON with sorted keys, `, ` and `: ` between them, characters as they are; NaN and malformed text give null."""
    import json

    def refuse(name):
        raise ValueError(name)

    def one(t):
        try:
            return None if t is None else json.dumps(json.loads(t, parse_constant=refuse), ensure_ascii=False, sort_keys=True, allow_nan=False)
        except ValueError:
            return None

    return s.map(one)


def question_messages(messages: Column, system: str | None = None) -> Column:
    """Messages (structs of role, content) without the last; a system prompt replaces the first system message or goes before."""
    kept = F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))
    if system is None:
        return kept
    own = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    first = F.coalesce(F.try_element_at(kept, F.lit(1))["role"] == "system", F.lit(False))
    return F.concat(own, F.when(first, F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept))


def with_context(messages: Column, context: Column) -> Column:
    """Messages with the context appended to the last user message; raises without one."""
    last = F.array_max(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i)))
    told = F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == last, F.concat(m["content"], context)).otherwise(m["content"]).alias("content")))
    return F.when(last.isNull(), F.raise_error(F.lit("no user message"))).otherwise(told)


def chat_template(messages: Column, opening: str = "<|{}|>\n", closing: str = "\n", reply: str = "assistant") -> Column:
    """Messages rendered with a mark of the role before each, and the mark of the reply at the end."""
    before, after = opening.split("{}")
    return F.concat(F.array_join(F.transform(messages, lambda m: F.concat(F.lit(before), m["role"], F.lit(after), m["content"])), closing), F.lit(closing + opening.format(reply)))
