"""Column expressions for prompts, answers, conversations and spans."""

from __future__ import annotations

import ast
import operator
import re

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digit groups of one or two, letters with one leading mark, marks, line ends, white space (a fixed pattern).
SPLIT_PATTERN = r"(?U)'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SPLIT_PATTERN), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def multiple_choice(question: Column, letters: Column, choices: Column) -> Column:
    """The question, a line per choice with its letter behind it, and the request for the letter."""
    n = F.least(F.size(letters), F.size(choices))
    lines = F.zip_with(F.slice(choices, 1, n), F.slice(letters, 1, n), lambda c, l: F.concat(F.lit("- "), c, F.lit("="), l, F.lit("\n")))
    return F.concat(F.lit("Multiple Choice question: "), question, F.lit("\n"), F.array_join(lines, ""), F.lit("\nRespond only with the letter of the correct answer."))


def choice_prompts(query: Column, choices: Column, delimiter: str, shots: Column | None = None) -> Column:
    """One prompt per choice; ``shots`` are solved examples, already text."""
    head = F.lit("") if shots is None else F.array_join(F.transform(shots, lambda s: F.concat(s, F.lit("\n\n"))), "")
    return F.transform(choices, lambda c: F.concat(head, query, F.lit(delimiter), c))


def schema_prompts(contexts: Column, continuation: Column, delimiter: str, shots: Column | None = None) -> Column:
    head = F.lit("") if shots is None else F.array_join(F.transform(shots, lambda s: F.concat(s, F.lit("\n\n"))), "")
    return F.transform(contexts, lambda c: F.concat(head, c, F.lit(delimiter), continuation))


def lm_prompts(context: Column, continuation: Column, delimiter: str) -> Column:
    """(without, with) the continuation; the first has no white space at its ends."""
    stem = F.concat(strip(context), F.lit(delimiter))
    return F.array(strip(stem), F.concat(stem, continuation))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.least(F.when(first == 0, F.size(same)).otherwise(first - 1), F.size(a), F.size(b)).cast("int")


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def pad(ids: Column, size: Column, fill: Column) -> Column:
    return F.concat(ids, F.array_repeat(fill, (size - F.size(ids)).cast("int")))


def left_truncate(ids: Column, limit: int) -> Column:
    return F.when(F.size(ids) > limit, F.slice(ids, -limit, limit)).otherwise(ids)


def final_number(text: Column) -> Column:
    """The number behind ``#### ``, without commas; null where there is none."""
    found = F.regexp_extract(text, r"#### (\-?[0-9\.\,]+)", 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit("")))


def tool_parts(answer: Column) -> Column:
    """``a<<x=y>>b`` as ordered parts: text, python (x) and python_output (y), split at the last ``=``."""
    lead = F.when(answer.startswith("<<"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    pieces = F.concat(lead, F.split(answer, r"(?=<<[^>]+>>)|(?<=>>)"))

    def part(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    def expand(p: Column) -> Column:
        inner = p.substr(F.lit(3), F.length(p) - 4)
        result = F.substring_index(inner, "=", -1)
        expr = F.when(inner.contains("="), inner.substr(F.lit(1), F.length(inner) - F.length(result) - 1)).otherwise(inner)
        call = F.array(part("python", expr), part("python_output", F.when(inner.contains("="), result).otherwise(F.lit(""))))
        return F.when(p.rlike(r"^<<[^>]+>>$"), call).otherwise(F.array(part("text", p)))

    return F.flatten(F.transform(pieces, expand))


def import_lines(prompt: Column) -> Column:
    """The import lines at a prompt's head: comments and blank lines between them are skipped, code ends them."""

    def step(acc: Column, line: Column) -> Column:
        t = strip(line)
        is_import = t.startswith("import ") | t.startswith("from ")
        stop = acc["stop"] | (~is_import & (t != "") & ~t.startswith("#"))
        return F.struct(stop.alias("stop"), F.when(~stop & is_import, F.concat(acc["lines"], F.array(t))).otherwise(acc["lines"]).alias("lines"))

    start = F.struct(F.lit(False).alias("stop"), F.array().cast("array<string>").alias("lines"))
    return F.array_join(F.aggregate(F.split(prompt, "\n"), start, step)["lines"], "\n")


def code_block(completion: Column) -> Column:
    """The first fenced block, else the whole text, without white space at its ends."""
    found = F.regexp_extract(completion, r"(?s)```(?:python)?\s*\n(.*?)\n```", 1)
    return strip(F.when(found != "", found).otherwise(completion))


def conversation_error(roles: Column, contents: Column) -> Column:
    """The first rule a conversation breaks, or null: optional system turn, then two turns or more, user and assistant in turn, no empty text."""
    rest = F.when(roles[0] == "system", F.slice(roles, F.lit(2), F.greatest(F.size(roles) - 1, F.lit(0)))).otherwise(roles)
    turns = F.forall(F.transform(rest, lambda r, i: (r == F.when(i % 2 == 0, "user").otherwise("assistant"))), lambda x: x)
    blank = F.exists(contents, lambda c: F.coalesce(strip(c), F.lit("")) == "")
    return F.when(F.size(rest) < 2, "fewer than two turns").when(~turns, "roles do not alternate").when(blank, "empty text")


def program(prompt: Column, completion: Column, test: Column, entry: Column) -> Column:
    """A program to run elsewhere: the prompt's imports, the completion's code, the test and the call that checks ``entry``."""
    return F.concat(import_lines(prompt), F.lit("\n\n"), code_block(completion), F.lit("\n\n"), test, F.lit("\ncheck("), entry, F.lit(")"))


#: Limits of a chat request (fixed values).
LIMITS = {"messages": 500, "message": 8000, "conversation": 32000, "temperature": (0.0, 2.0), "top_k": (0, 200), "max_tokens": (1, 4096)}


def list_error(messages: Column) -> Column:
    """The rule a line of messages breaks, or null: two messages or more, texts that are there."""
    return F.when(F.size(messages) < 2, "fewer than two messages").when(F.exists(messages, lambda m: m["content"].isNull()), "a text is missing")


def blank_error(messages: Column) -> Column:
    """As ``list_error``, and no text of white space alone."""
    return F.coalesce(list_error(messages), F.when(F.exists(messages, lambda m: strip(m["content"]) == ""), "empty text"))


def request_error(messages: Column, temperature: Column, top_k: Column, max_tokens: Column) -> Column:
    """The first rule a chat request breaks, or null; settings that are null are not checked."""
    total = F.aggregate(messages, F.lit(0), lambda a, m: a + F.coalesce(F.length(m["content"]), F.lit(0)))
    out = F.when(F.size(messages) == 0, "no message").when(F.size(messages) > LIMITS["messages"], "too many messages")
    out = out.when(F.exists(messages, lambda m: F.coalesce(m["content"], F.lit("")) == ""), "empty text")
    out = out.when(F.exists(messages, lambda m: F.length(m["content"]) > LIMITS["message"]), "a message is too long").when(total > LIMITS["conversation"], "the conversation is too long")
    out = out.when(F.exists(messages, lambda m: ~F.coalesce(m["role"].isin("user", "assistant"), F.lit(False))), "unknown role")
    for name, value in (("temperature", temperature), ("top_k", top_k), ("max_tokens", max_tokens)):
        lo, hi = LIMITS[name]
        out = out.when((value < lo) | (value > hi), f"{name} out of range")
    return out


def report_field(section: Column, key: str) -> Column:
    """The text behind the colon of the last line that has ``key``, up to a second colon; null without one."""
    lines = F.filter(F.split(section, "\n"), lambda l: l.contains(key))
    return F.when(F.size(lines) > 0, strip(F.split(F.element_at(lines, -1), ":")[1]))


def report_time(section: Column, prefix: str) -> Column:
    """The time behind the first line that begins with ``prefix`` and has one."""
    lines = F.filter(F.split(section, "\n"), lambda l: l.startswith(prefix))
    times = F.filter(F.transform(lines, lambda l: F.try_to_timestamp(strip(F.regexp_replace(l, "^[^:]*:", "")), F.lit("yyyy-MM-dd HH:mm:ss"))), lambda t: t.isNotNull())
    return F.when(F.size(times) > 0, times[0])


def merge_system(messages: Column) -> Column:
    """A leading system message becomes the head of the first user message."""
    merged = F.struct(messages[1]["role"].alias("role"), F.concat(messages[0]["content"], F.lit("\n\n"), messages[1]["content"]).alias("content"))
    return F.when(messages[0]["role"] == "system", F.concat(F.array(merged), F.slice(messages, F.lit(3), F.greatest(F.size(messages) - 2, F.lit(0))))).otherwise(messages)


def clamp_spans(spans: Column, text: Column) -> Column:
    """Spans within the text, inverted ones turned round; all of a null text are empty."""
    n = F.coalesce(F.length(text), F.lit(0))

    def fix(s: Column) -> Column:
        a, b = (F.least(F.greatest(s[k], F.lit(0)), n) for k in ("s", "e"))
        return F.struct(F.least(a, b).alias("s"), F.greatest(a, b).alias("e"))

    return F.transform(spans, fix)


def cut_at(text: Column, points: Column) -> Column:
    """The text cut at character offsets; an empty text is one empty piece, a null text null."""
    inner = F.filter(points, lambda p: (p > 0) & (p < F.length(text)))
    marks = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), inner, F.array(F.length(text)))))
    starts, ends = F.slice(marks, 1, F.size(marks) - 1), F.slice(marks, 2, F.size(marks))
    return F.when(text == "", F.array(F.lit(""))).when(text != "", F.zip_with(starts, ends, lambda a, b: F.substr(text, a + 1, b - a)))


def shift_targets(ids: Column, mask: Column, ignore: int = -1) -> Column:
    """Next-token targets; ``ignore`` where the target is not trained on."""
    n = F.size(ids) - 1
    return F.zip_with(F.slice(ids, 2, n), F.slice(mask, 2, n), lambda t, m: F.when(m == 1, t).otherwise(F.lit(ignore)))


def slugify(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit("-"))


# ------------------------------------------------------------ calculator

_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv}
_SIGNS = {ast.UAdd: operator.pos, ast.USub: operator.neg}
_ARITHMETIC = re.compile(r"[0-9*+\-/.() ]*")
#: Bits that a whole number may reach; larger results count as none.
MOST_BITS = 1 << 14


def _evaluated(tree: ast.AST) -> int | float:
    """The value of an arithmetic tree of any depth."""
    todo: list[tuple[ast.AST, bool]] = [(tree, False)]
    values: list[int | float] = []
    while todo:
        n, ready = todo.pop()
        if isinstance(n, ast.Constant) and type(n.value) in (int, float):
            values.append(n.value)
        elif isinstance(n, ast.UnaryOp) and type(n.op) in _SIGNS:
            if ready:
                values.append(_SIGNS[type(n.op)](values.pop()))
            else:
                todo += [(n, True), (n.operand, False)]
        elif isinstance(n, ast.BinOp) and type(n.op) in _OPS:
            if ready:
                right = values.pop()
                values.append(_OPS[type(n.op)](values.pop(), right))
                if isinstance(values[-1], int) and values[-1].bit_length() > MOST_BITS:
                    raise OverflowError
            else:
                todo += [(n, True), (n.right, False), (n.left, False)]
        else:
            raise ValueError
    return values.pop()


def calculate(expr: str | None) -> str | None:
    """Arithmetic with + - * / // and brackets, or ``'text'.count('x')``; None for all else. Commas go first; nothing is executed."""
    if expr is None:
        return None
    expr = expr.replace(",", "").strip()
    arithmetic = _ARITHMETIC.fullmatch(expr) is not None
    if (arithmetic and "**" in expr) or not (arithmetic or ".count(" in expr):
        return None
    try:
        tree = ast.parse(expr, mode="eval").body
        if arithmetic:
            return str(_evaluated(tree))
        if isinstance(tree, ast.Call) and len(tree.args) == 1 and not tree.keywords and isinstance(f := tree.func, ast.Attribute) and f.attr == "count":
            text, part = (n.value if isinstance(n, ast.Constant) else None for n in (f.value, tree.args[0]))
            return str(text.count(part)) if isinstance(text, str) and isinstance(part, str) else None
    except (SyntaxError, ValueError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        pass
    return None


@F.pandas_udf(T.StringType())
def calculator(expressions: pd.Series) -> pd.Series:
    return expressions.map(calculate, na_action="ignore")
