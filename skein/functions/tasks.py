"""Task rows as conversations, answer spans, grading, gate specifications: column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .draws import choice, shuffled, spelling_draws


@dataclass(frozen=True)
class Task:
    """A task: its rows, the conversation and the grade of each as columns, and how answers are compared.

    ``eval_type`` is ``generative`` (a completion is graded) or ``categorical``
    (a letter among ``letters`` is).
    """

    rows: DataFrame
    conversation: Column
    grade: Callable[[Column], Column]
    eval_type: str
    letters: Column | None = None

    def conversations(self) -> DataFrame:
        return self.rows.withColumn("messages", self.conversation)

    def graded(self, answer: str) -> DataFrame:
        """Rows with ``correct`` (boolean) and ``reward`` (0 or 1) of the column ``answer``."""
        out = self.rows.withColumn("correct", self.grade(F.col(answer)))
        return out.withColumn("reward", F.col("correct").cast("double"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def question_and_answer(question: Column, answer: Column) -> Column:
    return F.array(message("user", question), message("assistant", answer))


def choice_conversation(question: Column, letters: Column, choices: Column, answer: Column) -> Column:
    """A multiple-choice question and the letter at index ``answer``; choices without a letter are an error."""
    ok = F.size(letters) == F.size(choices)
    letter = F.when(~ok, F.raise_error(F.lit("letters and choices differ in number")).cast("string")).otherwise(F.element_at(letters, answer.cast("int") + 1))
    return question_and_answer(X.multiple_choice(question, letters, choices), letter)


def same_number(predicted: Column, reference: Column) -> Column:
    """Equal answers; where neither text has one, they count as equal."""
    return X.final_number(predicted).eqNullSafe(X.final_number(reference))


def same_letter(predicted: Column, reference: Column, letters: Column) -> Column:
    """Equal letters; a prediction that is no letter of the task is an error."""
    wrong = F.raise_error(F.concat(F.lit("no letter of the task: "), F.coalesce(predicted, F.lit("null")))).cast("boolean")
    return F.when(F.coalesce(F.array_contains(letters, predicted), F.lit(False)), predicted == reference).otherwise(wrong)


# ------------------------------------------------------------ answer spans


def spans_after_prefix(options: Column) -> Column:
    """``options`` share a head: (start, end) of what each has of its own behind it."""
    head = F.aggregate(F.slice(options, 2, F.size(options)), F.size(options[0]), lambda a, o: F.least(a, X.common_prefix(options[0], o)))
    return F.transform(options, lambda o: F.struct(head.alias("s"), F.size(o).alias("e")))


def spans_before_suffix(options: Column) -> Column:
    """``options`` share a tail: (start, end) of that tail in each."""
    tail = F.aggregate(F.slice(options, 2, F.size(options)), F.size(options[0]), lambda a, o: F.least(a, X.common_suffix(options[0], o)))
    return F.transform(options, lambda o: F.struct((F.size(o) - tail).alias("s"), F.size(o).alias("e")))


def span_of_continuation(without: Column, with_: Column) -> Column:
    """(start, end) of the continuation; ``without`` has to be the head of ``with_``."""
    n = F.size(without)
    ok = (n <= F.size(with_)) & (F.slice(with_, 1, n) == without)
    none = without.isNull() | with_.isNull()  # a null text has no span
    start = F.when(ok, n).when(none, F.lit(None).cast("int")).otherwise(F.raise_error(F.lit("the prompt is no head of the whole")).cast("int"))
    return F.struct(start.alias("s"), F.size(with_).alias("e"))


def left_cut(ids: Column, span: Column, limit: int) -> Column:
    """The last ``limit`` ids with the span moved along: ids, s, e. A span cut into is an error."""
    gone = F.greatest(F.size(ids) - limit, F.lit(0))
    start = F.when(ids.isNull(), F.lit(None).cast("int")).when(span["s"] >= gone, span["s"] - gone).otherwise(F.raise_error(F.lit("a span begins before the cut")).cast("int"))
    return F.struct(X.left_truncate(ids, limit).alias("ids"), start.alias("s"), (span["e"] - gone).alias("e"))


# ------------------------------------------------------------ gate specifications


def gate_kind(spec: Column) -> Column:
    """``auto[:t]``, ``donor[:stat]``, ``abs:n``, a number or ``[a, b]`` as (mode, value); null where it is none of them or a dial below zero.

    What follows a keyword, behind any colons, has to be its value and nothing else: ``auto0.1`` and
    ``donorp95`` are good, ``automatic`` is not.
    """
    number = r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*"

    def rest(keyword: str) -> Column:
        return F.regexp_extract(spec, rf"^{keyword}:*(.*)$", 1)

    def plain(value: Column) -> Column:
        return F.when(value.rlike(f"^{number}$"), value.try_cast("double").cast("string"))

    def kind(mode: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(mode).alias("mode"), value.alias("value")))

    dial = F.when(spec.rlike(f"^{number}$") & (spec.try_cast("double") >= 0), spec.try_cast("double").cast("string"))
    stat = rest("donor")
    donor = F.when(stat == "", F.lit("p50")).when(stat.isin("p50", "p90", "p95", "p99"), stat)
    vector = F.when(spec.rlike(rf"^\s*\[{number}(,{number})*\]\s*$"), spec)
    return (
        F.when(spec.startswith("auto"), kind("auto", F.when(rest("auto") == "", F.lit("0.05")).otherwise(plain(rest("auto")))))
        .when(spec.startswith("donor"), kind("donor", donor))
        .when(spec.startswith("abs"), kind("abs", plain(rest("abs"))))
        .when(spec.startswith("["), kind("vector", vector))
        .otherwise(kind("dial", dial))
    )


def report_value(rows: DataFrame, name: str) -> Column:
    """A column as a report states it, by its type: four places for numbers with a point, commas between the thousands of integers from 10,000 on, other values as they are.

    Places are rounded half up on the shortest decimal form of the number. A null is ``None``.
    """
    kind, value = rows.schema[name].dataType, F.col(name)
    if isinstance(kind, T.FloatType | T.DoubleType | T.DecimalType):
        value = value.cast("double")
        text = F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").otherwise(F.format_string("%.4f", value))
    elif isinstance(kind, T.IntegralType):
        text = F.when(value >= 10000, F.format_number(value, 0)).otherwise(value.cast("string"))
    elif isinstance(kind, T.BooleanType):
        text = F.when(value, "True").otherwise("False")
    else:
        text = value.cast("string")
    return F.when(F.col(name).isNull(), "None").otherwise(text)


def report_section(rows: DataFrame, title: Column, at: Column, names: list[str], notes: Column | None = None) -> Column:
    """A section of a report for each row: its title, its time, ``notes`` as they are, a line a value, and a blank line."""
    lines = [F.concat(F.lit(f"- {n}: "), report_value(rows, n), F.lit("\n")) for n in names]
    head = F.concat(F.lit("## "), title, F.lit("\ntimestamp: "), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("\n\n"))
    return F.concat(head, *([] if notes is None else [F.coalesce(notes, F.lit(""))]), *lines, F.lit("\n"))


def first_pattern(text: Column, table: list[tuple[str, float]], default: float | None = None) -> Column:
    """The value of the first pattern that ``text`` contains, in any case."""
    out = F.lit(default)
    for pattern, value in reversed(table):
        out = F.when(F.lower(text).contains(pattern.lower()), F.lit(value)).otherwise(out)
    return out


#: Ways to ask how often a letter is in a word (fixed values).
QUESTIONS = (
    "How many {letter} are in the word {word}",
    "How many {letter} are in the word {word}",
    "How many {letter} are in {word}",
    "Count the number of {letter} in {word}",
    "How many times does {letter} appear in {word}",
    "What's the count of {letter} in {word}",
    "In the word {word}, how many {letter} are there",
    "How many letter {letter} are in the word {word}",
    "Count how many {letter} appear in {word}",
    "Tell me the number of {letter} in {word}",
    "How many occurrences of {letter} are in {word}",
    "Find the count of {letter} in {word}",
    "Can you count the {letter} letters in {word}",
    "What is the frequency of {letter} in {word}",
    "How many {letter}s are in {word}",
    "How many {letter}'s are in {word}",
    "Count all the {letter} in {word}",
    "How many times is {letter} in {word}",
    "Number of {letter} in {word}",
    "Total count of {letter} in {word}",
    "How many {letter} does {word} have",
    "How many {letter} does {word} contain",
    "What's the number of {letter} in {word}",
    "{word} has how many {letter}",
    "In {word}, count the {letter}",
    "How many {letter} appear in {word}",
    "Count the {letter} in {word}",
    "Give me the count of {letter} in {word}",
    "How many instances of {letter} in {word}",
    "Show me how many {letter} are in {word}",
    "Calculate the number of {letter} in {word}",
    "¿Cuántas {letter} hay en {word}?",
    "¿Cuántas veces aparece {letter} en {word}?",
    "Cuenta las {letter} en {word}",
    "¿Cuántas letras {letter} tiene {word}?",
    "{word}中有多少个{letter}",
    "{word}里有几个{letter}",
    "数一下{word}中的{letter}",
    "{word}这个词里有多少{letter}",
    "{word}에 {letter}가 몇 개 있나요",
    "{word}에서 {letter}의 개수는",
    "{word}에 {letter}가 몇 번 나오나요",
    "{word}라는 단어에 {letter}가 몇 개",
    "Combien de {letter} dans {word}",
    "Combien de fois {letter} apparaît dans {word}",
    "Compte les {letter} dans {word}",
    "Wie viele {letter} sind in {word}",
    "Wie oft kommt {letter} in {word} vor",
    "Zähle die {letter} in {word}",
    "{word}に{letter}は何個ありますか",
    "{word}の中に{letter}がいくつ",
    "{word}に{letter}が何回出てくる",
)
#: The seeds of a test split begin here (fixed value).
TEST_SEEDS = 10_000_000


def drawn_words(indices: DataFrame, words: DataFrame, seed: int) -> DataFrame:
    """``indices(index)`` with the ``word`` that each draws out of ``words(idx, word)``, whose ``idx`` counts from 0, and ``words``, their number."""
    n = words.count()
    drawn = indices.select("index", F.lit(n).cast("long").alias("words"))
    drawn = drawn.withColumn("_at", choice(seed)(F.col("index"), F.col("words")))
    return drawn.join(words.select(F.col("idx").alias("_at"), "word"), "_at").drop("_at")


def counted_letters(word: Column, letter: Column) -> Column:
    """The letters of a word a line, with the count so far where it is ``letter``."""
    letters = F.split(word, "")
    hits = lambda i: F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda x: x == letter)).cast("string")
    line = lambda c, i: F.concat((i + 1).cast("string"), F.lit(":"), c, F.when(c == letter, F.concat(F.lit(" hit! count="), hits(i))).otherwise(""), F.lit("\n"))
    return F.array_join(F.transform(letters, line), "")


def spelling_conversations(indices: DataFrame, words: DataFrame, split: str = "train", questions: tuple[str, ...] = QUESTIONS) -> DataFrame:
    """index, word, letter, answer, asked and parts (type, text) of the conversation of each index.

    ``words(idx, word)`` is the word list in its order. Empty words give no conversation.
    """
    seed = TEST_SEEDS if split == "test" else 0
    d = drawn_words(indices, words, seed)
    d = d.withColumn("d", spelling_draws(seed, len(questions))(F.col("index"), F.col("words"), F.col("word"))).where("d IS NOT NULL")
    word, letter = F.col("word"), F.col("d")["letter"]
    template = F.element_at(F.array(*map(F.lit, questions)), F.col("d")["template"] + 1)
    template = F.when(F.col("d")["lower"], F.lower(template)).otherwise(template)
    around = lambda q, x: F.concat(F.col("d")[q], x, F.col("d")[q])
    asked = F.replace(F.replace(template, F.lit("{letter}"), around("letter_quote", letter)), F.lit("{word}"), around("word_quote", word))
    asked = F.concat(asked, F.when(F.col("d")["mark"], "?").otherwise(""))
    answer = F.size(F.filter(F.split(word, ""), lambda x: x == letter))
    count = answer.cast("string")
    steps = F.concat(
        F.lit("We are asked to find the number '"), letter, F.lit("' in the word '"), word, F.lit("'. Let me try a manual approach first.\n\nFirst spell the word out:\n"), spelled(word),
        F.lit("\n\nThen count the occurrences of '"), letter, F.lit("':\n"), counted_letters(word, letter), F.lit("\nThis gives us "), count, F.lit("."),
    )
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    parts = F.array(
        part("text", steps), part("text", F.lit("\n\nLet me double check this using Python:\n\n")), part("python", F.concat(F.lit("'"), word, F.lit("'.count('"), letter, F.lit("')"))),
        part("python_output", count), part("text", F.concat(F.lit("\n\nPython gives us "), count, F.lit(".\n\nMy final answer is:\n\n#### "), count)),
    )
    return d.select("index", "word", letter.alias("letter"), answer.alias("answer"), asked.alias("asked"), parts.alias("parts"))


def spelled(word: Column) -> Column:
    return F.concat(word, F.lit(":"), F.array_join(F.split(word, ""), ","))


def spelling_only(indices: DataFrame, words: DataFrame, split: str = "train", order_seed: int = 42) -> DataFrame:
    """index, word, asked and answered: a word to spell, drawn out of the list in a seeded order of its own."""
    order = shuffled(words, "idx", order_seed).select(F.col("place").alias("idx"), "word")
    d = drawn_words(indices, order, TEST_SEEDS if split == "test" else 0)
    return d.select("index", "word", F.concat(F.lit("Spell the word: "), "word").alias("asked"), spelled(F.col("word")).alias("answered"))
