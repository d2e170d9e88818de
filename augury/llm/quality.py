"""Quality rules as a short-circuit cascade.

Each rule is a predicate over statistics of one text. A sample of bounded expected size gives each rule's cost
and the share of texts that it rejects; the cascade is one CASE that tries the rules in the
order of rejections per cost, so a text rejected by a cheap rule never pays for a costly one.
The order changes the cost and the reported first reason only, never the verdict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.llm.common import SPACES, text_or_empty, words_of

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2000
SAMPLE_SEED = 5
#: Steps that a statistic takes for each character or word of a text, relative to each other, as measured once in codegen.
#: Words are split off for all of them.
WORK = {"n_words": {"words": 0.1}, "word_chars": {"chars": 1.0}, "n_symbols": {"chars": 1.0}, "n_dup_lines": {"chars": 1.5}, "n_repeat_words": {"words": 20.0}}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blank_free(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(text: Column) -> Column:
    """Code points in words: all but white space."""
    return F.char_length(_blank_free(text)).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(_blank_free(line)) > 0)
    return _let(lines, lambda kept: F.size(kept) - F.size(F.array_distinct(kept))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text, the first occurrence included.

    Windows are compared by a 64-bit hash of their three words. Equal hashes are found by sorting
    (hash, position), so the cost is n log n however long or repetitive the text is.
    """

    def covered(sorted_hits: Column) -> Column:
        n = F.size(sorted_hits)
        same = lambda x, k: (k >= 1) & (k <= n) & (F.get(sorted_hits, k - 1)["h"] == x["h"])
        twice = F.filter(sorted_hits, lambda x, k: same(x, k) | same(x, k + 2))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def count(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(words) - 3)
        hashes = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
        spread = lambda hs: F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = _let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(_let(spread(hs), covered)))
        return F.when(F.size(words) < 4, 0).otherwise(found)

    return _let(words, count).cast("long")  # else the optimizer may put the split into the lambda, once a word


#: The statistics of a text, and those of its words.
OF_TEXT: dict[str, Callable[[Column], Column]] = {"word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines}
OF_WORDS: dict[str, Callable[[Column], Column]] = {"n_words": n_words, "n_repeat_words": n_repeat_words}


def stat_of(name: str, text: Column, words: Column) -> Column:
    return OF_TEXT[name](text) if name in OF_TEXT else OF_WORDS[name](words)


@dataclass(frozen=True)
class Rule:
    """A text fails if fails(stat) is true, where stat(name) is the column of a statistic."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: Production rules: length, repetition, length of words, symbols, repeated lines.
RULES = (
    Rule("too_short", lambda s: s("n_words") < 50),
    Rule("repeated_windows", lambda s: 100 * s("n_repeat_words") > 50 * s("n_words")),
    Rule("short_words", lambda s: s("word_chars") < 2 * s("n_words")),
    Rule("long_words", lambda s: s("word_chars") > 20 * s("n_words")),
    Rule("symbols", lambda s: 10 * s("n_symbols") > s("n_words")),
    Rule("repeated_lines", lambda s: 10 * s("n_dup_lines") > s("n_words")),
)
BASE_RULES = ("too_short", "repeated_windows")


def order_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling rejections per cost, both measured on a row sample of about sample_rows texts.

    A rule's cost is the work of the statistics that it asks for: steps over the sample's characters and
    words, weighted by WORK. One job gives everything, and always the same for the same rows. Without
    any text, and among equal rules, the given order stays.
    """
    texts = docs.select(text_or_empty(text_col).alias("text"))
    if (rows := texts.count()) > sample_rows:
        texts = texts.sample(fraction=sample_rows / rows, seed=SAMPLE_SEED)
    stat = lambda words: lambda name: stat_of(name, F.col("text"), words)
    asked = {rule.name: _statistics(rule) for rule in rules}
    failed = _let(words_of(F.col("text")), lambda words: F.struct(*[F.coalesce(rule.fails(stat(words)), F.lit(False)).alias(rule.name) for rule in rules], F.size(words).alias("__words")))
    seen = texts.select(failed.alias("f"), F.char_length("text").alias("chars"))
    hits = [F.count_if(F.col("f")[rule.name]).alias(rule.name) for rule in rules]
    found = seen.agg(F.count(F.lit(1)).alias("__n"), F.sum("chars").alias("__chars"), F.sum("f.__words").alias("__words"), *hits).first()
    if not found["__n"]:
        return list(rules)
    size = {"chars": found["__chars"], "words": found["__words"], "texts": found["__n"]}
    work = {name: sum(times * size[unit] for unit, times in steps.items()) for name, steps in WORK.items()}
    value = {rule.name: found[rule.name] / (size["texts"] + sum(work[name] for name in asked[rule.name])) for rule in rules}
    return sorted(rules, key=lambda rule: -value[rule.name])


def _statistics(rule: Rule) -> set[str]:
    """The names of the statistics that a rule asks for."""
    names: set[str] = set()

    def asked(name: str) -> Column:
        names.add(name)
        return F.lit(0)

    rule.fails(asked)
    return names


def _judge(text: Column, verdict: Callable[[Callable[[str], Column]], Column]) -> Column:
    """verdict(stat) on a text: its words are split once, and each statistic is computed where and if the verdict asks for it."""
    return _let(words_of(text), lambda words: verdict(lambda name: stat_of(name, text, words)))


def cascade(rules: list[Rule], stat: Callable[[str], Column]) -> Column:
    """The name of the first failing rule, null if none fails. CASE evaluates no rule after that."""
    out = F
    for rule in rules:
        out = out.when(F.coalesce(rule.fails(stat), F.lit(False)), F.lit(rule.name))
    return out if rules else F.lit(None).cast("string")


def quality_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id, the statistics, base_failed, failed_rule, kept.

    Who wants the statistics has all of them computed; the cascade then only reads them. keep_good is
    the form that stops at the first rule that fails.
    A null text counts as one without words. Rows are independent: repeated rows each get a row,
    null ids stay null, other columns are not read. An empty table gives no rows.
    """
    order = order_rules(docs, text_col, rules)
    text = text_or_empty(text_col)
    every = _judge(text, lambda stat: F.struct(*[stat(name).alias(name) for name in STATS]))
    stats = docs.select(F.col(id_col).alias("doc_id"), every.alias("s")).select("doc_id", *[F.col(f"s.{name}").alias(name) for name in STATS])
    base = cascade([r for r in rules if r.name in BASE_RULES], F.col).isNotNull()
    return stats.withColumns({"base_failed": base, "failed_rule": cascade(order, F.col)}).withColumn("kept", F.col("failed_rule").isNull())


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows, with all their columns, that no rule rejects. Statistics are computed rule by rule, as far as needed."""
    text = text_or_empty(text_col)
    order = order_rules(docs, text_col, rules)
    return docs.filter(_judge(text, lambda stat: cascade(order, stat).isNull()))
