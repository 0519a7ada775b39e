"""Quality rules as a ledger of failure bits.

``ledger`` evaluates every rule once per document and keeps the measurements and one bit per
failed rule. A policy is a named, versioned mask over the bits, so another policy is a bitwise
``and`` over stored rows and never a second look at a text; ``ablations`` reads what each rule
alone rejects from counts by bit pattern.

Only SQL functions run. Defined cases: a null text has no words and fails; an empty table gives an
empty ledger; repeated rows are judged alike; columns of the input that clash with the ledger's
own names are replaced by the ledger's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintager.llm.common import WORD, once

BLANKS = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A named condition under which a document fails, over the measurements."""

    name: str
    fails: str


# The position of a rule is its bit; append, never reorder, as ledgers are stored.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
    Rule("capitals", "100 * n_capitals > 50 * n_letters"),
)
BASE = ("few_words", "repeated_words")
POLICIES = {
    "base-1": BASE,
    "base-2": (*BASE, "word_length"),
    "strict-1": tuple(rule.name for rule in RULES),
}
PRODUCTION = "strict-1"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_letters", "n_capitals",
)


def mask(names: tuple[str, ...]) -> int:
    """The bits of the named rules."""
    bits = {rule.name: 1 << i for i, rule in enumerate(RULES)}
    return sum(bits[name] for name in names)


def _length(text: Column) -> Column:
    return F.length(text).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements of every whole text."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.drop(*MEASURES)
    parts = docs.withColumns(
        {
            "__words": once(F.regexp_extract_all(body, F.lit(f"({WORD})"), F.lit(1))),
            "__lines": F.filter(
                F.split(body, "\n", -1),
                lambda line: F.length(F.translate(line, BLANKS, "")) > 0,
            ),
        }
    )
    # A window of three words is their joined text: the blank occurs in no word.
    grams = parts.withColumn(
        "__grams",
        F.when(
            F.size("__words") >= 3,
            F.zip_with(
                F.zip_with(
                    F.expr("slice(__words, 1, size(__words) - 2)"),
                    F.expr("slice(__words, 2, size(__words) - 2)"),
                    lambda a, b: F.concat_ws(" ", a, b),
                ),
                F.expr("slice(__words, 3, size(__words) - 2)"),
                lambda a, b: F.concat_ws(" ", a, b),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )
    # Only texts with a repeated window sort theirs; equal windows are then neighbours.
    ranked = grams.withColumn(
        "__ranked",
        once(
            F.when(
                F.size(F.array_distinct("__grams")) < F.size("__grams"),
                F.expr("array_sort(transform(__grams, (g, i) -> struct(g AS g, i AS i)))"),
            )
        ),
    ).drop("__grams")
    places = ranked.withColumn(
        "__places",
        once(
            F.expr(
                "array_sort(transform(filter(__ranked, (x, j) -> get(__ranked, j - 1).g <=> x.g"
                " OR get(__ranked, j + 1).g <=> x.g), x -> x.i))"
            )
        ),
    ).drop("__ranked")
    covered = (
        "aggregate(transform(__places, (p, j) -> least(3, coalesce(get(__places, j + 1) - p, 3))),"
        " 0L, (a, x) -> a + x)"
    )
    solid = F.translate(body, BLANKS, "")
    return places.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": _length(solid),
            "n_symbols": _length(body) - _length(F.translate(body, SYMBOLS, "")),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.expr(covered), F.lit(0)).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_letters": _length(F.regexp_replace(body, r"\P{L}+", "")),
            "n_capitals": _length(F.regexp_replace(body, r"\P{Lu}+", "")),
        }
    ).drop("__words", "__lines", "__places")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``fail_bits``: bit i is set where ``RULES[i]`` fails."""
    rows = measured(docs, text).drop("fail_bits")
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), 1 << i).otherwise(0).cast("long"))
    return rows.withColumn("fail_bits", bits)


def passes(policy: str) -> Column:
    """Whether a ledger row passes the named policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Per rule of a policy: documents that fail it, and that would stay without it.

    The ledger is reduced to one count per bit pattern before anything else; patterns are bounded
    by two to the number of rules.
    """
    used = mask(POLICIES[policy])
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(used)).alias("bits")).agg(
        F.count("*").alias("n")
    )
    rules = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.lit(mask((name,))).cast("long").alias("bit"))
            for name in POLICIES[policy]
        ]
    )
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(fails, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias(
            "failed_alone"
        ),
        F.coalesce(F.sum(F.when(F.col("bits") == 0, F.col("n"))), F.lit(0)).alias("kept"),
    )


def judged(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The ledger with the base verdict and the policy's."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE))) != 0
    return ledger(docs).drop("base_failed", "kept").withColumns(
        {"base_failed": base, "kept": ~base & passes(policy)}
    )
