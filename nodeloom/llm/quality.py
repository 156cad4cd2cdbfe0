"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one ``failures``
long whose bit ``n`` says that rule ``n`` failed. Policies are named, versioned masks over those
bits, so that a policy is applied, changed or ablated on the ledger with bit operations and the
texts are not read again. Everything is built-in column functions within the row: no shuffle
before the ablation, whose only shuffle is of one row per task and distinct mask.

NULL and empty texts have no words, so they fail the base rule. Repeated rows are judged alike.
A very long text is measured whole within its row: its words must fit in the memory of a task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.columns import words

MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A bit of the ledger: ``fails`` is a condition over the measurements."""

    bit: int
    name: str
    fails: Callable[[Column], Column]


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules. A document passes when no bit of ``mask`` is set."""

    version: str
    mask: int


RULES = (
    Rule(0, "few_words", lambda m: m["n_words"] < 50),
    Rule(1, "repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule(2, "symbols", lambda m: 100 * m["n_symbols"] > 20 * m["word_chars"]),
    Rule(3, "short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule(4, "long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
    Rule(5, "repeated_lines", lambda m: (m["n_dup_lines"] > 2) & (100 * m["n_dup_lines"] > 40 * m["n_lines"])),
)
BASE = Policy("base-1", 0b000011)
STRICT = Policy("strict-1", 0b111111)


def _repeated_words(w: Column) -> Column:
    """Words inside three-word windows that the text holds at least twice.

    Windows are compared by 64-bit hashes. Texts without any repetition, told by a hash set, are
    done; others sort (hash, position) once, so that equal windows are neighbours.
    """
    last = F.size(w) - 3
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def covered(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return _let(F.sort_array(_let(order, twice)), _spread)

    def twice(order: Column) -> Column:
        """Positions whose hash is also that of a neighbour in the order."""
        before = F.transform(order, lambda x, i: x["h"] == order[F.greatest(i - 1, F.lit(0))]["h"])
        return _let(
            before,
            lambda b: F.transform(
                F.filter(order, lambda x, i: ((i > 0) & b[i]) | ((i < F.size(b) - 1) & b[F.least(i + 1, F.size(b) - 1)])),
                lambda x: x["p"],
            ),
        )

    return F.when(last < 0, F.lit(0)).otherwise(
        _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    )


def _spread(p: Column) -> Column:
    """Positions covered by windows of three that start at the rising positions ``p``."""
    gap = F.transform(p, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - p[F.greatest(i - 1, F.lit(0))])))
    return F.aggregate(gap, F.lit(0), lambda a, x: a + x)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def _judged(rules: tuple[Rule, ...]) -> Column:
    """The measurements of ``text`` and ``failures`` as one struct.

    One expression with its parts bound to names: a filter on it can be moved by the optimizer
    without words being cut again for every use of them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = F.struct(text.alias("text"), words(text).alias("words"), lines.alias("lines"))

    def measured(c: Column) -> Column:
        w, held = c["words"], c["lines"]
        symbols = F.length(c["text"]) - F.length(F.regexp_replace(c["text"], r"[#*$%&|<>]+", ""))
        found = (F.size(w), F.length(F.concat_ws("", w)), symbols, F.size(held), F.size(held) - F.size(F.array_distinct(held)), _let(w, _repeated_words))
        return F.struct(*(x.cast("long").alias(n) for n, x in zip(MEASUREMENTS, found)))

    def judged(m: Column) -> Column:
        bits = F.lit(0).cast("long")
        for rule in rules:
            bits = bits.bitwiseOR(F.when(rule.fails(m), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
        return F.struct(*(m[n].alias(n) for n in MEASUREMENTS), bits.alias("failures"))

    return _let(_let(cut, measured), judged)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, the measurements and ``failures``, the bits of the rules that the document fails."""
    return docs.select("doc_id", _judged(rules).alias("_judged")).select("doc_id", "_judged.*")


def keep_passing(docs: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that pass the policy."""
    return docs.where(_judged(rules)["failures"].bitwiseAND(F.lit(policy.mask)) == 0)


def passes(policy: Policy) -> Column:
    return F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it rejects, and kept without it.

    The ledger is first reduced to one row per distinct mask (at most two to the number of rules).
    """
    counts = book.groupBy(F.col("failures").bitwiseAND(F.lit(policy.mask)).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    within = [r for r in rules if policy.mask >> r.bit & 1]
    each = counts.withColumn("rule", F.explode(F.array(*(F.struct(F.lit(r.name).alias("name"), F.lit(1 << r.bit).cast("long").alias("b")) for r in within))))
    m, b, n = F.col("m"), F.col("rule.b"), F.col("n")
    total = lambda condition: F.sum(F.when(condition, n).otherwise(0))
    return each.groupBy(F.col("rule.name").alias("rule")).agg(
        F.lit(policy.version).alias("policy"),
        total(m.bitwiseAND(b) != 0).alias("failed"),
        total(m == b).alias("only_this_rule"),
        total((m == 0) | (m == b)).alias("kept_without"),
    )


def compare_policies(book: DataFrame, policies: Mapping[str, Policy]) -> DataFrame:
    """One row per policy: its version, mask, and documents kept."""
    counts = book.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    rows = [F.struct(F.lit(k).alias("name"), F.lit(p.version).alias("version"), F.lit(p.mask).cast("long").alias("mask")) for k, p in policies.items()]
    each = counts.withColumn("p", F.explode(F.array(*rows)))
    keeps = F.col("failures").bitwiseAND(F.col("p.mask")) == 0
    return each.groupBy("p.name", "p.version", "p.mask").agg(F.sum(F.when(keeps, F.col("n")).otherwise(0)).alias("kept"))
