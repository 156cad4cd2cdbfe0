"""Secret scanning behind a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams: an OR of clauses,
each an AND of trigrams that every match must contain (in lower case). The index holds postings
(trigram, document) for the trigrams that some rule asks for. A clause's postings are intersected
by counting its trigrams per document; documents of a full clause are candidates of the rule, and
only those are searched with the expression. Rules without mandatory trigrams search every text.

Built-in functions only. Positions are code points. A match is found by splitting the text at the
expression, which gives the gaps, beside the list of matches, which gives their lengths.

NULL texts count as empty. Repeated rows get the same spans: postings are kept per distinct key
of (doc_id, text), and a hash collision of keys only adds candidates, never spans.
"""

from __future__ import annotations

import re._parser as parser
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of one clause that are followed before a part of a pattern counts as unknown.
MOST_SPELLINGS = 64


@dataclass(frozen=True)
class Rule:
    """``value_group`` of a match needs ``shortest`` characters, else the match is dropped."""

    kind: str
    pattern: str
    shortest: int = 0
    value_group: int = 0


# The three kinds of the contract.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # runs are maximal, so this is [0-9a-f]+ of 16 or more
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + ADDED


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses (OR) of trigrams (AND) in lower case, or None if a match need not hold any."""
    clauses: set[frozenset[str]] | None = None

    def grams(text: str) -> frozenset[str]:
        return frozenset(text[i : i + 3] for i in range(len(text) - 2))

    def spellings(node) -> set[str] | None:
        """All texts of a part, in lower case, or None if they are too many."""
        kind, value = node
        name = str(kind)
        if name == "LITERAL":
            return {chr(value).lower()}
        if name == "IN" and all(str(k) == "LITERAL" for k, _ in value):
            return {chr(v).lower() for _, v in value}
        if name == "SUBPATTERN":
            return joined(value[3])
        if name == "BRANCH":
            parts = [joined(x) for x in value[1]]
            return None if None in parts else set().union(*parts)
        if name in ("MAX_REPEAT", "MIN_REPEAT") and value[1] <= 1:
            once = joined(value[2])
            return None if once is None else once | ({""} if value[0] == 0 else set())
        return None

    def joined(nodes) -> set[str] | None:
        texts = {""}
        for node in nodes:
            more = spellings(node)
            if more is None or len(texts) * len(more) > MOST_SPELLINGS:
                return None
            texts = {a + b for a in texts for b in more}
        return texts

    def close(texts: set[str]) -> None:
        """Keep the run of known spellings that asks for most trigrams."""
        nonlocal clauses
        found = {grams(t) for t in texts}
        if all(found) and (clauses is None or min(map(len, found)) > min(map(len, clauses))):
            clauses = found

    run: set[str] = {""}
    for node in parser.parse(pattern):
        kind, value = node
        more = spellings(node)
        if more is not None and len(run) * len(more) <= MOST_SPELLINGS:
            run = {a + b for a in run for b in more}
            continue
        close(run)
        run = more if more is not None and len(more) <= MOST_SPELLINGS else {""}
    close(run)
    return None if clauses is None else sorted(clauses, key=sorted)


def _key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def postings(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """``key, trigram``: which of the asked trigrams each document holds, letters in either case."""
    low = docs.select(_key().alias("key"), F.lower("text").alias("low"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return low.select("key", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``key, kinds``: the indexed rules whose query each document satisfies.

    The clause table follows from the rules alone, so that its broadcast has their size.
    """
    spark = docs.sparkSession
    asked = []
    for rule in rules:
        for n, clause in enumerate(trigram_query(rule.pattern) or ()):
            asked += [(rule.kind, n, len(clause), t) for t in sorted(clause)]
    if not asked:
        return spark.createDataFrame([], "key bigint, kinds array<string>")
    clauses = spark.createDataFrame(asked, "kind string, clause int, size int, trigram string")
    index = postings(docs, sorted({t for *_, t in asked}))
    return (
        index.join(F.broadcast(clauses), "trigram")
        .groupBy("key", "kind", "clause", "size")
        .agg(F.count_distinct("trigram").alias("held"))
        .where("held = size")
        .groupBy("key")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def _spans(rule: Rule, number: int) -> Column:
    """Array of (start, number, end) of a rule's matches in ``text``."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, 0)
    value = F.regexp_extract_all(text, pattern, rule.value_group) if rule.value_group else whole
    size = F.transform(whole, lambda m: F.length(m))
    gap = F.transform(F.slice(F.split(text, rule.pattern), 1, F.size(whole)), lambda g: F.length(g))
    parts = F.transform(
        F.arrays_zip(gap.alias("gap"), size.alias("size"), F.transform(value, lambda v: F.length(v)).alias("value")),
        lambda x: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), (x["value"] >= rule.shortest).alias("good")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,number:int,end:int>>").alias("found"))

    def step(a: Column, x: Column) -> Column:
        begin, end = a["at"] + x["gap"], a["at"] + x["gap"] + x["size"]
        span = F.array(F.struct(begin.alias("start"), F.lit(number).alias("number"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["good"], F.concat(a["found"], span)).otherwise(a["found"]).alias("found"))

    found = F.aggregate(parts, start, step, lambda a: a["found"])
    return F.when(text.rlike(rule.pattern), found).otherwise(start["found"])


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with NULL texts emptied and ``secrets``: array of (start, number, end), sorted.

    ``number`` is the place of the rule in ``rules``. All columns of ``docs`` stay but a clashing one.
    """
    docs = docs.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    indexed = [r for r in rules if trigram_query(r.pattern) is not None]
    found = candidates(docs.select("doc_id", "text"), indexed).withColumnsRenamed({"key": "_key", "kinds": "_kinds"})
    joined = docs.withColumn("_key", _key()).join(found, "_key", "left")
    none = F.array().cast("array<struct<start:int,number:int,end:int>>")
    parts = [
        F.when(F.array_contains("_kinds", rule.kind), _spans(rule, n)).otherwise(none) if rule in indexed else _spans(rule, n)
        for n, rule in enumerate(rules)
    ]
    return joined.withColumn("secrets", F.sort_array(F.concat(*parts))).drop("_key", "_kinds")


def written(spans: Column, rules: Sequence[Rule]) -> Column:
    """Spans as ``kind:start:end``, joined with commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", kinds[s["number"]], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans give one mark."""
    found = find_secrets(docs.select("doc_id", "text", F.struct("*").alias("doc")), rules)
    text, spans = F.col("text"), F.col("secrets")
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept"))

    def step(a: Column, s: Column) -> Column:
        more = F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["kept"], more)).otherwise(a["kept"]).alias("kept"),
        )

    rest = lambda a: F.concat_ws("", a["kept"], F.array(F.substring(text, a["at"] + 1, F.length(text))))
    clean = F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, empty, step, rest))
    return found.select(F.col("doc").withField("text", clean).alias("doc")).select("doc.*")
