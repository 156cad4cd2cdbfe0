"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.llm import chat, decontaminate, hidden_markov, infill, language_id, mixing, near_dedup, quality, secret_scan, spelling, suffix_dedup, token_counts, warc
from nodeloom.llm.columns import fold_number
from nodeloom.runtime import work_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_chat_formatting")
def _(spark, d):
    """All conversations and one, numbered -1, that speaks in control strings."""
    said = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    extra = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string")
    talks = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.render(chat.fold(chat.event_log(talks)))
    whole = out.select("conv_id", "pieces", chat.formatted(F.col("pieces")).alias("text"))
    read = whole.select("conv_id", "pieces", "text", chat.read_turns(F.col("text")).alias("turns"))
    loss = F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: chat.unescape(p["text"]))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select("conv_id", "text", F.size("turns").cast("long").alias("n_turns"), F.concat_ws("", lines).alias("lines"), F.concat_ws("", loss).alias("loss")).select(
        "conv_id",
        "n_turns",
        F.sha2("lines", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )


@query("op3_quality_rules")
def _(spark, d):
    book = quality.ledger(table(spark, d, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(quality.BASE)).alias("base_failed"),
        quality.passes(quality.STRICT).alias("kept"),
        "failures",
    )


@query("op4_secret_scans")
def _(spark, d):
    rules = secret_scan.RULES
    found = secret_scan.find_secrets(table(spark, d, "documents").select("doc_id", "text"), rules)
    number = {r.kind: n for n, r in enumerate(rules)}
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["number"] == number[kind])).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["number"] < len(secret_scan.BASE))
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"),
        F.sha2(secret_scan.written(base, rules), 256).alias("base_sha256"),
        secret_scan.written(F.col("secrets"), rules).alias("spans"),
    )


@query("op8_token_counts")
def _(spark, d):
    return token_counts.count_tokens(table(spark, d, "documents"), token_counts.read_ranks())


@query("op9_source_mixing")
def _(spark, d):
    mixed = mixing.mix(table(spark, d, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")


@query("op10_decontamination")
def _(spark, d):
    found = decontaminate.find_overlaps(table(spark, d, "documents"), table(spark, d, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query("op6_near_dedup")
def _(spark, d):
    return near_dedup.find_components(table(spark, d, "documents"), near_dedup.CONTRACT)


@query("op7_suffix_dedup")
def _(spark, d):
    cut = suffix_dedup.remove_repeats(table(spark, d, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_language_id")
def _(spark, d):
    docs = table(spark, d, "documents")
    held_out = fold_number(F.col("doc_id"), 4) == 2
    network = language_id.train(docs.where(~held_out).select("lang", "text"))
    return language_id.predict(docs.select("doc_id", "text"), network).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op5_lm_scoring")
def _(spark, d):
    docs = table(spark, d, "documents")
    held_out = fold_number(F.col("doc_id"), 7) == 2
    trained = hidden_markov.train(docs, learn=~held_out)
    scored = hidden_markov.score(None, trained)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
        F.lit(trained.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


@query("op12_fill_in_middle")
def _(spark, d):
    cut = infill.transform(table(spark, d, "documents"))
    back = infill.restored(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


@query("op13_warc")
def _(spark, d):
    path = work_path(spark, "warc")
    warc.write_archives(table(spark, d, "pages"), path)
    found = warc.read_archives(spark, path, payloads=False).where("problem is null")
    return found.select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


@query("op11_spelling_variants")
def _(spark, d):
    return spelling.group_variants(table(spark, d, "documents"))
