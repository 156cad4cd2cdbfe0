"""Ids above 2^53 beside a NULL id come out of every Python step unchanged."""

from collections import Counter

from nodeloom.llm import decontaminate, hidden_markov, language_id, near_dedup, suffix_dedup, token_counts

LARGE = (1 << 62) + 1
TEXT = " ".join(f"w{n}" for n in range(200))


def frame(spark):
    """One partition, so that all ids come in one batch."""
    rows = [(None, "other words"), (LARGE, TEXT), (LARGE + 2, TEXT + " more"), (LARGE + 5, "quite another text")]
    return spark.createDataFrame([(*r, "en") for r in rows], "doc_id bigint, text string, lang string").coalesce(1)


def test_large_ids_beside_a_null(spark):
    docs = frame(spark)
    want = Counter([None, LARGE, LARGE + 2, LARGE + 5])
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    assert ids(language_id.predict(docs, language_id.Network.fresh(["a", "b"], 3))) == want
    assert ids(token_counts.count_tokens(docs, [bytes([b]) for b in range(256)])) == want
    assert ids(suffix_dedup.remove_repeats(docs)) == want
    assert ids(hidden_markov.score(docs, hidden_markov.train(docs, states=2))) == want
    items = spark.createDataFrame([(1, TEXT), (2, "q " * 20)], "item_id bigint, text string")
    for per_block in (20, 1):
        found = decontaminate.find_overlaps(docs, items, items_per_block=per_block)
        assert ids(found) == want and ids(found.where("size(spans) > 0")) == Counter([LARGE, LARGE + 2])


def test_large_ids_keep_their_links(spark):
    docs = frame(spark)
    got = {r.doc_id: r.component_id for r in near_dedup.find_components(docs).collect()}
    assert got == {None: None, LARGE: LARGE, LARGE + 2: LARGE, LARGE + 5: LARGE + 5}
    assert Counter(r.doc_id for r in near_dedup.keep_one(docs).collect()) == Counter([None, LARGE, LARGE + 5])
