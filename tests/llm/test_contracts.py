"""Repeated ids, missing ids, short items and used-up surrogates."""

import random
import time

from pyspark.sql import functions as F

from quirelake.llm.decontamination import contaminated_pairs
from quirelake.llm.line_dedup import dedup_lines
from quirelake.llm.ngram_join import jaccard_join
from quirelake.llm.pii import entities, replace_pii

LINE = "a line of more than twenty characters"


def test_lines_are_counted_by_distinct_documents(spark):
    rows = [(1, LINE), (1, f"{LINE}\nx"), (2, LINE), (None, "another " + LINE), (None, f"another {LINE}\ny"), (3, "another " + LINE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_dropped for r in dedup_lines(docs).collect()} == {0}
    more = docs.unionByName(spark.createDataFrame([(4, LINE)], docs.schema))
    got = dedup_lines(more).filter("n_dropped > 0").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, ""), (1, "x"), (2, "")]


def test_short_items_are_found_whole(spark):
    items = spark.createDataFrame([(1, "Alpha beta"), (2, "gamma"), (3, "one two three four five six"), (4, " ")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha BETA y"), (2, "alphabeta alpha, beta"), (3, "the gamma"), (4, "beta alpha"), (5, "gammas"), (6, "one two three four five"), (7, None)], "doc_id long, text string")
    got = contaminated_pairs(docs, items, short_items=True).select("doc_id", "item_id", "coverage").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1.0), (3, 2, 1.0), (6, 3, 5 / 6)]


def test_surrogates_never_run_out(spark):
    values = [f"555-{i:04d}" for i in range(0, 10_000, 3)]
    rows = [(None if i % 2 else i, f"call {v} now") for i, v in enumerate(values)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    plain = {v for v in values if entities(f"call {v} now")}
    out = [r.text[5:-4] for r in replace_pii(docs, "k", plain_draws=1).collect()]
    assert len(plain) == len(values) == len(set(out)) and not plain & set(out)


def test_rows_without_id_share_surrogates_with_others(spark):
    values = [f"555-{i:04d}" for i in range(3000)]
    docs = spark.createDataFrame([(None, f"call {v} now") for v in values] + [(i, f"call {v} now") for i, v in enumerate(values)], "doc_id long, text string")
    got = replace_pii(docs, "k", plain_draws=4)
    texts = [r.text for r in got.filter("doc_id IS NULL").collect()]
    assert sorted(texts) == sorted(r.text for r in got.filter("doc_id IS NOT NULL").collect()) and len(set(texts)) == len(values)


def test_many_entities_in_one_text():
    text = " ".join(f"user{i}@example.org" for i in range(8000))
    start = time.time()
    assert len(entities(text)) == 8000
    assert time.time() - start < 3


def test_near_copies_meet_in_stars(spark):
    """A group around the threshold, whose pairs are more than its rows: the same components as pair by pair."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"v{rng.randrange(9)}"
        texts.append(" ".join(words))
    got = {r.doc_id: r.component_id for r in jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=3, share=(80, 100)).collect()}
    grams = [{tuple(t.split()[i : i + 3]) for i in range(58)} for t in texts]
    root = list(range(120))
    changed = True
    while changed:
        changed = False
        for a in range(120):
            for b in range(a):
                if len(grams[a] & grams[b]) * 100 >= 80 * len(grams[a] | grams[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert got == dict(enumerate(root))
