"""The stages of the corpus pipeline, each against a plain version of it on its own input."""

import random
import re

import pytest

import corpus_pipeline
from quirelake.llm.common import read

COLUMNS = list(corpus_pipeline.COLUMNS)
INSULTS = ["wretchkin", "vilefoul", "dimwitted"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("abdeilmnorst") for _ in range(rng.randint(3, 9))) for _ in range(1500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = {i: text(30) for i in range(5)}
    rows, labels = [], []
    for i in range(500):
        t = text(60) + "\n" + text(20)
        if i % 5 == 0:
            for _ in range(5):
                t += f" {rng.choice(INSULTS)} {text(3)}"
        elif i % 10 == 1:
            t += "\nThis line is one that many documents share."
        elif i % 10 == 2:
            t += " " + items[i % 5]
        elif i % 50 == 3 and i > 50:
            w = rows[3][1].split(" ")
            w[i % len(w)] = "other"
            t = " ".join(w)
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(600, None, None, None, None), (601, "", "", "", 0), (None, text(30), "en", "s1", 0), (602, "one two", "en", "s0", 7), (602, "one two", "en", "s0", 7)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_toxic_documents_go(spark, folder):
    docs = read(spark, folder, "documents")
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert kept.columns == COLUMNS
    ids = [r.doc_id for r in kept.collect()]
    toxic = {i for i in range(500) if i % 5 == 0}
    assert len(toxic & set(ids)) <= 5 and len([i for i in ids if i not in toxic]) >= 400


def test_shared_lines_stay_once(spark, folder):
    docs = read(spark, folder, "documents").filter("doc_id < 100 OR doc_id >= 600")
    got = corpus_pipeline.drop_repeated_lines(spark, docs, folder)
    assert got.columns == COLUMNS and got.count() == docs.count()
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    before = rows_of(docs)
    holders = {}
    for i, r in before.items():
        for line in set(map(key, (r.text or "").split("\n"))):
            holders.setdefault(line, set()).add(i)
    for i, r in rows_of(got).items():
        want = "\n".join(x for x in (before[i].text or "").split("\n") if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and i != max(holders[key(x)])))
        assert r.text == want and r.n_chars == len(want)


def test_one_of_each_group_stays(spark, folder):
    docs = read(spark, folder, "documents").filter("doc_id IS NULL OR doc_id % 50 < 5 OR doc_id >= 600")
    got = corpus_pipeline.keep_one_of_each_group(spark, docs, folder)
    assert got.columns == COLUMNS

    def shingles(t):
        w = re.findall(r"[^ \t\n\x0b\x0c\r]+", (t or "").lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {r.doc_id: shingles(r.text) for r in docs.collect() if r.doc_id is not None}
    root = {i: i for i in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    ids = [r.doc_id for r in got.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({i for i in sets if root[i] == i}) and ids.count(None) == 1
    assert 53 not in ids and 3 in ids


def test_documents_with_items_go(spark, folder):
    docs = read(spark, folder, "documents")
    got = corpus_pipeline.drop_contaminated(spark, docs, folder)
    ids = {r.doc_id for r in got.collect()}
    assert got.columns == COLUMNS and {r.doc_id for r in docs.collect()} - ids == {i for i in range(500) if i % 10 == 2}


def test_mix_takes_towards_the_targets(spark, folder):
    docs = read(spark, folder, "documents").filter("doc_id < 500")
    got = corpus_pipeline.mix(spark, docs, folder).collect()
    size = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    by = {}
    for r in got:
        assert r.taken == r.copies * size[r.doc_id] and 1 <= r.copies <= 3
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(taken - target) <= max(size.values()) * 3 for taken, target in by.values())


def test_all_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    ids = {r.doc_id for r in got.collect()}
    assert set(COLUMNS) < set(got.columns) and [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    assert not ids & {i for i in range(500) if i % 10 == 2} and len(ids & {i for i in range(500) if i % 5 == 0}) <= 5
