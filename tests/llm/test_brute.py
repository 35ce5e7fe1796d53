"""Operators that SQL can't express, against plain versions of the same."""

import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirelake.llm.components import connected_components
from quirelake.llm.decontamination import contaminated_pairs, tiles
from quirelake.llm.mixing import mix_sources
from quirelake.llm.nearest import merged, nearest, quantised, tile
from quirelake.llm.pii import GIVEN_NAMES, entities, replace_pii, surrogate
from quirelake.llm.quality import GOOD, LABELLERS, fit_label_model, fit_quality, pattern, score_quality, votes
from quirelake.llm.toxicity import peculiar_stretches
from quirelake.llm.url_filter import judge_urls


def table(spark, texts, extra=""):
    return spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, _quality string")


def longest_first(doc, item, least):
    """Greedy tiling by its definition: of all matches of unmarked words the longest, first in the document, then in the item."""
    free_d, free_i, found = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and free_d[a + n] and free_i[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return found
        found.append((a, b, n))
        for k in range(n):
            free_d[a + k] = free_i[b + k] = False


def test_tiling_against_its_definition():
    rng = random.Random(7)
    for _ in range(150):
        words = rng.randint(2, 12)
        item = [rng.randrange(words) for _ in range(rng.randint(1, 30))]
        doc = [rng.randrange(words) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(len(item))
            at = rng.randint(0, len(doc))
            doc[at:at] = item[a : a + rng.randint(3, 15)]
        got = tiles(np.array(doc, np.uint64) * np.uint64(7919), np.array(item, np.uint64) * np.uint64(7919), 3)
        want = longest_first(doc, item, 3)
        assert sum(x[2] for x in got) == sum(x[2] for x in want) and sorted(got) == sorted(want)


def test_tiling_of_repeated_words_stays_small():
    same = np.full(6000, 12345, np.uint64)
    assert tiles(same, same[:5000], 5) == [(0, 0, 5000)]


def test_contaminated_pairs_against_tiling(spark):
    rng = random.Random(8)
    vocabulary = ["w%d" % i for i in range(40)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.randint(5, 40))] for i in range(12)}
    texts = {}
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            whole = items[i % 12]
            cut = rng.randint(0, len(whole))
            w[rng.randint(0, len(w)) :] = whole[cut:] + ["between"] + whole[:cut]
        texts[i] = " ".join(w).upper()
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.covered for r in contaminated_pairs(table(spark, texts.items()), bench).collect()}
    want = {}
    for (i, t), (j, w) in itertools.product(texts.items(), items.items()):
        covered = sum(x[2] for x in longest_first(t.lower().split(), w, 5))
        if covered >= 0.8 * len(w):
            want[i, j] = covered
    assert got == want and len(want) >= 5


def test_nearest_tiles_keep_every_neighbour():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 16)), rng.normal(size=(500, 16)) * rng.random((500, 1)) * 100
    ids, k = np.arange(500), 7
    lists = [tile((np.arange(1000, 1040), *quantised(x)), (ids[a : a + 90], *quantised(y[a : a + 90])), k) for a in range(0, 500, 90)]
    products = x @ y.T
    for q in range(40):
        mine = [part[q][1:] for part in lists]
        for found, low, high in mine:
            assert (low <= products[q, found]).all() and (products[q, found] <= high).all()
        kept = merged(mine, k)[0]
        assert set(np.argsort(-products[q])[:k]) <= set(kept) and len(kept) < 60


def test_nearest_edges(spark):
    schema = "vec_id long, embedding array<float>, query_id string, score string"
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, [0.5, 0.5]), (22, [0.5, 0.5]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (41, [])]
    got = nearest(spark.createDataFrame([(*r, "a", "b") for r in rows], schema), F.col("vec_id") % 20 == 0, k=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 20, 0.5), (0, 2, 21, 0.5), (20, 1, 0, 0.5), (20, 2, 21, 0.5)]
    assert nearest(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0


def test_url_filter_learns_and_takes_edges(spark):
    schema = "page_id long, url string, host string, verdict string"
    urls = [None, "", "no-url", "http://", "HTTP://A.NET/es/?q#f", "http://a.net/es/" + "9" * 50_000]
    rows = [(i % 4, u, "x", "y") for i, u in enumerate(urls)] + [(None, "http://b.com/", "x", "y")] * 2
    got = judge_urls(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)
    assert judge_urls(spark.createDataFrame([], schema)).count() == 0
    # hosts outside the rules must go by what the rules' hosts show: sections es and fr are blocked, others not
    rules = (("allow", "com/"), ("block", "com/es/"), ("block", "com/fr/"))
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    known = [f"http://{word()}.com/{s}/{word()}" for s in ("es", "fr") for _ in range(150)] + [f"http://{word()}.com/{s}/{word()}" for s in ("it", "pt", "de") for _ in range(100)]
    other = [(f"http://{word()}.org/{s}/{word()}", s in ("es", "fr")) for s in ("es", "fr", "it", "pt") for _ in range(25)]
    urls = known + [u for u, _ in other]
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame([(i, u, "", "") for i, u in enumerate(urls)], schema), rules=rules).collect()}
    right = [got[len(known) + i] == ("block" if blocked else "allow") for i, (_, blocked) in enumerate(other)]
    assert np.mean(right) > 0.9


def test_label_model_against_plain_em():
    rng = np.random.default_rng(4)
    n = len(LABELLERS)
    v = rng.integers(0, 3, (400, n))
    y = rng.random(400) < 0.6
    v[:, :3] = np.where(rng.random((400, 3)) < 0.85, y[:, None], ~y[:, None]).astype(int) * GOOD + 0
    patterns, counts = np.unique([pattern(x) for x in v.tolist()], return_counts=True)
    model = fit_label_model(patterns, counts.astype(float))
    # a document at a time, by the definition of the posterior
    for code, x in zip([pattern(x) for x in v[:50].tolist()], v[:50].tolist(), strict=True):
        good, bad = model.prior, 1 - model.prior
        for j, vote in enumerate(x):
            if vote < 2:
                good, bad = good * model.rates[j, 1, vote], bad * model.rates[j, 0, vote]
        assert abs(model.posterior(np.array([code]))[0] - good / (good + bad)) < 1e-9


def test_quality_keeps_columns_and_separates(spark):
    good = "The old house by the river was sold to a family from the north, and they have been there since. It is a quiet place, but in the summer the children play on the bank until it is dark. "
    rng = random.Random(2)
    texts = [(i, good * rng.randint(2, 4)) for i in range(40)] + [(100 + i, " ".join("".join(rng.choice("@#$%&*0189") for _ in range(7)) for _ in range(80))) for i in range(40)]
    d = table(spark, texts)
    got = score_quality(d, fit_quality(d)).collect()
    assert {r._quality for r in got} == {"x"} and len(got) == 80
    agree = [(r.quality >= 0.5) == (r.doc_id < 100) for r in got]
    assert np.mean(agree) > 0.95
    assert all(abs(v - w) < 1e-12 for v, w in zip(*[[r.quality for r in score_quality(d, fit_quality(d)).orderBy("doc_id").collect()] for _ in range(2)], strict=True))
    assert votes("") is not None


def test_surrogates_against_the_originals(spark):
    names = [n for pool in GIVEN_NAMES.values() for n in pool]
    for pool in GIVEN_NAMES.values():
        out = [surrogate("given", n, b"surrogates") for n in pool]
        assert sorted(out) == sorted(pool) and all(a != b for a, b in zip(out, pool, strict=True))
    rng = random.Random(5)
    texts = {}
    for i in range(80):
        who = f"{rng.choice(names)} {rng.choice(['Stone', 'Иванов', 'Παππάς', 'Brown', 'Quill'])}"
        texts[i] = f"Dear {who}, mail x{i % 30}@mail.example.com, call +1 (602) 555-{1000 + i % 20}, from 10.0.0.{i % 9}. password: 密码密码密码{i % 3}密 Xaver Young said: My name is Zoltan Kovacs. Kovacs again."
    out = {r.doc_id: r.text for r in replace_pii(table(spark, texts.items()), "surrogates").collect()}
    mapping = {}
    for i, text in texts.items():
        before, after = entities(text), out[i]
        assert len(before) >= 8
        places = [0, *itertools.chain(*[(x, y) for x, y, _ in before]), len(text)]
        between = [re.escape(text[x:y]) for x, y in zip(places[::2], places[1::2], strict=True)]
        found = re.fullmatch("(.+?)".join(between), after, re.S)
        for (a, b, kind), new in zip(before, found.groups(), strict=True):
            assert mapping.setdefault((kind, text[a:b]), new) == new != text[a:b]
    for kind in {k for k, _ in mapping}:
        of_kind = {v: n for (k, v), n in mapping.items() if k == kind}
        assert len(set(of_kind.values())) == len(of_kind)
        if kind != "given":
            assert not set(of_kind.values()) & set(of_kind)
    assert "Kovacs" not in out[0] and "Xaver" in out[0]


def test_surrogates_that_run_out_raise(spark):
    with pytest.raises(Exception, match="still taken"):
        replace_pii(table(spark, [(i, f"mail {a}@{b}.com") for i, (a, b) in enumerate(itertools.product("aeiou", "aeiou"))]), "k", max_draws=3).count()


def test_stretches_of_one_class_only():
    rng = random.Random(6)
    words = ["".join(rng.choice("abdeilmnorst") for _ in range(rng.randint(3, 9))) for _ in range(2000)]
    text = lambda: " ".join(rng.choice(words) for _ in range(150))
    plain = [text().encode() for _ in range(150)]
    marked = [(text() + " wretchkin " + text()[:300] + " vilefoul " + text()[:200]).encode() for _ in range(150)]
    found = {w for s in peculiar_stretches(marked, plain) for w in s.split()}
    assert found == {b"wretchkin", b"vilefoul"}
    assert peculiar_stretches(plain[:75], plain[75:]) == []


def test_components_against_union_find(spark):
    rng = random.Random(9)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5), (None, 3)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for x in list(root)}


def test_mixing_of_repeated_ids_does_not_depend_on_partitions(spark):
    rows = [(i % 7 if i % 3 else None, "w " * (1 + i % 5), f"s{i % 2}") for i in range(300)]
    runs = []
    for parts in (1, 3, 8):
        d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        runs.append(sorted((str(r.doc_id), r.size, r.taken, r.source) for r in mix_sources(d).collect()))
    assert runs[0] == runs[1] == runs[2]
    assert pd.Series([r[2] for r in runs[0]]).sum() > 0


@pytest.mark.parametrize("block_columns", [40, 1 << 14])
def test_jaccard_blocks_give_one_result(spark, block_columns):
    from quirelake.llm.ngram_join import jaccard_join

    rng = random.Random(12)
    base = [[rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(rng.randint(5, 60))] for _ in range(6)]
    texts = {}
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "NEW" + str(rng.randint(0, 3))
        texts[i] = " ".join(w)
    sets = {i: set(zip(*[t.lower().split()[k:] for k in range(3)])) for i, t in texts.items()}
    root = {i: i for i in texts}
    for _, a, b in itertools.product(range(4), texts, texts):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[a] = root[b] = min(root[a], root[b])
    got = jaccard_join(table(spark, texts.items()), share=(80, 100), block_columns=block_columns).collect()
    assert {r.doc_id: r.component_id for r in got} == root
