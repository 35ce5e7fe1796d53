import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm.decontamination import contaminated_pairs, tiles
from quirelake.llm.line_dedup import dedup_lines
from quirelake.llm.mixing import mix_sources
from quirelake.llm.nearest import nearest
from quirelake.llm.ngram_join import jaccard_join
from quirelake.llm.pii import entities, luhn_digit, replace_pii, surrogate
from quirelake.llm.quality import fit_label_model, fit_quality, pattern, score_quality, votes
from quirelake.llm.substring_dedup import dedup_substrings
from quirelake.llm.suffixes import permuted_prefixes, suffix_array
from quirelake.llm.toxicity import fit_toxicity, score_toxicity
from quirelake.llm.url_filter import judge_urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, text2 string"


def docs(spark, texts):
    rows = [(i, t, "en", f"s{(i or 0) % 2}", len(t or ""), "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


EDGES = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b c d"), (4, "word " * 5000)]


def test_edge_rows_everywhere(spark):
    d, none = docs(spark, EDGES), docs(spark, []).limit(0)
    for run in (
        lambda x: dedup_lines(x), lambda x: mix_sources(x), lambda x: jaccard_join(x), lambda x: dedup_substrings(x), lambda x: replace_pii(x, "k"), lambda x: score_quality(x, fit_quality(x)),
        lambda x: score_toxicity(x, fit_toxicity(x, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int"))),
    ):
        assert run(d).count() == len(EDGES)
        assert run(none).count() == 0
    bench = spark.createDataFrame([(1, "word " * 20), (2, None), (3, "a b")], "item_id long, text string")
    assert {r.doc_id for r in contaminated_pairs(d, bench).collect()} == {4}
    assert contaminated_pairs(none, bench).count() == 0


def test_line_dedup_keeps_largest_id(spark):
    line = "The same long line of text."
    out = {r.doc_id: r for r in dedup_lines(docs(spark, [(1, f"{line}\nx"), (2, f" {line.upper()} \ny"), (9, f"{line}\n{line}")])).collect()}
    assert (out[1].text, out[1].n_dropped) == ("x", 1) and out[2].text == "y" and out[9].n_dropped == 0


def brute_removed(texts, length):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        b, gone = t.encode(), bytearray(len(t.encode()))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\x01" * length
            seen.add(b[p : p + length])
        out[i] = bytes(x for x, g in zip(b, gone) if not g)
    return out


@pytest.mark.parametrize("wide", [1, 4096])
def test_substring_dedup_against_brute_force(spark, wide):
    rng = random.Random(5)
    parts = ["".join(rng.choice("abcd é") for _ in range(rng.randint(60, 260))) for _ in range(12)] + ["z" * 400, "ab" * 200]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) for i in range(40)}
    got = {r.doc_id: bytes(r.kept) for r in dedup_substrings(docs(spark, texts.items()), wide=wide, shard_bytes=4096).collect()}
    assert got == brute_removed(texts, 100)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(100):
        s = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 80)), 0)
        sa = suffix_array(s)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        common = permuted_prefixes(s, sa, 9)
        for a, b in zip(sa, sa[1:]):
            k = next((k for k in range(9) if s[a : a + k + 1].tolist() != s[b : b + k + 1].tolist()), 9)
            assert common[b] == k


def test_jaccard_join_against_brute_force(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(rng.randint(1, 80))] for _ in range(8)]
    texts = {}
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "NEW" + str(rng.randint(0, 3))
        texts[i] = " ".join(w)
    sets = {i: set(zip(*[t.lower().split()[k:] for k in range(3)])) or {tuple(t.lower().split())} for i, t in texts.items()}
    root = {i: i for i in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = jaccard_join(docs(spark, texts.items())).collect()
    assert {r.doc_id: r.component_id for r in got} == root
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}


def test_tiles_find_reordered_passages():
    item = np.arange(1, 41, dtype=np.uint64) * np.uint64(7919)
    doc = np.concatenate([item[20:], np.arange(5, dtype=np.uint64), item[:20]])
    assert sorted(tiles(doc, item, 5)) == [(0, 20, 20), (25, 0, 20)]


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[7] = v[9] = v[20]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0, None] + [0.0] * 6)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=5, query_block=4, candidate_block=40, fan_in=3).collect()
    want = {}
    for q in range(0, 300, 20):
        s = v.astype(float) @ v[q].astype(float)
        want[q] = [i for i in sorted(range(300), key=lambda i: (-round(s[i], 9), i)) if i != q][:5]
    assert {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in want} == want
    assert {r.query_id for r in got} == set(want)


def test_surrogates_keep_format_and_distinctness(spark):
    texts = {1: "Write to anna.b@mail.example.com or +1 (602) 555-5136, card 4539578763621486.", 2: "From 10.1.2.3: Mary Smith met John Smith. Ms Smith: password=hunter22x", 3: "anna.b@mail.example.com 10.1.2.4"}
    out = {r.doc_id: r.text for r in replace_pii(docs(spark, texts.items()), "key").collect()}
    for real in ("anna.b@mail", "555-5136", "4539578763621486", "10.1.2.3", "Smith", "hunter22x"):
        assert real not in " ".join(out.values())
    mail = re.search(r"[\w.]+@[\w.]+", out[1])[0]
    assert mail in out[3] and mail.endswith(".com") and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[1])
    card = re.search(r"\d{16}", out[1])[0]
    assert luhn_digit(card[:-1]) == card[-1]
    surname = re.search(r"Ms (\w+)", out[2])[1]
    assert out[2].count(surname) == 3
    many = {surrogate("ip", f"10.0.{i // 256}.{i % 256}", b"k") for i in range(3000)}
    assert len(many) == 3000
    assert [k for _, _, k in entities("nothing here at all")] == []


def test_label_model_finds_weak_labellers():
    rng = np.random.default_rng(0)
    y = rng.random(5000) < 0.7
    v = np.full((5000, 8), 2)
    for j, right in enumerate((0.95, 0.9, 0.85, 0.6)):
        v[:, j] = np.where(rng.random(5000) < right, y, ~y)
    patterns, counts = np.unique([pattern(x) for x in v.tolist()], return_counts=True)
    accuracy = list(fit_label_model(patterns, counts.astype(float)).accuracies().values())
    assert abs(accuracy[0] - 0.95) < 0.05 and abs(accuracy[3] - 0.6) < 0.08
    assert votes("the cat and the dog sat in the sun " * 5)[0] == 1


def test_toxicity_learns_words(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abdeilmnorst") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(80)]
        if i % 3 == 0:
            for _ in range(5):
                w[rng.randrange(80)] = rng.choice(["wretchkin", "vilefoul", "dimwitted"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    d = docs(spark, rows)
    model = fit_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int"), usable=F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    got = [(r.toxicity >= 0.7, r.doc_id % 3 == 0) for r in score_toxicity(d, model).collect() if held(r.doc_id)]
    assert np.mean([a == b for a, b in got]) > 0.95


def test_url_rules(spark):
    urls = ["http://a.example.com/en/1", "https://www.example.com/en/2", "http://x.net/es/3", "http://WWW.B.com/q?x", None, "no-url", "http://x.net/de"]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i].rule for i in range(7)] == ["example.com/en/", "www.example.com/en/", "net/es/", "com/", None, None, None]
    assert [got[i].verdict for i in range(4)] == ["block", "allow", "block", "allow"] and got[3].host == "www.b.com" and got[4].host == "" == got[5].path


def test_mixing_meets_targets(spark):
    got = mix_sources(docs(spark, [(i, "w " * (1 + i % 7)) for i in range(400)])).collect()
    by = {}
    for r in got:
        s = by.setdefault(r.source, [0, r.target])
        s[0] += r.taken
        assert r.taken <= 3 * r.size
    assert all(abs(t - want) < 0.05 * want for t, want in by.values())
    assert hashlib.md5(str(sorted((r.doc_id, r.taken) for r in got)).encode()).hexdigest()
