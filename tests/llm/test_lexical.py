"""Lexical search against sums over all documents, and its parts on their own."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from farpoint.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    counts = [(i, Counter(split(t))) for i, t in docs if i is not None]
    counts = [(i, c) for i, c in counts if c]
    total, df = sum(c.total() for _, c in counts), Counter(t for _, c in counts for t in c)
    w = {t: math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * n + 1))) for t, n in df.items()}
    asked, out = defaultdict(set), []
    for i, t in items:
        if i is not None:
            asked[i] |= set(split(t))
    for item, terms in asked.items():
        scores = [(-sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * c.total() * len(counts) // total))) for t in terms if t in c), i) for i, c in counts]
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return sorted(out)


def test_numbers_packed():
    x = np.array([0, 1, 127, 128, 16_383, 16_384, 2**40, 5, 2**62])
    data, size = lexical.packed(x)
    assert lexical.unpacked(data.tobytes()).tolist() == x.tolist() and size.tolist() == [1, 1, 1, 2, 2, 3, 6, 1, 9]


def test_terms_are_the_pattern():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("aZ09_ -'\x00\x7f\t\n\xa0é–ß中😀[`{@/:") for _ in range(rng.randint(0, 30)))
        assert [t.decode() for t in lexical.terms(text.encode())] == split(text)


@pytest.mark.parametrize("window", [1, 7, 1024])
def test_merge_with_bounds(monkeypatch, window):
    """The k best of random lists, from any bound that they reach; many equal scores."""
    monkeypatch.setattr(lexical, "WINDOW", window)
    rng = np.random.default_rng(6)
    for _ in range(60):
        lists = [lexical.Postings(d := np.sort(rng.choice(400, n, replace=False)), rng.integers(0, 5, len(d)) * int(rng.integers(1, 9))) for n in rng.integers(1, 300, rng.integers(1, 9))]
        sums = np.zeros(400, int)
        for x in lists:
            sums[x.docs] += x.adds
        want = [(-s, d) for s, d in sorted((-int(s), d) for d, s in enumerate(sums) if s)[:5]]
        assert lexical.best(lists, 5) == want
        for bar in {s for s, _ in want}:
            assert lexical.best(lists, 5, bar) == [x for x in want if x[0] >= bar]
        assert all(sums[d] == s for s, d in lexical.opening(lists, 5))


@pytest.mark.parametrize("items,each", [(256, 300), (2, 1 << 24)])
def test_search_against_all_documents(spark, monkeypatch, items, each):
    """Several shards and blocks of items; a third of the documents are one text, ties go to the smaller id."""
    monkeypatch.setattr(lexical, "ITEMS", items)
    monkeypatch.setattr(lexical, "OPENING", 20)
    rng = random.Random(2)
    word = lambda: f"w{int(rng.paretovariate(0.6))}" if rng.random() < 0.95 else rng.choice(["Ünder", "Foo_bar", "x-Y", "Ångström’s"])
    docs = [(i * 7 - 300, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(10_000 + i, "w1 w2 w3 W9 rare") for i in range(150)]
    docs += [(-9, None), (-8, ""), (-7, "... !"), (None, "w1 rare"), (9_000, "w1 " * 5000), (9_001, "w2 " * 9), (9_001, "w2 " * 9)]
    asked = [(i, " ".join(word() for _ in range(12))) for i in range(9)] + [(20, "rare w9"), (21, None), (22, "nowhere"), (None, "w1"), (23, "w2"), (23, "w3 w2"), (24, "the " + " ".join(f"w{k}" for k in range(200)))]
    rng.shuffle(docs)
    d = spark.createDataFrame([(*x, "a", 1) for x in docs], "doc_id long, text string, term string, shard int").repartition(3)
    q = spark.createDataFrame([(*x, 1) for x in asked], "item_id long, text string, term int")
    table = lexical.index(d, each=each)
    got = lexical.search(table, lexical.asked(q))
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == plain(docs, asked)
    assert lexical.search(table, lexical.asked(q.limit(0))).count() == 0


def test_no_documents(spark):
    q = spark.createDataFrame([("a", "w1")], "item_id string, text string")
    got = lexical.search(lexical.index(spark.createDataFrame([(1, None)], "doc_id long, text string")), lexical.asked(q))
    assert got.count() == 0 and dict(got.dtypes)["item_id"] == "string"
