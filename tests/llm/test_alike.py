"""The similarity join of sets against all pairs."""

import random

import numpy as np
import pytest

from farpoint.llm import paragraphs, simhash
from tests.llm.test_ops import WORDS, docs, prose


def roots_of(sets, similarity=0.8):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9 and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


def test_no_pair_of_texts_is_lost(spark):
    """Pairs at a similarity of 0.80 to 0.83, one text with more at its end; and one large family whose variants are linked here and there."""
    rng, texts = random.Random(11), []
    for _ in range(80):
        w = [f"{rng.choice(WORDS)}{rng.randrange(60)}" for _ in range(200)]
        texts += [" ".join(w), " ".join([*w, *(f"{rng.choice(WORDS)}{rng.randrange(60)}" for _ in range(46))])]
    base = prose(5, 120).split()
    for _ in range(250):
        w = list(base)
        for k in rng.sample(range(120), rng.choice((2, 2, 3))):
            w[k] = rng.choice(WORDS)
        texts.append(" ".join(w))
    root = roots_of([set(simhash.shingles(t, 5)) for t in texts])
    assert all(root[2 * i + 1] == 2 * i for i in range(80)) and 20 < len(set(root[160:])) < 230
    assert {r["doc_id"] for r in simhash.keep_one(docs(spark, *texts)).collect()} == set(root)


@pytest.mark.parametrize("part", [7, 2000])
def test_links_of_sets(spark, part):
    """Sets of all sizes in families of all degrees, with very frequent elements; homes in one part and in many."""
    from farpoint.llm import alike

    rng, sets = random.Random(3), [set(), {1}, {1, 2}]
    for f in range(12):
        base = [rng.getrandbits(60) for _ in range(rng.choice((1, 4, 5, 30, 80)))] + list(range(rng.choice((0, 3))))
        for _ in range(20):
            sets.append({x if rng.random() > 0.01 * f else rng.getrandbits(60) for x in base} | {rng.getrandbits(60) for _ in range(rng.randrange(3))})
    sets = [set(s) for s in sorted({tuple(sorted(s)) for s in sets})]
    keys = [i.to_bytes(16, "big") for i in range(len(sets))]
    known = (np.arange(3, dtype=np.uint64), np.array([9, 8, 7]))
    h = [np.array(sorted(s), np.uint64) for s in sets]
    c, length, n = alike.prefixes(np.concatenate(h), np.array(list(map(len, h))), known, 0.8)
    assert n.tolist() == list(map(len, sets))
    ends = np.cumsum(length)
    rows = [(k, len(s), c[e - m : e].view(np.int64).tolist()) for k, s, e, m in zip(keys, sets, ends, length, strict=True)]
    packed = spark.createDataFrame([(k, x.tobytes()) for k, x in zip(keys, h, strict=True)], "key binary, s binary")
    given = spark.createDataFrame(rows, "key binary, n long, c array<long>")
    found = alike.links(given.union(given.limit(9)), lambda wanted: packed.join(wanted, "key"), 0.8, part)
    got = [(int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")) for r in found.collect()]
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 for a, b in got)
    root = list(range(len(sets)))
    for a, b in got:
        lo, hi = sorted((root[a], root[b]))
        root = [lo if r == hi else r for r in root]
    assert root == roots_of(sets)
    if part > len(sets):
        assert len(got) < 2 * len(sets)  # a forest for each home, no pairs


def test_no_link_of_paragraphs_is_lost(spark, monkeypatch):
    """Classes of one large family of lines, dealt over parts, are those of all pairs."""
    monkeypatch.setattr(paragraphs, "PART", 50)
    rng, texts, base = random.Random(4), [], prose(6, 60).split()
    for _ in range(200):
        w = list(base)
        for k in rng.sample(range(60), 2):
            w[k] = rng.choice(WORDS)
        texts.append(" ".join(w))
    root = roots_of([set(simhash.shingles(t, 5)) for t in texts])
    got = [tuple(r["classes"]) for r in paragraphs.repeats(docs(spark, *texts)).orderBy("doc_id").collect()]
    assert all((got[i] == got[j] != ()) == (root[i] == root[j]) for i in range(200) for j in range(i) if texts[i] != texts[j])
