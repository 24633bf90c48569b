"""Helpers: hot keys, filters of fixed size, batches."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from farpoint.llm import common


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rng = random.Random(1)
    rows = [(rng.choice("abc") if rng.random() < 0.7 else f"k{rng.randrange(90)}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "key string, i long")
    sizes = spark.createDataFrame(list(Counter(k for k, _ in rows).items()), "key string, n long")
    labels = spark.createDataFrame([(k, k.upper()) for k, _ in rows[:300]], "key string, label string").distinct()
    known = {r["key"]: r["label"] for r in labels.collect()}
    for how in ("inner", "left"):
        got = common.spread_join(df, labels, ["key"], sizes, ["i"], how).collect()
        assert sorted((r["i"], r["label"]) for r in got) == sorted((i, known.get(k)) for k, i in rows if how == "left" or k in known)
    assert common.spread_join(df.limit(0), labels, ["key"], sizes.limit(0), ["i"]).count() == 0


def test_filter_lets_all_known_rows_through(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id", "xxhash64(id) AS h")
    known = df.where("id % 7 = 0")
    got = {r["id"] for r in df.where(common.maybe_in(common.sieve(known, "h"), "h")).collect()}
    assert {i for i in range(0, 5000, 7)} <= got and len(got) < 720
    assert df.where(common.maybe_in(common.sieve(known.limit(0), "h"), "h")).count() == 0
    monkeypatch.setattr(common, "SIEVE", 1)  # full: every row passes
    assert df.where(common.maybe_in(common.sieve(df, "h"), "h")).count() == 5000


def test_names_and_batches():
    assert common.fresh(["a", "_A", "b"], "a", "c", "c") == ["__a", "c", "_c"]
    texts = ["x" * 10, "é" * 10, "y" * 100, "z"]
    assert list(common.by_bytes(texts, 25)) == [["x" * 10], ["é" * 10], ["y" * 100], ["z"]]
    b = pa.RecordBatch.from_arrays([pa.array([*texts, None])], names=["t"])
    parts = list(common.slices(b, 0, 25))
    assert [t for p in parts for t in p.column(0).to_pylist()] == [*texts, None] and max(p.num_rows for p in parts) < 5
    assert np.array_equal(common.pieces(10, 3), 4)


def test_components_of_many_parts(spark, monkeypatch):
    """Chains, stars and random graphs, in parts of a few edges, against a walk; hubs of many edges, binary names."""
    from farpoint.llm import components as graphs

    rng = random.Random(2)
    chain = list(range(200))
    rng.shuffle(chain)
    e = [*zip(chain, chain[1:]), *((500, i) for i in range(501, 620)), *((rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(110)), (7, 7), (None, 3)]
    want = {x: x for p in e for x in p if None not in p and p[0] != p[1]}
    changed = True
    while changed:
        changed = False
        for a, b in e:
            if a is not None and a != b and want[a] != want[b]:
                want[a] = want[b] = min(want[a], want[b])
                changed = True
    for most in (7, 60, 500_000):
        monkeypatch.setattr(graphs, "EDGES", most)
        got = {r["node"]: r["root"] for r in graphs.components(spark.createDataFrame(e, "a long, b long")).collect()}
        assert got == want
    names = spark.createDataFrame([(bytes([a % 256, a // 256]), bytes([b % 256, b // 256])) for a, b in e if a is not None], "a binary, b binary")
    assert len({bytes(r["root"]) for r in graphs.components(names).collect()}) == len(set(want.values()))


@pytest.mark.parametrize("down", [False, True])
def test_components_of_rising_chains(spark, monkeypatch, down):
    """A thousand links whose names rise along a path, a hundred to a part: few levels."""
    from farpoint.llm import components as graphs

    made = []
    monkeypatch.setattr(graphs, "EDGES", 100)
    monkeypatch.setattr(graphs, "ordered", lambda e, level, plain=graphs.ordered: made.append(level) or plain(e, level))
    edges = [(1000 - i, 999 - i) if down else (i, i + 1) for i in range(1000)]
    got = {r["node"]: r["root"] for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(1001), 0) and max(made) <= 8
