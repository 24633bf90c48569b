"""Spelling variants and sharding against plain Python, and on awkward tables."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from farpoint.llm import sharding, spelling

DOC = "doc_id long, text string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    out = {}
    for w, n in counts.items():
        near = [(-m, v) for v, m in counts.items() if one_edit(w, v)]
        m, best = min(near, default=(0, None))
        out[w] = (best if best and -m >= 5 * n else None, n, len(near), -m if best and -m >= 5 * n else None)
    for w, (form, *more) in list(out.items()):
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (form, root, *more)
    return out


def got(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


@pytest.mark.parametrize("hot", [2, 5000])
def test_near_words_against_all_pairs(spark, hot):
    """Also where nearly all segments are hot and told apart by halves of the rest; letters repeat, so that an edit can be read in both halves."""
    rng = random.Random(8)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))): rng.choice([5, 6, 30, 200]) for _ in range(900)}
    counts |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = {r["word"]: tuple(r)[1:] for r in spelling.near(words, each=150, hot=hot).collect()}
    want = {}
    for w in counts:
        near = [(-m, v) for v, m in counts.items() if one_edit(w, v)]
        if near:
            want[w] = (len(near), -min(near)[0], min(near)[1])
    assert found == want


def test_variants_against_a_plain_count(spark):
    rng = random.Random(3)
    base = ["weather", "wheather", "weathers", "Übermut", "übermut", "naïveté", "naiveté", "straight", "straigt", "stright", "stringent"]
    docs = [(i if i % 17 else None, " ".join(rng.choice(base[:4] * 9 + base) for _ in range(rng.randint(0, 60))) + "-x1abcdefg2") for i in range(60)]
    docs += [(900, None), (901, ""), (902, "q" * 40_000), (903, "tiny"), (1, docs[1][1]), (1, docs[1][1])]
    for slips in (None, 7):
        counts = Counter()
        for i, t in docs:
            run = ""
            for c in (t or "") + " ":
                if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                    run += c.lower() if c.isascii() else c
                    continue
                if run:
                    h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                    counts[run[: h % len(run)] + run[h % len(run) + 1 :] if slips and h % slips == 0 else run] += 1
                run = ""
        want = plain({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
        assert len(want) > 8
        df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], DOC + ", word int, n int, x int")
        assert got(spelling.variants(df, slips=slips)) == want


def test_chain_of_forms(spark):
    n, step = 200, [(f"w{i:03}", f"w{i + 1:03}") for i in range(200)]
    assert {r[0]: r[1] for r in spelling.roots(spark.createDataFrame(step, "word string, form string")).collect()} == {w: f"w{n:03}" for w, _ in step}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    assert spelling.variants(none).count() == 0 and sharding.shards(none).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "")], DOC)).count() == 0


def test_shards_are_contiguous_and_balanced(spark):
    """Sums by hand; a third of the rows bears one id, and ranges are small."""
    rng = random.Random(1)
    docs = [(rng.choice([7, i]) if i % 3 else 7, "é" * rng.randint(0, 50)) for i in range(900)] + [(None, "x"), (5, None), (5, None), (6, "long " * 700)]
    rows = sharding.shards(spark.createDataFrame([(*d, 1, 2, "a") for d in docs], DOC + ", shard int, size int, at string").repartition(5), each=40).collect()
    assert rows[0].asDict().keys() == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    want = sorted((-1 if i is None else i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in docs)
    total, before, seen, plan = sum(x[2] for x in want), 0, defaultdict(int), []
    for i, crc, size in want:
        shard = min(7, (2 * before + size) * 8 // (2 * total))
        plan.append((i, crc, size, shard, seen[shard]))
        seen[shard] += 1
        before += size
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in rows) == sorted(plan)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert max(abs(s - total / 8) for s in sizes.values()) <= max(x[2] for x in want)


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (i % 40), i % 3) for i in range(500)], DOC + ", slot int")
    manifest = sharding.write_shards(docs, f"{tmp_path}/out", n=4).collect()
    back = spark.read.json(f"{tmp_path}/out")
    assert [r["rows"] for r in manifest] == [r["count"] for r in back.groupBy("shard").count().orderBy("shard").collect()]
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == [(i, "word " * (i % 40)) for i in range(500)]
    assert [(m["first_id"], m["last_id"]) for m in manifest] == sorted((m["first_id"], m["last_id"]) for m in manifest)
    with pytest.raises(ValueError):
        sharding.write_shards(docs.union(docs), f"{tmp_path}/again")
