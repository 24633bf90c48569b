"""Each operator against brute force, the library or a round trip, and on awkward tables."""

import html as entities
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from farpoint.llm import ann, html, linededup, mixing, paragraphs, quality, simhash, tokencount, topk, wfst
from farpoint.llm.components import components
from farpoint.llm.queries import tokenizer

DOC = "doc_id long, text string, source string, n_chars long, text_md5 string"
WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha", "ki", "lo") for b in ("n", "r", "s", "t", "lla", "mmo", "ppe", "zz")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if i % 11 == 10 else "") for i in range(n))


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "s", 0, "x") for i, t in enumerate(texts)], DOC)


def awkward(spark):
    """Nulls, no text, blanks, a long text, repeated rows, clashing names."""
    t = prose(1, 60)
    rows = [(1, None, None, None, None), (None, t, "a", 1, "x"), (2, "", "a", 1, "x"), (3, " \n\t ", "b", 1, "x"), (4, t, "b", 1, "x"), (4, t, "b", 1, "x"), (5, "\n".join([t] * 400), None, 1, "x")]
    return spark.createDataFrame(rows, DOC)


def vectors(spark, n, width=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(n, None), (n + 1, [1.0, None] * (width // 2)), (n + 2, [float("nan")] * width), (n + 3, [0.0] * width), (None, x[0].tolist()), (n + 4, x[0].tolist())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_topk(spark):
    v = vectors(spark, 300)
    got = topk.top_k(v, v.where("vec_id % 20 = 0"), k=7).collect()
    good = {r["vec_id"]: np.floor(64 * np.array(r["embedding"])) for r in v.collect() if r["vec_id"] is not None and r["embedding"] and None not in r["embedding"] and not np.isnan(r["embedding"]).any()}
    want = [(q, k + 1, i, int(-s)) for q in good if q % 20 == 0 for k, (s, i) in enumerate(sorted((-(good[q] @ x), i) for i, x in good.items() if i != q)[:7])]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_topk_of_large_and_unlike_vectors(spark):
    """Components far beyond 2**53, scores beyond 64 bits, and queries longer than every candidate."""
    rows = [(0, [1e30, 1.0]), (1, [2.0**60, -3.0]), (2, [1.5, 2.5]), (3, [-1e30, 2.0]), (4, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(v, spark.createDataFrame([(2, [1.5, 2.5, 7.0]), (9, [1.0])], "vec_id long, embedding array<double>")).collect()
    most = (1 << 63) - 1
    scale = {i: [max(-most - 1, min(most, int(np.floor(64 * x)))) for x in e] for i, e in rows}
    want = []
    for q, e in ((2, [96, 160, 448]), (9, [64])):
        s = sorted((-max(-most - 1, min(most, sum(a * b for a, b in zip(e, c)))), i) for i, c in scale.items() if i != q)
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_threshold_algorithm_stops():
    """On a long list with few good rows the bound ends the search; results equal those of all rows."""
    rng = np.random.default_rng(4)
    x = rng.integers(-9, 10, (4000, 2))
    x[:30] += rng.integers(200, 300, (30, 2))
    ids = rng.permutation(9000)[:4000]
    want = [sorted((-int(a @ q), int(i)) for i, a in zip(ids, x) if i != ids[0])[:5] for q in ([3, 1], [-1, 2])]
    got = topk.best(ids, x, np.array([ids[0]] * 2), np.array([[3, 1], [-1, 2]]), 5)
    assert [(-s, i) for _, i, s in got] == [p for w in want for p in w]


def test_neighbours(spark):
    v = vectors(spark, 600)
    got = ann.search(v, v.where("vec_id % 50 = 0")).collect()
    good = {r["vec_id"]: np.array(r["embedding"]) for r in v.collect() if r["vec_id"] is not None and r["vec_id"] not in (600, 601, 602, 603)}
    hit = sum(r["vec_id"] in {i for i, _ in ann.nearest_exact(good, r["query_id"])} for r in got)
    assert len(got) == 5 * len([i for i in good if i % 50 == 0]) and hit / len(got) >= 0.9
    few = vectors(spark, 2)
    assert ann.search(few, few.where("vec_id = 0")).count() == 2
    assert ann.search(v.limit(0), v.limit(0)).count() == 0


def test_ann_many_lists(spark, monkeypatch):
    """A thousand lists whose rows and queries are all dealt into pieces: as brute force finds them."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1400, 4))
    monkeypatch.setattr(ann, "fit", lambda x, rows: ann.Index(4, ann.unit(x[:1000]), np.eye(4)))
    monkeypatch.setattr(ann, "PART", 1)
    monkeypatch.setattr(ann, "BLOCK", 1)
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in ann.search(v, v.where("vec_id in (3, 900)"), probes=1.0).orderBy("query_id", "rank").collect()]
    held = dict(enumerate(x))
    assert got == [p for q in (3, 900) for p in ann.nearest_exact(held, q)]


def test_neighbours_outside_the_lists(spark, monkeypatch):
    """A query whose lists hold fewer than k others gets k all the same, whatever the table's size."""
    one = np.eye(4)[0]
    monkeypatch.setattr(ann, "fit", lambda x, rows: ann.Index(4, np.stack([one, -one]), np.eye(4)))
    v = spark.createDataFrame([(i, (one if i < 600 else -one).tolist()) for i in range(603)], "vec_id long, embedding array<double>")
    got = ann.search(v, v.where("vec_id in (5, 600)"), probes=0.5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [*((5, i + 1, i) for i in range(5)), (600, 1, 601), (600, 2, 602), (600, 3, 0), (600, 4, 1), (600, 5, 2)]


def test_mixing(spark):
    rows = [(i, "t", s, 0, "x") for i, s in enumerate(["a"] * 400 + ["b"] * 150 + [None] * 90)]
    weights = {"a": 1.0, "b": 2.0, None: 1.0}
    got = mixing.mix(spark.createDataFrame(rows, DOC), weights, block=8).orderBy("mix_position").collect()
    assert [r["mix_position"] for r in got] == list(range(640)) and len({r["doc_id"] for r in got}) == 640
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in got)
    first = sorted({(r["mix_slot"], r["source"] or "") for r in got if r["mix_phase"] == 0})
    for t in range(1, len(first) + 1):
        for s, w in (("a", 0.25), ("b", 0.5), ("", 0.25)):
            assert abs(sum(x == s for _, x in first[:t]) - w * t) < 1
    assert mixing.in_order(mixing.mix(awkward(spark))).count() == 7
    assert mixing.mix(awkward(spark).limit(0)).count() == 0


def test_mixing_against_a_plain_scheduler(spark):
    """Slots by looking at all released blocks at each slot, with exact fractions; columns of any name stay."""
    from fractions import Fraction

    counts, weights, block = {"a": 200, "b": 90, "c": 17}, {"a": 3.0, "b": 2.0, "c": 1.0}, 8
    names = "s g start period lo hi slots n i r b u row before mix_slot".split()
    rows = [(k, "t", s, *range(len(names))) for k, s in enumerate(x for x, n in counts.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{x} int" for x in names))
    got = mixing.mix(df, weights, block=block).collect()
    assert all(r[x] == k for r in got for k, x in enumerate(names[:-1]))

    left = {s: -(-n // block) for s, n in counts.items()}
    done, want = dict.fromkeys(left, 0), []
    while any(left.values()):
        live = [s for s in left if left[s]]
        slots = mixing.shares({s: weights[s] for s in live})
        share, dealt, t = {s: Fraction(slots[s], sum(slots.values())) for s in live}, dict.fromkeys(live, 0), 0
        while all(left[s] for s in live):
            due = {s: -((-(dealt[s] + 1) * share[s].denominator) // share[s].numerator) for s in live if dealt[s] / share[s] // 1 <= t}
            s = min(due, key=lambda x: (due[x], live.index(x)))
            want.append((s, done[s]))
            dealt[s] += 1
            done[s] += 1
            left[s] -= 1
            t += 1
    assert [(r[0], r[1]) for r in sorted({(r["source"], r["mix_block"], r["mix_slot"]) for r in got}, key=lambda r: r[2])] == want
    order = mixing.in_order(mixing.mix(df, weights, block=block), each=50).select("mix_position").collect()
    assert [r[0] for r in order] == list(range(307))


def test_position_of_pieces(spark):
    """The pipeline's last result tells the mix, also where the mixed rows were more than one part and come in another order."""
    import corpus_pipeline as pipeline

    n = mixing.GROUP + 4000
    src = spark.range(n).selectExpr("id AS doc_id", "concat('t', id) AS text", "'en' AS lang", "CASE WHEN id % 8 < 5 THEN 'a' WHEN id % 8 < 7 THEN 'b' END AS source", "2L AS n_chars")
    mixed = pipeline.cut(pipeline.mix_stage(spark, src, None))
    out = pipeline.piece_stage(spark, mixed.orderBy("doc_id"), None).select("mix_position", "source").orderBy("mix_position").collect()
    assert [r[0] for r in out] == list(range(n))
    counts = {"a": n * 5 // 8, "b": n // 4, None: n // 8}
    total, seen, all_last = sum(c**0.5 for c in counts.values()), dict.fromkeys(counts, 0), True
    for t, (_, s) in enumerate(out, 1):
        seen[s] += 1
        all_last = all_last and all(seen[x] < counts[x] for x in counts)
        if all_last and t % mixing.BLOCK == 0:  # shares are rounded to a period's slots
            assert all(abs(seen[x] - counts[x] ** 0.5 / total * t) < mixing.BLOCK * (1 + t / mixing.BLOCK / mixing.PERIOD) for x in counts)


def test_pieces(spark):
    import sentencepiece

    texts = [prose(2, 300), "Ünïcode ✓ 漢字 🎉\t\n  spaces  ", "", " ", "a" * 5000, " x\u0000y", "é" * 300]
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    got = wfst.encode(docs(spark, *texts), tokenizer("piece_bpe_32k.model"), check=True).orderBy("doc_id").collect()
    assert [list(r["ids"]) for r in got] == [lib.encode(t) for t in texts] and all(r["exact"] for r in got)
    back = wfst.decode(wfst.encode(docs(spark, *texts), tokenizer("piece_bpe_32k.model")), tokenizer("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == texts
    out = wfst.encode(awkward(spark), tokenizer("piece_bpe_32k.model")).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 7 and by[1]["ids"] == by[2]["ids"] == [] and by[4]["ids"] == by[None]["ids"] == lib.encode(prose(1, 60)) and by[3]["ids"] == lib.encode(" \n\t ") and sum(r["doc_id"] == 4 for r in out) == 2
    assert wfst.encode(awkward(spark).limit(0), tokenizer("piece_bpe_32k.model")).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [5, None, 10**6, -1]), (2, [5, None, 10**6, -1])], "doc_id long, ids array<int>")
    assert [r["text"] for r in wfst.decode(odd, tokenizer("piece_bpe_32k.model")).orderBy("doc_id").collect()] == ["", lib.decode([5]), lib.decode([5])] and wfst.decode(odd.limit(0), tokenizer("piece_bpe_32k.model")).count() == 0


def test_cheapest_path():
    m = wfst.Transducer([("<u>", 9.0), ("a", 2.0), ("b", 2.0), ("ab", 1.0), ("aba", 2.5), ("▁", 1.0)], [0] * 256, 0, merges=False)
    best = {}

    def walk(s):
        if not s:
            return 0.0
        if s not in best:
            best[s] = min(w + walk(s[len(p) :]) for p, w in (("a", 2.0), ("b", 2.0), ("ab", 1.0), ("aba", 2.5)) if s.startswith(p))
        return best[s]

    for s in ("a", "ab", "abab", "aabba", "ababa"):
        assert sum(m.weight[i] for i in m.path(s)) == walk(s)


def test_lines(spark):
    a, b, c, d = (prose(i, 9) for i in range(4))
    texts = [f"{a}\n{b}\n{c}\n{d}", f"x\n{a}\n{b}\n{c}\ny", f"{a}\n{b}\nz", f"{b}\n{c}\n{d}\n{a}\n{b}\n{c}"]
    got = linededup.dedup_lines(docs(spark, *texts)).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [texts[0], "x\ny", texts[2], ""]
    out = linededup.dedup_lines(awkward(spark)).collect()
    assert len(out) == 7 and linededup.dedup_lines(awkward(spark).limit(0)).count() == 0
    assert [r["n_removed"] for r in out if r["doc_id"] == 5] == [399]


def test_simhash(spark):
    rng = random.Random(5)
    base = [prose(i, 120) for i in range(30)]
    texts = [*base, *(t.replace(rng.choice(t.split()), "other", 1) for t in base), None, "", "one two"]
    got = {r["doc_id"]: r for r in simhash.simhash(docs(spark, *texts)).collect()}

    def brute(t):
        w = (t or "").lower().split()
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fp = [brute(t) for t in texts]
    assert [int(got[i]["fingerprint"], 16) for i in range(len(texts))] == fp
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j in range(len(texts)) if bin(fp[i] ^ fp[j]).count("1") <= 3) for i in range(len(texts))]
    assert [got[i]["component_id"] for i in range(len(texts))] == root
    out = simhash.simhash(awkward(spark)).collect()
    of = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out}
    t = f"{brute(prose(1, 60)):016x}"
    assert len(out) == 7 and of[1] == of[2] == of[3] == ("0" * 16, 1) and of[None] == of[4] == (t, 4) and of[5][0] == f"{brute(chr(10).join([prose(1, 60)] * 400)):016x}"
    assert simhash.simhash(awkward(spark).limit(0)).count() == 0


def test_links_of_short_fingerprints(spark):
    """All pairs within 3 bits are connected, for fingerprints so short that there are many."""
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 16, 900).astype(np.uint64))
    df = spark.createDataFrame([(int(v),) for v in x], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(df, len(x), 16)).collect()}
    for v in x:
        for u in x[np.bitwise_count(x ^ v) <= 3]:
            assert roots.get(int(u), int(u)) == roots.get(int(v), int(v))


def test_keep_one(spark):
    t = prose(3, 200)
    kept = simhash.keep_one(docs(spark, t, t.upper(), t.replace(t.split()[50], "other", 1), prose(4, 200), "", " ")).collect()
    assert {r["doc_id"] for r in kept} == {0, 3, 4}
    assert simhash.keep_one(awkward(spark)).count() == 2  # no words; one text, once and 400 times


def test_near_groups_of_variants(spark):
    """Groups equal the components of the exact Jaccard similarity."""
    texts = []
    for base in range(3):
        words = prose(20 + base, 200).split()
        for i in range(25):
            texts.append(" ".join(["other", *words[1:]] if not i else [*words[: 5 * i], f"other{i}", *words[5 * i + 1 :]]))
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    assert {r["doc_id"] for r in simhash.keep_one(docs(spark, *texts)).collect()} == {root.index(r) for r in set(root)}


def test_pairs_at_the_threshold(spark):
    """Texts of which one is the other with words changed, or with more at its end, at a similarity of 0.80 to 0.83: pairs that never meet in larger groups."""
    rng, texts, pairs = random.Random(3), [], []
    for i in range(160):
        w = [f"{rng.choice(WORDS)}{rng.randrange(60)}" for _ in range(200)]
        other = list(w)
        if i % 2:
            other += [f"{rng.choice(WORDS)}{rng.randrange(60)}" for _ in range(44)]
        else:
            for k in rng.sample(range(5, 195), 4):
                other[k] = "changed"
        x, y = (set(simhash.shingles(" ".join(t), 5)) for t in (w, other))
        assert len(x & y) / len(x | y) >= 0.8
        texts += [" ".join(w), " ".join(other)]
        pairs.append((2 * i, 2 * i + 1))
    kept = {r["doc_id"] for r in simhash.keep_one(docs(spark, *texts)).collect()}
    found = [b not in kept for _, b in pairs]
    assert all(a in kept for a, _ in pairs) and sum(found) / len(found) >= 0.9 and sum(found[::2]) >= 0.97 * len(found[::2])


def test_repeated_rows_of_a_kept_document(spark):
    """Of rows that repeat id and text one stays, the same at each run; columns may have any name."""
    t = prose(3, 40)
    rows = [(1, t, "b", 5), (1, t, "a", 7), (2, t, "c", 1), (None, "other words here", "d", 2), (None, "other words here", "d", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `h` string, `__n` int")
    got = sorted(map(tuple, simhash.keep_one(df).collect()), key=str)
    assert len(got) == 2 and got == sorted(map(tuple, simhash.keep_one(df.orderBy("h")).collect()), key=str) and got[0][0] == 1


def test_token_counts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    texts = [prose(2, 700), "it's  3\t\tx\n\n y 　z ", "<|endoftext|> a<|endoftext|>", "", " ", "\n\n", "a" * 3000, "漢字🎉 'll don't  "]
    got = tokencount.token_counts(docs(spark, *texts), tokenizer("byte_bpe_50k.json")).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(t.encode(x, add_special_tokens=False)) for x in texts]
    assert [r["n_bytes"] for r in got] == [len(x.encode()) for x in texts] and got[0]["over_limit"]
    out = tokencount.token_counts(awkward(spark), tokenizer("byte_bpe_50k.json")).collect()
    of = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out}
    n = lambda x: (len(x.encode()), len(t.encode(x, add_special_tokens=False)), len(t.encode(x, add_special_tokens=False)) > 512)
    assert len(out) == 7 and of[1] == of[2] == (0, 0, False) and of[3] == n(" \n\t ") and of[4] == of[None] == n(prose(1, 60)) and of[5] == n("\n".join([prose(1, 60)] * 400))


def test_quality(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    rows = quality.score(d, l).where("held_out").join(l, "doc_id").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) >= 0.95
    none = spark.createDataFrame([(1, None), (None, 1), (4, 1)], "doc_id long, quality int")
    out = quality.score(awkward(spark), none).collect()
    assert len(out) == 7 and {(r["score"], r["predicted"]) for r in out} == {(0.5, 1)}  # one label alone is no preference
    both = spark.createDataFrame([(2, 0), (4, 1), (5, 0), (3, 0)], "doc_id long, quality int")
    of = {}
    for r in quality.score(awkward(spark), both).collect():
        of.setdefault(r["doc_id"], set()).add((r["score"], r["predicted"]))
    assert of[1] == of[2] == of[3] and of[4] == of[None] and all(len(v) == 1 for v in of.values())
    kept = quality.keep_good(awkward(spark), both)
    assert kept.columns == awkward(spark).columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(k) for k, v in of.items() for _ in range(1 + (k == 4)) if next(iter(v))[1])
    assert quality.score(awkward(spark).limit(0), none.limit(0)).count() == 0


def test_html(spark):
    text = "A story of &lt;tags&gt; &amp; more. " + "Words go on and on in this long line of the text. " * 6
    page = f"<html><head><title>T</title><script>var x='<p>';</script></head><body><nav><a href=1>Home</a></nav><div class='cookie-notice'>We use cookies</div><div><p>{text}</p><p>Second &nbsp; part, " + "which is long too. " * 12 + "</p></div><div id=comments><p>First!</p></div><footer>c 2020</footer></body></html>"
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>short"), (4, "<p>short"), (5, "<div " * 3000)], "page_id long, html string")
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    assert got[1]["text"] == " ".join(entities.unescape(text + " Second &nbsp; part, " + "which is long too. " * 12).split())
    assert got[2]["text"] == "" and got[3]["n_chars"] == 0 and html.extract(df).count() == 6


def test_html_against_a_plain_reader():
    """Pages made of known blocks, with and without <article>: the text between surges and dives is the blocks of the story, read by the library's parser."""
    from html.parser import HTMLParser

    class Blocks(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out = [""]

        def handle_starttag(self, tag, attrs):
            self.out += [""] * (tag in ("p", "h1", "h2", "li", "blockquote"))

        def handle_endtag(self, tag):
            self.out += [""] * (tag in ("p", "h1", "h2", "li", "blockquote"))

        def handle_data(self, data):
            self.out[-1] += data

    for seed in range(60):
        rng = random.Random(seed)
        story = f"<h1>{prose(seed, 4)}</h1>" + "".join(f"<{t}>{prose(seed * 50 + i, rng.randrange(30, 60))} &amp; &eacute;&nbsp;<b>x</b></{t}>" + "<div class='ad'>Buy this now, it is cheap and good.</div>" * (i == 2) for i, t in enumerate(rng.choices(["p", "li", "blockquote"], k=5)))
        plain = Blocks()
        plain.feed(story.replace("<div class='ad'>Buy this now, it is cheap and good.</div>", ""))
        want = " ".join(" ".join(b.split()) for b in plain.out if b.split())
        menu = "<nav><ul>" + "".join(f"<li><a href=/{i}>Item {i}</a>" for i in range(rng.randrange(3, 9))) + "</ul></nav>"
        after = "<aside>" + prose(seed + 900, 40) + "</aside><div class=comments><article class='comment reply'><p>" + prose(seed + 901, 60) + "</p></article></div><footer>" + prose(seed + 902, 30) + "</footer>"
        wrap = rng.choice(["<article>{}</article>", "<div class='post'>{}</div>", "<main>{}<article class=comment><p>Not I, said the duck, for I am a comment.</p></article></main>"])
        page = f"<html><head><style>p{{}}</style><title>T</title></head><body><header>{menu}</header>{wrap.format(story)}{after}</body></html>"
        assert html.main_text(page) == want, seed


def test_html_takes_linear_time():
    import time

    for page in ("<div " * 200_000, '<a "' * 200_000, "<svg>" * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<div class=nav>x" * 20_000, "<a '>" * 100_000, "</script" * 100_000):
        began = time.time()
        html.main_text(page)
        assert time.time() - began < 15


def test_html_short_article():
    assert html.main_text("<body><p>" + "Long text outside. " * 40 + "</p><article><h1>Hi</h1></article></body>") == "Hi"
    assert html.main_text("<p>just this") == "just this"
    assert html.main_text('<article><p>Body text.</p><article class="comment"><p>Nice post!</p></article></article>') == "Body text."


def test_html_keeps_the_article():
    """Wrappers named by their layout, ids of headings and sections, and captions do not cost text."""
    text, more = "Words of the story go on and on. " * 8, "Its second part goes on as well. " * 8
    story, want = f"<p>{text}</p><h2 id='legal-form'>Form</h2><section id='search-history'><p>{more}</p></section><figure><img src=x><figcaption>A caption</figcaption></figure>", " ".join(f"{text} Form {more} A caption".split())
    rest = "<div class='sidebar'><p>Aside.</p></div><div id='comments'><article class='comment'><p>" + "First! " * 200 + "</p></article></div>"
    for name in ("layout no-sidebar", "has-sidebar", "with-menu", "search-result", "sidebar-right"):
        assert html.main_text(f"<body><div class='{name}'><article>{story}</article></div>{rest}</body>") == want
        assert html.main_text(f"<body><div class='{name}'><div>{story.replace("section", "div").replace("search-history", "part")}</div></div>{rest}</body>") == want
    assert "Aside" not in html.main_text(f"<div class='has-sidebar'>{story}{rest}</div>")


def test_paragraphs(spark):
    p, q = prose(7, 60), prose(8, 60)
    near = p.replace(p.split()[30], "other", 1)
    inside = f"{prose(9, 30)}. {q} {prose(10, 30)}"
    texts = [p, f"x\n{near}", prose(11, 80), f"{prose(12, 25)} {q} {prose(13, 25)}", inside, q + "\n" + prose(14, 40)]
    got = {r["doc_id"]: r for r in paragraphs.repeats(docs(spark, *texts)).collect()}
    assert got[0]["n_repeated"] == 1 and got[1]["removed"] == [1] and got[1]["keepers"] == [0]
    assert got[2]["n_repeated"] == got[2]["n_runs"] == 0
    assert got[3]["n_runs"] > 0 and not got[3]["spans"] and got[4]["spans"] and 3 in got[4]["keepers"]
    left = {r["doc_id"]: r["text"] for r in paragraphs.remove_repeats(docs(spark, *texts)).collect()}
    assert left[0] == p and left[1] == "x" and left[2] == texts[2] and len(left[4]) < len(inside)
    out = paragraphs.repeats(awkward(spark)).collect()
    of = {r["doc_id"]: r for r in out}
    assert len(out) == 7 and all(of[i]["n_paragraphs"] == 0 and of[i]["keepers"] == [] for i in (1, 2, 3))
    assert of[4]["removed"] == [] and of[None]["removed"] == [0] and of[None]["keepers"] == [4] and of[5]["removed"] == list(range(400)) and of[5]["keepers"] == [4] and of[5]["n_paragraphs"] == 400
    assert paragraphs.repeats(awkward(spark).limit(0)).count() == 0


def wrapped(text, *widths):
    """``text`` in lines of so many words in turn."""
    words, out = text.split(), []
    while words:
        n = widths[len(out) % len(widths)]
        out.append(" ".join(words[:n]))
        words = words[n:]
    return "\n".join(out)


def test_passages_over_line_ends(spark):
    """Passages in short lines, wrapped in another way, without sentence marks, or a line here and inside a line there."""
    p, q, r = (prose(i, 60).replace(".", "") for i in (41, 42, 43))
    texts = [wrapped(p, 7), f"{prose(44, 30)}\n{wrapped(p, 7)}\n{prose(45, 9)}", f"{prose(46, 12)}\n{wrapped(p, 12, 5)}", f"{prose(47, 25)} {q} {prose(48, 25)}", wrapped(q, 25), r, f"{prose(49, 25)} {r} {prose(50, 25)}", wrapped(prose(51, 90), 8), "same " * 100]
    got = {x["doc_id"]: x for x in paragraphs.repeats(docs(spark, *texts)).collect()}
    assert [got[i]["keepers"] for i in range(9)] == [[], [0], [0], [], [3], [], [5], [], []] and got[7]["n_runs"] == got[8]["n_runs"] == 0
    left = {x["doc_id"]: x["text"] for x in paragraphs.remove_repeats(docs(spark, *texts)).collect()}
    assert all(left[i] == texts[i] for i in (0, 3, 5, 7, 8))
    for i in (1, 2, 4, 6):
        kept, own = left[i].split(), texts[i].split()
        ends = 2 * (paragraphs.WORDS - paragraphs.RUN)
        assert len(own) - 64 <= len(kept) <= len(own) - 60 + ends  # a word beside it may be equal by chance


def test_passages_cut_anywhere(spark):
    """Passages of 51 to 80 words, cut at any word, alone in one text and inside another, in lines of 12 or of all words: all are found, and no other text is."""
    rng = random.Random(8)
    texts, pairs = [], []
    for i in range(60):
        words = prose(1000 + i, 400).replace(".", "").split()
        a, n = rng.randrange(300), rng.randrange(51, 81)
        part = words[a : a + n]
        before, after = prose(2000 + i, 40).split(), prose(3000 + i, 40).split()
        own, other = " ".join(words), " ".join(before + part + after)
        pairs.append((len(texts), len(texts) + 1))
        texts += [own if i % 2 else wrapped(own, 12), other if i % 3 else wrapped(other, 12)]
    clean = [prose(5000 + i, 150) for i in range(40)]
    short = " ".join(prose(7000, 29).split())
    clean += [f"{prose(6000 + i, 60)} {short} {prose(6500 + i, 60)}" for i in range(2)]
    got = {x["doc_id"]: x for x in paragraphs.repeats(docs(spark, *texts, *clean)).collect()}
    assert all(got[b]["keepers"] == [a] and got[a]["n_runs"] and not got[a]["spans"] for a, b in pairs)
    assert not any(got[i]["n_runs"] or got[i]["classes"] for i in range(len(texts), len(texts) + len(clean)))
    for a, b in pairs:  # spans lie inside the passage
        words = texts[b].lower().split()
        assert all(" ".join(words[s["first"] : s["first"] + s["words"]]) in " ".join(texts[a].lower().split()) for s in got[b]["spans"])


def test_runs_against_the_plain_rule():
    rng = np.random.default_rng(0)
    counts = np.array([0, 10, 29, 30, 35, 50, 51, 0, 200, 700])
    x = rng.integers(0, 2**63, counts.sum()).astype(np.uint64)
    x[500:560] = x[600]  # ties
    h = paragraphs.rolled(x, 30)
    want, begin = set(), 0
    for n in counts.tolist():
        w = min(21, n - 29)
        want |= {begin + s + int(h[begin + s : begin + s + w].argmin()) for s in range(n - 29 - w + 1)} if w > 0 else set()
        begin += n
    assert paragraphs.chosen(h, counts, 21, 30).tolist() == sorted(want)
    assert (paragraphs.rolled(np.concatenate([x[900:], x[20:90]]), 30)[-41:] == h[20:61]).all()


def test_hot_passages(spark, monkeypatch):
    """A passage and a line that most texts share, dealt over several tasks: the same result as in one."""
    p, q = prose(71, 60), prose(72, 55)
    texts = [f"{prose(8000 + i, 20)}\n{p}\n{prose(9000 + i, 15)} {q} {prose(9500 + i, 15)}" for i in range(60)] + [prose(73, 120)]
    want = {x["doc_id"]: tuple(x) for x in paragraphs.repeats(docs(spark, *texts)).collect()}
    import farpoint.llm.common as common

    monkeypatch.setattr(common, "HOT_ROWS", 7)
    got = {x["doc_id"]: tuple(x) for x in paragraphs.repeats(docs(spark, *texts)).collect()}
    assert got == want and all(got[i][7][:1] == [0] for i in range(1, 60)) and got[60][7] == []


def test_paragraph_pairs(spark):
    """Classes against all pairs, in a large group of variants of one text."""
    rng, base = random.Random(2), prose(20, 60).split()
    texts = [" ".join(base)]
    for _ in range(80):
        w = list(base)
        for _ in range(rng.choice((1, 2, 3))):
            w[rng.randrange(60)] = rng.choice(WORDS)
        texts.append(" ".join(w))
    sets = [set(paragraphs.shingle_hashes(paragraphs.words_of(t)).tolist()) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j in range(len(texts)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8) for i in range(len(texts))]
    got = {r["doc_id"]: tuple(r["classes"]) for r in paragraphs.repeats(docs(spark, *texts)).collect()}
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if root[i] == root[j]]
    assert linked and sum(got[i] == got[j] != () for i, j in linked) / len(linked) >= 0.98


def test_templates(spark, monkeypatch):
    """Texts that meet in bands of many others, whose hub is alike to neither: pages of one template. Bands of more than a few members are several tasks."""
    monkeypatch.setattr(paragraphs, "PART", 8)
    frame, part = prose(60, 64), prose(61, 9)
    texts = [f"{frame} {part} last{i}" for i in range(40)] + [f"{frame} " + " ".join(f"own{i}x{j}" for j in range(7)) for i in range(4)]
    sets = [set(paragraphs.shingle_hashes(paragraphs.words_of(t)).tolist()) for t in texts]
    alike = {(i, j) for i in range(44) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    assert alike == {(i, j) for i in range(44) for j in range(i) if (i < 40) == (j < 40)}
    got = [tuple(r["classes"]) for r in paragraphs.repeats(docs(spark, *texts)).orderBy("doc_id").collect()]
    assert len(set(got[:40])) == len(set(got[40:])) == 1 and got[0] != got[40] and () not in got


def test_components(spark):
    rng = random.Random(1)
    e = [(i, i + 1) for i in range(300)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)] + [(None, 3), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_html_sections_of_the_article():
    """Words such as discussion or related prove nothing inside an article; comments, adverts and teasers go all the same. Formulas and labels are text."""
    long = "The body of this article goes on for quite a while and says something. " * 4
    for mark in ("class='discussion'", "id='related-work'", "class='related-work'", "class='sponsor'", "id='reply'", "class='respond'"):
        assert html.main_text(f"<article><p>{long}</p><section {mark}><p>{long}</p></section></article>") == f"{long}{long}".strip(), mark
    for mark in ("class='comments'", "id='comments'", "class='ad'", "class='ad-slot'", "class='related-posts'", "class='newsletter'", "class='share'", "class='user-comments list'"):
        assert html.main_text(f"<article><p>{long}</p><div {mark}><p>{long}</p></div></article>") == long.strip(), mark
    assert html.main_text(f"<article><p>{long}</p><p>Where <math><mi>x</mi> = <mn>1</mn></math>, <label>case one</label>.</p></article>").endswith("Where x = 1, case one.")
    outside = f"<div class='discussion'><p>{long}</p></div>"
    assert html.main_text(f"<body><article><p>{long}</p></article>{outside}</body>") == long.strip()


def test_short_paragraphs(spark):
    """Pairs of 20 to 49 words with a changed, a lost or an added word at a similarity of 0.8 and more."""
    rng, texts, pairs = random.Random(9), [], []
    vocabulary = [a + b + c for a in "bdfgk" for b in WORDS[:30] for c in "aeiou"]
    while len(pairs) < 240:
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 49))]
        v = list(w)
        for _ in range(rng.randint(1, 2)):
            at = rng.choice([0, 1, len(v) - 1, rng.randrange(len(v))])
            kind = rng.randrange(3)
            v[at : at + 1] = [[rng.choice(vocabulary)], [], [v[at], rng.choice(vocabulary)]][kind]
        x, y = (set(zip(*(z[i:] for i in range(5)), strict=False)) for z in (w, v))
        if len(v) >= 20 and 0.8 <= len(x & y) / len(x | y) < 1:
            pairs.append((len(texts), len(texts) + 1))
            texts += [" ".join(w), " ".join(v)]
    got = {r["doc_id"]: tuple(r["classes"]) for r in paragraphs.repeats(docs(spark, *texts)).collect()}
    assert sum(got[a] == got[b] != () for a, b in pairs) >= 0.95 * len(pairs)
    assert len({got[a] for a, _ in pairs if got[a]}) == sum(got[a] != () for a, _ in pairs)


def test_columns_of_any_name(spark):
    """Columns that bear the names of helper columns stay as they are."""
    names = ["text", "html", "ids", "__text", "__html", "__t", "__i", "_text", "_html", "_ids"]
    df = spark.createDataFrame([(1, "<p>" + "some words here " * 30 + "</p>", "a b", 5, *range(6))], "doc_id long, html string, body string, __text int, " + ", ".join(f"{n} int" for n in names[4:]))
    assert tokencount.token_counts(df, tokenizer("byte_bpe_50k.json"), text="body").select("n_tokens", "__text", "_text").first()[1:] == (5, 3)
    got = html.extract(df).first()
    assert got["text"].startswith("some words") and (got["__html"], got["_html"]) == (0, 4)
    coded = wfst.encode(df.withColumn("n", F.lit(1)), tokenizer("piece_bpe_32k.model"), text="body")
    assert (coded.first()["__t"], coded.first()["_text"]) == (1, 3)
    back = wfst.decode(coded, tokenizer("piece_bpe_32k.model")).first()
    assert back["text"] == "a b" and (back["__i"], back["_ids"]) == (2, 5)
