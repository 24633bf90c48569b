"""The pipeline against plain Python over the smallest tables, stage by stage."""

import os

import sentencepiece

import corpus_pipeline as pipeline
from farpoint.llm import mixing, quality, simhash
from farpoint.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, `k` string, n int"


def plain_lines(docs):
    seen, out = set(), {}
    for i in sorted(docs):
        lines = (docs[i] or "").split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        new = "\n".join(x for p, x in enumerate(lines) if p not in gone) if gone else docs[i]
        if not gone or new.strip():
            out[i] = new
    return out


def plain_copies(docs):
    ids = sorted(docs)
    words = {i: (docs[i] or "").encode().lower().split() for i in ids}
    sets = {i: set(simhash.shingles(docs[i], 5)) for i in ids}
    root = {i: i for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if words[i] == words[j] or sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                lo, hi = min(old, new), max(old, new)
                root = {k: lo if r == hi else r for k, r in root.items()}
    return {i for i in ids if root[i] == i}


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    good = {r["doc_id"] for r in quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert 0 < len(good) < len(text)
    lined = plain_lines({i: text[i] for i in good})
    want = plain_copies(lined)
    got = pipeline.run(spark, SF).orderBy("mix_position").collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want)
    assert [r["mix_position"] for r in got] == list(range(len(want)))
    assert all(list(r["ids"]) == lib.encode(lined[r["doc_id"]] or "") and r["n_pieces"] == len(r["ids"]) and r["exact"] for r in got)
    for r, s in zip(got, mixing.mix(spark.createDataFrame([r for r in docs.collect() if r["doc_id"] in want], docs.schema).drop("text")).orderBy("mix_position").collect(), strict=True):
        assert r["source"] == s["source"]  # whose turn it is depends on counts alone


def test_stages_of_awkward_tables(spark, tmp_path):
    """Nulls, no text, blanks, a very long text, repeated rows, further columns; then no rows at all."""
    line = "some words that make up a line of the text that is long enough to count as prose, more or less, I think."
    long = "\n".join(f"{line} {i}" for i in range(3000))
    rows = [(None, None, None, None, None, None, None), (1, "", "en", "a", 0, "x", 1), (2, " \n ", "en", None, 3, "x", 2), (3, long, "en", "a", 1, "y", 3), (3, long, "en", "a", 1, "y", 3), (4, f"{line}\nb\nc\n{line}\nb\nc", "en", "b", 1, "z", 4)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, AWKWARD)
    for empty in (False, True):
        d = docs.limit(0) if empty else docs
        for name, stage in pipeline.STAGES:
            out = stage(spark, d, str(tmp_path))
            kept = out.collect()
            if name != "pieces":
                assert out.columns == list(pipeline.COLUMNS)
            assert not empty or not kept
            if empty:
                continue
            if name == "lines":
                assert [r["text"] for r in kept if r["doc_id"] == 4] == [f"{line}\nb\nc"] and len(kept) == 6
            if name == "copies":  # without words: one, of the least id; the repeated row: one
                assert sorted(r["doc_id"] for r in kept) == [1, 3, 4]
            if name == "mix":
                assert len(kept) == 6
            if name == "pieces":
                assert sorted(r["mix_position"] for r in kept) == list(range(6)) and {r["n_pieces"] for r in kept if not r["ids"]} == {0}
    assert os.path.isdir(tmp_path)
