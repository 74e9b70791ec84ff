"""The pipeline on planted documents, stage by stage against what a plain reading of the rules gives."""

import random

import corpus_pipeline

RNG = random.Random(11)
WORDS = ["".join(RNG.choices("abcdefghijklmnop", k=RNG.randint(2, 8))) for _ in range(5000)]


def line(n=14):
    return " ".join(RNG.choices(WORDS, k=n)).capitalize() + "."


def near(text):
    words = text.split()
    words[RNG.randrange(5, len(words) - 5)] = RNG.choice(WORDS)
    return " ".join(words)


def test_planted_documents(spark, tmp_path):
    clean = {i: "\n".join(line() for _ in range(6)) for i in range(40)}
    items = [line(20) + " " + line(10) for _ in range(5)]
    passage, whole = line(60), line(120)
    texts = dict(clean)
    texts[100] = "\n".join("Home | News | Shop | About us" for _ in range(9))  # rejected
    texts[101] = "Too short."  # rejected
    texts[102] = None  # rejected
    texts[110] = clean[3]  # exact copy
    texts[111] = clean[3]
    texts[120], texts[121] = (line() + "\n" + passage + "\n" + line() for _ in range(2))  # one line in two documents
    for i in range(130, 136):
        texts[i] = near(whole)  # near copies of one another
    for i in range(5):
        texts[140 + i] = line(30) + "\n" + items[i] + " " + line(40)  # benchmark items
    texts[150] = clean[5] + "\nAll rights reserved."  # a notice and a copy
    rows = [(i, t, "en", "web", 0 if t is None else len(t)) for i, t in texts.items()]
    rows.append(rows[7])  # a repeated row
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    want = [set(texts) - {100, 101, 102}]
    want.append(want[0] - {110, 111, 150})
    want.append(want[1] - set(range(131, 136)))
    want.append(want[2] - set(range(140, 145)))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want):
        docs = corpus_pipeline.common.stored(stage(spark, docs, str(tmp_path)))
        assert {r.doc_id for r in docs.collect()} == ids, name
    left = {r.doc_id: r.text for r in docs.collect()}
    assert docs.count() == len(left)  # the repeated row is there once
    assert left[120] == texts[120] and passage not in left[121] and len(left[121].split("\n")) == 2
    assert all(left[i] == t for i, t in clean.items())

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for run in (corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))):
        packed, tokens = {}, 0
        for r in run.collect():
            packed.setdefault(r.doc_id, []).append((r.piece, r.ids))
            tokens += r.length
        assert {i: [x for _, p in sorted(v) for x in p] for i, v in packed.items()} == {
            i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in left.items()}
        assert run.select("sequence_id").distinct().count() == -(-tokens // 2048)


def test_line_dedup_takes_the_end_of_a_repeated_run(spark, docs):
    run = line(68) + "\n" + line(4)
    own = [line(30), line(30)]
    rows = docs({1: run + "\n" + own[0], 2: run + "\n" + own[1], 3: run})
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, rows, "").collect()}
    assert left == {1: run + "\n" + own[0], 2: own[1]}


def test_near_copies_of_shared_and_null_ids(spark, docs):
    one, other, third = line(60), line(60), line(60)
    rows = [(3, one), (5, one), (5, other), (None, one), (None, one), (None, third), (None, None), (9, near(other)),
            (7, third), (7, third), (8, ""), (8, "")]
    got = corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, [
        (3, one), (5, other), (7, third), (None, None), (8, ""), (8, "")]))


def test_pipeline_of_no_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
