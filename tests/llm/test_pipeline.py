"""The pipeline keeps clean documents, drops what is planted, and passes odd rows through."""

import random

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in ("ln", "rt", "st")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bad = ["vile", "rotten", "foul"]
    rows, labels = [], []
    for i in range(240):
        t = text(rng.randint(60, 120))
        if i % 5 == 0:
            w = t.split()
            for _ in range(5):
                w[rng.randrange(len(w))] = rng.choice(bad)
            t = " ".join(w)
        rows.append([i, t, "en", f"s{i % 4}", len(t)])
        labels.append((i, int(i % 5 == 0)))
    shared = text(80)
    for i in (11, 22, 33):
        rows[i][1] += " " + shared
    rows += [[240, rows[1][1], "en", "s0", 1], [241, rows[2][1] + " extra", "en", "s1", 1], [242, None, None, None, None], [243, "", "en", "s1", 0]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen.append((name, docs))
        assert docs.columns == corpus_pipeline.COLUMNS
    after = {name: {r["doc_id"]: r for r in df.collect()} for name, df in seen}
    clean = {i for i in range(240) if i % 5}
    assert set(after["toxicity"]) & set(range(240)) == clean
    assert set(after["near_duplicates"]) == (clean | {242, 243}) - {243}  # null and empty text are equal
    assert shared not in after["repeats"][11]["text"] and after["repeats"][12]["text"] == rows[12][1]
    assert after["repeats"][242]["text"] is None
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 200


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null and repeated keys, repeated rows, a very long text, columns with names that stages use themselves, no labels at all."""
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    texts = [text(80) for _ in range(6)]
    rows = [(1, texts[0], "s"), (1, texts[0], "s"), (1, texts[1], "s"), (None, texts[2], None), (None, texts[2], None), (None, None, None), (2, "", "s"), (3, texts[3] + " " + texts[4], "t"), (4, texts[4] + " " + texts[5], "t"), (5, "x " * 400_000, "u")]
    wide = "doc_id long, text string, lang string, source string, n_chars long, _rid long, class_id long, copies int, kept string"
    spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, 3, "k") for i, t, s in rows], wide).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        after[name] = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert len(after["toxicity"]) == len(rows)
    assert sorted(len(t or "") for _, t in after["near_duplicates"]) == sorted(len(t or "") for t in [texts[0], texts[1], texts[2], "", rows[7][1], rows[8][1], rows[9][1]])
    kept = {i: t for i, t in after["repeats"] if i in (3, 4, 5)}
    assert texts[4][5:-5] not in kept[3] + kept[4] and kept[5] == "" and kept[3].startswith(texts[3]) and kept[4].endswith(texts[5])
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.count() >= 4 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(result.columns)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
