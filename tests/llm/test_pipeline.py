"""The pipeline on planted rows: what must go goes, what must stay stays."""

import corpus_pipeline


def test_pipeline_on_planted_rows(spark, tmp_path):
    clean = [f"Document {w} tells of {w} and its many sides. " * 6 + f"\nA second line about {w}." for w in ("rivers", "mountains", "engines", "music", "trade")]
    toxic = [f"you vile foul person {w} vile foul nasty words {w}" for w in "abcdefghijkl"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)] + [(20, clean[0], "en", "s", 1), (21, 'the key is password = "abcdefgh12345" ok', "en", "s", 1), (22, None, None, None, None)]
    rows += [(100 + i, t, "en", "s", 1) for i, t in enumerate(toxic * 8)]
    rows += [(300 + i, f"fine plain text number {i} of the set about {w}", "en", "s", 1) for i, w in enumerate(["sun", "moon", "sea", "wind"] * 24)]
    labels = [(100 + i, 1, 1) for i in range(96)] + [(300 + i, 1, 0) for i in range(96)] + [(i, 1, 0) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert not any(100 <= i < 200 for i in seen[0]) and set(range(5)) <= set(seen[0])
    assert seen[1].keys() == seen[0].keys()
    assert 20 not in seen[2] and set(range(5)) <= set(seen[2])
    assert "abcdefgh12345" not in seen[3][21] and seen[3].keys() == seen[2].keys()
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(seen[3])


def test_stages_of_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __id int, __hash string, kept string, __kept int, __lines int, toxic_text string"
    long = " ".join(f"w{i % 977}x" for i in range(60_000))
    rows = [(1, long, "en", "s", 1), (2, long, "en", "s", 1), (3, "", None, None, None), (4, None, None, None, None), (None, "no id here", "en", "s", 9), (5, "twice the same row", "en", "s", 2), (5, "twice the same row", "en", "s", 2)]
    odd = [(*r, 7, "h", "k", 3, 4, "t") for r in rows]
    labels = spark.createDataFrame([(1, 1, 0), (9, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for k, own in enumerate((odd, [])):
        spark.createDataFrame(own, schema).write.parquet(f"{tmp_path}/{k}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        columns, types = docs.columns, docs.dtypes
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert (docs.columns, docs.dtypes) == (columns, types), name
            docs.write.parquet(f"{tmp_path}/{k}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")
        found = docs.collect()
        assert {(r["__id"], r["__hash"], r["kept"], r["__kept"], r["__lines"], r["toxic_text"]) for r in found} == ({(7, "h", "k", 3, 4, "t")} if own else set())
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        if own:
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == [(False, 1), (False, 3), (False, 5), (False, 5), (True, 0)]
            assert next(r["text"] for r in found if r["doc_id"] == 1) == long
            assert sum(r["length"] for r in packed if r["doc_id"] == 1) > 60_000 and {r["doc_id"] for r in packed} == {1, 3, 5, None}
        else:
            assert found == packed == []
