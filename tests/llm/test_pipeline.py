"""The pipeline's stages on a small table, with decisions that can be told by eye."""

import hashlib

from tests.llm.test_operators import long_unique


def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    item = long_unique("item", 30)
    good = [long_unique(f"g{i}", 60) for i in range(6)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(good)]
    rows += [(10, good[0], "en", "s", 0), (11, good[1].upper(), "en", "t", 0), (12, "too short", "en", "s", 0), (13, None, None, None, 0)]
    rows += [(14, long_unique("x", 40) + " " + item, "en", "s", 0), (15, long_unique("y", 40) + " password=abcdefghijklmnop1234", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r["doc_id"] for r in docs.collect()})
    assert seen == [{*range(6), 10, 11, 14, 15}, {*range(6), 14, 15}, {*range(6), 15}, {*range(6), 15}]
    masked = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert masked[15].endswith(" [secret]") and masked[0] == good[0]
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(6), 15}
    assert all(r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() for r in out.values())


def test_odd_tables(spark, tmp_path):
    """Empty tables, repeated and null rows, a very long text, and columns whose names the stages use inside."""
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _gone string, row int, key int, _leak string, _t string, spans string, ids string"
    item, long = long_unique("item", 30), "\n".join(long_unique(f"long{i}", 40) for i in range(800))
    rows = [(1, long, "en"), (2, long_unique("a", 50), "en"), (2, long_unique("a", 50), "en"), (None, long_unique("b", 50), None), (None, long_unique("b", 50) + " tail", None)]
    rows += [(None, item + " " + long_unique("c", 30), "en"), (None, None, None), (3, "", "en"), (3, long_unique("d", 50), "en")]
    tail = ("s", 0, "g", 1, 2, "l", "t", "sp", "id")
    for name, given in (("some", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame([(*r, *tail) for r in given], schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, item)] if given else [], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == schema.replace(",", "").split()[::2]
            seen.append(sorted(((r["doc_id"], len(r["text"] or "")) for r in docs.collect()), key=repr))
        if given:
            size = lambda seed, n: len(long_unique(seed, n))
            last = [(1, len(long)), (2, size("a", 50)), (3, size("d", 50))]
            assert [x for x in seen[3] if x[0]] == last and [x[0] for x in seen[3]].count(None) == 1
            assert len(seen[0]) == 7 and len(seen[1]) == 5 and len(seen[2]) == 4
        else:
            assert seen == [[]] * 4
        out = corpus_pipeline.run(spark, folder)
        assert out.count() == len(seen[3]) and out.filter("ids is null").count() == 0
