import zlib
from collections import Counter

import corpus_pipeline
from nearkin.llm import simhash, substrings
from nearkin.llm.decontamination import contamination
from nearkin.llm.shared import stored

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, D), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        assert docs.filter("n_chars != char_length(text)").count() == 0 or name in ("toxicity", "near_duplicates")
        before = docs.count()
        if name == "near_duplicates":
            assert {r[0] for r in simhash.near_duplicates(docs).groupBy("root").count().select("count").collect()} == {1}
        if name == "substrings":
            assert substrings.digest_substrings(docs).filter("n_removed > n_words").count() == 0
        if name == "decontamination":
            assert contamination(docs, spark.read.parquet(f"{D}/benchmark.parquet")).filter("contaminated").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()
    assert {r["doc_id"] for r in pieces} == {r[0] for r in docs.select("doc_id").collect()}
    tokens, whole = Counter(), {}
    for r in pieces:
        tokens[r["doc_id"]] += r["length"]
        whole[r["doc_id"]] = r["doc_tokens"]
    assert tokens == whole
    run = corpus_pipeline.run(spark, D).select("doc_id", "start", "length", "ids_crc32").collect()
    key = lambda r: zlib.crc32(repr(tuple(r)).encode())
    assert sorted(map(key, run)) == sorted(key((r["doc_id"], r["start"], r["length"], r["ids_crc32"])) for r in pieces)


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, clashing names, and empty tables."""
    long = " ".join(f"w{k}" for k in range(3000))
    item = "the quick brown fox jumps over a lazy dog today"
    texts = [None, "", "   ", "one", long, long, f"{long} tail", f"first {item} last", f"second {item} end", "plain words of a clean text"]
    docs = [(k if k != 3 else None, t, "en" if k % 2 else None, None, None if t is None else len(t), "r", 1, "n", [k], 2) for k, t in enumerate(texts)]
    docs += [docs[9], docs[9], docs[0]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_id string, slab int, node string, keys array<int>, c0 int"
    df = spark.createDataFrame(docs, schema)
    spark.createDataFrame([(k, k % 2, 0, "clash") for k in range(6)] + [(None, 1, None, ""), (2, None, None, "")], "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item, 3), (2, None, 4), (None, "one", 5)], "item_id long, text string, row_id int").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (df, df.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stored(stage(spark, now, str(tmp_path)), name)
            assert now.schema.names == df.schema.names
        kept = now.collect()
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in kept}
        if table is df:
            by = {r["doc_id"]: r for r in kept}
            assert by[7]["text"] == "first last" and by[9]["text"] == texts[9] and by[9]["row_id"] == "r" and by[9]["keys"] == [9]
            assert sum(r["doc_id"] == 9 for r in kept) == 1 and sum(r["doc_id"] == 4 for r in kept) == 1 and 5 not in by and 6 not in by
        else:
            assert kept == [] == pieces


def test_reject_toxic(spark):
    """The stage keeps exactly what the scores do not reject, with all columns as they were."""
    from nearkin.llm import toxicity

    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in toxicity.score_toxicity(docs, labels).filter("predicted = 0").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want
