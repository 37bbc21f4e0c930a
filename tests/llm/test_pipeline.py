import corpus_pipeline
from support import DATA, rows_of

from trialweave.llm.mixing import mix_report
from trialweave.llm.neardup import near_duplicates
from trialweave.llm.quality import quality_rules


def test_stages_take_effect_one_after_another(spark):
    folder = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.staged(stage(spark, docs, folder), "test")
        seen.append((name, docs, after))
        if name != "best-fit packing":
            assert after.columns == columns
        docs = after
    ids = lambda df: sorted(r[0] for r in rows_of(df, ["doc_id"]))
    _, before, after = seen[0]
    assert ids(after) == ids(quality_rules(before).where("kept"))
    _, before, after = seen[1]
    assert set(ids(after)) <= set(ids(before))
    texts = dict(rows_of(before, ["doc_id", "text"]))
    for d, text, n in rows_of(after, ["doc_id", "text", "n_chars"]):
        assert len(text) == n
        assert set(text.split("\n")) <= set(texts[d].split("\n"))
    _, before, after = seen[2]
    assert ids(after) == ids(near_duplicates(before).where("kept"))
    _, before, after = seen[3]
    assert sum(len(t.split()) for _, t in rows_of(after, ["doc_id", "text"])) == sum(r[0] for r in rows_of(mix_report(before), ["taken"]))
    _, before, after = seen[4]
    assert sorted(ids(after.where("piece = 0"))) == ids(before)
    final = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, final.collect())) == sorted(map(str, after.collect()))


def test_empty_and_odd_documents_pass_through(spark, odd):
    for docs in (odd, odd.limit(0)):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.staged(stage(spark, docs, ""), "test")
        docs.count()
