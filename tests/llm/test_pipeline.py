import corpus_pipeline
from tracelode.llm import decontamination, packing, secrets, simhash, toxicity
from tests.llm.test_packing import check
from tests.llm.test_simhash import similar


def test_against_plain_stages(spark, sf, documents):
    model = toxicity.learn(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = sorted((r.asDict() for r in documents.collect()), key=lambda r: r["doc_id"])
    rows = [r for r, s in zip(rows, model.apply([r["text"] for r in rows], {})[0], strict=True) if s < 0.3]
    kept, _ = similar([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if r["doc_id"] in set(kept)]
    items = [decontamination.words_of(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaks(text):
        own = decontamination.shingles(decontamination.words_of(text), 5)
        return any(len(own & (s := decontamination.shingles(i, 5))) >= 0.8 * len(s) for i in items)

    rows = [{**r, "text": secrets.redacted(r["text"])} for r in rows if not leaks(r["text"])]
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in rows} and 0 < len(rows) < documents.count()
    check(got, [r["text"] for r in rows], 2048)


def test_stages_keep_columns(spark, sf, documents):
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.STAGES[0][0], corpus_pipeline.STAGES[-1][0]] == [5, "toxicity", "packing"]
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.schema == documents.schema, name


def test_odd_and_empty_tables(spark, sf, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
        packed = packing.pack(docs, corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
        assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}
        assert (docs.count() > 0) == (packed.count() > 0)
    assert simhash.first_of_each(odd).count() == 6
