import corpus_pipeline as P
from sparkann.llm import language_id, quality
from sparkann.llm.common import stored
from tests.llm.test_near_copies import brute_kept

DATA = "/root/testdata/sf0.01"


def test_stages_against_their_operators(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    names = [n for n, _ in P.STAGES]
    assert names == ["language", "quality", "near_duplicates", "mixing", "packing"]
    steps = [docs]
    for name, f in P.STAGES:
        steps.append(stored(f(spark, steps[-1], DATA), name))
    ids = [[r.doc_id for r in s.select("doc_id").collect()] for s in steps]
    assert all(s.columns == docs.columns for s in steps[:-1])
    # Language: what is not rejected stays.
    told = language_id.classify(docs, language_id.fit(docs.where(~language_id.held_out("doc_id"))))
    assert sorted(ids[1]) == sorted(r.doc_id for r in told.where("not rejected").collect())
    # Quality: what is kept stays; clean documents are.
    assert sorted(ids[2]) == sorted(r.doc_id for r in quality.figures(steps[1]).where("kept").collect())
    clean = [i for i in ids[1] if labels.get(i) == 1]
    assert sum(i in set(ids[2]) for i in clean) > 0.95 * len(clean)
    # Near-duplicates: the smallest id of each component of texts whose five-word shingles have a similarity of 0.8 or more, by all pairs.
    rows = [(r.doc_id, r.text) for r in steps[2].select("doc_id", "text").collect()]
    assert sorted(ids[3]) == sorted(rows[i][0] for i in brute_kept(rows))
    # Mixing: known documents, three times at most.
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].count(i) for i in set(ids[4])) <= 3
    # Packing: every copy is packed.
    packed = steps[5].toPandas()
    starts = packed[packed.start == 0].groupby("doc_id").size().to_dict()
    assert starts == {i: ids[4].count(i) for i in set(ids[4])}


def test_run_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
