"""The pipeline's result against its stages by brute force, and its contract."""

import corpus_pipeline
from pyspark.sql import functions as F
from topograph.llm import decontaminate, language_id
from test_similarity_operators import brute


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = language_id.label(docs).toPandas()
    kept = told[(told.lang_pred != "und") & (told.score >= corpus_pipeline.LEAST_SCORE)]
    assert len(kept) > 0.95 * len(told)
    groups = brute(list(zip(kept.doc_id, kept.text, strict=True)), 5, 80, 100)
    kept = kept[[groups[i][1] == i for i in kept.doc_id]]
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas()
    index, canon = decontaminate.Benchmark(list(zip(bench.item_id, bench.text, strict=True))), decontaminate.Canon()
    kept = kept[[not x for x in index.leaks(list(kept.text), canon)]]
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert sorted(out.doc_id) == sorted(kept.doc_id) and out.round_trip.all()


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, blanks, repeated rows, long texts and clashing columns: every stage keeps the values of all columns, and judges rows by their own text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first()["text"]
    fine = "The weather was fine and so they walked along the river for a while before they had their lunch under the old trees. "
    odd = [(None, None), (None, leak), (-1, ""), (-2, " \n "), (-3, "12 34"), (-4, fine), (-4, fine), (None, fine), (-5, " ".join(f"{fine}{i}" for i in range(3000))), (-4, leak)]
    rows = docs.unionByName(spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema))
    clash = {"score": F.lit(-7.0), "lang_pred": F.lit("mine"), "Held_Out": F.lit(3), "gone": F.lit("g"), "tag": F.lit("t"), "id": F.lit(1), "item_id": F.lit(2), "key": F.lit(0)}
    rows = rows.withColumns(clash)
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf_dir)
        assert out.columns == rows.columns
        assert [tuple(r) for r in out.select(*clash).distinct().collect()] == [(-7.0, "mine", 3, "g", "t", 1, 2, 0)]
        left[name] = sorted((r["doc_id"] or 0, r["text"]) for r in out.filter("doc_id is null or doc_id < 0").select("doc_id", F.coalesce("text", F.lit("null")).alias("text")).collect())
    mine = lambda *skip: sorted((i or 0, "null" if t is None else t) for k, (i, t) in enumerate(odd) if k not in skip)
    assert left["language_id"] == mine(0, 2, 3, 4)
    assert [x for x in left["jaccard_join"] if x[1] == fine] == [(-4, fine)] and (0, "null") in left["jaccard_join"] and (-2, " \n ") in left["jaccard_join"]
    assert left["decontamination"] == mine(1, 9)
    encoded = corpus_pipeline.encode_texts(spark, rows, sf_dir)
    assert encoded.count() == rows.count() and encoded.filter("not round_trip").count() == 0
