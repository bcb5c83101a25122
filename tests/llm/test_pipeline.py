import corpus_pipeline as c
from talkmill.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_work_on_their_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.dtypes
    assert [n for n, _ in c.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "pii_redaction", "source_mixing"]
    sizes = [docs.count()]
    for k, (_, f) in enumerate(c.STAGES):
        f(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        assert docs.dtypes == schema or k == len(c.STAGES) - 1
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] > 0
    run = sorted(map(str, c.run(spark, SF).collect()))
    assert run == sorted(map(str, docs.collect()))


def test_all_are_registered():
    names = list(queries.QUERIES)
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_stages_on_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _fp string, _text string, quality_score int, quality_ok int, _place int, comp int, _base int"
    good = "the river by the stone goes on and the tree stands there in the rain until night falls over all of it "
    extra = ("f", "t", 1, 1, 1, 1, 1)
    rows = [(1, good * 3, "en", "src0", 9, *extra), (2, good * 3, "en", "src0", 9, *extra), (2, good * 3, "en", "src0", 9, *extra), (None, good[::-1] * 2, None, None, None, *[None] * 7),
            (5, None, None, None, None, *extra), (6, "", "", "", 0, *extra), (7, good * 2000, "en", "src1", 1, *extra), (8, good + "a@b.cc +1 (743) 555-3824", "en", "src2", 3, *extra)]
    docs = spark.createDataFrame(rows, schema)
    sf = str(tmp_path / "sf")
    spark.createDataFrame([(1, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "no such words " * 9)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, f in c.STAGES:
        out = f(spark, docs, sf)
        got = out.collect()
        if name == "source_mixing":
            assert out.columns == [*docs.columns, "copy_no"]
        else:
            assert out.dtypes == docs.dtypes
        if name == "minhash_near_dedup":  # one row of those with the same shingles (7 repeats 1), both empty ones, the null id's and the rest
            assert sorted((str(r.doc_id) for r in got)) == ["1", "5", "6", "8", "None"]
        if name == "benchmark_decontamination":
            assert len(got) == len(rows)
        if name == "pii_redaction":
            assert next(r.text for r in got if r.doc_id == 8) == good + "[EMAIL] [PHONE]" and len(got) == len(rows)
        assert f(spark, docs.limit(0), sf).count() == 0
