"""The pipeline's stages, and queries with SQL."""

import pytest

import corpus_pipeline
from lumenframe import llm
from lumenframe.llm import _shared, langid, lines, mixing
from lumenframe.llm._shared import forget, stash


from ..compare import same
from .test_operators import kept_of_groups

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same(spark, sf_dir, llm.queries()[name], SQL[name])


def test_every_operator_has_one_query():
    numbers = [int(n[2:].split("_")[0]) for n in llm.queries()]
    assert sorted(numbers) == list(range(1, 14))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf_dir).cache())
    assert all(d.columns == columns for d in seen[:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:])) 
    # each stage against what its operator says of its own input
    said = {r.doc_id for r in langid.identify(seen[0]).where("lang_pred != 'und' and score >= 0.4").collect()}
    assert ids[1] == said
    left = {r.doc_id for r in lines.dedup_lines(seen[1]).where("n_words > 0 or n_removed = 0").collect()}
    assert ids[2] == left
    want = kept_of_groups({r.doc_id: r.text for r in seen[2].collect()})
    assert want <= ids[3] and len(ids[3] - want) <= 0.1 * (len(ids[2]) - len(want))
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    low = {r.doc_id: r.text.lower() for r in seen[4].collect()}
    assert not [i for i, t in low.items() for b in bench if b and len(b.split()) >= 10 and b.lower() in t]
    taken = {(r.doc_id, n) for r in mixing.mix_sources(seen[4]).collect() if r.size for n in range(1, r.taken // r.size + 1)}
    assert {(r.doc_id, r.copy) for r in seen[5].collect()} == taken
    out = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, seen[5].collect()))


def test_run_leaves_only_what_its_result_reads(spark):
    forget(spark)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    assert len(_shared._WRITTEN) <= 3  # the fourth stage's result and the mix's counts


def last_plan(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return next(p for p in (runs.apply(i).physicalPlanDescription() for i in reversed(range(runs.size()))) if "InsertInto" in p)


def test_whole_texts_are_not_sorted_into_buckets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    rows = _shared.placed(docs.select("doc_id", "text"))
    plan = last_plan(spark)
    assert "WriteFiles" in plan and "Sort" not in plan
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    said = _shared.answered(rows, rows.select("_at", (rows.doc_id * 2).alias("twice")), "twice")
    assert said.where("twice = doc_id * 2").count() == docs.count() and len(rows.inputFiles()) == 3


def test_texts_go_to_python_some_at_a_time(spark):
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    count = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
    before = spark.conf.get(key)
    sizes = [r.n for r in _shared.stash_texts(spark.range(9000, numPartitions=1).mapInArrow(count, "n long")).collect()]
    assert sum(sizes) == 9000 and max(sizes) <= _shared.TEXT_ROWS and spark.conf.get(key) == before


def test_queries_in_two_threads_keep_their_tables(spark):
    from threading import Barrier, Thread

    both, seen = Barrier(2), {}

    def query(name, first):
        step = _shared.own_tables()
        own = stash(spark.range(5))
        both.wait()
        if first:
            _shared.clear(spark, step)
        both.wait()
        seen[name] = own if first else own.count()

    threads = [Thread(target=query, args=(n, n == "a")) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert seen["b"] == 5
    with pytest.raises(Exception):
        seen["a"].count()
    assert forget(spark) >= 1


def test_language_id_sends_python_few_rows(spark, monkeypatch):
    import pyarrow as pa

    def predict(docs, model, carry):
        def run(batches):
            for b in batches:
                few = "en" if b.num_rows <= _shared.TEXT_ROWS else "und"
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], pa.array([few] * b.num_rows), pa.array([1.0] * b.num_rows)], names=[*carry, "lang_pred", "score"])

        return docs.select(*carry).mapInArrow(run, _shared.with_fields("", docs, carry, "lang_pred string, score double"))

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(langid, "predict", predict)
    monkeypatch.setattr(langid, "fit", lambda docs: None)
    try:
        docs = spark.range(9000, numPartitions=1).selectExpr("id AS doc_id", "'a b' AS text", "'en' AS lang")
        assert langid.reject_unknown_language(docs).count() == 9000  # read after the call, as by the pipeline's next stage
        spark.conf.set(key, "7")
        langid.reject_unknown_language(docs)
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, before)


def test_sample_starts_no_python_workers(spark, monkeypatch):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    monkeypatch.setattr(langid, "MOST_BROADCAST", 0)  # what is broadcast is not in the lineage
    spark.conf.set(key, "-1")
    try:
        docs = spark.range(20).selectExpr("id AS doc_id", "'some text' AS text", "'en' AS lang")
        rdds, names = [langid.sample(docs)._jdf.queryExecution().toRdd()], []
        while rdds:
            rdd = rdds.pop()
            names.append(rdd.getClass().getSimpleName())
            rdds += [rdd.dependencies().apply(i).rdd() for i in range(rdd.dependencies().size())]
    finally:
        spark.conf.set(key, before)
    assert len(names) > 3 and "PythonRDD" not in names
