import itertools
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from turnstone.llm.tokens import public_tokenizer, tokenizer
from turnstone.llm.toxicity import raw_score, train, words_in
from turnstone.session import scratch_path

from .test_decontaminate import brute as contaminated
from .test_lm_and_lines import brute as lines_without_repeats
from .test_similarity import grouped

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == names
        after = docs.count()
        assert 0 < after <= before and (name != "line_dedup" or after == before)
        before = after
    packed = corpus_pipeline.packing(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == before


def test_run_as_brute_force(spark):
    """All stages one after another over plain lists: what goes, what stays, and the pieces that are packed."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    lexicon = train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    machine = lexicon.machine()
    left = [(i, t) for i, t in sorted(docs.items()) if lexicon.slope * raw_score(machine, words_in(t)) + lexicon.bias < 0]
    left = lines_without_repeats(left)
    sets = {}
    for i, t in left:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    near = lambda x, y: x == y or len(x & y) >= 0.8 * len(x | y) - 1e-9
    roots = grouped(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if near(sets[a], sets[b])])
    left = [(i, t) for i, t in left if roots[i] == i]
    dirty = {i for i, *_ in contaminated(left, items)}
    want = Counter()
    for i, t in left:
        if i not in dirty:
            n = len(tokenizer(public_tokenizer()).library.encode(t, add_special_tokens=False).ids) + 1
            want.update((i, p, min(2048, n - at)) for p, at in enumerate(range(0, n, 2048)))
    got = Counter((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_python_tasks_get_small_batches(spark):
    """What a Python task of a stage holds at once does not follow its rows: 600 texts of 40 KB, in one partition."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(600, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), 10_000).alias("text"))
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(limit)
            stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(50), SF)
            got = texts.mapInArrow(sizes, "n long, bytes long").collect()
            assert sum(r.n for r in got) == 600 and max(r.bytes for r in got) < 6 << 20, name
        spark.conf.set(limit, "1048576")  # a session's own limit stays
        corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
        assert spark.conf.get(limit) == "1048576"
    finally:
        spark.conf.unset(limit)
