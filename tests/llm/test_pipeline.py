import corpus_pipeline
from planlake.llm import decontaminate, simhash
from planlake.llm._io import table


def test_stages_keep_their_promises(spark, sf):
    docs = table(spark, sf, "documents").cache()
    made, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf).cache()
        made[name] = now
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    ids = lambda n: [r["doc_id"] for r in made[n].select("doc_id").collect()]
    first = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert set(ids("language_id")) == first
    groups = simhash.near_groups(made["language_id"], words=5, max_bits=22, segments=3, parts=2).collect()
    assert sorted(ids("simhash_near_dedup")) == sorted({r["component_id"] for r in groups})
    bench = table(spark, sf, "benchmark")
    leaks = {r["doc_id"] for r in decontaminate.matches(made["simhash_near_dedup"], bench).collect()}
    assert leaks and sorted(ids("benchmark_decontamination")) == sorted(set(ids("simhash_near_dedup")) - leaks)
    mixed = ids("source_mix")
    assert set(mixed) <= set(ids("benchmark_decontamination")) and max(map(mixed.count, set(mixed))) <= 2
    assert sorted(r["doc_id"] for r in made["token_output"].collect()) == sorted(mixed)
    assert corpus_pipeline.run(spark, sf).count() == len(mixed)
