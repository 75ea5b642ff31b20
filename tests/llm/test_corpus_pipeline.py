"""The stages of the corpus pipeline, each against what its operator's own tests establish, and the run as a whole."""

from collections import Counter

import corpus_pipeline
from tessera.llm import fm_toxicity, host_rules, probminhash
from tessera.llm.common import table

AT = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = table(spark, AT, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = corpus_pipeline.cut(stage(spark, docs, AT), f"test-{name}")
        assert held.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = held.collect()
        ids = {r.doc_id for r in rows}
        assert ids <= before and len(ids) == len(rows)
        if name == "quality":
            judged = host_rules.judged(docs).select("row.doc_id", "kept").collect()
            assert ids == {r.doc_id for r in judged if r.kept}
        elif name == "toxicity":
            score = fm_toxicity.fit(docs, table(spark, AT, "labels")).scorer()
            assert ids == {r.doc_id for r in docs.collect() if score(r.text) < 0.5}
        else:
            classes = {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs).collect()}
            assert Counter(classes[i] for i in ids) == Counter(set(classes.values()))
        docs, before = held, ids


def test_run(spark):
    got = corpus_pipeline.run(spark, AT).collect()
    room = Counter()
    for r in got:
        room[r.sequence_id] += r.length
    assert got and max(room.values()) <= 2048
    at = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for (s, o, n), (t, p, _) in zip(at, at[1:], strict=False):
        assert p == (o + n if s == t else 0)


def test_empty_tables_and_extra_columns(spark):
    docs = table(spark, AT, "documents")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), AT).count() == 0
