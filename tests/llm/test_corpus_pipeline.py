"""The corpus pipeline on the smallest lake: what each stage hands on, and the mix of what is left."""

import re

import corpus_pipeline
from reitlens.llm import mixing, quality_lm, simhash_trie
from reitlens.llm.common import stored
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_hand_on_what_their_operators_keep(spark):
    source = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs, texts = source, {r.doc_id: r.text or "" for r in source.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF_SMALL), "test-stage")
        before, after = {r.doc_id for r in docs.collect()}, out.collect()
        left = {r.doc_id for r in after}
        assert left <= before and len(left) == len(after)
        if name == "quality rules":
            assert left == {r.doc_id for r in quality_lm.judge(docs.select("doc_id", "text", "lang")).where("kept").collect()} < before
        if name == "line dedup":
            for r in after:
                kept = iter(texts[r.doc_id].split("\n"))
                assert all(line in kept for line in (r.text or "").split("\n")) or not r.text  # lines of the text, in order
                assert r.n_chars == len(r.text or "")
        if name == "simhash near-dedup":
            cls = {r.doc_id: r.component_id for r in simhash_trie.classes(docs.select("doc_id", "text")).collect()}
            assert left == set(cls.values())
        if name != "mixing sources":
            assert out.columns == source.columns
        else:
            words = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
            assert all(r["size"] == words[r.doc_id] and r.copies in (1, 2) for r in after)
            assert {(r.doc_id, r.copies) for r in after} == {(r.doc_id, r.copies) for r in mixing.mix(docs).collect() if r.copies}
        docs = out
