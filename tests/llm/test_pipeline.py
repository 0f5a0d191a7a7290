"""The pipeline on a small table against its stages by brute force, and the registered queries' columns."""

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from adinsight.llm import catalogue, decontamination, quality_rules
from adinsight.llm.common import table, written

from .test_operators import brute_components, brute_hits

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id start n_tokens ids_crc32", "op2": "doc_id n_tokens ids_sha256 decoded_sha256", "op4": "page_id url text n_chars",
    "op5": "doc_id held_out n_tokens n_known train_tokens base_score score", "op8": "doc_id n_shingles component_id",
    "op6": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op9": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op11": "doc_id piece start length ids_crc32 sequence_id offset", "op12": "vec_id component n deviation whitened explained identity_error",
    "op13": "lang rank phrase a l r n score", "op10": "doc_id n_assign n_access n_hex base_sha256 spans",
}


def test_every_operator_is_registered_once():
    names = [n for n in entry.queries() if n in catalogue.queries()]
    assert sorted(n.split("_")[0] for n in names) == sorted([*(f"op{i}" for i in range(1, 14)), "pipeline"])


def test_registered_queries_have_their_columns(spark):
    for name, query in catalogue.queries().items():
        wanted = COLUMNS.get(name.split("_")[0])
        if wanted:
            assert set(wanted.split()) <= set(query(spark, SF).columns), name


def test_stages_take_effect_and_keep_columns(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(written(stage(spark, kept[-1], SF), "stage"))
        assert kept[-1].columns == columns, name
    raw, quality, single, clean, private = ({r.doc_id: r.text for r in df.collect()} for df in kept)
    verdicts = quality_rules.assess(docs, quality_rules.fit(docs, table(spark, SF, "labels")))
    assert set(quality) == {r.doc_id for r in verdicts.select("doc_id", "__kept").collect() if r["__kept"]}
    order = sorted(quality)
    _, roots = brute_components([quality[i] for i in order], 5, 4, 5)
    assert set(single) == {order[min(k for k, r in enumerate(roots) if r == root)] for root in set(roots)}
    items = [(r.item_id, decontamination.words_of(r.text.encode())) for r in table(spark, SF, "benchmark").collect()]
    for i, text in single.items():
        words = decontamination.words_of(text.encode())
        hits, _ = brute_hits(words, items, 13)
        assert (i not in clean) == bool(hits and 20 * hits >= len(words))
        assert hits or clean[i] == text
    assert set(private) == set(clean)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in corpus_pipeline.STAGES[-1][1](spark, kept[-1], SF).collect():
        ids = library.encode(private[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline_over_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
