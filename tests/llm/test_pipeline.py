import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from cutloom.llm import packing, toxicity
from cutloom.llm.common import written
from cutloom.tables import table

from .test_near import plain_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = written(stage(spark, docs, SF), name)
    return out


def test_each_stage(spark, kept):
    documents = table(spark, SF, "documents")
    for name in list(kept)[:-1]:
        assert kept[name].columns == documents.columns
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_report(documents, table(spark, SF, "labels")).collect()}
    clean = {r["doc_id"] for r in kept["toxicity"].collect()}
    assert clean == {d for d, s in scores.items() if s < 0.3}
    # five words at a similarity of 0.8, by brute force over all pairs
    alone = kept["simhash_near_dedup"].collect()
    assert sorted(r["doc_id"] for r in alone) == plain_kept([(r["doc_id"], r["text"]) for r in kept["toxicity"].collect()])
    bare = {r["doc_id"]: r for r in kept["secret_scan"].collect()}
    assert set(bare) == {r["doc_id"] for r in alone}
    assert not any(re.search(r"[0-9a-f]{32,}|AKIA[A-Z0-9]{12,}", r["text"]) for r in bare.values())
    assert all(bare[r["doc_id"]]["text"] == r["text"] for r in alone if not re.search(r"(?i)[0-9a-f]{32,}|AKIA|token|secret|passw|api_?key|pwd|login|user|client|account|access", r["text"]))
    assert all(r["n_chars"] == len(r["text"]) for r in bare.values())
    mixed = [r["doc_id"] for r in kept["source_mixing"].collect()]
    assert set(mixed) == set(bare) and all(1 <= mixed.count(d) <= 2 for d in bare)
    pieces = kept["best_fit_packing"].collect()
    assert sum(r["piece"] == 0 for r in pieces) == len(mixed)
    want = packing.pieces_of(kept["source_mixing"], 4096, 1, packing.tokenizer_file()).agg(F.sum("length"), F.sum("ids_crc32")).first()
    assert (sum(r["length"] for r in pieces), sum(r["ids_crc32"] for r in pieces)) == tuple(want)


def test_run_gives_the_last_stage(spark, kept):
    assert corpus_pipeline.run(spark, SF).count() == kept["best_fit_packing"].count()


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert set(entry.oracle_sql()) <= set(names)


def test_stages_on_odd_and_empty_documents(spark, odd, nothing):
    docs = odd
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        docs = written(stage(spark, docs, SF), name)
        assert docs.count() > 0
        assert stage(spark, nothing, SF).count() == 0
        if number < 5:
            assert docs.columns == odd.columns
        if number == 1:  # it only leaves rows out, and keeps all values of the others
            there = Counter(map(repr, odd.collect()))
            assert not Counter(map(repr, docs.collect())) - there
    rows = docs.collect()
    assert all(r["ids"] is not None and len(r["ids"]) == 4 * r["length"] for r in rows)
    assert len({(r["row_id"], r["piece"]) for r in rows}) == len(rows)
