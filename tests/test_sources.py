"""Readers, writers and annotation tables."""

import json

import numpy as np
import pytest

from orrery.plans import audit
from orrery.sources import tables as T


def test_delimited_and_scores(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("source\ttarget\tconfidence\ntf1\tg1\tB\nTF1\tG1\tA\ntf1\tg2\tX\ntf2\tg1\t\n")
    raw = T.read_delimited(spark, str(tmp_path / "a.tsv"), "source string, target string, confidence string", "\t")
    got = {(r.source, r.target): r.score for r in T.confidence_scores(raw, -1).collect()}
    assert got == {("TF1", "G1"): 4, ("TF1", "G2"): -1, ("TF2", "G1"): -1}
    T.write_delimited(raw, str(tmp_path / "out"))
    assert T.read_delimited(spark, str(tmp_path / "out"), "source string, target string, confidence string").count() == 4


def test_signed_pairs_first_wins(spark):
    raw = spark.createDataFrame([(1, "a", "b", "Activation"), (2, "A", "B", "Repression"), (3, "a", "c", "Unknown"), (4, "a", "c", "repression")], "line int, source string, target string, mode string")
    assert {(r.source, r.target): r.sign for r in T.signed_pairs(raw, "line").collect()} == {("A", "B"): 1, ("A", "C"): -1}
    assert T.source_degree(raw).first().degree == 4


def test_symmetric_scores_and_terms(spark):
    raw = spark.createDataFrame([("a", "b", 0.4), ("b", "a", 1.7), ("a", "c", float("nan"))], "a string, b string, score double")
    assert {(r.a, r.b): r.score for r in T.symmetric_scores(raw).collect()} == {("A", "B"): 1.0, ("B", "A"): 1.0}
    terms = spark.createDataFrame([("a", "GO:1"), ("A", "GO:1"), ("a", "x")], "symbol string, term string")
    assert [tuple(r) for r in T.term_sets(terms, "GO:").collect()] == [("A", "GO:1")]


def test_tensor_and_paths(spark, tmp_path):
    np.save(tmp_path / "t.npy", np.arange(12, dtype=np.float32).reshape(2, 3, 2))
    got = {(r.layer, r.node_id): r.vec for r in T.read_tensor(spark, str(tmp_path / "t.npy")).collect()}
    assert got[(1, 2)] == [10.0, 11.0] and len(got) == 6
    T.require_paths(spark, [str(tmp_path / "t.npy")])
    with pytest.raises(FileNotFoundError, match="nowhere"):
        T.require_paths(spark, [str(tmp_path / "t.npy"), str(tmp_path / "nowhere")])


def test_json_documents(spark, tmp_path):
    for n, d in ((7, "negative"), (8, "promising")):
        (tmp_path / f"iter_{n:04d}.json").write_text(json.dumps({"hypotheses": [{"id": f"H{n}", "family": "geo", "decision": d}]}, indent=1))
    docs = T.read_json_documents(spark, str(tmp_path), "hypotheses array<struct<id string, family string, decision string>>")
    assert sorted((r.iteration, r.id) for r in audit.explode_screens(docs).collect()) == [(7, "H7"), (8, "H8")]
    T.append_events(spark.createDataFrame([("2026", "start")], "ts string, event string"), str(tmp_path / "log"))
    T.append_events(spark.createDataFrame([("2026", "stop")], "ts string, event string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    T.write_json_document(spark, str(tmp_path / "doc"), {"b": 1, "a": 2})
    assert json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "doc"), wholetext=True).collect())) == {"a": 2, "b": 1}
