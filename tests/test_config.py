"""Checks of configuration documents."""

import pytest

from corpusmill.operators import config as C


def test_chunker():
    assert C.chunker_problems({"target_tokens": 10, "overlap_ratio": 0.1, "chunking_version": "v"}) == []
    assert C.chunker_problems({"target_tokens": 0, "overlap_ratio": 1.0}) == ["target_tokens", "overlap_ratio", "chunking_version"]


def test_cleanup_rules():
    assert C.cleanup_rule_problems([{"kind": "regex", "value": r"\d+", "band": "top"}]) == []
    assert C.cleanup_rule_problems([{"kind": "x"}, {"kind": "regex", "value": "("}, {"kind": "regex", "value": r"\\d"}, {"kind": "equals", "band": "left"}]) == ["0: kind", "1: pattern", "2: escaped twice", "3: band"]


def test_numbers_and_names():
    assert C.weight_problems({"a": 0.0, "b": -1, "c": float("nan"), "d": True, "e": None}) == ["b", "c", "d", "e"]
    assert C.parse_smoothing("standard") is None and C.parse_smoothing("epsilon") == 0.25 and C.parse_smoothing("epsilon:0.1") == 0.1
    with pytest.raises(ValueError):
        C.parse_smoothing("other")
    assert C.clamp(500, 200) == 200
    with pytest.raises(ValueError):
        C.clamp(0, 10)
    assert C.collection_name("docs", "bm25_like") == "docs_bm25"
    with pytest.raises(ValueError):
        C.collection_name("docs_bow", "bm25_like")
    assert C.artifact_problems({"a": 1}, {"a": 1, "b": 2}) == ["b"]


def test_documents(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text("a = 1\n[b]\nc = 2\n")
    assert C.read_config(str(p), {"a", "b"})["b"]["c"] == 2
    with pytest.raises(ValueError):
        C.read_config(str(p), {"a"})
