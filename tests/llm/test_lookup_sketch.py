from __future__ import annotations

import hashlib
import re

import pytest

from tallywright.llm import lookup_sketch as ls

TEXTS = {0: "a\nb\nc\nd\n", 5: None, 7: "", 9: "é🙂" * 301, 12: "a\nb\nc\nd\n", 20: "line %d\n" * 1, 21: "\n".join(f"row {i}" for i in range(900)), 30: "\n".join(f"row {i}" for i in range(905)), 31: "x"}


def units(text):
    return set(re.findall(rf"[^\n]{{1,{ls.PART}}}\n?|\n", text))


def likeness(a, b):
    a, b = units(a), units(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(texts):
    order = sorted(texts, reverse=True)
    out = {}
    for i, d in enumerate(order):
        text, after = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out[d] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(text, edited), likeness(text, after))
    return out


def check(frame, texts):
    rows = {r.doc_id: r for r in ls.fingerprints(frame).collect()}
    want = expected(texts)
    assert set(rows) == set(want)
    for d, (n, sha, edited, after) in want.items():
        r = rows[d]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert r.near_edited == pytest.approx(edited) and r.near_next == pytest.approx(after)
    return rows


def test_matches_brute_force(spark):
    frame = spark.createDataFrame([(k, v, "z") for k, v in TEXTS.items()], "doc_id long, text string, size string").repartition(3)
    rows = check(frame, TEXTS)
    assert rows[0].fingerprint == rows[12].fingerprint != rows[21].fingerprint
    assert rows[5].fingerprint == rows[7].fingerprint == ""


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(docs, {r.doc_id: r.text for r in docs.collect()})


def test_repeated_and_null_ids_and_empty_table(spark):
    rows = [(1, "one\ntwo"), (1, "one\ntwo"), (1, "other"), (None, "abcd"), (None, "abcd"), (2, "second")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = ls.fingerprints(frame).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 4), (0, 4), (1, 5), (1, 7), (1, 7), (2, 6)]
    assert {r.edited_sha256 for r in got if r.doc_id is None} == {hashlib.sha256(b"ab").hexdigest()}
    two = next(r for r in got if r.doc_id == 2)
    assert two.edited_sha256 == hashlib.sha256(b"secone\n"[:3] + b"one").hexdigest()
    assert ls.fingerprints(frame.limit(0)).collect() == []
