"""The pipeline's stages on a small corpus."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from .test_operators import _ADDED, SCHEMA, brute_components, brute_languages, brute_spans, corpus, shingles

pytest.importorskip("public_tokenizers")


def test_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline

    rows = [*corpus(), (900, "12345 67890", "en", "s", 1), (901, "please keep token = abcdef123456 to yourself and tell nobody at all", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, "").cache()
        assert docs.columns == before.columns and 0 < docs.count() <= before.count(), name
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 900 not in texts and 100 not in texts and texts[901] == "please keep [SECRET] to yourself and tell nobody at all"
    kept = [shingles(t, 5) for i, t in texts.items() if i is not None]
    assert not any(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(kept) for b in kept[:i] if a and b)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == set(texts)


def test_run_on_the_smallest_tables(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def brute_pipeline(rows, encode):
    """Tokens by document, from plain loops over the same five stages."""
    language = brute_languages(rows)
    rows = [r for r in rows if (found := language(r[1]))[0] != "und" and found[1] >= 0.2]
    groups: dict = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), []).append(r)
    rows = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    component = {doc: label for doc, _, label in brute_components(rows, 5, 80, 100)}
    rows = [r for r in rows if r[0] is None or component[r[0]] == r[0]]
    out = Counter()
    for doc, text, *_ in rows:
        spans = sorted([(s, e) for s, e, _ in brute_spans(text)] + [m.span() for x in _ADDED.values() for m in x.finditer(text)])
        kept, at = "", 0
        for start, end in spans:
            if start >= at:
                kept += text[at:start] + "[SECRET]"
            at = max(at, end)
        out[(doc, len(encode(kept + text[at:])) + 1)] += 1
    return out


def test_run_equals_brute_force(spark, tmp_path):
    import public_tokenizers
    import tokenizers

    import corpus_pipeline

    secrets = [(i + 500, f"please keep token = abcdef{i}123456 and ghp_{'aB3' * 14} or Bearer {'x1' * 12}{i} to yourself number {i * 7919}", "en", "s", 1) for i in range(9)]
    rows = [*corpus(), (900, "12345 67890", "en", "s", 1), *secrets]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got: dict = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    want = brute_pipeline(rows, lambda text: library.encode(text, add_special_tokens=False).ids)
    assert set(got) == set(want)
    for (_, total), pieces in got.items():
        # rows without an id may share a length
        assert sum(n for _, n in pieces) % total == 0
