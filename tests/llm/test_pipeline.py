"""The pipeline as a whole: every stage's written documents against brute force."""

from __future__ import annotations

import random
from collections import defaultdict
from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm import brute
from vintager.llm import decontaminate


def _text(rng, n=70):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def _redacted(text):
    for span in reversed(brute.pii(text)):
        kind, start, end = span.split(":")
        text = f"{text[:int(start)]}[{kind.upper()}]{text[int(end):]}"
    return text


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(5)
    item, base = _text(rng, 15), _text(rng)
    texts = {1: base, 2: f"{base} more", 3: "too short", 4: None, 5: f"{_text(rng)} {item.upper()} x"}
    texts |= {6: f"{_text(rng)} ask a@b.cd or 4111 1111 1111 1111 now", 7: _text(rng).upper()}
    texts |= {8: _text(rng), 9: "run " * 90, 10: f"{_text(rng)} {item[:40]}", 11: base}
    source = {i: f"s{i % 2}" for i in texts}
    rows = [(i, t, "en", source[i], len(t or ""), "mine", "mine") for i, t in texts.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, base string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()

    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    folder = max(Path(shared).glob("pipeline-*"), key=lambda p: p.stat().st_mtime)
    expected = {i: t for i, t in texts.items() if not brute.quality(t)[-1] and t.upper() != t}
    after = {"quality_rules": expected}
    groups = brute.components(list(expected.items()), corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    expected = {i: t for i, t in expected.items() if groups[i, t][1] == i}
    after["near_duplicates"] = expected
    pattern = decontaminate.normal(item)
    most = len(pattern) // decontaminate.CHARS_PER_ERROR
    expected = {
        i: t for i, t in expected.items()
        if brute.edit_distance(pattern, decontaminate.normal(t)) > most
    }
    after["decontamination"] = expected
    after["personal_data"] = {i: _redacted(t) for i, t in expected.items()}
    assert [name for name, _ in corpus_pipeline.STAGES] == [*after, "mixture"]
    assert [len(docs) for docs in after.values()] == [7, 5, 4, 4]
    for name, docs in after.items():
        written = spark.read.parquet(f"{folder}/{name}")
        assert written.columns == [c.split()[0] for c in schema.split(", ")]
        found = {r.doc_id: tuple(r)[1:] for r in written.collect()}
        wanted = {i: (t, "en", source[i], len(t), "mine", "mine") for i, t in docs.items()}
        assert (name, sorted(found)) == (name, sorted(wanted))
        for i, row in wanted.items():
            assert (name, i, found[i][1:]) == (name, i, row[1:])
            assert found[i][0] == row[0], (name, i)
    total = defaultdict(int)
    for i, t in after["personal_data"].items():
        total[source[i]] += len(brute.words(t))
    targets = brute.targets(dict(total))
    assert sorted((r.doc_id, r.source, r.size) for r in result) == sorted(
        (i, source[i], len(brute.words(t))) for i, t in after["personal_data"].items()
    )
    for r in result:
        assert r.source_size == total[r.source] and r.target == pytest.approx(targets[r.source])
