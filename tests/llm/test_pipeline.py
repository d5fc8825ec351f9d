"""The corpus pipeline: columns, decisions that take effect, and clean documents that stay."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import numpy as np  # noqa: E402
import public_tokenizers  # noqa: E402

import corpus_pipeline  # noqa: E402
from talentmill.llm.bpe import encoder  # noqa: E402


def clean(i):
    """Prose without a repeated three-word window, and without a shared one between texts."""
    word = lambda *k: "".join(chr(97 + x % 26) for x in k)
    return " ".join(f"the {word(i, j, 3 * j, i + j)}er of {word(j, i, 7 * j, 5)}ing {word(2 * i, j, 5 * j)}" for j in range(26)) + "."


def test_stages_take_effect(spark):
    rows = [(0, clean(0)), (1, clean(1) + " mail me@site.org"), (2, clean(0)), (3, "too short"), (4, None), (5, clean(5) + "\n" + clean(0)),
            (6, clean(6) + " one more"), (7, clean(6) + " yet other")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, "")
        if name != "packing":
            assert new.dtypes == docs.dtypes
            seen[name] = {r.doc_id: r.text for r in new.collect()}
            docs = spark.createDataFrame(new.collect(), docs.schema)
    assert set(seen["quality rules"]) == {0, 1, 2, 5, 6, 7}
    assert set(seen["line dedup"]) == {0, 1, 5, 6, 7} and seen["line dedup"][5] == clean(5)
    assert set(seen["near dedup"]) == {0, 1, 5, 6}
    assert seen["pii"][1] == clean(1) + " mail [EMAIL]" and seen["pii"][0] == clean(0)
    pieces = {}
    for r in new.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    coder = encoder(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    for i, text in seen["pii"].items():
        ids = np.frombuffer(b"".join(x for _, x in sorted(pieces[i])), "<u4")
        assert ids[-1] == 1 and coder.decode(ids[:-1].tobytes()) == text


def test_whole_run(spark, small_dir):
    rows = corpus_pipeline.run(spark, small_dir).collect()
    whole = {}
    for r in rows:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length - (r.doc_tokens if r.start == 0 else 0)
    assert rows and not any(whole.values())


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
