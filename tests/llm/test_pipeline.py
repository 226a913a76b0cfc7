"""Each stage of the corpus pipeline against a plain version on the stage's own input."""

from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from gearlens.llm.common import stage, table  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
import plain_versions as H  # noqa: E402


def test_stages(spark):
    docs = table(spark, SF_SMALL, "documents")
    columns = docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "source_mix"]
    at = docs
    seen = {}
    for name, step in pipeline.STAGES:
        before, at = at, stage(step(spark, at, SF_SMALL), f"test-{name}")
        seen[name] = (before.collect(), at.collect())
        if name != "source_mix":
            assert at.columns == columns

    before, after = seen["language_id"]
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if any(c.isalpha() for c in r.text or ""))

    before, after = seen["near_dedup"]
    want = H.components([(r.doc_id, r.text) for r in before], width=5)
    assert Counter(r.doc_id for r in after) == Counter(i for i, c in want.items() if i == c)

    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, SF_SMALL, "benchmark").collect()]
    clean = [r.doc_id for r in before for n, hit, _ in [H.contamination(r.text, items)] if not (hit and 20 * hit >= n)]
    assert Counter(r.doc_id for r in after) == Counter(clean)

    before, after = seen["secret_scan"]
    new = {r.doc_id: r for r in after}
    assert len(after) == len(before)
    changed = [r for r in before if new[r.doc_id].text != r.text]
    assert all("[SECRET]" in new[r.doc_id].text and new[r.doc_id].n_chars == len(new[r.doc_id].text) for r in changed)

    before, after = seen["source_mix"]
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
    assert sum(r.size for r in after) == sum(len(H.WORD.findall(r.text or "")) for r in before)


def test_unlabelled_documents_stay(spark):
    rows = [(1, "a text with letters", None), (2, "123 !", None), (3, None, None), (4, "Ünï", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = pipeline.language_id(spark, docs, SF_SMALL).collect()
    assert {(r.doc_id, r.text, r.lang) for r in got} == {rows[0], rows[3]}


def test_run(spark):
    assert pipeline.run(spark, SF_SMALL).count() > 0
