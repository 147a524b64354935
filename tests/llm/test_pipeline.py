import pytest

import corpus_pipeline
from wirelattice.llm import jaccard, mixing, pii, quality
from wirelattice.sources.staging import materialise


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], sf_dir), "test-" + name.replace(" ", "-")))
    return out


def test_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_quality_stage(spark, sf_dir, stages):
    verdict = quality.judge(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r["doc_id"] for r in verdict.where("kept").collect()}
    assert {r["doc_id"] for r in stages[1].collect()} == kept and 0 < len(kept) < stages[0].count()


def test_duplicate_stage(stages):
    from tests.llm.test_jaccard import brute

    rows = [(r["doc_id"], r["text"], "s") for r in stages[1].collect()]
    assert {r["doc_id"] for r in stages[2].collect()} == {i for i, _, c in brute(rows, 80, 5) if i == c}


def test_personal_data_stage(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    after = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    assert set(before) == set(after) and not any(pii.base_spans(t) for t in after.values())
    clean = [i for i, t in before.items() if not any(c.isdigit() or c == "@" for c in t)]
    assert clean and all(before[i] == after[i] for i in clean)


def test_mixing_stage(stages):
    want = {r["doc_id"]: r["copies"] for r in mixing.copies(stages[3])[0].collect()}
    got = {r["doc_id"]: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_encoding_stage(stages, spark, sf_dir):
    tokenizers = pytest.importorskip("tokenizers")
    from wirelattice.llm.bpe import default_file

    t = tokenizers.Tokenizer.from_file(default_file())
    t.no_truncation()
    text = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    assert all(r["n_tokens"] == len(t.encode(text[r["doc_id"]], add_special_tokens=False).ids) for r in rows[:60])
    again = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, again.select("doc_id", "ids_sha256").collect())) == sorted(str(r) for r in stages[5].select("doc_id", "ids_sha256").collect())
    assert jaccard.WORDS == 4 and jaccard.PERCENT == 85
