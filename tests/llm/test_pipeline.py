"""Each stage of the pipeline against a plain version of what it decides."""

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as pipe
from panelcast.llm import bpe_tree
from tests.llm.test_decontam import plain as plain_hits
from tests.llm.test_near_copies import plain_keep
from tests.llm.test_secret_ledger import plain as plain_spans

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in pipe.STAGES:
        before = docs
        docs = pipe.materialize(stage(spark, docs, FOLDER))
        out.append((name, before, docs))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(steps):
    assert all(after.columns == before.columns and after.dtypes == before.dtypes for _, before, after in steps[:-1])


def test_quality(spark, steps):
    _, before, after = steps[0]
    kept, labels = rows(after), {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    poor = [i for i, r in labels.items() if r.quality == 0]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean) and sum(i in kept for i in poor) <= 0.05 * len(poor)


def test_near_duplicates(steps):
    _, before, after = steps[1]
    assert sorted(rows(after), key=str) == plain_keep([(r.doc_id, r.text) for r in before.collect()])


def test_no_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in pipe.STAGES:
        docs = pipe.materialize(stage(spark, docs, FOLDER))
        assert docs.count() == 0


def test_decontamination(spark, steps):
    _, before, after = steps[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert sorted(rows(after)) == sorted(i for i, _, _, _, hit in plain_hits([(r.doc_id, r.text) for r in before.collect()], items) if not hit)


def test_secrets(steps):
    _, before, after = steps[3]
    old, new = rows(before), rows(after)
    assert old.keys() == new.keys()
    for i, r in new.items():
        if not plain_spans(old[i].text or ""):
            assert r.text == old[i].text
        else:
            assert not plain_spans(r.text) and "[SECRET]" in r.text
        assert r.text is None or r.n_chars == len(r.text)


def test_tokens(steps):
    _, before, after = steps[4]
    bpe = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=_ranks(), special_tokens={})
    new = rows(after)
    assert all(new[i].ids == bpe.encode_ordinary(r.text or "") and new[i].n_tokens == len(new[i].ids) for i, r in rows(before).items())


def _ranks():
    return bpe_tree.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)._bpe._mergeable_ranks
