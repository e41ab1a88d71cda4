"""The pipeline's stages against brute force, and its whole run."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from atlasloom.llm import common, mixing, quality
from atlasloom.llm.queries import QUERIES, bpe_path
from tests.llm.conftest import pairs_of
from tests.llm.test_corpus import shingles
from tests.llm.test_rows import plain_windows


@pytest.fixture(scope="module")
def stages(spark, sf, documents):
    out, docs = [documents], documents
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf), "test-stage")
        out.append(docs)
    return out


def test_columns_and_keys(stages, documents):
    for docs in stages[:-1]:
        assert docs.columns == documents.columns
    assert dict(stages[-1].dtypes)["doc_id"] == "bigint"


def test_near_duplicates(stages):
    before, after = pairs_of(stages[1]), pairs_of(stages[2])
    sets = {i: shingles(t, 5) for i, t in before}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {i for i, _ in after} == {find(i) for i in sets}


def test_decontamination(spark, sf, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = dict(pairs_of(stages[2])), dict(pairs_of(stages[3]))
    for i, t in before.items():
        n, hit, _ = plain_windows(t, items)
        if not hit:
            assert after[i] == t
        elif 2 * len(hit) > n:
            assert i not in after
        else:
            assert len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", after[i])) == n - len(hit)


def test_mixing_repeats_and_keeps(stages):
    before, after = pairs_of(stages[3]), Counter(pairs_of(stages[4]))
    assert set(before) == set(after) and max(after.values()) <= 2
    tokens = Counter()
    for r in stages[4].select("source", mixing.word_count().alias("n")).collect():
        tokens[r.source] += r.n
    old = Counter()
    for r in stages[3].select("source", mixing.word_count().alias("n")).collect():
        old[r.source] += r.n
    assert all(1 <= tokens[s] / old[s] <= corpus_pipeline.REPETITION + 1e-9 for s in old if old[s])


def test_records(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe_path())
    want, start = Counter(), 0
    for i, t in sorted(pairs_of(stages[4])):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want[(i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        start += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in stages[5].collect()) == want


def test_run_is_the_stages(spark, sf, stages):
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(QUERIES["pipeline"](spark, sf)) == key(stages[-1])


def test_stages_take_odd_tables(spark, sf, odd, nothing):
    for docs in (odd, nothing):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = common.written(stage(spark, docs, sf), "test-odd")
            if k < 4:
                assert docs.columns == columns
        assert docs.count() >= 0


def test_rejected_documents_go(stages):
    gone = {i for i, _ in pairs_of(stages[0])} - {i for i, _ in pairs_of(stages[1])}
    rejected = {r.doc_id for r in quality.report(stages[0]).where("rejected_by IS NOT NULL").collect()}
    assert gone == rejected
