"""Operators that judge each row for itself, against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atlasloom.llm import bpe, common, decontam, pretokens, quality, records, sharding, token_counts
from atlasloom.llm.queries import QUERIES, bpe_path
from tests.llm.conftest import pairs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def same(got, want):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def plain_quality(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count, hit = Counter(grams), set()
    for k, g in enumerate(grams):
        if count[g] > 1:
            hit |= {k, k + 1, k + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("table", ["odd", "documents", "nothing"])
def test_quality_features(request, table):
    docs = request.getfixturevalue(table)
    got = quality.report(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    same([tuple(r) for r in got.collect()], [(i, *plain_quality(t)) for i, t in pairs_of(docs)])


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    """With no hash bits left every window collides, so each row takes the plain path."""
    monkeypatch.setattr(quality, "LOW", (1 << 62) - 1)
    rows = [("a b c a b c d",), ("a b c d e f",), ("a a a a",), ("x y",)]
    sql = quality.repeated_words_sql(quality.words_sql("t"))
    got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(F.expr(sql)).collect()]
    assert got == [plain_quality(t)[4] for (t,) in rows]


def test_cascade_keeps_columns_and_does_not_depend_on_order(odd, documents):
    kept = quality.keep_good(documents)
    assert kept.columns == documents.columns and quality.keep_good(odd).columns == odd.columns
    known = quality.features("text")
    other = documents.filter(f"{quality.verdict_sql(quality.RULES[::-1], known)} IS NULL")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in other.collect()}
    assert {r.doc_id for r in quality.report(documents).where("rejected_by IS NULL").collect()} == {r.doc_id for r in kept.collect()}


def test_later_rules_are_not_evaluated(spark, documents):
    """A rule that fails when evaluated never sees a row that an earlier rule rejects; a feature that only rules ask for stays inside the cascade."""
    bomb = quality.Rule("bomb", "raise_error('evaluated') IS NOT NULL AND {n_words} > 0")
    every = quality.Rule("every", "{n_words} >= 0")
    sql = quality.verdict_sql([every, bomb], quality.features())
    assert [r[0] for r in documents.select(F.expr(sql)).distinct().collect()] == ["every"]
    plan = quality.report(documents)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    upper, lower = plan[0], "\n".join(plan[1:])
    assert "[A-Z]+" in upper and "CASE WHEN" in upper and "[A-Z]+" not in lower and "[#*$%&|<>]" in lower


def test_query_gives_the_cascade_s_verdict(spark, sf):
    """`base_failed` and `kept` against plain Python over every document."""
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op3_quality_rules"](spark, sf).collect():
        t = text[r.doc_id]
        n, chars, symbols, dups, repeats = plain_quality(t)
        failed = n < 50 or 100 * repeats > 50 * n
        lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
        other = 10 * symbols > n or 100 * len(re.findall("[A-Z]", t)) > 40 * len(t) or not 2 * n <= chars <= 14 * n or 100 * dups > 50 * lines
        assert (r.base_failed, r.kept) == (failed, not (failed or other)), r.doc_id


def test_clean_documents_stay_and_junk_goes(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.report(documents).join(labels, "doc_id")
    assert judged.where("quality = 1 AND n_words >= 50 AND rejected_by IS NOT NULL").count() == 0
    assert judged.where("quality = 0 AND rejected_by IS NULL").count() == 0


def test_quality_plan_is_native(spark, sf):
    plan = QUERIES["op3_quality_rules"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_path())


@pytest.mark.parametrize("table", ["odd", "documents", "nothing"])
def test_token_counts(request, library, table):
    docs = request.getfixturevalue(table)
    got = token_counts.counted(docs, bpe_path(), sample_rows=20, table_words=50)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in pairs_of(docs)]
    same([tuple(r) for r in got.collect()], want)


@pytest.mark.parametrize("table", ["odd", "documents", "nothing"])
def test_token_records(request, spark, library, table):
    docs = request.getfixturevalue(table)
    path = common.fresh_path(spark, "test-records")
    found = records.starts(records.write(docs, bpe_path(), path, files=3))
    got = records.read(found, path, digest=True, keep=("doc_id", "start")).select("doc_id", "start", "n_read", "ids_crc32")
    want, start = [], 0
    for i, t in sorted(pairs_of(docs), key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, p[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same([tuple(r) for r in got.collect()], want)
    # A shuffled subset of the index reads the same ids.
    some = found.where("ordinal % 2 = 1").orderBy(F.desc("offset"))
    whole = {(r.part, r.ordinal): r.ids for r in records.read(found, path, keep=("part", "ordinal")).collect()}
    assert all(whole[(r.part, r.ordinal)] == r.ids for r in records.read(some, path, keep=("part", "ordinal")).collect())


def test_damage_is_noticed():
    data = bytearray(records.frame(np.arange(5, dtype="<u2").tobytes(), 2))
    assert records.unframe(bytes(data))[0].tolist() == [0, 1, 2, 3, 4]
    for at in (0, 9, 20, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises((ValueError, Exception)):
            records.unframe(bytes(broken))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab Z'st\n\t\r\x1c é½²_1.9-<|endoftext|>中👍 ")), max_size=40), max_size=4))
def test_pre_tokens_agree_with_the_library(texts):
    encoder, counter = bpe.Encoder(bpe_path(), bits=5), bpe.Counter(bpe_path(), (pretokens.hashes(["a"]), np.array([1], np.uint32)), bits=5)
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, encoder.type).tolist() for b in encoder.encode_many(texts)] == want
    assert counter.count_many(texts) == [len(w) for w in want]


def plain_windows(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    w, hit, names = find(text), set(), set()
    for name, item in items:
        v = find(item)
        n = min(10, len(v))
        windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
        for k in range(len(w) - n + 1 if v else 0):
            if tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                names.add(str(name))
    return len(w), sorted(hit), sorted(names)


ITEMS = [(1, "w1 w2 w3"), (2, "W1, W2; w3"), (3, None), (4, "!!"), (5, "one two three four"), (6, "naïve"), (7, " ".join(f"w{k}" for k in range(25))), (8, " ".join(f"w{k}" for k in range(5, 20))), (9, "w7")]


@pytest.mark.parametrize("chunk", [2_000_000, 12])
@pytest.mark.parametrize("table", ["odd", "documents", "nothing"])
def test_decontamination(request, spark, sf, table, chunk):
    docs = request.getfixturevalue(table)
    if table == "documents":
        bench = spark.read.parquet(f"{sf}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "the of and"), (901, "de la")], "item_id bigint, text string"))
    else:
        bench = spark.createDataFrame([(i, t) for i, t in ITEMS], "item_id bigint, text string")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = []
    for r in decontam.flagged(docs, bench, automaton_words=max(chunk, 40) if table == "documents" else chunk).collect():
        got.append((r.doc_id, r.n_words, [k for a, b in zip(r.hit_start, r.hit_end, strict=True) for k in range(a, b)], r.item_ids))
    same(got, [(i, *plain_windows(t, items)) for i, t in pairs_of(docs)])


def test_decontamination_removes_spans(spark, odd):
    passage = " ".join(f"item{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"Keep this. {passage.upper()}! And this too, with many more words to keep here.", 5), (2, passage, 0), (3, None, None), (4, "clean", 5)], "doc_id bigint, text string, n_chars bigint")
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    got = {r.doc_id: (r.text, r.n_chars) for r in decontam.cleaned(docs, bench).collect()}
    left = "Keep this. ! And this too, with many more words to keep here."
    assert got == {1: (left, len(left)), 3: (None, None), 4: ("clean", 5)}
    clean = decontam.cleaned(odd, bench)
    assert clean.columns == odd.columns and sorted(map(str, clean.collect())) == sorted(map(str, odd.collect()))
    assert decontam.cleaned(docs, bench.limit(0)).count() == 4


@pytest.mark.parametrize("chunk", [1, 25])
def test_decontamination_is_the_same_with_more_automata(spark, chunk):
    w = [f"v{k}" for k in range(300)]
    said = lambda a, b: " ".join(w[a:b])
    items = [(1, said(0, 10)), (2, said(5, 15)), (3, said(100, 110)), (4, said(120, 130)), (5, said(200, 205) + " " + said(215, 220))]
    docs = [(1, said(0, 60)), (2, said(100, 110) + " " + said(240, 244) + " " + said(120, 130) + " " + said(250, 259)), (3, said(200, 220) + " " + said(260, 290)), (4, said(200, 205) + " " + said(100, 110) + " " + said(215, 220) + " " + said(260, 290)), (5, None)]
    docs, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string").coalesce(1)
    got = {r.doc_id: r.text for r in decontam.cleaned(docs, bench, automaton_words=chunk).collect()}
    assert got == {r.doc_id: r.text for r in decontam.cleaned(docs, bench).collect()}
    assert got == {1: " " + said(15, 60), 3: said(200, 220) + " " + said(260, 290), 4: said(200, 205) + "  " + said(215, 220) + " " + said(260, 290), 5: None}


def test_query_s_law_of_sharding(spark, sf):
    """Eight shards of nearly equal bytes, gapless slots, equal texts in one slot's reach, crc32 of every text."""
    import zlib
    from collections import defaultdict

    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size, slots = defaultdict(int), defaultdict(list)
    rows = QUERIES["op10_sharding"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(text) and len(rows) == len(text)
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "bytes", None)
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(size) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= max(map(len, text.values())) + 1


@pytest.mark.parametrize("table", ["odd", "documents", "nothing"])
def test_sharding(request, spark, table):
    docs = request.getfixturevalue(table)
    rows = sharding.assigned(docs, n_shards=4, n_slots=64).collect()
    same([(r.doc_id, r.size, r.text_crc32) for r in rows], [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs_of(docs)])
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(0 <= r.shard < 4 and r.next_shard in (r.shard, 4) for r in rows)
    if table == "documents":
        sizes = [sum(r.size for r in rows if r.shard == s) for s in range(4)]
        assert max(sizes) - min(sizes) <= max(r.size for r in rows)


def test_slot_maps(spark):
    totals = spark.createDataFrame([(k, 1, b) for k, b in enumerate([9, 7, 6, 5, 4, 4, 3, 0])], "vslot int, rows bigint, bytes bigint")
    first = sharding.packed(totals, 2)
    loads = [sum(r.bytes for r in first.collect() if r.shard == s) for s in (0, 1)]
    assert sum(loads) == 38 and abs(loads[0] - loads[1]) <= 2
    fewer = sharding.rebalanced(sharding.packed(totals, 3), 2).collect()
    assert {r.shard for r in fewer} == {0, 1} and len(fewer) == 8
    maps = sharding.SlotMaps(spark, common.fresh_path(spark, "test-map"))
    maps.store(first, 1, 2)
    assert maps.load(1).count() == 8
    with pytest.raises(Exception, match="already exists"):
        maps.store(first, 1, 2)


def test_sharding_plan_is_native(spark, sf):
    plan = QUERIES["op10_sharding"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
