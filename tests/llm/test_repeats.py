"""Spelling variants, repeated passages and periodic runs, against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasloom.llm import passages, periodic, variants
from atlasloom.llm.queries import QUERIES, misspelled, with_planted_runs
from tests.llm.conftest import pairs_of
from tests.llm.test_rows import WORD, same

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_KEY = -(1 << 63)


def near(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(count, ratio=5):
    links = {w: [x for x in count if near(w, x)] for w in count}
    best = {w: min(found, key=lambda x: (-count[x], x), default=None) for w, found in links.items()}
    form = {w: b if b is not None and count[b] >= ratio * count[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return [(w, count[w], len(links[w]), form[w], count[form[w]] if form[w] else None, root(w)) for w in count]


GROUPED = ("word", "n", "n_near", "form", "form_n", "root")


@pytest.mark.parametrize("most", [20_000, 5, 1])
def test_variant_groups(spark, most):
    """Few letters make many near words; small limits split every frequent segment, down to rests of one letter."""
    rng = random.Random(most)
    count = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))): int(5 * 10 ** (3 * rng.random())) for _ in range(300)}
    count |= {"a" * 40: 7, "a" * 41: 100, "a" * 39 + "b": 5000}
    long = [("x" * 50_000, 6, 1, "x" * 49_999, 60, "x" * 49_999), ("x" * 49_999, 60, 1, None, None, "x" * 49_999)] if most > 1000 else []
    words = spark.createDataFrame([(w, n, 1) for w, n in [*count.items(), *(r[:2] for r in long)]], "word string, n bigint, size int")
    same([tuple(r) for r in variants.grouped(words, most=most).select(*GROUPED).collect()], plain_groups(count) + long)


def plain_words(pairs, edit=None):
    count = Counter()
    for i, t in pairs:
        for run in LETTERS.findall(t or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            count[edit("" if i is None else str(i), run) if edit else run] += 1
    return count


@pytest.mark.parametrize("table", ["odd", "documents", "nothing"])
def test_variant_words(request, table):
    docs = request.getfixturevalue(table)
    got = variants.counted(docs, edit=misspelled)
    same([tuple(r) for r in got.collect()], [(w, n) for w, n in plain_words(pairs_of(docs), misspelled).items() if w])
    assert variants.grouped(got.where("n > 4")).count() == sum(n > 4 and len(w) > 5 for w, n in plain_words(pairs_of(docs), misspelled).items())


def test_counting_hands_on_what_it_holds(documents, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 10)
    same([tuple(r) for r in variants.counted(documents).collect()], list(plain_words(pairs_of(documents)).items()))


def test_misspellings():
    """Every code point may go, and one run in some two hundred loses one."""
    changed = [(k, misspelled(str(k), "spelling")) for k in range(40_000)]
    gone = [w for _, w in changed if w != "spelling"]
    assert 100 < len(gone) < 300 and {len(w) for w in gone} == {7} and len(set(gone)) == 7
    k = next(k for k, w in changed if w != "spelling")
    h = zlib.crc32(f"{k}:spelling".encode())
    assert h % 199 == 0 and dict(changed)[k] == "spelling"[: h % 8] + "spelling"[h % 8 + 1 :]


def plain_passages(pairs, window=13):
    key = lambda i: LEAST_KEY if i is None else i
    words, first, out = [WORD.findall(t or "") for _, t in pairs], {}, []
    for (i, _), w in zip(pairs, words, strict=True):
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, 1 << 63), key(i))
    for (i, _), w in zip(pairs, words, strict=True):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < key(i):
                gone[k : k + window] = True
        out.append((i, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def cut(df):
    return [(r.doc_id, r.n_words, sum(b - a for a, b in zip(r.span_start, r.span_end, strict=True)), r.kept) for r in df.collect()]


@pytest.mark.parametrize("table", ["odd", "documents", "nothing"])
@pytest.mark.parametrize("hot", [2000, 0])
def test_passages(request, table, hot):
    docs = request.getfixturevalue(table)
    same(cut(passages.deduplicated(docs, hot=hot)), plain_passages(pairs_of(docs)))


@pytest.mark.parametrize(("vocabulary", "hot", "window", "shard"), [(2, 2000, 13, 512 << 10), (2, 3, 13, 100), (50, 0, 8, 100), (3000, 3, 13, 1000)])
def test_passages_of_few_words(spark, vocabulary, hot, window, shard):
    rng = random.Random(vocabulary)
    prose = lambda n: [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    parts, pairs = [prose(rng.randint(10, 60)) for _ in range(20)], []
    for _ in range(150):
        t = sum((rng.choice(parts) if rng.random() < 0.5 else prose(rng.randint(1, 40)) for _ in range(rng.randint(0, 5))), [])
        pairs.append((rng.randrange(100) if rng.random() < 0.97 else None, rng.choice([" ", "  ", "\n"]).join(t[rng.randrange(len(t) + 1) :] if rng.random() < 0.4 else t)))
    docs = spark.createDataFrame(pairs, "doc_id bigint, text string").repartition(3)
    same(cut(passages.deduplicated(docs, window=window, hot=hot, shard_bytes=shard)), plain_passages(pairs, window))


def test_long_passages(spark):
    """A text of megabytes, and a later one that holds a part of it."""
    rng = random.Random(5)
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(400_000)) + " " + "y" * 1_000_000
    docs = spark.createDataFrame([(1, long), (2, "before " + long[1_000_000:1_500_000] + " after")], "doc_id bigint, text string")
    one, two = sorted(passages.deduplicated(docs).collect(), key=lambda r: r.doc_id)
    assert one.kept == long and one.n_words == 400_001
    assert two.kept.split(" ")[0] == "before" and two.kept.split(" ")[-1] == "after" and len(two.kept.split()) <= 4


def test_automaton_s_documents():
    """Every window's smallest document, in the words of several documents at once."""
    rng = random.Random(9)
    texts = [[rng.randrange(3) for _ in range(rng.randint(0, 30))] for _ in range(40)]
    automaton = passages.Automaton()
    for k, t in enumerate(texts):
        automaton.add(t, k)
    automaton.settle()
    for probe in [*texts, [rng.randrange(4) for _ in range(200)]]:
        want = [min([k for k, t in enumerate(texts) for j in range(len(t) - 4) if t[j : j + 5] == probe[a : a + 5]], default=(1 << 63) - 1) for a in range(len(probe) - 4)]
        assert automaton.firsts(probe, 5) == want


def plain_runs(w, least=12):
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b - a, p) for (a, b), p in out.items())


def plain_collapsed(w, found):
    gone = {k for a, n, p in found for k in range(a + p, a + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_numbers(seed):
    rng, docs = random.Random(seed), []
    for _ in range(rng.randint(1, 12)):
        n, k = rng.choice([0, 5, 13, 40, 150, 400]), rng.choice([1, 2, 3, 5, 30])
        d = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 9)
            d = [d[i] if i < a else d[a + (i - a) % p] for i in range(n)]
        docs.append(d)
    least = rng.choice([2, 7, 12, 12])
    columns = periodic.periodic_runs(np.array([x for d in docs for x in d], np.int64), np.concatenate([[0], np.cumsum([len(d) for d in docs])]), least)
    got = defaultdict(list)
    for t, *run in zip(*(c.tolist() for c in columns), strict=True):
        got[t].append(tuple(run))
    assert [got[k] for k in range(len(docs))] == [plain_runs(d, least) for d in docs]


@pytest.mark.parametrize("table", ["odd", "nothing"])
def test_runs(request, table):
    docs = request.getfixturevalue(table)
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.runs(docs).collect()]
    want = []
    for i, t in pairs_of(docs):
        w = WORD.findall(t or "")
        found = plain_runs(w)
        want.append((i, len(w), found, plain_collapsed(w, found)))
    same(got, want)


def test_long_runs(spark):
    """Texts of hundreds of thousands of words, with one run over all, with none, and with a long period."""
    rng = random.Random(2)
    block = [f"b{k}" for k in range(150_000)]
    texts = [["a", "b", "c"] * 200_000, [f"w{rng.randrange(1000)}" for _ in range(300_000)], ["x", *block, *block, *block[:7], "y"]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in periodic.runs(docs).collect()}
    assert [[tuple(x) for x in got[k].runs] for k in range(3)] == [[(0, 600_000, 3)], [], [(1, 300_007, 150_000)]]
    assert got[0].collapsed == "a b c" and got[2].collapsed.split() == ["x", *block, "y"]


def test_planted_runs(odd):
    def plain(i, t):
        if i is None or t is None or zlib.crc32(str(i).encode()) % 10:
            return t
        w, g = WORD.findall(t), zlib.crc32(str(i).encode()) // 10
        if not w:
            return ""
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        return " ".join(x if k < a else w[a + (k - a) % p] for k, x in enumerate(w))

    docs = odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000))
    same([tuple(r) for r in with_planted_runs(docs).collect()], [(i, plain(i, t)) for i, t in pairs_of(docs)])
    assert any(t != plain(i, t) for i, t in pairs_of(docs))


def test_queries_return_every_row(spark, sf, documents):
    for name in ("op12_substring_dedup", "op13_periodic_runs"):
        assert QUERIES[name](spark, sf).count() == documents.count()
