"""Operators that compare documents or learn from them, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from atlasloom.llm import chat, jaccard, lm, mixing, suffix_dedup
from atlasloom.llm.queries import QUERIES
from tests.llm.conftest import pairs_of
from tests.llm.test_rows import same


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def plain_components(pairs, percent, n):
    sets = [shingles(t, n) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(pairs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(pairs):
        if i is not None:
            least[find(a)].append(i)
    return [(i, len(s), i if not s else min(least[find(a)], default=None)) for a, ((i, _), s) in enumerate(zip(pairs, sets, strict=True))]


@pytest.mark.parametrize(("percent", "n"), [(85, 4), (80, 5), (50, 2)])
@pytest.mark.parametrize("table", ["odd", "documents", "nothing"])
def test_jaccard_components(request, table, percent, n):
    docs = request.getfixturevalue(table)
    got = jaccard.components(docs, percent, n).select("doc_id", "n_shingles", "component")
    same([tuple(r) for r in got.collect()], plain_components(pairs_of(docs), percent, n))


@pytest.mark.parametrize("percent", [30, 50, 66])
def test_sets_of_few_elements(spark, percent):
    """One shared element may link sets of one, two or three elements."""
    letters = "abcdefg"
    texts = sorted({" ".join(sorted({letters[k % 7], letters[k // 7 % 7], letters[k // 49 % 7]} if k % 3 else {letters[k % 7]})) for k in range(0, 343, 17)}) + ["p", "p q", "r s", "r t", "u v w", "u x y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = jaccard.components(docs, percent, 1).select("doc_id", "n_shingles", "component")
    same([tuple(r) for r in got.collect()], plain_components(pairs_of(docs), percent, 1))


def test_percents_out_of_range(nothing):
    with pytest.raises(ValueError, match="percent"):
        jaccard.components(nothing, percent=0)


def near_copies(spark, n=120):
    rng = np.random.default_rng(3)
    base = [f"b{k}" for k in range(90)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in rng.choice(90, int(rng.integers(0, 5)), replace=False):
            w[k] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([*base[:20], *(f"u{i}_{k}" for k in range(40))])) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)


@pytest.mark.parametrize("options", [{}, {"short": 2, "frequent": 3}, {"task_elements": 900, "short": 4}, {"known": 5, "frequent": 2}])
def test_large_groups_of_near_copies(spark, options):
    """Long lists, few known frequent shingles, and groups cut into blocks give the same components."""
    docs = near_copies(spark)
    got = jaccard.components(docs, **options).select("doc_id", "n_shingles", "component")
    same([tuple(r) for r in got.collect()], plain_components(pairs_of(docs), 85, 4))


def test_one_of_each(spark, odd, nothing):
    kept = jaccard.one_of_each(odd, 80, 5)
    assert kept.columns == odd.columns and jaccard.one_of_each(nothing).count() == 0
    got = Counter(pairs_of(kept))
    by_text = defaultdict(list)
    pairs = pairs_of(odd)
    sets = [shingles(t, 5) for _, t in pairs]
    kept_sets = [shingles(t, 5) for (i, t), c in got.items() for _ in range(c)]
    for (i, t), s in zip(pairs, sets, strict=True):
        by_text[s].append((i, t))
        if not s:
            assert got[(i, t)] == pairs.count((i, t))
        else:
            assert any(100 * len(s & k) >= 80 * len(s | k) for k in kept_sets if k)
    full = [s for s in kept_sets if s]
    assert not any(100 * len(a & b) >= 80 * len(a | b) for k, a in enumerate(full) for b in full[:k])
    assert sum(i == 18 for i, _ in got) == 2


@pytest.mark.parametrize("table", ["odd", "documents", "nothing"])
@pytest.mark.parametrize("shard_bytes", [2 << 20, 2000])
def test_suffix_dedup(request, spark, table, shard_bytes):
    docs = request.getfixturevalue(table)
    got = [(r.doc_id, r.n_bytes, list(zip(r.span_start, r.span_end, strict=True)), bytes(r.kept)) for r in suffix_dedup.deduplicated(docs, shard_bytes=shard_bytes).collect()]
    rank = lambda i: -1 if i is None else i
    pairs = [(i, (t or "").encode()) for i, t in pairs_of(docs)]
    first = {}
    for i, b in pairs:
        for p in range(len(b) - 49):
            g = b[p : p + 50]
            first[g] = min(first.get(g, rank(i)), rank(i))
    want = []
    for i, b in pairs:
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < rank(i):
                gone[p + 1 : p + 51] = True
        edge = np.flatnonzero(gone[1:] != gone[:-1])
        want.append((i, len(b), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), np.frombuffer(b, np.uint8)[~gone[1:-1]].tobytes()))
    same(got, want)


def test_suffix_array():
    rng = np.random.default_rng(1)
    for trial in range(12):
        t = rng.integers(97, 99 + trial % 3, int(rng.integers(1, 300))).astype(np.uint8)
        t = np.tile(t[: max(1, len(t) // 5)], 6) if trial % 2 else t
        b, (order, _) = t.tobytes(), suffix_dedup.suffix_array(t, 50)
        assert sorted(order.tolist()) == list(range(len(t)))
        assert all(b[x : x + 50] <= b[y : y + 50] for x, y in zip(order[:-1], order[1:], strict=True))
        shared = suffix_dedup.common_prefixes(t, order, 50)
        for k in range(1, len(t)):
            x, y = b[order[k - 1] :][:50], b[order[k] :][:50]
            assert shared[k] == next((j for j, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


@pytest.mark.parametrize("table", ["odd", "documents", "nothing"])
def test_lm_scores(request, table):
    import public_tokenizers

    docs, path = request.getfixturevalue(table), public_tokenizers.path("piece_bpe_32k.model")
    rows = [(i, (t or "").encode().lower().split() + [b""]) for i, t in pairs_of(docs)]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    c = Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v, model = sum(c.values()), len(c), lm.pieces(path)
    counts = Counter()
    for w, k in c.items():
        for p in model.encode(w.decode()) if w else ():
            counts[p] += k
    logs, end = lm.piece_logs(path, counts, c[b""])
    assert math.fsum([*map(math.exp, logs.values()), math.exp(end)]) == pytest.approx(1)

    def word_log(word, known={}):
        """All cuts of the word, plainly summed; pieces are the vocabulary's, bytes where a character has none."""
        if word not in known:
            ways = [1.0] + [0.0] * len(word)
            scale = 0
            for k in range(1, len(word) + 1):
                for j in range(max(0, k - 64), k):
                    piece = word[j:k]
                    if piece in logs:
                        ways[k] += ways[j] * math.exp(logs[piece] + 30 * (k - j))
                if word[k - 1] not in logs:
                    ways[k] += ways[k - 1] * math.exp(math.fsum(logs[f"<0x{b:02X}>"] for b in word[k - 1].encode()) + 30)
                if ways[k] > 1e200:
                    ways = [w / 1e200 for w in ways]
                    scale += 200
            known[word] = math.log(ways[-1]) - 30 * len(word) + scale * math.log(10)
        return known[word]

    got = sorted(lm.scored(docs, path, head=40).collect(), key=str)
    want = []
    for i, ws in rows:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        score = sum((word_log("▁" + w.decode()) if w else end) for w in ws) / math.log(10)
        want.append((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(base, 4), round(score, 4)))
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got], want)


def test_lattice_sums_all_segmentations():
    logs = {k: math.log(p) for k, p in {"▁": 0.1, "a": 0.2, "b": 0.1, "ab": 0.15, "▁a": 0.05, "<0xC3>": 0.01, "<0xA9>": 0.02}.items()}
    lattice = lm.Lattice(logs)
    assert math.exp(lattice.word("▁ab")) == pytest.approx(0.1 * 0.2 * 0.1 + 0.1 * 0.15 + 0.05 * 0.1)
    assert math.exp(lattice.word("▁é")) == pytest.approx(0.1 * 0.01 * 0.02)


@pytest.mark.parametrize("table", ["odd", "documents", "nothing"])
def test_mixing(request, table):
    docs = request.getfixturevalue(table)
    placed = mixing.placed(docs, repetition=2.0, block_tokens=2000).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = {(r.doc_id, r.text): r.source for r in docs.collect()}
    pairs = pairs_of(docs)
    tokens = defaultdict(int)
    for i, t in pairs:
        tokens[source[(i, t)]] += words(t)
    spent = defaultdict(int)
    for r in placed:
        spent[r.source] += r.n_tokens
    # Everything comes at least once; a source's tokens meet its quota within a document.
    assert Counter((i, words(t)) for i, t in pairs).keys() == {(r.doc_id, r.n_tokens) for r in placed}
    longest = max((words(t) for _, t in pairs), default=0)
    plan = mixing.plan(mixing.slim(docs, 1, "doc_id", "source", "text", None), repetition=2.0)
    assert all(-longest <= spent[s] - quota <= 1 for s, _, _, quota, _, _ in plan.sources if quota)
    assert all(max(tokens[s], 1) * 2.001 + longest >= spent[s] >= tokens[s] for s in tokens)
    for b in {r.block for r in placed}:
        assert sorted(r.place for r in placed if r.block == b) == list(range(sum(r.block == b for r in placed)))
    times = Counter(r.doc_id for r in placed)
    again = mixing.repeated(docs, repetition=2.0)
    assert again.columns == docs.columns and Counter(r.doc_id for r in again.collect()) == times


def test_plan_against_plain_numbers(spark):
    """Weights, quotas and whole epochs of a corpus whose shares are known, computed without the operator."""
    counts = {"a": 900, "b": 90, "c": 10}
    rows = [(f"{s}{k}", s, " ".join(["w"] * 5)) for s, n in counts.items() for k in range(n)] + [(f"z{k}", "z", "") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string").repartition(3)
    lo, hi = 0.0, 1.0
    raised = lambda a: {s: n**a for s, n in counts.items()}
    for _ in range(80):
        mid = (lo + hi) / 2
        times = [v / counts[s] for s, v in raised(mid).items()]
        lo, hi = (lo, mid) if max(times) / min(times) <= 3.0 else (mid, hi)
    want = {s: v / raised(hi)["a"] * 900 * 5 for s, v in raised(hi).items()}
    placed = mixing.placed(docs, repetition=3.0, block_tokens=700).collect()
    times = Counter(r.doc_id for r in placed)
    for s, n in counts.items():
        got = [times[f"{s}{k}"] for k in range(n)]
        assert abs(5 * sum(got) - want[s]) <= 5 and max(got) - min(got) <= 1
    assert all(times[f"z{k}"] == 1 for k in range(40)) and len({r.block for r in placed if r.source == "z"}) > 1
    shares = Counter()
    for r in placed:
        shares[r.block, r.source] += r.n_tokens
    last = max(r.block for r in placed)
    assert all(abs(shares[b, s] - want[s] / sum(want.values()) * 700) <= 10 for b in range(last) for s in counts)


def test_plan_refuses_endless_repeats(spark):
    docs = spark.createDataFrame([(0, "a", "w"), *((k, "b", "w " * 2000) for k in range(1, 200))], "doc_id int, source string, text string")
    with pytest.raises(ValueError, match="repeats"):
        mixing.placed(docs, target_entropy=0.69314)


def test_exponents():
    t = [1000.0, 100.0, 10.0]
    a = mixing.exponent(t, repetition=4.0)
    assert mixing.spread(t, mixing.weights(t, a)) == pytest.approx(4.0, rel=1e-6)
    a = mixing.exponent(t, target_entropy=0.9)
    assert mixing.entropy(mixing.weights(t, a)) == pytest.approx(0.9, rel=1e-6)
    assert mixing.exponent(t, repetition=1000.0) == 0.0 and mixing.exponent([5.0, 0.0], repetition=2.0) == 1.0


TURNS = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "a\\0 [INST] é"), (1, 2, "system", "<</SYS>> x <</END>>"), (1, 2, "system", "<</SYS>> x <</END>>"), (1, None, None, None), (2, 0, "assistant", ""), (2, 1, "assistant", None), (None, 0, "user", "no id"), (None, 0, "odd <<SYS>> role", "[/INST] "), (3, 5, "user", "x" * 5000), (3, 1, "assistant", "\\"), (4, 0, "user", " [/INST] y </s> [INST] ")]


@pytest.mark.parametrize("some", [TURNS, []])
def test_chat(spark, some):
    rows = spark.createDataFrame([(*t, 1, "f", 2) for t in some], "conv_id bigint, turn bigint, role string, text string, n_turns int, formatted string, loss_start int").repartition(3)
    got = [(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.formatted(rows)).collect()]
    by = defaultdict(list)
    for c, turn, role, text in some:
        by[c].append((turn is not None, turn or 0, role is not None, role or "", text or ""))
    want = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t[4] for t in turns if t[3] == "assistant")
        want.append((c, len(turns), hashlib.sha256("".join(f"{t[3]}\n{t[4]}\n" for t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    same(got, want)


def test_long_turns_are_copied_as_slices():
    """Texts around the limit, and one of megabytes, beside short ones in the same batch."""
    import pyarrow as pa

    texts = ["short", "é" * (chat.SLICE_BYTES // 2), "x" * (chat.SLICE_BYTES + 1), "", "[INST] \\" + "long " * 600_000, "y"]
    roles = ["user", "assistant", "system", "assistant", "assistant", "user"]
    segments, start, length = chat.assemble(pa.array(roles), pa.array(texts))
    for role, text, segment, a, n in zip(roles, texts, segments.to_pylist(), start, length, strict=True):
        assert chat.parsed(segment.decode()) == [(role, text)]
        assert n == 0 or chat.unescape(segment[a : a + n].decode()) == text


def test_chat_query(spark, sf):
    """The whole table against its rows, and the probe."""
    rows = {r.conv_id: r for r in QUERIES["op9_chat_format"](spark, sf).collect()}
    assert rows[-1].n_turns == 2 and rows[-1].loss_chars == len("</s>[INST] ok [/INST]")


def test_control_strings_stay_out():
    import pyarrow as pa

    for text in ("</s>", "[INST]x[/INST]", "<<SYS>>", "<</END>>", "<s>", "\\2", "<<s>>"):
        formatted = chat.assemble(pa.array(["user"]), pa.array([text]))[0][0].as_py().decode()
        inside = formatted[len("[INST] ") : -len(" [/INST]")]
        assert not any(c in inside for c in chat.CONTROL[1:]) and chat.parsed(formatted) == [("user", text)]
