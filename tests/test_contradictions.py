"""Contradiction rounds against plain sets, over random updates and planted ones."""

import random

import pytest
from pyspark.sql import functions as F

from atlasloom.operators import contradictions as C

PAIRS = "a string, b string, agree_ab long, through_ab long, agree_ba long, through_ba long"
FRAMES = "name string, new boolean, fixed boolean, refs array<string>"
OK, BAD, FEW = (500, 5, 480, 0), (100, 400, 500, 5), (3, 2, None, 9)


def by_sets(pairs, frames, rounds=C.ROUNDS, most=C.MOST_REJECTED):
    state = {}
    for a, b, *c in pairs:
        ratio = []
        fails = False
        for agree, through in (c[:2], c[2:]):
            agree, through = agree or 0, through or 0
            if agree + through >= 40:
                ratio.append(agree)
                fails |= agree < 0.9 * (agree + through) and (agree < 0.75 * (agree + through) or through >= 100)
        state[a, b] = state[b, a] = "fails" if fails else "agrees" if ratio else None
    new = {n: set(refs or []) for n, is_new, _, refs in frames if is_new}
    fixed = {n for n, is_new, f, _ in frames if not is_new and f}
    stored = {n for n, is_new, _, _ in frames if not is_new}
    first, marked, vetoed, rejected, out = len(new), set(), set(), set(), []
    for number in range(1, rounds + 2):
        is_ = lambda what, x, y: state.get((x, y)) == what
        sound, decisions, now = fixed - marked, {}, set()
        for s in fixed - vetoed:
            votes = []
            for n, refs in new.items():
                witness = {w for w in sound - {s} if is_("agrees", n, w)}
                if is_("fails", n, s) and not any(is_("fails", n, o) for o in sound - {s}) and witness & refs and witness - refs:
                    votes.append(n)
            if len(votes) >= C.QUORUM and not any(is_("fails", x, y) for x in votes for y in votes):
                decisions[s] = ("keep" if s in marked else "mark", sorted(votes))
                now.add(s)
            elif s in marked:
                decisions[s] = ("veto", [])
        hit = {n: {s for s in stored - now if is_("fails", n, s)} for n in new}
        if not any(hit.values()):
            hit = {n: {o for o in new if is_("fails", n, o)} for n in new}
        gone = {n: ("reject", sorted(o)) for n, o in hit.items() if o}
        while True:
            more = {n: ("depend", sorted(refs)) for n, refs in new.items() if n not in gone and refs and refs <= set(gone)}
            if not more:
                break
            gone |= more
        decisions |= gone
        changes = any(d != "keep" for d, _ in decisions.values())
        applied = not changes or not (len(rejected) + len(gone) > most * first or number > rounds)
        out += [(n, d, w, number, applied) for n, (d, w) in decisions.items()]
        if not changes or not applied:
            return sorted(out)
        marked = (marked - {n for n, (d, _) in decisions.items() if d == "veto"}) | {n for n, (d, _) in decisions.items() if d == "mark"}
        vetoed |= {n for n, (d, _) in decisions.items() if d == "veto"}
        rejected |= set(gone)
        new = {n: r for n, r in new.items() if n not in gone}
    return sorted(out)


def ours(spark, pairs, frames, **how):
    got = C.resolved(spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(frames, FRAMES), **how).collect()
    return sorted((r.name, r.decision, list(r["with"]), r.round, r.applied) for r in got)


def update(seed):
    """Stored frames s0 to s7 (one not fixed), new ones n0 to n13; wrong frames fail with most others."""
    rng = random.Random(seed)
    stored, new = [f"s{i}" for i in range(8)], [f"n{i}" for i in range(14)]
    wrong = set(rng.sample(stored, 2) + rng.sample(new, 2))
    frames = [(s, False, s != "s7", None) for s in stored] + [(n, True, None, rng.sample(stored + new[:i], rng.randint(0, 2)) or None) for i, n in enumerate(new)]
    pairs = []
    for i, n in enumerate(new):
        for o in stored + new[:i]:
            if rng.random() < 0.7:
                bad = rng.random() < (0.85 if {n, o} & wrong else 0.004)
                pair = (n, o) if rng.random() < 0.5 else (o, n)
                pairs.append((*pair, *(BAD if bad else FEW if rng.random() < 0.1 else OK)))
    return pairs, frames


@pytest.mark.parametrize("seed", range(5))
def test_equals_sets(spark, seed):
    pairs, frames = update(seed)
    assert ours(spark, pairs, frames, most=0.9) == by_sets(pairs, frames, most=0.9)


def test_a_wrong_stored_frame_is_marked_and_new_ones_stay(spark):
    frames = [(s, False, True, None) for s in ("s0", "s1", "s2")] + [(n, True, None, ["s1"]) for n in ("n0", "n1", "n2")]
    pairs = [(n, s, *(BAD if s == "s0" else OK)) for n in ("n0", "n1", "n2") for s in ("s0", "s1", "s2")]
    want = [("s0", "keep", ["n0", "n1", "n2"], 2, True), ("s0", "mark", ["n0", "n1", "n2"], 1, True)]
    assert ours(spark, pairs, frames) == want == by_sets(pairs, frames)
    torn = [*pairs, ("n0", "n1", *BAD)]
    assert all(not r[4] and r[1] == "reject" for r in ours(spark, torn, frames))
    two = [p for p in pairs if p[0] != "n2"]
    assert ours(spark, two, frames) == by_sets(two, frames)


def test_chains_of_dependents_and_the_cap(spark):
    frames = [("s", False, True, None), ("a", True, None, ["s"]), *[(f"b{i}", True, None, [f"b{i - 1}" if i else "a"]) for i in range(4)], *[(f"c{i}", True, None, ["s"]) for i in range(9)]]
    pairs = [("a", "s", *BAD), ("c0", "s", *OK)]
    got = ours(spark, pairs, frames)
    assert got == by_sets(pairs, frames) and [r[:3] for r in got] == [("a", "reject", ["s"]), ("b0", "depend", ["a"]), *[(f"b{i}", "depend", [f"b{i - 1}"]) for i in (1, 2, 3)]]
    assert all(not r[4] for r in ours(spark, pairs, frames[:-8]))


def test_nulls_repeated_rows_and_empty_tables(spark):
    frames = [("s", False, None, None), ("n", True, None, None), (None, True, True, ["s"]), ("m", True, None, ["s", "s"])]
    pairs = [("n", "s", *BAD)] * 2 + [("m", "m", *BAD), (None, "s", *BAD), ("m", "gone", *BAD), ("m", "s", *FEW)]
    assert [r[:3] for r in ours(spark, pairs, frames)] == [("n", "reject", ["s"])]
    assert ours(spark, [], frames) == [] and ours(spark, pairs, []) == []
    [r] = C.judged(spark.createDataFrame([("a", "b", None, None, 50, None)], PAIRS)).collect()
    assert (r.fails, r.agrees, r.ratio_ab, r.ratio_ba) == (False, True, None, 1.0)
