"""Merges in rounds against one pair after another."""

import random

import pytest

from atlasloom.operators import merging as M
from atlasloom.plans import catalogue
from atlasloom.plans.base import checkpoint_folder


@pytest.fixture(autouse=True)
def checkpoints(spark):
    checkpoint_folder(spark)


def strength(a, b):
    if not (a["touched"] or b["touched"]) or (a["published"] is not None and b["published"] is not None and a["published"] != b["published"]):
        return 0
    box = lambda o: [(min(c[k] for c in o["cells"]), max(c[k] for c in o["cells"])) for k in range(3)]
    x, y = box(a), box(b)
    edge = [min(p[1], q[1]) - max(p[0], q[0]) + 1 for p, q in zip(x, y, strict=True)]
    if min(edge) <= 0:
        return 0
    volume = lambda o: (o[0][1] - o[0][0] + 1.0) * (o[1][1] - o[1][0] + 1) * (o[2][1] - o[2][0] + 1)
    common, va, vb = float(edge[0] * edge[1] * edge[2]), volume(x), volume(y)
    n, least, most = len(a["cells"] & b["cells"]), min(len(a["cells"]), len(b["cells"])), max(len(a["cells"]), len(b["cells"]))
    label = lambda o: min(((-v, k) for k, v in o["votes"].items()), default=(0, None))[1]
    if label(a) == label(b):
        return max(n / least / M.OVERLAP, common / (va + vb - common) / M.BOX_IOU, common / min(va, vb) / M.CONTAINED)
    if a["frames"] & b["frames"] or max(len(a["frames"]), len(b["frames"])) < M.DETECTIONS or least < M.SCALE * most:
        return 0
    return n / least / M.OVERLAP


def one_after_another(objects):
    objects = {k: {**o, "cells": set(o["cells"]), "frames": set(o["frames"]), "votes": dict(o["votes"])} for k, o in objects.items()}
    alias = {k: k for k in objects}
    while True:
        found = [(-s, a, b) for a in objects for b in objects if a < b and objects[a]["cells"] and objects[b]["cells"] and (s := strength(objects[a], objects[b])) >= 1]
        if not found:
            return alias
        _, a, b = min(found)
        keep, gone = objects[a], objects.pop(b)
        keep["cells"] |= gone["cells"]
        keep["frames"] |= gone["frames"]
        for k, v in gone["votes"].items():
            keep["votes"][k] = keep["votes"].get(k, 0) + v
        keep["touched"] |= gone["touched"]
        keep["published"] = gone["published"] if keep["published"] is None else keep["published"]
        alias = {k: a if v == b else v for k, v in alias.items()}


@pytest.mark.parametrize(("seed", "n", "room"), [(3, 26, 5), (0, 20, 4)])
def test_rounds_are_one_after_another(spark, seed, n, room):
    """Small boxes in little room: many ties, growing boxes, labels that change, ids that must stay apart."""
    rng = random.Random(seed)
    objects = {}
    for k in range(n):
        at, size = [rng.randrange(room) for _ in range(3)], [rng.randint(1, 4) for _ in range(3)]
        block = [(at[0] + i, at[1] + j, at[2] + h) for i in range(size[0]) for j in range(size[1]) for h in range(size[2])]
        seen = [(rng.randrange(30), rng.choice("aab" if seed % 2 else "abc")) for _ in range(rng.randint(0, 4))]
        objects[k] = {"cells": {c for c in block if rng.random() < 0.9}, "seen": seen, "frames": {f for f, _ in seen}, "votes": {}, "touched": seed == 0 or rng.random() < 0.6, "published": rng.choice([None, None, None, k % 3]) if seed else None}
        for _, label in seen:
            objects[k]["votes"][label] = objects[k]["votes"].get(label, 0) + 1
    cells = spark.createDataFrame([(k, *c) for k, o in objects.items() for c in o["cells"]], "id bigint, x int, y int, z int")
    sightings = spark.createDataFrame([(k, f, label) for k, o in objects.items() for f, label in o["seen"]], "id bigint, frame int, label string")
    marks = spark.createDataFrame([(k, o["touched"], o["published"]) for k, o in objects.items()], "id bigint, touched boolean, published int")
    got = {r.id: r.object for r in M.merged(cells, sightings, marks).collect()}
    want = one_after_another(objects)
    assert got == want and len(set(want.values())) < len(want) - 3


def test_query(spark, sf):
    """Every object once, in one that keeps its own id, a lower one."""
    kept = {r.id: r.object for r in catalogue.QUERIES["object_merges"](spark, sf).collect()}
    n = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("floor(l_orderkey / 40) AS id").distinct().count()
    assert len(kept) == n and all(kept[o] == o <= i for i, o in kept.items()) and len(set(kept.values())) < n


def test_a_round_describes_only_what_it_would_make(spark, monkeypatch):
    """Twelve objects of which two are one: after the first pass over all, a round meets the one that it would make."""
    sizes, real = [], M.strengths
    monkeypatch.setattr(M, "strengths", lambda left, right: sizes.append((left["objects"].count(), right["objects"].count())) or real(left, right))
    cells = spark.createDataFrame([(k, 100 * (k % 11), j, 0) for k in range(12) for j in range(3)], "id bigint, x int, y int, z int")
    sightings = spark.createDataFrame([(k, k, "a") for k in range(12)], "id bigint, frame int, label string")
    marks = spark.createDataFrame([(k, True, None) for k in range(12)], "id bigint, touched boolean, published int")
    assert {r.id: r.object for r in M.merged(cells, sightings, marks).collect()} == {k: k % 11 for k in range(12)}
    assert sizes == [(12, 12), (1, 13)]
