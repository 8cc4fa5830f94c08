"""How much the driver plans and holds for connected components and what uses them."""

import random

import pytest

from argusline.llm import parity_join, secrets
from argusline.llm.common import Stages
from argusline.llm.components import components


def found(spark, monkeypatch, edges, kind="long"):
    """Roots by node, rounds after the first table and how often memory was released."""
    rounds, released, write = [], [], Stages.write
    monkeypatch.setattr(Stages, "write", lambda self, df, label="t", *a, **b: rounds.append(label) or write(self, df, label, *a, **b))
    monkeypatch.setattr(Stages, "release", lambda self: released.append(1))
    got = components(spark.createDataFrame(edges, f"a {kind}, b {kind}"), "a", "b", Stages(spark, "t")).collect()
    monkeypatch.undo()
    assert len(got) == len({r.node for r in got})
    return {r.node: r.root for r in got}, len(rounds) - 1, len(released)


def brute(edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_stars_take_no_round_and_each_round_is_released(spark, monkeypatch):
    stars = [(0, k) for k in range(1, 30)] + [(31, 30), (30, 31)]
    assert found(spark, monkeypatch, stars) == (brute(stars), 0, 0)
    assert found(spark, monkeypatch, []) == ({}, 0, 0)
    # A hub that is not the smallest, a path, and a node with two smaller ones.
    for edges in ([(5, k) for k in range(10)], [(1, 2), (2, 3)], [(1, 3), (2, 3)]):
        edges = [e for e in edges if e[0] != e[1]]
        got, rounds, released = found(spark, monkeypatch, edges)
        assert got == brute(edges) and 0 < rounds == released


@pytest.mark.parametrize("kind", ["long", "string"])
def test_random_graphs(spark, monkeypatch, kind):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    edges = [(f"{a:02}", f"{b:02}") if kind == "string" else (a, b) for a, b in pairs if a != b]
    assert found(spark, monkeypatch, edges, kind)[0] == brute(edges)


def test_no_sets_are_moved_for_pairs_that_the_bits_rule_out(spark, monkeypatch):
    texts = [" ".join(f"w{k}" for k in range(30 * i, 30 * i + 40)) for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    verified, sift = [], parity_join.ParityJoin.sift
    monkeypatch.setattr(parity_join.ParityJoin, "sift", lambda self, pairs: sift(self, pairs).where("false"))
    monkeypatch.setattr(parity_join.ParityJoin, "verify", lambda self, pairs: verified.append(pairs) or pairs)
    got = parity_join.near_duplicates(docs).collect()
    assert not verified and {(r.doc_id, r.component_id) for r in got} == {(i, i) for i in range(6)}


def test_what_training_leaves_is_released(spark, monkeypatch):
    steps, fit = [], secrets.train_forest
    monkeypatch.setattr(Stages, "release", lambda self: steps.append("release"))
    monkeypatch.setattr(secrets, "train_forest", lambda *a: steps.append("fit") or fit(*a))
    labelled = spark.createDataFrame([(*[float(i % 2 + k) for k in range(len(secrets.FEATURES))], i % 2) for i in range(20)], [*secrets.FEATURES, "label"])
    scanner = secrets.train_scanner(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), labelled=labelled)
    assert steps == ["release", "fit", "release"] and scanner.trees
