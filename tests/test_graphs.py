"""Graph algorithms and kernels on small graphs, against brute force."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.operators import graph, kernels, solve

SIGNED = [(0, 1, -10.0), (0, 2, -2.0), (0, 3, 6.0), (1, 3, 3.0), (2, 3, 11.0)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "u long, v long, w double")


def random_edges(seed, n, p, low=-2.0, high=1.5):
    rng = random.Random(seed)
    return [(a, b, rng.uniform(low, high)) for a in range(n) for b in range(a + 1, n) if rng.random() < p]


def test_components(spark):
    e = frame(spark, [(5, 9, 1.0), (9, 12, 1.0), (3, 12, 1.0), (20, 21, 1.0)])
    nodes = spark.createDataFrame([(7,)], "node long")
    got = dict(graph.connected_components(e, nodes).collect())
    assert got == {3: 3, 5: 3, 9: 3, 12: 3, 20: 20, 21: 20, 7: 7}


def test_components_of_a_long_chain(spark):
    ids = list(range(300))
    random.Random(1).shuffle(ids)
    e = frame(spark, [(min(a, b), max(a, b), 1.0) for a, b in itertools.pairwise(ids)])
    assert {r.component for r in graph.connected_components(e).collect()} == {0}


def test_node_label_components(spark):
    e = frame(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)])
    labels = spark.createDataFrame([(0, 0), (1, 4), (2, 4), (3, 9)], "node long, label long")
    got = dict(graph.components_from_node_labels(e, labels, dense=True, ignore_background=True).collect())
    assert got[0] == 0 and got[1] == got[2] >= 1 and got[3] >= 1 and got[3] != got[1]


def test_shortest_path(spark):
    e = frame(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 0.0), (3, 4, 0.0), (0, 5, 0.0), (4, 5, 5.0), (7, 8, 1.0)])
    goal = spark.createDataFrame([(0, 4), (0, 8)], "source long, target long")
    got = {r.target: (list(r.path), r.dist) for r in graph.shortest_paths(e, goal).collect()}
    assert got == {4: ([4, 3, 2, 1, 0], 2.0), 8: ([], None)}


def test_bellman_ford(spark):
    arcs = spark.createDataFrame([(0, 1, 4.0), (0, 2, 1.0), (2, 1, -2.0)], "src long, dst long, w double")
    assert dict(graph.bellman_ford(arcs, 0).collect()) == {0: 0.0, 1: -1.0, 2: 1.0}
    loop = spark.createDataFrame([(0, 1, 1.0), (1, 0, -2.0)], "src long, dst long, w double")
    with pytest.raises(ValueError, match="negative"):
        graph.bellman_ford(loop, 0)


def test_lifted_neighborhood(spark):
    square = frame(spark, [(0, 1, 1.0), (0, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0)])
    assert graph.lifted_neighborhood(square, 1).count() == 0
    assert sorted((r.u, r.v, r.hops) for r in graph.lifted_neighborhood(square, 2).collect()) == [(0, 3, 2), (1, 2, 2)]


def test_label_propagation(spark):
    e = frame(spark, [(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0), (3, 4, 1.0)])
    got = dict(graph.label_propagation(e, 30).collect())
    assert got[0] == got[1] == got[2] and got[3] == got[4] != got[0]


def test_signed_agglomeration():
    mean, largest, total = (kernels.gasp(SIGNED, c) for c in ("mean", "abs_max", "sum"))
    assert mean[1] == mean[2] == mean[3] != mean[0]
    assert largest[0] == largest[2] == largest[3] != largest[1]
    assert total[0] == total[2] == total[3] != total[1]
    assert set(kernels.gasp(SIGNED, "rank", q=0.5)) == {0, 1, 2, 3}
    edge = kernels.Ranked.single(2.0, 1.0, 0.5, 5, 0.0, 4.0)
    assert edge.counts == (0.0, 0.0, 1.0, 0.0, 0.0)
    with pytest.raises(NotImplementedError):
        kernels.linkage("nothing")


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_multicut_kernels_against_brute_force(seed):
    e = random_edges(seed, 7, 0.6)
    if not e:
        return
    best = kernels.energy(e, kernels.exact_multicut(e))
    greedy = kernels.energy(e, kernels.greedy_additive(e))
    for solver in (kernels.kernighan_lin, kernels.fusion_moves, kernels.chained(kernels.greedy_additive, kernels.kernighan_lin)):
        assert best - 1e-9 <= kernels.energy(e, solver(e)) <= greedy + 1e-9
    assert kernels.energy(e, kernels.greedy_fixation(e)) >= best - 1e-9


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_min_cut_against_brute_force(seed):
    rng = random.Random(seed)
    e = random_edges(seed, 6, 0.6, 0, 2)
    un = {i: (rng.random() * 3, rng.random() * 3) for i in range(6)}
    cost = lambda c: sum(w for a, b, w in e if c[a] != c[b]) + sum(un[i][c[i]] for i in un)
    flow, labels = kernels.min_st_cut(e, un)
    best = min(map(cost, itertools.product((0, 1), repeat=6)))
    assert abs(flow - best) < 1e-9 and abs(cost(labels) - best) < 1e-9


def test_lifted_solvers_do_not_raise_the_energy():
    for seed in range(20):
        e, far = random_edges(seed, 8, 0.4), random_edges(seed + 99, 8, 0.2)
        start = kernels.lifted_greedy_additive(e, far)
        total = e + far
        for solver in (kernels.lifted_kernighan_lin, kernels.lifted_fusion_moves):
            assert kernels.energy(total, solver(e, far)) <= kernels.energy(total, start) + 1e-9


def test_watersheds_agree_on_a_path():
    e = [(0, 1, 0.1), (1, 2, 0.9), (2, 3, 0.2)]
    seeds = {0: 1, 3: 2}
    assert kernels.kruskal_watershed(e, seeds) == kernels.prim_watershed(e, seeds) == {0: 1, 1: 1, 2: 2, 3: 2}
    assert kernels.node_watershed(e, seeds, {0: 0, 1: 0.5, 2: 0.7, 3: 0}) == {0: 1, 1: 1, 2: 2, 3: 2}
    assert kernels.carve(e, seeds)[1] == 1 and kernels.carve(e, seeds, bias=10.0)[1] == 2


def test_star_agglomerates_to_one():
    assert len(set(kernels.edge_weighted_clustering([(0, 1, 1.0), (0, 2, 1.0), (0, 3, 1.0)]).values())) == 1


def test_decomposed_equals_whole(spark):
    e = random_edges(3, 12, 0.3)
    whole = kernels.greedy_additive(e)
    parts = dict(solve.per_component(frame(spark, e), kernels.greedy_additive, positive=True).collect())
    assert parts == whole


def test_block_multicut_is_a_partition(spark):
    e = random_edges(5, 12, 0.4)
    blocks = spark.createDataFrame([(i, i // 4) for i in range(12)], "node long, block long")
    got = dict(solve.block_multicut(frame(spark, e), blocks).collect())
    assert set(got) == set(range(12)) and kernels.energy(e, got) <= 1e-9 + sum(w for *_, w in e if w > 0) - 0


def test_triangles(spark):
    e = [(a, b, 1.0) for a, b, _ in random_edges(8, 12, 0.5)]
    s = {(a, b) for a, b, _ in e}
    want = sorted(t for t in itertools.combinations(range(12), 3) if {(t[0], t[1]), (t[0], t[2]), (t[1], t[2])} <= s)
    assert sorted(map(tuple, graph.triangles(frame(spark, e)).collect())) == want


def test_two_way_cut_is_exact_on_a_forest():
    e = [(0, 1, -2.0), (1, 2, 3.0), (1, 3, -1.0), (5, 6, 4.0)]
    assert kernels.energy(e, kernels.two_way_cut(e)) == -3.0


def test_heights_rise_with_the_merge_order():
    e = [(0, 1, 0.1), (1, 2, 0.5), (2, 3, 0.2)]
    h = {(u, v): x[0] for u, v, x in kernels.ucm(e, [0.0], [(0, 1), (2, 3), (0, 3)])}
    assert h[0, 1] < h[2, 3] < h[0, 3]


def slow_agglomeration(edges, value, stop, best=min, alone=1):
    """Join the best pair of clusters again and again; values are computed anew from all edges between two clusters."""
    groups = {x: {x} for e in edges for x in e[:2]}
    while len(groups) > alone:
        pairs = []
        for a, b in itertools.combinations(sorted(groups), 2):
            w = [x for u, v, x in edges if (u in groups[a] and v in groups[b]) or (v in groups[a] and u in groups[b])]
            if w:
                pairs.append((value(w, len(groups[a]), len(groups[b])), a, b))
        if not pairs or stop(best(pairs, key=lambda p: p[0])[0]):
            break
        _, a, b = best(pairs, key=lambda p: p[0])
        groups[a] |= groups.pop(b)
    return {frozenset(g) for g in groups.values()}


def clusters(labels):
    out = {}
    for x, c in labels.items():
        out.setdefault(c, set()).add(x)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("seed", range(12))
def test_rules_on_graphs_with_cycles_against_slow_agglomeration(seed):
    """Each linkage merges in its own order; the partitions differ between rules on most of these graphs."""
    e = random_edges(seed, 11, 0.5)
    values = {"sum": sum, "mean": lambda w: sum(w) / len(w), "max": max, "min": min, "abs_max": lambda w: max(w, key=abs)}
    for rule, f in values.items():
        want = slow_agglomeration(e, lambda w, a, b, f=f: f(w), lambda p: p <= 0, max)
        assert clusters(kernels.gasp(e, rule)) == want, rule
    assert clusters(kernels.greedy_additive(e)) == slow_agglomeration(e, lambda w, a, b: sum(w), lambda p: p <= 0, max)


def test_rules_differ():
    seen = [[clusters(kernels.gasp(random_edges(s, 11, 0.5), r)) for r in ("sum", "mean", "max", "min", "abs_max")] for s in range(12)]
    assert all(any(x[i] != x[j] for x in seen) for i, j in itertools.combinations(range(5), 2) if (i, j) != (0, 1))


@pytest.mark.parametrize("seed", range(8))
def test_size_regularised_clustering_against_slow_agglomeration(seed):
    e = random_edges(seed, 10, 0.5, 0.05, 1.0)
    for left, r in ((3, 0.5), (5, 1.0), (4, 0.0)):
        want = slow_agglomeration(e, lambda w, a, b, r=r: sum(w) / len(w) * 2 / (1 / a**r + 1 / b**r), lambda p: False, alone=left)
        assert clusters(kernels.edge_weighted_clustering(e, regularizer=r, stop_nodes=left)) == want


@pytest.mark.parametrize("seed", range(8))
def test_watersheds_with_several_seeds_against_flooding(seed):
    """Both edge watersheds flood along the lightest edge that leaves the flooded part."""
    e = random_edges(seed, 12, 0.4, 0.0, 1.0)
    nodes = {x for u, v, _ in e for x in (u, v)}
    seeds = {x: x + 100 for x in sorted(nodes)[::4]}
    got = dict(seeds)
    while True:
        leaving = [(w, u, v) if u in got else (w, v, u) for u, v, w in e if (u in got) != (v in got)]
        if not leaving:
            break
        _, inside, outside = min(leaving)
        got[outside] = got[inside]
    for kernel in (kernels.prim_watershed, kernels.kruskal_watershed):
        labels = kernel(e, seeds)
        assert {x: labels[x] for x in got} == got
    assert len(set(got.values())) > 1
