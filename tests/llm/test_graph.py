"""Connected components against a plain union, and in how few rounds small graphs are settled."""

import numpy as np
import pytest

from markerflow.llm import graph


def plain(edges):
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("held", [2, 7, 1 << 20])
@pytest.mark.parametrize("shape", ["random", "path", "star", "loops"])
def test_components(spark, held, shape):
    rng = np.random.default_rng(5)
    places = rng.permutation(200)
    edges = {
        "random": [tuple(map(int, e)) for e in rng.integers(0, 300, (220, 2))],
        "path": [(int(a), int(b)) for a, b in zip(places, places[1:])],
        "star": [(500, i) for i in range(60)] + [(i, 500) for i in range(60)],
        "loops": [(3, 3), (4, 4)],
    }[shape]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert {r.node: r.root for r in graph.components(df, held).collect()} == plain(edges)


def test_a_small_graph_takes_no_round(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(graph, "stage", lambda df, name, *more: staged.append(name) or STAGE(df, name, *more))
    edges = [(i, i + 1) for i in range(300)]
    found = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert {r.node: r.root for r in found} == plain(edges) and len(staged) <= 3


STAGE = graph.stage


def test_nothing_that_grows_with_the_texts_is_broadcast(spark, monkeypatch):
    from markerflow.llm import batches, graph, ngram_join

    plans, kept = {}, ngram_join.stage

    def noted(df, name, *more):
        plans[f"{name} {len(plans)}"] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, name, *more)

    for module in (batches, graph, ngram_join):
        monkeypatch.setattr(module, "stage", noted)
    words = [[f"w{k}x{i}" for i in range(40)] for k in range(6)]
    texts = [" ".join(w) for w in words] + [" ".join(w[:-1]) for w in words] + [" ".join(words[0])]
    out = ngram_join.ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tile=2)
    assert {tuple(r) for r in out.select("doc_id", "component_id").collect()} == {(i, i % 6) for i in range(13)}
    plans["result"] = out._jdf.queryExecution().executedPlan().toString()
    assert sum("Join" in p for p in plans.values()) >= 5
    # tiles read one row a block of more than a tile, which is none a text
    assert not [n for n, p in plans.items() if "Broadcast" in p and not n.startswith("grams-compared")]
