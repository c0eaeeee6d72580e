from __future__ import annotations

import random

from loomline.llm.components import contracted


def test_contraction_equals_union_find(spark):
    rng = random.Random(4)
    for links in ([], [(i, i + 1) for i in range(60)], [(rng.randrange(90), rng.randrange(90)) for _ in range(70)], [(0, i) for i in range(1, 50)]):
        parent = {i: i for i in range(90)}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        start = {i: i - i % 3 if i < 9 else i for i in range(90)}
        for a, b in [*start.items(), *links]:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
        labels = spark.createDataFrame(list(start.items()), "id long, component long")
        found = contracted(labels, spark.createDataFrame(links, "src long, dst long"))
        assert {r.id: r.component for r in found.collect()} == {i: root(i) for i in range(90)}
