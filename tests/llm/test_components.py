"""Components of graphs that end in the driver, at once or after steps that shrink them."""

from __future__ import annotations

import random

import pytest

from duskveil.llm import common, linkage


def brute(links):
    up = {x: x for link in links for x in link}
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    return {x: r for x, r in up.items() if x != r}


@pytest.mark.parametrize("few,steps", [(1 << 14, 1), (40, 9), (0, 99)])
def test_steps_end_where_few_links_are_left(spark, monkeypatch, few, steps):
    draw = random.Random(5)
    path = [(i, i + 1) for i in range(-60, 60)]
    star = [(1000 + i % 3, 2000 + i) for i in range(200)]
    links = [*path, *star, *[(b, a) for a, b in star], (7, 7), *[(draw.randrange(5000, 5300), draw.randrange(5000, 5300)) for _ in range(120)]]
    made, stored = [], common.stored
    monkeypatch.setattr(linkage, "FEW", few, raising=False)
    monkeypatch.setattr(common, "stored", lambda df, what: made.append(what) or stored(df, what))
    got = linkage.components(spark.createDataFrame(links, "a long, b long")).collect()
    want = brute([link for link in links if link[0] != link[1]])
    assert len(got) == len(want) and {r.id: r.root for r in got} == want
    assert made.count("edges") <= steps
    assert linkage.components(spark.createDataFrame([], "a long, b long")).count() == 0
