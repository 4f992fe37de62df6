"""Components of links by stars: what they are, and how many rounds finding them takes."""

import random

from spanloom.llm import components as module
from spanloom.llm.components import components, stars


def one_by_one(links):
    at = {}
    for a, b in links:
        if a != b:
            x, y = at.setdefault(a, {a}), at.setdefault(b, {b})
            if x is not y:
                x |= y
                at.update(dict.fromkeys(y, x))
    return sorted((k, min(v)) for k, v in at.items())


def test_components_of_any_links(spark):
    r = random.Random(3)
    chain = [(k, k + 1) for k in range(20)]
    hub = [(100, 100 + k) for k in range(1, 40)] + [(100 + k, 99) for k in range(5, 9)]
    links = [*chain, *hub, *hub[:5], (7, 7), (500, 500), *[(r.randint(200, 290), r.randint(200, 290)) for _ in range(60)]]
    df = spark.createDataFrame(links, "a long, b long")
    assert sorted(map(tuple, components(df).collect())) == one_by_one(links)
    found = stars(df)
    more = [(0, 250), (300, 301), (99, 20)]
    again = components(found.unionByName(spark.createDataFrame(more, "a long, b long")))
    assert sorted(map(tuple, again.collect())) == one_by_one([*links, *more])
    assert components(df.filter("a = b")).collect() == []


def test_stars_are_seen_without_another_round(spark, monkeypatch):
    checkpoints, plain = [], module.durable
    monkeypatch.setattr(module, "durable", lambda df: checkpoints.append(1) or plain(df))
    found = components(spark.createDataFrame([(1, k) for k in range(2, 30)], "a long, b long"))
    assert sorted(map(tuple, found.collect())) == [(k, 1) for k in range(1, 30)]
    assert len(checkpoints) == 1  # were 3: the links, a round, and one more to see that nothing changes
