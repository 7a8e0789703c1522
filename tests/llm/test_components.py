"""Components are settled in one task where few links are left, and in rounds before that."""

import random

from graphlens.llm import components as module
from graphlens.llm.common import staged

from .test_near import brute_components


def test_few_links_take_one_table(spark):
    links, written = [(k, k + 1) for k in range(3_000)] + [(7, 7), (9_000, 9_000), (5, 4)], []

    def keep(df, label):
        written.append(label)
        return staged(df, label)

    got = {r.id: r.component for r in module.components(spark.createDataFrame(links, "a long, b long").repartition(5), keep).collect()}
    assert got == brute_components({x for p in links for x in p}, links)
    assert written == ["components"]


def test_rounds_and_what_they_leave(spark):
    rng = random.Random(5)
    links = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(k, k + 1) for k in range(2_000, 2_300)] + [(5_000, 5_000)]
    most, module.SETTLED = module.SETTLED, 60
    try:
        got = {r.id: r.component for r in module.components(spark.createDataFrame(links, "a long, b long")).collect()}
    finally:
        module.SETTLED = most
    assert got == brute_components({x for p in links for x in p}, links)
