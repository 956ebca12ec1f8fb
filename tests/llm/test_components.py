"""Connected components of long chains."""

import numpy as np

from graphloom.llm.components import components


def test_long_chain_is_one_component(spark):
    rng = np.random.default_rng(4)
    names = [int(x) for x in rng.permutation(1 << 20)[:2004]]
    chain, pair = names[:2001], names[2001:2003]
    edges = [(names[i], names[i + 1]) for i in range(2000)] + [tuple(pair), (names[2003], names[2003])]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: min(chain) for x in chain} | {x: min(pair) for x in pair}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
