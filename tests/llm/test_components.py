"""Star contraction against union-find."""

import random

import brute

from casewright.llm.components import components, extended

SCHEMA = "a long, b long"


def found(spark, pairs):
    rows = components(spark.createDataFrame(pairs, SCHEMA)).collect()
    return {r.node: r.root for r in rows}


def test_random_graphs_chains_and_stars(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    links += [(1000 + k, 1001 + k) for k in range(60)]  # a chain
    links += [(2000, 2001 + k) for k in range(200)]  # a star
    nodes = {x for pair in links for x in pair}
    wanted = {n: r for n, r in brute.roots(nodes, links).items() if n != r}
    assert found(spark, links + links[:10] + [(7, 7)]) == wanted


def test_nulls_loops_and_no_pairs(spark):
    assert found(spark, [(None, 1), (2, None), (3, 3)]) == {}
    assert found(spark, []) == {}


def test_more_links_extend_what_is_known(spark):
    rng = random.Random(6)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    frame = lambda pairs: spark.createDataFrame(pairs, SCHEMA)
    roots = components(frame(links[:150]))
    for part in (links[150:220], links[:40], [], links[220:] + [(401, 402)]):
        roots = extended(roots, frame(part))
    nodes = {x for pair in links for x in pair} | {401, 402}
    wanted = {n: r for n, r in brute.roots(nodes, [*links, (401, 402)]).items() if n != r}
    got = roots.collect()
    assert len(got) == len(wanted) and {r.node: r.root for r in got} == wanted
