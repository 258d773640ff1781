"""Components of links that chains, stars and random graphs make, and links added in turn."""

import random

import pytest

from rankloom.llm.components import components
from rankloom.llm.hyperminhash import LinkTables
from rankloom.session import materialize

SCHEMA = "a bigint, b bigint"


def plain(links):
    least = {i: i for link in links for i in link if None not in link and link[0] != link[1]}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in least and b in least and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return least


def drawn(seed, ids, count):
    draw = random.Random(seed)
    return [(draw.randrange(ids), draw.randrange(ids)) for _ in range(count)]


CASES = {
    "none": [], "loops and nulls": [(3, 3), (None, 4), (5, None)], "star": [(7, 1), (1, 9), (5, 1), (1, 5)],
    "centre hangs": [(9, 5), (8, 5), (5, 2)], "two centres": [(9, 5), (9, 2), (9, 9)],
    "chain": [(i, i + 1) for i in range(40)], "upside down": [(i * 37 % 41, (i + 1) * 37 % 41) for i in range(40)],
    "sparse": drawn(1, 60, 40), "dense": drawn(2, 20, 80),
}


@pytest.mark.parametrize("name", CASES)
def test_components_equal_plain_ones(spark, name):
    got = components(spark.createDataFrame(CASES[name], SCHEMA)).collect()
    assert len(got) == len({r.id for r in got})
    assert {r.id: r.component for r in got} == plain(CASES[name])


def test_links_added_in_turn(spark):
    found, links = LinkTables(), []
    assert found.joined() is None
    for seed in (3, 4, 5):
        more = drawn(seed, 80, 25)
        links += more
        found.add(materialize(spark.createDataFrame(more, SCHEMA), "links"))
        found.add(spark.createDataFrame([], SCHEMA))
        assert {r.id: r.component for r in found.joined().collect()} == plain(links)
    assert len(found.tables) == 3 and found.joined() is found.joined()
