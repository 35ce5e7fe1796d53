"""Components of few links take few jobs, and the same ones as rounds of stars."""

import random

from quirelake.llm.components import connected_components


def smallest(links):
    at = {x: x for link in links for x in link if link[0] != link[1]}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and at[a] != at[b]:
                at[a] = at[b] = min(at[a], at[b])
                changed = True
    return at


def test_few_links_take_few_jobs(spark):
    rng = random.Random(5)
    path = [(i, i + 1) for i in range(0, 300)]
    links = rng.sample(path, len(path)) + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(250)] + [(7, 7)]
    want = smallest(links)
    table = spark.createDataFrame([(f"{a:04}", f"{b:04}") for a, b in links], "a string, b string")
    spark.sparkContext.setJobGroup("few-links", "components")
    try:
        got = {int(r.node): int(r.component) for r in connected_components(table).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-links"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert got == want and jobs <= 20
    assert {int(r.node): int(r.component) for r in connected_components(table, few=0).collect()} == want
