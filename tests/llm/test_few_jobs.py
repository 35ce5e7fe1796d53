"""The n-gram join runs no job for each partition, and its few links come as one small part."""

from quirelake.llm.components import connected_components
from quirelake.llm.ngram_join import column_counts


def test_sketch_is_one_job_a_shuffle(spark):
    docs = spark.createDataFrame([(i, f"a b c d{i % 7} e") for i in range(40)], "_id long, _text string").repartition(9)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("sketch", "counts")
    try:
        total = column_counts(docs, 3)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("sketch"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k, v in held.items():
            spark.conf.set(k, v)
    # a b c in all 40 texts, two more runs in each of the seven kinds
    assert sorted(total[total > 0]) == [5] * 4 + [6] * 10 + [40] and jobs <= 6


def test_few_links_are_one_part(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(None, 3), (5, 5)], "a long, b long").repartition(7)
    found = connected_components(links)
    assert found.rdd.getNumPartitions() == 1
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(21)}
    none = connected_components(links.filter("a > 99"))
    assert none.columns == ["node", "component"] and not none.collect()
