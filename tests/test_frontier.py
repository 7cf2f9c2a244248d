from pyspark.sql import functions as F

from rankloom.sources.frontier import SeenLinks


def links(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, link string")


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_only_new_links_and_repeats(spark, tmp_path):
    seen = SeenLinks(spark, str(tmp_path / "seen"), "seen_a", 8)
    first = links(spark, (1, "a"), (2, "a"), (2, "b"), (3, None))
    assert rows(seen.add(first, 0)) == [("a", 1), ("b", 2)]
    second = links(spark, (4, "b"), (5, "c"), (6, "c"))
    for _ in range(2):  # a crawl that comes again counts once
        assert rows(seen.add(second, 1)) == [("c", 5)]
    assert rows(seen.add(second.where("false"), 2)) == []
    # Another session finds the files through a table of its own.
    again = SeenLinks(spark, seen.path, "seen_b", 8)
    assert rows(again.stored()) == [("a", 1, 0), ("b", 2, 0), ("c", 5, 1)] and rows(again.new(first, 3)) == []


def test_the_stored_side_is_not_shuffled(spark, tmp_path):
    seen = SeenLinks(spark, str(tmp_path / "seen"), "seen_c", 8)
    seen.add(spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("l"), F.col("id")).alias("link")), 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = seen.new(links(spark, (1, "l7"), (1, "new")), 1)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert rows(found) == [("new", 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.split("\n")
    scan = next(k for k, line in enumerate(lines) if "seen_c" in line)
    depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-"))
    join = next(k for k in range(scan, -1, -1) if "Join" in lines[k])
    side = [line for line in lines[join + 1 : scan] if len(line) - len(line.lstrip(" :+-")) < depth and not line.lstrip(" ").startswith(":")]
    assert "Bucketed: true" in lines[scan] and not any("Exchange" in line for line in side)
