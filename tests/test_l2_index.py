import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import l2_index
from rankloom.operators.vectors import l2_nearest


def items_of(spark, vectors):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v], f"n{k}") for k, v in enumerate(vectors)], "item_id long, vector array<double>, name string")


def clusters(seed, groups=12, size=40, width=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 50, (groups, width))
    return np.concatenate([c + rng.normal(0, 1, (size, width)) for c in centres])


def asked(items):
    return items.select(F.col("item_id").alias("query_id"), "vector")


def rows(frame):
    return sorted((r.query_id, r["rank"], r.item_id, round(r.distance, 6)) for r in frame.collect())


@pytest.mark.parametrize("limits", [(65_536, 65_536), (16, 7)])
def test_search_equals_the_scan_and_skips_cells(spark, tmp_path, monkeypatch, limits):
    monkeypatch.setattr(l2_index, "SLICE_ROWS", limits[0])
    monkeypatch.setattr(l2_index, "BLOCK_ROWS", limits[1])
    items = items_of(spark, clusters(1))
    l2_index.build(items, str(tmp_path / "i"), cells=12)
    index = l2_index.L2Index.load(spark, str(tmp_path / "i"))
    found = index.search(asked(items), 7, payload=["name"])
    assert rows(found) == rows(l2_nearest(items, asked(items), 7))
    assert all(r.name == f"n{r.item_id}" for r in found.collect())
    read = index.cells_read(asked(items), 7).agg(F.avg(F.col("cells_read") / F.col("cells")), F.count("*")).first()
    assert read[0] < 0.5 and read[1] == 480


def test_ties_copies_null_vectors_and_more_than_there_are(spark, tmp_path):
    vectors = [[1, 1]] * 30 + [[0, 0], None, [0, 2], [2, 0], [0, 2]] + [[5, 5]] * 3
    items = items_of(spark, vectors)
    l2_index.build(items, str(tmp_path / "i"), cells=4)
    index = l2_index.L2Index.load(spark, str(tmp_path / "i"))
    for k, decimals in ((5, None), (33, 2), (100, 6)):
        assert rows(index.search(asked(items), k, decimals=decimals)) == rows(l2_nearest(items, asked(items), k, decimals=decimals))


def test_random_points_and_rounded_ranks(spark, tmp_path):
    items = items_of(spark, np.random.default_rng(3).integers(0, 4, (300, 3)) * 1e4)
    l2_index.build(items, str(tmp_path / "i"))
    index = l2_index.L2Index.load(spark, str(tmp_path / "i"))
    assert rows(index.search(asked(items), 9)) == rows(l2_nearest(items, asked(items), 9))


def test_empty_tables(spark, tmp_path):
    items = items_of(spark, [[1, 2], [3, 4]])
    l2_index.build(items, str(tmp_path / "i"))
    assert l2_index.L2Index.load(spark, str(tmp_path / "i")).search(asked(items).where("false"), 3).count() == 0
    l2_index.build(items.where("false"), str(tmp_path / "none"))
    assert l2_index.L2Index.load(spark, str(tmp_path / "none")).search(asked(items), 3).count() == 0
    with pytest.raises(ValueError):
        l2_index.build(items, str(tmp_path / "bad"), cells=0)


def test_queries_are_copied_once_a_shelf_and_not_once_a_cell(spark, tmp_path, monkeypatch):
    copies, score_cells = [], l2_index.score_cells
    monkeypatch.setattr(l2_index, "score_cells", lambda asked, given, *a: copies.append((asked.count(), given.count())) or score_cells(asked, given, *a))
    # Without clusters nearly all of the 40 cells are read.
    items = items_of(spark, np.random.default_rng(4).normal(size=(300, 12)))
    l2_index.build(items, str(tmp_path / "i"), cells=40)
    index = l2_index.L2Index.load(spark, str(tmp_path / "i"))
    assert rows(index.search(asked(items), 5)) == rows(l2_nearest(items, asked(items), 5))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(copies) == 2 and all(a <= 300 * width and g <= 300 for a, g in copies)
    read = index.cells_read(asked(items), 5).agg(F.avg("cells_read")).first()[0]
    assert read > 30
