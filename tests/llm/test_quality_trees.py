import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import quality_trees as qt


def test_forest_walks_its_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.1)).astype(float)
    forest = qt.fit(x, y, trees=20, depth=3, bins=32)
    score = forest.score(x)
    assert ((score > 0.5) == (y == 1)).mean() > 0.95

    def walk(row):
        total = forest.base
        for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(score[:50], [walk(r) for r in x[:50]])


@pytest.mark.parametrize("x, y", [(np.zeros((0, qt.N_STATISTICS)), np.zeros(0)), (np.zeros((7, qt.N_STATISTICS)), np.ones(7))])
def test_nothing_to_learn(x, y):
    score = qt.fit(x, y).score(np.zeros((3, qt.N_STATISTICS)))
    assert np.ptp(score) == 0 and (score[0] == 0.5 if not len(y) else score[0] > 0.9)


def test_statistics_of_odd_texts():
    rows = qt.statistics([None, b"", b" \n ", b"a", b"AB!! cd\ncd\ncd", b"x " * 60_000])
    assert np.isfinite(rows).all() and not rows[:2].any()
    assert np.array_equal(qt.statistics([b"same"]), qt.statistics([b"same"]))


def test_train_and_score(spark, docs):
    rows = [(i, ("calm words of prose number " * 9 if i % 2 else "AAA!! ### BBB!! " * 9) + str(i)) for i in range(200)]
    frame = docs([*rows, (None, None), (201, ""), (3, rows[3][1])]).withColumnRenamed("key", "score")
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"))
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (3, 1)], "doc_id long, label long"))
    forest = qt.train(frame, labels.where(~qt.held_out(F.col("doc_id"))))
    made = qt.score(frame, forest)
    assert made.columns == [*(c for c in frame.columns if c != "score"), "score"]
    got = {r.doc_id: r.score for r in made.collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(200)) and 0 <= got[201] <= 1 and 0 <= got[None] <= 1
    # The sample is bounded and chosen by hash, so it is the same each time.
    few = [qt.train(frame, labels, max_rows=50).score(qt.statistics([b"calm words"]))[0] for _ in range(2)]
    assert few[0] == few[1]
    assert {r.score for r in qt.score(frame, qt.train(frame, labels.where("false"))).collect()} == {0.5}
    assert qt.score(frame.where("false"), forest).count() == 0


def test_held_out_labels_tell_on_the_test_tables(spark):
    """Held-out accuracy of the registered query."""
    from rankloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    found = QUERIES["op5_quality_trees"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert len(found) > 40 and np.mean([r.predicted == r.quality for r in found]) > 0.95


def plain_statistics(text):
    """The statistics of one text, counted byte by byte and word by word."""
    if not text:
        return [0.0] * qt.N_STATISTICS
    kinds = [
        b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b".,;:'\"()-?", b"!", b"\n", b" \t\x0b\x0c\r", bytes(range(128, 256)),
    ]
    out = [sum(b in kind for b in text) / len(text) for kind in kinds]
    words, word = [], b""
    for b in text + b" ":
        if b in b" \t\x0b\x0c\r\n":
            words += [word] if word else []
            word = b""
        else:
            word += bytes([b])
    lines, n = text.split(b"\n"), max(1, len(words))
    couples = {(words[i], words[i + 1]) for i in range(len(words) - 1)}
    lengths = [np.log(1 + len(text)), np.log(1 + len(words)), len(text) / n]
    return [*out, *lengths, len(set(words)) / n, (1 + len(couples)) / n, max([len(w) for w in words], default=0), len(set(lines)) / len(lines), len(text) / len(lines)]


def test_statistics_equal_plain_counts():
    rng = np.random.default_rng(3)
    texts = [None, b"", b" ", b"\n\n", "é ß x".encode(), b"one two one two\none two"]
    texts += [bytes(rng.choice(list(b"aAzZ09#!.? \t\n\x0b\xc3\xa9word  "), rng.integers(1, 300)).astype(np.uint8)) for _ in range(60)]
    assert np.allclose(qt.statistics(texts), [plain_statistics(t) for t in texts])


@pytest.mark.parametrize("seed", range(6))
def test_splits_are_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(300, 4)), 1)  # with ties
    y = (x[:, seed % 4] + 0.5 * x[:, 1] + rng.normal(size=300) > 0).astype(float)
    bins, ridge, rate = 8, 1.0, 0.2
    forest = qt.fit(x, y, trees=1, depth=2, bins=bins, rate=rate, ridge=ridge)
    p = y.mean()
    gradient, weight = y - p, np.full(len(y), p * (1 - p))
    edges = [np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]) for f in range(4)]

    def gain(rows, feature, cut):
        sides = [rows & (x[:, feature] <= cut), rows & (x[:, feature] > cut)]
        if any(weight[s].sum() < 1 for s in sides):
            return 0.0
        worth = [gradient[s].sum() ** 2 / (weight[s].sum() + ridge) for s in [*sides, rows]]
        return worth[0] + worth[1] - worth[2]

    def check(rows, node):
        if node >= 3:
            assert forest.leaf[0][node - 3] == pytest.approx(rate * gradient[rows].sum() / (weight[rows].sum() + ridge))
            return
        best = max(gain(rows, f, c) for f in range(4) for c in edges[f])
        feature, cut = forest.feature[0][node], forest.cut[0][node]
        if best <= 1e-9:
            assert np.isinf(cut)
        else:
            assert cut in edges[feature] and gain(rows, feature, cut) == pytest.approx(best)
        check(rows & (x[:, feature] <= cut), 2 * node + 1)
        check(rows & (x[:, feature] > cut), 2 * node + 2)

    check(np.ones(len(y), bool), 0)
