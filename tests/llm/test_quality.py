import numpy as np
import pyarrow as pa

from credence.llm import quality
from credence.llm._common import read_table


def test_isotonic_is_the_least_squares_rise():
    rng = np.random.default_rng(1)
    for _ in range(50):
        total = rng.integers(0, 4, 12).astype(float)
        good = np.floor(total * rng.random(12))
        got = quality.isotonic(total, good)
        assert (np.diff(got) >= 0).all()
        if total.sum() == 0:
            continue
        at = np.flatnonzero(total)
        y, w = good[at] / total[at], total[at]
        for k in range(len(at)):  # max-min form
            want = max(min((y[i : j + 1] @ w[i : j + 1]) / w[i : j + 1].sum() for j in range(k, len(at))) for i in range(k + 1))
            assert abs(got[at[k]] - want) < 1e-9


def test_statistics_of_single_and_sliced_texts_agree():
    texts = ["", None, "A b. c D", "X!! Y!!", "é" * 9, "one two one two", "a\n\nb|c", "w" * 100_000]
    whole = quality.statistics(pa.array(texts, pa.string()))
    assert whole.shape[1] == quality.N_STATISTICS and np.isfinite(whole).all()
    for i, t in enumerate(texts):
        assert np.allclose(quality.statistics(pa.array(["pad", t, "pad"], pa.string()).slice(1, 1))[0], whole[i])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    got = quality.quality_scores(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.predicted == held.quality).mean() >= 0.9
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == int(got.predicted.sum())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "Some text.", 2), (1, None, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (1, 7)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 3 and {r.score for r in got} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_weights_equal_plain_ridge_over_all_labelled_rows(spark):
    """The summed equations, dealt over tasks, against one least-squares solution in memory."""
    sf = "/root/testdata/sf0.01"
    stats = quality.document_statistics(read_table(spark, sf, "documents").repartition(7)).cache()
    labels = read_table(spark, sf, "labels")
    model = quality.fit(stats, labels)
    rows = stats.where(f"fold <> {quality.HELD_OUT}").toPandas().merge(labels.toPandas(), on="doc_id")
    rows = rows[rows.quality.isin((0, 1))]
    x = np.stack(rows.stats.to_list()).astype(np.float64)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0) + 1e-6, atol=1e-6)
    fit = (rows.fold != quality.CALIBRATION).to_numpy()
    z, y = quality.cosines(x[fit], model.mean, model.scale), rows.quality.to_numpy()[fit].astype(np.float64)
    penalty = np.sqrt(quality.RIDGE * len(z) / quality.FEATURES)
    want = np.linalg.lstsq(np.vstack([z, penalty * np.eye(z.shape[1])]), np.append(y, np.zeros(z.shape[1])), rcond=None)[0]
    assert np.allclose(z @ model.weights, z @ want, atol=1e-6)


def test_sums_are_a_tree(spark, monkeypatch):
    from credence.llm import _common

    monkeypatch.setattr(_common, "SUM_GROUP", 3)
    parts = spark.createDataFrame([(at, part, [float(part), 1.0]) for at in range(2) for part in range(20)], "at int, part int, sums array<double>")
    got = _common.summed_rows(parts, 2, 20)
    assert {k: v.tolist() for k, v in got.items()} == {0: [190.0, 20.0], 1: [190.0, 20.0]}
