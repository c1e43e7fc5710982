"""The network's gradients, its independence of partitions, and when it stops."""

import numpy as np
import pytest

from answerflow.plans import learned, network
from answerflow.plans.features import vector_column
from answerflow.plans.network import DenseClassifier, first_weights, gradient, loss_of, forward, mask, masks_of, uniform


def frame(spark, x, y, parts=3):
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return vector_column(spark.createDataFrame(rows, "id long, embedding array<double>, label double").repartition(parts))


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    weights = [(w, rng.normal(size=b.shape)) for w, b in first_weights(4, [6, 5], 3)]
    x, y, w = rng.normal(size=(9, 4)), rng.integers(0, 2, 9).astype(float), rng.random(9) + 0.5
    masks = masks_of(np.arange(9), [6, 5], [0.4, 0.2], 7)
    loss, grads = gradient(weights, x, y, w, masks)
    assert loss == pytest.approx((w * loss_of(forward(weights, x, masks)[0], y)).sum())
    for layer in range(3):
        for part in (0, 1):
            for at in [tuple(rng.integers(0, s) for s in weights[layer][part].shape) for _ in range(5)]:
                moved = []
                for step in (1e-6, -1e-6):
                    changed = [[w.copy(), b.copy()] for w, b in weights]
                    changed[layer][part][at] += step
                    moved.append((w * loss_of(forward([tuple(c) for c in changed], x, masks)[0], y)).sum())
                assert grads[layer][part][at] == pytest.approx((moved[0] - moved[1]) / 2e-6, abs=1e-5)


def test_masks_depend_on_the_row_alone():
    rows = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 2000)
    all_of = mask(rows, 50, 0.3, 1, 2)
    assert (all_of[::-1] == mask(rows[::-1], 50, 0.3, 1, 2)).all()
    assert abs((all_of == 0).mean() - 0.3) < 0.01 and np.allclose(all_of[all_of > 0], 1 / 0.7)
    assert abs(np.corrcoef(all_of[:, 0], all_of[:, 1])[0, 1]) < 0.08 and (all_of != mask(rows, 50, 0.3, 1, 3)).any()
    assert abs(uniform(rows, 5).mean() - 0.5) < 0.03


def test_partitions_change_nothing(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    learned = []
    for parts in (1, 6):
        machine = DenseClassifier(labelCol="label", hidden=[16, 8], dropout=[0.3, 0.2], epochs=4, batch_rows=100)
        learned.append(machine.fit(frame(spark, x, y, parts)).arrays())
    for name in learned[0]:
        assert np.allclose(learned[0][name], learned[1][name], atol=1e-9), name
    assert learned[0]["history"].shape == (4, 3)


def test_a_step_gets_only_the_rows_of_its_batch(spark, monkeypatch):
    """What goes to Python over an epoch is the table once, however many batches it is dealt to."""
    rows, summed = spark.sparkContext.accumulator(0), network.summed

    def counted(frame, work, **settings):
        def and_count(batches):
            def seen():
                for batch in batches:
                    rows.add(batch.num_rows)
                    yield batch

            return work(seen())

        return summed(frame, and_count, **settings)

    monkeypatch.setattr(network, "summed", counted)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3))
    DenseClassifier(labelCol="label", hidden=[4], dropout=[0.0], epochs=2, batch_rows=40).fit(frame(spark, x, (x[:, 0] > 0).astype(float)))
    assert rows.value == 2 * 400


def test_sums_added_up_by_the_driver_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 3))
    y, settings = (x[:, 0] > 0).astype(float), dict(labelCol="label", hidden=[8], dropout=[0.2], epochs=3, batch_rows=60)
    monkeypatch.setattr(network, "WORTH_A_TASK", 0)
    monkeypatch.setattr(network, "ROWS_AT_ONCE", 512)  # 32 rows are worth a task
    a = DenseClassifier(**settings).fit(frame(spark, x, y)).arrays()
    monkeypatch.setattr(learned, "AT_THE_DRIVER", 0)
    b = DenseClassifier(**settings).fit(frame(spark, x, y)).arrays()
    for name in a:
        assert np.allclose(a[name], b[name], atol=1e-9), name


def test_learns_what_no_line_can(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    machine = DenseClassifier(labelCol="label", hidden=[48, 24], dropout=[0.1, 0.0], epochs=60, rate=0.02)
    rows = machine.fit(frame(spark, x, y)).transform(frame(spark, x, y)).collect()
    assert np.mean([r.prediction == r.label for r in rows]) > 0.9
    assert all(r.prediction == (r.probability[1] >= 0.5) for r in rows)


def test_stops_early_and_keeps_the_best_weights(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(120, 20)), rng.integers(0, 2, 120).astype(float)  # nothing to learn
    machine = DenseClassifier(labelCol="label", hidden=[64], dropout=[0.0], penalty=0.0, epochs=80, rate=0.05, held_out=0.3, patience=5, slower_after=2)
    model = machine.fit(frame(spark, x, y))
    history = model.arrays()["history"]
    best = history[:, 1].argmin()
    assert len(history) == best + 6 < 80
    assert history[-1, 0] < history[0, 0] and history[-1, 2] < 0.05
    # The kept weights give the held-out loss of the best epoch.
    learned = model.arrays()
    weights = [(learned[f"w{i}"], learned[f"b{i}"]) for i in range(2)]
    rows = machine.training_rows(frame(spark, x, y)).collect()
    held = [r for r in rows if uniform(np.array([r.row]), 42)[0] < 0.3]
    logits = forward(weights, np.array([r.x for r in held]), [None, None])[0]
    assert loss_of(logits, np.array([r.y for r in held])).mean() == pytest.approx(history[best, 1])


def test_awkward_rows(spark):
    one = frame(spark, np.ones((1, 2)), np.ones(1))
    assert DenseClassifier(labelCol="label", hidden=[4], dropout=[0.5], epochs=2).fit(one).transform(one).count() == 1
    with pytest.raises(ValueError, match="no training rows"):
        DenseClassifier(labelCol="label").fit(one.where("id > 5"))
    with pytest.raises(ValueError, match="hidden layer"):
        DenseClassifier(labelCol="label", hidden=[4]).fit(one)
