"""What the driver holds while a classifier of op5 and op9 is fitted."""

import tracemalloc

import numpy as np

from quarryline.llm.pu import fit


def test_fit_holds_one_copy_of_its_rows():
    rng = np.random.default_rng(7)
    positive = (rng.random((1000, 500)) < 0.05).astype(np.float32)
    unlabelled = (rng.random((4000, 500)) < 0.05).astype(np.float32)
    given = positive.nbytes + unlabelled.nbytes
    tracemalloc.start()
    try:
        model = fit(positive, unlabelled, 0.3, steps=3)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert model.weights.shape == (500,)
    # the rows with their bias column once, not a second time for a change of type that changes nothing
    assert peak < 1.5 * given
