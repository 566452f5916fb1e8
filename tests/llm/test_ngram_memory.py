"""Document counts of n-grams in a byte each."""

import numpy as np

from tracegrain.llm import ngramjoin


def test_codes_keep_the_order_of_counts():
    counts = np.concatenate((np.arange(5000), [1 << 20, 1 << 31, 1 << 40]))
    codes = ngramjoin._codes(counts)
    assert codes.dtype == np.uint8 and (np.diff(codes.astype(int)) >= 0).all() and (codes[:128] == np.arange(128)).all()
