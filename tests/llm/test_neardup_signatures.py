"""Coordinates of a signature are independent."""

import numpy as np

from earshot.llm import neardup


def test_pairs_at_the_threshold_are_not_missed():
    """10,000 pairs of 70 shared and 15 own shingles each (similarity 0.7); coordinates that share minima miss about 16 of them."""
    rng, n = np.random.default_rng(3), 10_000
    both, own = rng.integers(0, 2**63, (n, 1, 70), dtype=np.uint64), rng.integers(0, 2**63, (n, 2, 15), dtype=np.uint64)
    shingles = np.concatenate([np.repeat(both, 2, axis=1), own], axis=2)
    signature = neardup._signatures(shingles.ravel(), np.arange(2 * n + 1) * 85).reshape(n, 2, -1)
    assert ((signature[:, 0] == signature[:, 1]).sum(axis=1) < neardup.MATCHES).sum() == 0
