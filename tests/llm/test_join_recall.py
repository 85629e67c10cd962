"""The n-gram Jaccard join on thousands of pairs just above the threshold, apart and over a passage that all texts share."""

import numpy as np
import pytest

from coinbrook.llm import jaccard

PAIRS = 1500


def pairs(n: int, shared: int, seed: int) -> list[tuple[int, str]]:
    """Texts 2k and 2k + 1 with similarity 0.80 to 0.85: the second has 8 to 11 of 100 shingles of its own; ``shared`` words start every text."""
    rng = np.random.default_rng(seed)
    start = [f"w{i}" for i in range(shared)]
    out = []
    for k in range(n):
        own = start + [f"p{x}" for x in rng.integers(0, 1 << 40, 104 - shared)]
        cut = int(rng.integers(8, 12))
        out += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[:-cut] + [f"q{x}" for x in rng.integers(0, 1 << 40, cut)]))]
    return out


@pytest.mark.parametrize("shared", [0, 44])
def test_recall_near_the_threshold(spark, shared):
    """Buckets of 32 members, so that with a shared passage (40 shingles of 100) they part over several levels."""
    df = spark.createDataFrame(pairs(PAIRS, shared, 7 + shared), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(df, bucket=32).collect()}
    assert len(got) == 2 * PAIRS and all(c in (d, d - 1) and (n == 1) == (got[d ^ 1][0] == c) for d, (c, n) in got.items())
    found = sum(got[2 * k + 1] == (2 * k, 1) for k in range(PAIRS))
    print(f"shared {shared}: {found} of {PAIRS}")
    assert found >= 0.998 * PAIRS
