import random

import pytest


@pytest.fixture
def words_of():
    """Reproducible word lists."""

    def made(seed, n, size=400):
        r = random.Random(seed)
        return [f"w{r.randrange(size)}" for _ in range(n)]

    return made
