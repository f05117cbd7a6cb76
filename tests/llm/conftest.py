import random

import pytest

WORDS = "the budget register was reviewed by committee after weekly meeting because insulation vendor delivered quarterly archive items and every transcript measured local conveyor despite temporary curriculum".split()


@pytest.fixture
def prose():
    def make(n: int, seed: int) -> str:
        rng = random.Random(seed)
        out = []
        while sum(map(len, out)) + len(out) < n:
            out.append(rng.choice(WORDS) + (str(rng.randint(0, 99999)) if rng.random() < 0.2 else ""))
        return " ".join(out)[:n]

    return make
