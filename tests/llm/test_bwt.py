import random
from collections import Counter

import pytest

from trellis.llm import bwt


@pytest.mark.parametrize(("letters", "depth", "seed"), [(b"ab", 7, 1), (b"abcd", 4, 2), (b"a", 5, 3), (bytes(range(256)), 3, 4)])
def test_against_brute_force(letters, depth, seed):
    rng = random.Random(seed)
    shards = [[bytes(rng.choices(letters, k=rng.randrange(30))) for _ in range(rng.randrange(1, 8))] for _ in range(3)]
    shards[0].append(shards[1][0])
    seen = Counter(s[i : i + depth] for group in shards for s in group for i in range(len(s) - depth + 1))
    want = [[{i for i in range(len(s) - depth + 1) if seen[s[i : i + depth]] > 1} for s in group] for group in shards]
    assert bwt.repeated_starts(shards, depth) == want
