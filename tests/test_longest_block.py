"""The longest common block as difflib finds it, in few searches."""

import random
import time
from difflib import SequenceMatcher

from paperloom.operators.audit import longest_block


def test_equal_to_difflib():
    draw = random.Random(5)
    for n in range(4000):
        letters = "ab" if n % 3 else "abcdefé "
        s, q = ("".join(draw.choices(letters, k=draw.randrange(40))) for _ in range(2))
        if n % 100 == 0:
            q = q * 12
        block = SequenceMatcher(None, s, q).find_longest_match(0, len(s), 0, len(q))
        assert longest_block(s, q)[1] == block.size and (not block.size or longest_block(s, q)[0] == block.a), (s, q)


def test_long_source():
    draw = random.Random(6)
    s, q = ("".join(draw.choices("etaoin shrdlu", k=k)) for k in (300_000, 80))
    start = time.process_time()
    found = longest_block(s, q)
    seconds = time.process_time() - start
    start = time.process_time()
    block = SequenceMatcher(None, s, q).find_longest_match(0, len(s), 0, len(q))
    assert found == (block.a, block.size) and seconds * 4 < time.process_time() - start
