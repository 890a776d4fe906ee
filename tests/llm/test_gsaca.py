import random

import numpy as np
import pytest

from pagework.llm.gsaca import common_prefixes, suffix_array


def plain(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


def cases():
    rng = random.Random(11)
    yield from ([], [0], [5], [1, 1, 1, 1], [0, 1, 0, 1, 0], [3, 2, 1, 0], [0, 1, 2, 3])
    yield list(b"mississippi")
    yield list(b"abracadabra abracadabra")
    fib = [0], [0, 1]
    for _ in range(9):
        fib = fib[1], fib[1] + fib[0]
    yield fib[1]
    for size in (2, 3, 10, 300):
        for alphabet in (1, 2, 3, 20):
            for _ in range(25):
                yield [rng.randrange(alphabet) for _ in range(rng.randint(1, size))]


def test_orders_suffixes_like_sorting():
    for text in cases():
        assert suffix_array(np.array(text, np.int64)).tolist() == plain(text), text


def test_common_prefixes():
    for text in cases():
        array = plain(text)
        wanted = [0] * len(text)
        for r in range(1, len(array)):
            a, b = text[array[r - 1] :], text[array[r] :]
            wanted[r] = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert common_prefixes(np.array(text), np.array(array, np.int64)).tolist() == wanted


@pytest.mark.parametrize("unit", [b"a", b"ab", b"aab"])
def test_periodic_text_stays_linear(unit):
    text = np.frombuffer(unit * (60000 // len(unit)), np.uint8)
    array = suffix_array(text)
    assert sorted(array.tolist()) == list(range(len(text)))
