import numpy as np
import pytest

from trialspark.llm.gsaca import suffix_array


@pytest.mark.parametrize("seed", range(60))
def test_order_is_that_of_sorted_suffixes(seed):
    rng = np.random.default_rng(seed)
    n, letters = int(rng.integers(0, 300)), int(rng.integers(1, 5)) if seed % 3 else 256
    text = rng.integers(0, letters, n).astype(np.uint8).tobytes()
    if seed % 4 == 0:
        text = text[: n // 5] * 4 + text
    assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("text", [b"", b"a", b"aaaaaaa", b"abababab", b"banana", b"\x00\x00\xff\x00", bytes(range(255, -1, -1)), b"mississippi" * 30])
def test_known_hard_texts(text):
    assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
