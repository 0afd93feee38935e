"""The suffix sorter on short texts, with queues that spill at once."""

import random
from collections import Counter

import numpy as np
import pytest

from loomline.llm import induced


@pytest.mark.parametrize("in_memory", [1, 7, 10_000])
@pytest.mark.parametrize("chunk", [2, 1 << 18])
def test_order_and_repeats(in_memory, chunk, monkeypatch, tmp_path):
    cap = 6
    monkeypatch.setattr(induced, "CAP", cap)
    monkeypatch.setattr(induced, "CHUNK", chunk)
    r = random.Random(in_memory + chunk)
    for _ in range(200):
        kinds = r.choice([1, 2, 3, 9])
        text = [r.randint(1, kinds) for _ in range(r.randint(1, 90))]
        text += text[: r.randint(0, len(text))] if r.random() < 0.5 else []
        text.append(0)
        array = np.array(text, np.uint16)
        order = induced.suffix_array(array, kinds + 1, str(tmp_path), in_memory).tolist()
        assert sorted(order) == list(range(len(text)))
        keys = [text[i : i + cap] for i in order]
        assert keys == sorted(keys)
        counts = Counter(tuple(text[i : i + cap]) for i in range(len(text) - cap + 1))
        want = [i + cap <= len(text) and counts[tuple(text[i : i + cap])] > 1 for i in range(len(text))]
        assert induced.repeated_starts(array, kinds + 1, in_memory).tolist() == want


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_star_positions(block):
    r = random.Random(block)
    for _ in range(300):
        text = [r.randint(1, 3) for _ in range(r.randint(0, 30))] + [0]
        small = [False] * len(text)
        small[-1] = True
        for i in range(len(text) - 2, -1, -1):
            small[i] = text[i] < text[i + 1] or (text[i] == text[i + 1] and small[i + 1])
        want = [i for i in range(1, len(text)) if small[i] and not small[i - 1]]
        if len(text) == 1:
            want = [0]
        assert induced.star_positions(np.array(text, np.uint16), block).tolist() == want
