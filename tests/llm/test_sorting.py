"""External induced sorting against plain sorting."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import induced


def check(raw: bytes, depth: int, memory: int) -> None:
    text = np.frombuffer(raw, np.uint8).astype(np.uint16) + 1
    blocks = list(induced.suffixes(text, depth, memory=memory))
    position = np.concatenate([b[0] for b in blocks]) if blocks else np.zeros(0, int)
    common = np.concatenate([b[1] for b in blocks]) if blocks else np.zeros(0, int)
    assert sorted(position.tolist()) == list(range(len(raw)))
    cut = [raw[p : p + depth] for p in position]
    assert cut == sorted(cut)
    for k in range(1, len(cut)):
        same = next((i for i, (a, b) in enumerate(zip(cut[k - 1], cut[k], strict=False)) if a != b), min(len(cut[k - 1]), len(cut[k])))
        assert common[k] == same


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=80).map(lambda b: bytes(97 + x % 3 for x in b)), st.sampled_from([3, 7, 255]), st.sampled_from([2, 1000]))
def test_order_and_common_prefixes(raw, depth, memory):
    check(raw, depth, memory)


def test_runs_and_repeats():
    check(b"a" * 300, 100, 50)
    check(b"abcab" * 60, 100, 1000)
    check(bytes(range(256)) * 2, 255, 100)
