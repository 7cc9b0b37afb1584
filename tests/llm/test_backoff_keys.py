"""N-grams whose hashes differ in low bits only are told apart."""

import inspect

import numpy as np

from chronoloom.llm import stupid_backoff as S


def test_low_bits_count(monkeypatch):
    bits = inspect.signature(S.backoff_scores).parameters["key_bits"].default
    monkeypatch.setattr(S, "window_hashes", lambda h, n: (np.uint64(1) << np.uint64(60)) + h[n - 1 :])
    grams = S.Grams(np.array([4]), np.array([5, 6, 7], np.uint64), np.array([0, 1, 2, 0]), bits)
    assert [len(k) for k in grams.keys] == [3, 3, 2]
