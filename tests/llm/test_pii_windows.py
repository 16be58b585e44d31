"""Spans are those of a decoding of all windows, wherever the signs are."""

import numpy as np
import pytest

from normscope.llm import pii


class AllEmail:
    """Tags everything but line breaks as one e-mail address."""

    def decode(self, x):
        return np.where((x == pii.BREAK) | (x == pii.PAD), 0, pii.TAGS.index("I-email")).astype(np.int8), np.zeros(len(x))


def every_window(model, text):
    x, side = pii.shapes(text), (pii.WINDOW - pii.STRIDE) // 2
    tags = np.zeros(x.size, np.int8)
    for s in range(-pii.STRIDE, x.size + pii.STRIDE, pii.STRIDE):
        part = np.zeros((1, pii.WINDOW), np.uint8)
        a, b = max(0, s), min(x.size, s + pii.WINDOW)
        if a < b:
            part[0, a - s : b - s] = x[a:b]
        best = model.decode(part)[0][0]
        a, b = max(0, s + side), min(x.size, s + side + pii.STRIDE)
        if a < b:
            tags[a:b] = best[a - s : b - s]
    return [s for s in pii._tagged(tags) if pii._may_add(text, *s)]


@pytest.mark.parametrize("before", [0, 5, 23, 24, 25, 47, 48, 100])
def test_long_spans_are_whole(before):
    piece = "n" * 200 + " @ example.org" + "x" * 90
    text = "w" * before + "\n" + piece + "\n" + "no sign here " * 9
    assert pii.network_spans(AllEmail(), [text, "", "1"])[0] == [("email", before + 1, before + 1 + len(piece))] == every_window(AllEmail(), text)


def test_same_as_every_window():
    model = pii.standard_model()
    texts = ["plain words in a row " * 20 + t + " and so on" * 20 for t, _ in pii.labelled_examples(30, seed=5)]
    assert pii.network_spans(model, texts) == [every_window(model, t) for t in texts]
