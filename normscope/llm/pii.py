"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds what they miss.

The network reads shapes of characters (letter, capital, digit, each ASCII sign), runs an LSTM both
ways and scores tag sequences with CRF transitions; it is trained here, in numpy, from labelled spans.
A text is cut into overlapping windows; each is decoded by Viterbi, every character takes its tag
from the window in whose middle part it lies, and spans are read from that one sequence of the whole
text, so no span depends on where windows begin.

A span of any kind holds a digit or an ``@`` (else it is dropped), so decoding begins with the windows
that hold such a sign, and goes on to the next windows while the decoded part's first or last character
has a tag. A span with a sign so lies in the decoded part, as if all windows were decoded.
Added spans must also pass the checks of ``_valid`` and not touch a span of the patterns, which stay. What the network
itself says is reported beside them: its spans before those checks, which pattern spans it confirms (a span of
its own of that kind that shares four fifths of their places together), and the mean score of its best tags.

Edge cases: a null or empty text has no spans; texts of any length are read whole, in linear time;
spans of one kind that begin together can't be; repeated rows give repeated rows; an empty table gives an empty one; other columns are neither read
nor returned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, spans

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48

# ---------------------------------------------------------------- patterns

_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive, and tried only where a run of digits begins: the same matches in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then by start."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(("email", start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-20:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---------------------------------------------------------------- network

_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PAD, LOW, HIGH, DIGIT, SPACE, BREAK, OTHER = range(7)
N_SHAPES = 7 + len(_SIGNS)
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


@lru_cache(maxsize=1)
def _shape_table() -> np.ndarray:
    table = np.full(0x300, OTHER, dtype=np.uint8)
    for i in range(0x300):
        c = chr(i)
        table[i] = DIGIT if "0" <= c <= "9" else HIGH if c.isupper() else LOW if c.isalpha() else SPACE if c in " \t\xa0" else BREAK if c in "\n\r" else 7 + _SIGNS.index(c) if c in _SIGNS else OTHER
    return table


def shapes(text: str) -> np.ndarray:
    """A number for each character: which letter or digit it is doesn't matter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 0x300, _shape_table()[np.minimum(points, 0x2FF)], LOW).astype(np.uint8)


class BiLstmCrf:
    """Both directions run as one batched recurrence; direction 1 reads the window backwards."""

    def __init__(self, hidden: int = 16, seed: int = 5):
        r = np.random.default_rng(seed)
        h, t = hidden, len(TAGS)
        self.hidden = h
        self.p = {
            "x": r.normal(0, 0.3, (2, N_SHAPES, 4 * h)), "h": r.normal(0, 0.25, (2, h, 4 * h)),
            "o": r.normal(0, 0.3, (2 * h, t)), "ob": np.zeros(t), "a": np.zeros((t, t)), "s": np.zeros(t), "e": np.zeros(t),
        }
        self.p["x"][:, :, h : 2 * h] += 1.0  # remember at first
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, keep: bool):
        n, length = x.shape
        h = self.hidden
        both = np.stack([x, x[:, ::-1]])
        hs = np.zeros((length, 2, n, h), dtype=np.float32)
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        trace = []
        direction = np.arange(2)[:, None]
        for t in range(length):
            z = self.p["x"][direction, both[:, :, t]] + state @ self.p["h"]
            gates = 0.5 * np.tanh(0.5 * z[..., : 3 * h]) + 0.5
            i, f, o, g = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :], np.tanh(z[..., 3 * h :])
            before, cell = cell, f * cell + i * g
            squashed = np.tanh(cell)
            if keep:
                trace.append((state, before, i, f, o, g, squashed))
            state = o * squashed
            hs[t] = state
        features = np.concatenate([hs[:, 0], hs[::-1, 1]], axis=-1)  # (length, n, 2h)
        return features @ self.p["o"] + self.p["ob"], features, trace, both

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of windows (n, length), and the scores of these paths."""
        score = self._run(x, False)[0]
        length, n, t = score.shape
        best = score[0] + self.p["s"]
        back = np.zeros((length, n, t), dtype=np.int8)
        for k in range(1, length):
            through = best[:, :, None] + self.p["a"]
            back[k] = through.argmax(axis=1)
            best = through.max(axis=1) + score[k]
        tags = np.zeros((n, length), dtype=np.int8)
        ending = best + self.p["e"]
        tags[:, -1] = ending.argmax(axis=1)
        rows = np.arange(n)
        for k in range(length - 1, 0, -1):
            tags[:, k - 1] = back[k][rows, tags[:, k]]
        return tags, ending.max(axis=1)

    def _crf(self, score: np.ndarray, y: np.ndarray):
        """Loss and gradients of the sequence likelihood."""
        length, n, t = score.shape
        a = self.p["a"]
        up = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[0] = score[0] + self.p["s"]
        for k in range(1, length):
            alpha[k] = up(alpha[k - 1][:, :, None] + a, 1) + score[k]
        beta[-1] = self.p["e"]
        for k in range(length - 2, -1, -1):
            beta[k] = up(a + (score[k + 1] + beta[k + 1])[:, None, :], 2)
        z = up(alpha[-1] + self.p["e"], 1)
        d_score = np.exp(alpha + beta - z[None, :, None])
        d_a = np.zeros_like(a)
        for k in range(1, length):
            d_a += np.exp(alpha[k - 1][:, :, None] + a + (score[k] + beta[k])[:, None, :] - z[:, None, None]).sum(axis=0)
        d_s, d_e = d_score[0].sum(axis=0), d_score[-1].sum(axis=0)
        rows, yt = np.arange(n), y.T
        gold = self.p["s"][yt[0]] + self.p["e"][yt[-1]] + a[yt[:-1], yt[1:]].sum(axis=0)
        for k in range(length):
            gold = gold + score[k, rows, yt[k]]
            d_score[k, rows, yt[k]] -= 1
        np.add.at(d_a, (yt[:-1].ravel(), yt[1:].ravel()), -1)
        np.add.at(d_s, yt[0], -1)
        np.add.at(d_e, yt[-1], -1)
        return float((z - gold).mean()), d_score / n, d_a / n, d_s / n, d_e / n

    def gradients(self, x: np.ndarray, y: np.ndarray):
        score, features, trace, both = self._run(x, True)
        loss, d_score, d_a, d_s, d_e = self._crf(score, y)
        h = self.hidden
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["a"], g["s"], g["e"], g["ob"] = d_a, d_s, d_e, d_score.sum(axis=(0, 1))
        g["o"] = features.reshape(-1, 2 * h).T @ d_score.reshape(-1, d_score.shape[-1])
        d_features = d_score @ self.p["o"].T
        d_h = np.stack([d_features[..., :h], d_features[::-1, :, h:]], axis=1)  # (length, 2, n, h)
        d_state = np.zeros_like(d_h[0])
        d_cell = np.zeros_like(d_state)
        for t in range(len(trace) - 1, -1, -1):
            state, before, i, f, o, cand, squashed = trace[t]
            d = d_h[t] + d_state
            d_cell = d_cell + d * o * (1 - squashed**2)
            dz = np.concatenate([d_cell * cand * i * (1 - i), d_cell * before * f * (1 - f), d * squashed * o * (1 - o), d_cell * i * (1 - cand**2)], axis=-1)
            g["h"] += state.transpose(0, 2, 1) @ dz
            for k in range(2):
                np.add.at(g["x"][k], both[k, :, t], dz[k])
            d_state = dz @ self.p["h"].transpose(0, 2, 1)
            d_cell = d_cell * f
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, *, epochs: int = 8, batch: int = 96, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        r = np.random.default_rng(seed)
        m, v, step, losses = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0, []
        for epoch in range(epochs):
            order, total = r.permutation(len(x)), []
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                loss, g = self.gradients(x[rows], y[rows])
                total.append(loss)
                norm = np.sqrt(sum(float((d**2).sum()) for d in g.values()))
                step += 1
                lr = rate * (1 - epoch / epochs) ** 0.5
                for k, d in g.items():
                    d = d * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(total)))
        return losses


# ---------------------------------------------------------------- labelled spans


def _invented(r: np.random.Generator, kind: str) -> str:
    """One piece of personal data in one of its usual forms."""
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    w = lambda a=2, b=9: "".join(chr(97 + c) for c in r.integers(0, 26, r.integers(a, b)))
    pick = lambda *x: x[int(r.integers(len(x)))]
    if kind == "email":
        local = pick(w(), w() + "." + w(), w() + d(2), w()[0] + "_" + w(), w() + "." + d(2), w() + "+" + w(), w().capitalize() + "." + w().capitalize())
        return local + pick("@", "@", "@", "@", " @ ", "(at)@") + pick(w(), w() + d(1), w() + "-" + w()) + "." + pick(w(2, 4), w() + "." + w(2, 4))
    if kind == "ip":
        sep = pick(".", ".", ".", ".", " . ", "[.]")
        return sep.join(str(int(x)) for x in r.integers(1, 256, 4))
    if kind == "card":
        digits = pick("4", "5", "37", "6011") + d(12)
        digits = digits[: pick(13, 16, 16, 16) - 1]
        digits += next(c for c in "0123456789" if luhn(digits + c))
        sep = pick("", "", " ", "-", ".", "/", "_")
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, sep = d(3), pick(" ", "-", ".")
    national = pick(f"({area}) {d(3)}-{d(4)}", f"{area}{sep}{d(3)}{sep}{d(4)}", f"0{d(2)}{sep}{d(3)}{sep}{d(2)}{sep}{d(2)}", f"0{d(3)}/{d(6)}", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}")
    return pick("+", "+", "00", "") + pick("", f"{d(2)} ", f"{d(1)} ", f"{d(2)}-") + national


def _ordinary(r: np.random.Generator) -> str:
    """A number or name that is nobody's data."""
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    n = lambda a, b: str(int(r.integers(a, b)))
    hexa = lambda k: "".join("0123456789abcdef"[c] for c in r.integers(0, 16, k))
    options = (
        n(1900, 2100), n(1, 1000), f"{n(1, 13)}/{n(1, 29)}/{n(1900, 2100)}", f"{n(1900, 2100)}-0{n(1, 10)}-{n(10, 29)}", f"{n(0, 24)}:{n(10, 60)}:{n(10, 60)}",
        f"{n(1, 100)}.{d(2)}", f"v{n(0, 9)}.{n(0, 20)}.{n(0, 9)}", f"{n(1, 999)},{d(3)},{d(3)}", f"${n(1, 999)}.{d(2)}", f"{n(1, 100)}%", d(int(r.integers(5, 26))),
        f'token = "{hexa(32)}"', hexa(40), f"@name{n(1, 99)}", f"#{n(1, 9999)}", f"{n(1, 99)}({n(1, 9)}):{n(100, 200)}-{n(200, 300)}", f"https://www.site.example/{n(1, 999)}", f"C{n(1, 99)}H{n(1, 99)}",
        f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{n(10, 20)}x{n(10, 20)}", f"{d(2)} {d(2)} {d(3)} {d(3)} {d(4)} {d(5)}",
    )
    return options[int(r.integers(len(options)))]


def labelled_examples(n: int, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts of invented words with invented data in them and its spans: the network sees shapes only,
    so the words' language doesn't matter."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        text, found = "", []
        while len(text) < WINDOW + 40:
            word = "".join(chr(97 + c) for c in r.integers(0, 26, r.integers(1, 11)))
            roll = r.random()
            if roll < 0.13:
                kind = KINDS[int(r.integers(len(KINDS)))]
                piece = _invented(r, kind)
                found.append((kind, len(text), len(text) + len(piece)))
                text += piece
            elif roll < 0.24:
                text += _ordinary(r)
            else:
                text += word.upper() if roll > 0.97 else word.capitalize() if roll > 0.85 else word
            text += ", " if (roll2 := r.random()) < 0.08 else ". " if roll2 < 0.14 else ".\n" if roll2 < 0.17 else "*** " if roll2 < 0.19 else ": " if roll2 < 0.21 else " | " if roll2 < 0.23 else " "
        out.append((text, found))
    return out


def training_windows(examples: list[tuple[str, list[tuple[str, int, int]]]], seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """A window at a random place of each text, and its tags."""
    r = np.random.default_rng(seed)
    x, y = np.zeros((len(examples), WINDOW), np.uint8), np.zeros((len(examples), WINDOW), np.int64)
    for k, (text, found) in enumerate(examples):
        tags = np.zeros(len(text), np.int64)
        for kind, a, b in found:
            tags[a:b] = TAGS.index(f"I-{kind}")
            tags[a] = TAGS.index(f"B-{kind}")
        at = int(r.integers(0, max(1, len(text) - WINDOW + 1)))
        part = shapes(text)[at : at + WINDOW]
        x[k, : part.size], y[k, : part.size] = part, tags[at : at + WINDOW]
    return x, y


def train(examples: list[tuple[str, list[tuple[str, int, int]]]], **fit: object) -> BiLstmCrf:
    model = BiLstmCrf()
    model.fit(*training_windows(examples), **fit)
    return model


@lru_cache(maxsize=1)
def standard_model() -> BiLstmCrf:
    """Trained from the invented examples, the same in every process."""
    return train(labelled_examples(1600))


# ---------------------------------------------------------------- whole texts


def _valid(kind: str, piece: str) -> bool:
    """Whether an added span can be what it says."""
    digits = _digits(piece)
    if kind == "email":
        return "@" in piece.strip("@ ") and "." in piece.partition("@")[2] and len(piece) <= 320
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        parts = [p for p in re.split(r"[^0-9]+", piece) if p]
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and "." in piece
    grouped = re.split(r"[^0-9]+", piece.strip("+() "))
    return 9 <= len(digits) <= 15 and len(grouped) >= 3 and max(map(len, grouped)) <= 6 and not re.fullmatch(r"(?:97[89][ -])?[0-9]+-[0-9]+-[0-9]+-[0-9Xx]", piece)


def network_tags(model: BiLstmCrf, texts: list[str], block: int = 256, *, every: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """Tags of whole texts, from windows' middle parts: those with signs, and those that spans reach from there (or
    ``every`` window); and each text's mean score of its decoded windows, a character, 0 for none."""
    coded = [shapes(t) for t in texts]
    side = (WINDOW - STRIDE) // 2
    # window s gives the tags from STRIDE * s - side, STRIDE of them
    held = [np.zeros((x.size + side - 1) // STRIDE + 1 if x.size else 0, bool) for x in coded]
    where: list[tuple[int, int]] = []
    for k, x in enumerate(coded):
        sign = np.flatnonzero((x == DIGIT) | (x == 7 + _SIGNS.index("@")))
        # windows start at multiples of STRIDE, one STRIDE before the text at first
        first = (sign - WINDOW + 1 + STRIDE + STRIDE - 1) // STRIDE
        last = (sign + STRIDE) // STRIDE
        starts = np.unique(np.concatenate([first + j for j in range(int((last - first).max(initial=-1)) + 1)])) if sign.size else []
        where += [(k, s) for s in range(held[k].size)] if every else [(k, int(s)) for s in starts if 0 <= s < held[k].size]
    tags = [np.zeros(x.size, np.int8) for x in coded]
    total, windows = np.zeros(len(texts)), np.zeros(len(texts))
    step = 1
    while where:
        for at in range(0, len(where), block):
            part = [(k, (s - 1) * STRIDE) for k, s in where[at : at + block]]
            x = np.zeros((len(part), WINDOW), np.uint8)
            for row, (k, s) in enumerate(part):
                a, b = max(0, s), min(coded[k].size, s + WINDOW)
                if a < b:
                    x[row, a - s : b - s] = coded[k][a:b]
            best, path = model.decode(x)
            of = [k for k, _ in part]
            np.add.at(total, of, path)
            np.add.at(windows, of, WINDOW)
            for row, (k, s) in enumerate(part):
                a, b = max(0, s + side), min(coded[k].size, s + side + STRIDE)
                if a < b:
                    tags[k][a:b] = best[row, a - s : b - s]
        for k, s in where:
            held[k][s] = True
        where = [(k, s) for k in sorted({k for k, _ in where}) for s in _reached(held[k], tags[k], step)]
        step *= 2  # so that a long span takes few rounds
    return tags, total / np.maximum(windows, 1)


def network_spans(model: BiLstmCrf, texts: list[str], *, every: bool = False) -> list[list[tuple[str, int, int]]]:
    """The network's spans that can be what they say."""
    tags, _ = network_tags(model, texts, every=every)
    return [[s for s in _tagged(t) if _may_add(text, *s)] for t, text in zip(tags, texts, strict=True)]


def _reached(held: np.ndarray, tags: np.ndarray, step: int) -> list[int]:
    """The windows, up to ``step`` a side, beside decoded ones whose outermost character there has a tag."""
    side = (WINDOW - STRIDE) // 2
    begins = np.flatnonzero(held[1:] & ~held[:-1]) + 1
    ends = np.flatnonzero(held[:-1] & ~held[1:])
    out: set[int] = set()
    for s in begins[tags[begins * STRIDE - side] > 0].tolist():
        out.update(range(max(0, s - step), s))
    for s in ends[tags[(ends + 1) * STRIDE - side - 1] > 0].tolist():
        out.update(range(s + 1, min(held.size, s + 1 + step)))
    return sorted(s for s in out if not held[s])


def _tagged(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Runs of one kind: a tag, then inner tags of its kind."""
    out, at = [], np.flatnonzero(tags)
    k = 0
    while k < at.size:
        start = int(at[k])
        kind = (int(tags[start]) - 1) // 2
        end = start + 1
        while end < tags.size and tags[end] == 2 * kind + 2:
            end += 1
        out.append((KINDS[kind], start, end))
        k = int(np.searchsorted(at, end))
    return out


def _may_add(text: str, kind: str, start: int, end: int) -> bool:
    piece = text[start:end]
    return ("@" in piece or bool(_digits(piece))) and _valid(kind, piece)


@dataclass(frozen=True)
class Finding:
    """``spans``: (kind, start, end, added, confirmed) by kind, then start; ``network``: its own spans as they are."""

    spans: list[tuple[str, int, int, bool, bool]]
    network: list[tuple[str, int, int]]
    score: float


def examine(model: BiLstmCrf, texts: list[str]) -> list[Finding]:
    out = []
    tags, scores = network_tags(model, texts)
    for text, own_tags, score in zip(texts, tags, scores.tolist(), strict=True):
        fixed, own = pattern_spans(text), _tagged(own_tags)
        free = [s for s in own if _may_add(text, *s) and not any(s[1] < b and a < s[2] for _, a, b in fixed)]
        alike = lambda x, y: x[0] == y[0] and 5 * (min(x[2], y[2]) - max(x[1], y[1])) >= 4 * (max(x[2], y[2]) - min(x[1], y[1]))
        found = [(*s, False, any(alike(s, n) for n in own)) for s in fixed] + [(*s, True, True) for s in free]
        out.append(Finding(sorted(found, key=lambda s: (KINDS.index(s[0]), s[1])), own, score))
    return out


def find(model: BiLstmCrf, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, added) of each text, by kind, then start."""
    return [[s[:4] for s in x.spans] for x in examine(model, texts)]


def redact(text: str, found: list[tuple[str, int, int, bool]]) -> str:
    """The text with every span, or run of overlapping spans, as its first kind in brackets."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b, _ in sorted(found, key=lambda s: (s[1], s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:long,end:long,added:boolean,confirmed:boolean>>"
NETWORK = "array<struct<kind:string,start:long,end:long>>"


def detect(df: DataFrame, id_col: str, text_col: str, *, model: BiLstmCrf | None = None) -> DataFrame:
    """(id, spans, network, score) of every row. ``network`` and ``score`` are the network's own word on what it decodes: the windows that hold
    a digit or ``@``, and on from there. They are null for a text without such a window, which it doesn't decode: no span of it could hold."""
    model = model or standard_model()
    weights = df.sparkSession.sparkContext.broadcast((model.hidden, model.p))  # some 100 KB

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        net = BiLstmCrf(weights.value[0])
        net.p = weights.value[1]
        text = batch.column(1)
        raw, at = spans.blob(text)
        may = np.flatnonzero(spans.per_text(((raw >= 0x30) & (raw <= 0x39)) | (raw == 0x40), at))
        listed: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        network: list[list[dict] | None] = [None] * batch.num_rows
        score: list[float | None] = [None] * batch.num_rows
        names = ("kind", "start", "end", "added", "confirmed")
        for i, x in zip(may.tolist(), examine(net, text.take(pa.array(may)).to_pylist()), strict=True):
            listed[i] = [dict(zip(names, s, strict=True)) for s in x.spans]
            network[i] = [dict(zip(names[:3], s, strict=True)) for s in x.network]
            score[i] = x.score
        return {"id": batch.column(0), "spans": listed, "network": network, "score": score}

    return base.map_arrow(
        df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), rows, f"id long, spans {SPANS}, network {NETWORK}, score double", max_bytes=1 << 20
    )


def redacted(df: DataFrame, text_col: str = "text", *, model: BiLstmCrf | None = None) -> DataFrame:
    """``df`` with all spans of its texts redacted; other columns and null texts as they are."""
    from pyspark.sql.pandas.types import to_arrow_schema

    model = model or standard_model()
    weights = df.sparkSession.sparkContext.broadcast((model.hidden, model.p))  # some 100 KB
    at, schema = df.columns.index(text_col), df.schema

    def run(batches):
        net = BiLstmCrf(weights.value[0])
        net.p = weights.value[1]
        arrow = to_arrow_schema(schema)
        for whole in batches:
            for batch in base.cut(whole, 1 << 20):
                text = batch.column(at)
                raw, place = spans.blob(text)
                may = np.flatnonzero(spans.per_text(((raw >= 0x30) & (raw <= 0x39)) | (raw == 0x40), place))
                columns = [c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=True)]
                if may.size:
                    texts = text.to_pylist()
                    some = [texts[i] for i in may.tolist()]
                    for i, t, s in zip(may.tolist(), some, find(net, some), strict=True):
                        texts[i] = redact(t, s) if s else t
                    columns[at] = pa.array(texts, arrow.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)
