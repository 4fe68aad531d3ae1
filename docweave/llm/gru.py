"""A small bidirectional gated recurrent network with attention pooling, in numpy.

The network reads segments: `core` words with `warm` words of context on either side, so a state knows what surrounds its
word, and each word gets one attention score and one value. A window's logit pools the values of its words by their scores.
Sums over neighbouring words give those of all windows, whatever their number, after one reading of the text.

Inputs are words. A word's vector joins a learned embedding of the hashed word with a learned
embedding of its hashed byte n-grams, so stems are recognised under endings never seen. Both
tables start from shrunken log-odds of the training texts in their first column, which gives the
first round of window choice something to go by.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from docweave.llm import ngrams

ORDERS = (3, 4, 5)
MARKS = b'.,;:!?"()[]{}#*$%&|<>'


@dataclass(frozen=True)
class GruShape:
    bits: int = 16
    word_dim: int = 4
    char_dim: int = 6
    hidden: int = 8
    attend: int = 8
    window: int = 16
    warm: int = 8
    core: int = 48


class Vocabulary:
    """Distinct words of some texts: word slots, and byte n-gram slots in rows of varying length."""

    def __init__(self, words: list[bytes], bits: int):
        self.word = ngrams.fold(ngrams.word_hashes(words), 0, bits) if words else np.empty(0, np.uint32)
        data = b"".join(b"^" + w + b"$" for w in words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(words)), sizes)
        slots, owners = [], []
        for k, n in enumerate(ORDERS):
            h = ngrams.byte_ngrams(data, min(n, 4))
            if n == 5 and len(data) >= 5:
                b = np.frombuffer(data, np.uint8)
                h = h[: len(data) - 4] * np.uint32(16777619) + b[4:]
            elif n == 5:
                h = np.empty(0, np.uint32)
            at = np.arange(len(h))
            inside = at + n <= ends[owner[: len(h)]]
            slots.append(ngrams.fold(h[inside], k, bits))
            owners.append(owner[: len(h)][inside])
        slot, own = np.concatenate(slots), np.concatenate(owners)
        order = np.argsort(own, kind="stable")
        self.gram, self.gram_word = slot[order], own[order]
        self.counts = np.bincount(own, minlength=len(words))
        self.scale = (1 / np.sqrt(np.maximum(self.counts, 1))).astype(np.float32)

    def vectors(self, words: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Input vectors of the words."""
        out = np.zeros((len(self.word), words.shape[1] + chars.shape[1]), np.float32)
        out[:, : words.shape[1]] = words[self.word]
        if len(self.gram):
            some = self.counts > 0
            starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]])[some]
            out[some, words.shape[1] :] = np.add.reduceat(chars[self.gram], starts) * self.scale[some, None]
        return out


def split_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, MARKS).split()


def segments(ids: np.ndarray, pad: int, shape: GruShape) -> np.ndarray:
    """Rows of word numbers, each a core of the text between its context."""
    starts = np.arange(0, len(ids), shape.core)
    padded = np.concatenate([np.full(shape.warm, pad, ids.dtype), ids, np.full(shape.core + shape.warm, pad, ids.dtype)])
    return padded[starts[:, None] + np.arange(shape.core + 2 * shape.warm)]


def around(ids: np.ndarray, start: int, pad: int, shape: GruShape) -> np.ndarray:
    """A window's word numbers between its context."""
    row = np.full(shape.window + 2 * shape.warm, pad, ids.dtype)
    low, high = max(start - shape.warm, 0), min(start + shape.window + shape.warm, len(ids))
    row[low - start + shape.warm : high - start + shape.warm] = ids[low:high]
    return row


def pooled(scores: np.ndarray, values: np.ndarray, window: int) -> np.ndarray:
    """Attention-weighted mean value of every window of a text's words; a shorter text is one window."""
    e = np.exp(scores.astype(np.float64) - scores.max())
    if len(e) <= window:
        return np.array([(e * values).sum() / e.sum()])
    view = np.lib.stride_tricks.sliding_window_view
    return (view(e * values, window).sum(1)) / view(e, window).sum(1)


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Net:
    """Parameters and passes. p: name -> array; f and b mark the directions."""

    def __init__(self, shape: GruShape, seed: int = 3):
        self.shape = s = shape
        rng = np.random.default_rng(seed)
        d, h = s.word_dim + s.char_dim, s.hidden

        def init(*dims: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(dims[0]), dims).astype(np.float32)

        self.p = {f"{k}_{way}": v for way in "fb" for k, v in (("Wx", init(d, 3 * h)), ("U", init(h, 3 * h)), ("bx", np.zeros(3 * h, np.float32)))}
        self.p |= {"Wa": init(2 * h, s.attend), "v": init(s.attend), "w": init(2 * h), "b": np.zeros(1, np.float32)}
        self.words = rng.normal(0, 0.05, (1 << s.bits, s.word_dim)).astype(np.float32)
        self.chars = rng.normal(0, 0.05, (1 << s.bits, s.char_dim)).astype(np.float32)

    def _run(self, g: np.ndarray, mask: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        n, t, _ = g.shape
        h, u = self.shape.hidden, self.p[f"U_{way}"]
        state = np.zeros((n, h), np.float32)
        out = np.empty((n, t, h), np.float32)
        for i in range(t) if way == "f" else range(t - 1, -1, -1):
            a = state @ u
            gates = _sig(g[:, i, : 2 * h] + a[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(g[:, i, 2 * h :] + r * a[:, 2 * h :])
            m = mask[:, i, None]
            nxt = state + m * (1 - z) * (new - state)
            if keep is not None:
                keep.append((i, state, a, z, r, new, m))
            state = nxt
            out[:, i] = state
        return out

    def word_scores(self, gates: dict[str, np.ndarray], ids: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
        """Attention score and value of the core words of segments; gates: the input side of every word's gates, by direction."""
        mask = (ids != pad).astype(np.float32)
        states = np.concatenate([self._run(gates[way][ids], mask, way, None) for way in "fb"], axis=2)[:, self.shape.warm : -self.shape.warm]
        return np.tanh(states @ self.p["Wa"]) @ self.p["v"], states @ self.p["w"] + self.p["b"][0]

    def gates(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """With one row more, of zeros, for padding."""
        x = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
        return {way: x @ self.p[f"Wx_{way}"] + self.p[f"bx_{way}"] for way in "fb"}

    def gradients(self, x: np.ndarray, mask: np.ndarray, inside: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Of the mean weighted log loss over windows between their context: by parameter, and by input vector. inside: which words are the window's."""
        p, h = self.p, self.shape.hidden
        n, t, d = x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(x @ p[f"Wx_{w}"] + p[f"bx_{w}"], mask, w, kept[w]) for w in "fb"], axis=2)
        act = np.tanh(states @ p["Wa"])
        score = np.where(inside > 0, act @ p["v"], -1e9)
        alpha = np.exp(score - score.max(1, keepdims=True))
        alpha /= alpha.sum(1, keepdims=True)
        pooled = (alpha[:, :, None] * states).sum(1)
        prob = _sig(pooled @ p["w"] + p["b"][0])
        loss = float(-(weight * np.where(y > 0, np.log(prob + 1e-7), np.log(1 - prob + 1e-7))).mean())
        dl = (weight * (prob - y) / n).astype(np.float32)
        g = {"w": pooled.T @ dl, "b": np.array([dl.sum()], np.float32)}
        dpool = dl[:, None] * p["w"]
        dstates = alpha[:, :, None] * dpool[:, None, :]
        dalpha = (dpool[:, None, :] * states).sum(2)
        dscore = alpha * (dalpha - (alpha * dalpha).sum(1, keepdims=True))
        dact = dscore[:, :, None] * p["v"] * (1 - act * act)
        g["v"] = (dscore[:, :, None] * act).sum((0, 1))
        g["Wa"] = states.reshape(-1, 2 * h).T @ dact.reshape(-1, act.shape[2])
        dstates += dact @ p["Wa"].T
        dx = np.zeros_like(x)
        for way, part in (("f", dstates[:, :, :h]), ("b", dstates[:, :, h:])):
            u = p[f"U_{way}"]
            du, dg = np.zeros_like(u), np.zeros((n, t, 3 * h), np.float32)
            back = np.zeros((n, h), np.float32)
            for i, before, a, z, r, new, m in reversed(kept[way]):
                back = back + part[:, i]
                now = m * back
                dn = now * (1 - z) * (1 - new * new)
                dz = now * (before - new) * z * (1 - z)
                dr = dn * a[:, 2 * h :] * r * (1 - r)
                da = np.concatenate([dz, dr, dn * r], axis=1)
                dg[:, i] = np.concatenate([dz, dr, dn], axis=1)
                du += before.T @ da
                back = back * (1 - m) + now * z + da @ u.T
            g[f"U_{way}"] = du
            g[f"Wx_{way}"] = x.reshape(-1, d).T @ dg.reshape(-1, 3 * h)
            g[f"bx_{way}"] = dg.sum((0, 1))
            dx += dg @ p[f"Wx_{way}"].T
        return g, dx, loss


class Adam:
    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.t = rate, {}, {}, 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, d in g.items():
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * d
            self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * d * d
            p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def log_odds(slots: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """By slot, how much likelier it is in texts of label 1, shrunk where few texts have it."""
    seen = np.zeros((2, size))
    for s, label in zip(slots, y, strict=True):
        seen[label, np.unique(s)] += 1
    n0, n1 = max((y == 0).sum(), 1), max((y == 1).sum(), 1)
    raw = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    total = seen.sum(0)
    return np.clip(raw * total / (total + 15), -2, 5).astype(np.float32)
