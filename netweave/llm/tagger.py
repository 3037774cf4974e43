"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Characters map to a fixed number of codes; each direction's LSTM reads them, a linear layer scores the tags of every
character, and a CRF weighs tag sequences. Training is plain BPTT with Adam on labelled texts of ``Spans``; the number
of texts, epochs and the seed are parameters, and nothing depends on the corpus.

Decoding cuts a text into overlapping windows, decodes each, and takes every character's tag from the window in whose
middle it lies deepest; spans are then read off the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from netweave.llm.pii_spans import KINDS, Spans

TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
CODES, EMBED, HIDDEN = 420, 24, 48
WINDOW, OVERLAP = 256, 64
#: The bound on training: labelled texts and passes over them.
TEXTS, EPOCHS, BATCH, RATE = 28_000, 4, 40, 0.012
#: Added to the score of every tag that begins an item, after training: more recall for a little precision. Chosen on
#: texts of pii_words.HELD (0.957 and 0.886 without, 0.956 and 0.891 with it).
LEAN = 0.5


def codes(text: str) -> np.ndarray:
    """One code per character: digits share one, Latin and Cyrillic letters keep theirs, others fall into classes."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.full(len(c), 1)
    ascii_ = (c >= 32) & (c < 127)
    out[ascii_] = c[ascii_] - 32 + 8
    latin = (c >= 0xC0) & (c < 0x180)
    out[latin] = 104 + (c[latin] - 0xC0) % 64 + 64 * (c[latin] >= 0x100)
    cyrillic = (c >= 0x400) & (c < 0x460)
    out[cyrillic] = 232 + c[cyrillic] - 0x400
    han = (c >= 0x3400) & (c < 0xA000)
    out[han] = 330 + (c[han] * 2654435761 % 4294967296) % 80
    out[((c >= 48) & (c < 58)) | ((c >= 0xFF10) & (c < 0xFF1A))] = 2
    out[(c < 32) | (c == 0xA0) | (c == 0x3000)] = 3
    out[(c >= 0x2010) & (c <= 0x2015)] = 4
    out[(c >= 0x3000) & (c < 0x3040) | ((c >= 0xFF00) & (c < 0xFF10)) | ((c >= 0xFF1A) & (c < 0xFF20))] = 5
    out[(c >= 0x2000) & (c < 0x2010)] = 6
    return out


def labels(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for s, e, kind in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[s], out[s + 1 : e] = k, k + 1
    return out


@dataclass
class Model:
    """Weights; W, U and b have leading axes for the gates (in, forget, out, new) and the directions (forward, backward).

    So every gate is a contiguous block, and one product serves all.
    """

    p: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int) -> Model:
        r = np.random.default_rng(seed)
        k = len(TAGS)
        p = {
            "E": r.normal(0, 0.1, (CODES, EMBED)), "W": r.normal(0, EMBED**-0.5, (4, 2, EMBED, HIDDEN)), "U": r.normal(0, HIDDEN**-0.5, (4, 2, HIDDEN, HIDDEN)),
            "b": np.array([0.0, 1.0, 0.0, 0.0])[:, None, None] + np.zeros((4, 2, HIDDEN)), "V": r.normal(0, (2 * HIDDEN) ** -0.5, (2 * HIDDEN, k)), "c": np.zeros(k), "T": r.normal(0, 0.1, (k, k)),
        }
        return Model({n: v.astype(np.float32) for n, v in p.items()})

    def _hidden(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (T, 2, B, H); x (T, 2, B) holds each direction's codes in reading order.

        The gates i, f, o are sigmoids, taken as tanh of half their input, so that one tanh serves all four.
        """
        steps, _, batch = x.shape
        half = np.array([0.5, 0.5, 0.5, 1.0], np.float32)[:, None, None, None]
        table = ((self.p["E"] @ self.p["W"] + self.p["b"][:, :, None]) * half).reshape(4, 2 * CODES, HIDDEN)
        u, rows = self.p["U"] * half, x + np.array([0, CODES])[None, :, None]
        h = c = np.zeros((2, batch, HIDDEN), np.float32)
        out, z, read = np.empty((steps, 2, batch, HIDDEN), np.float32), np.empty((4, 2, batch, HIDDEN), np.float32), np.empty((4, 2, batch, HIDDEN), np.float32)
        for t in range(steps):
            if keep is not None:
                z = np.empty_like(z)
            np.matmul(h, u, out=z)
            np.take(table, rows[t], axis=1, out=read, mode="clip")
            z += read
            np.tanh(z, out=z)
            z[:3] *= 0.5
            z[:3] += 0.5
            before, c = c, z[1] * c
            c += z[0] * z[3]
            e = np.tanh(c)
            if keep is not None:
                keep.append((z, before, e, h))
            h = np.multiply(z[2], e, out=out[t])
        return out

    def scores(self, x: np.ndarray, sizes: np.ndarray, keep: list | None = None):
        """Tag scores (T, B, K) of padded codes x (T, B), the hidden states, both ways' codes, and the place of each step read backward."""
        at = np.arange(len(x))[:, None]
        turn, cols = np.where(at < sizes, sizes - 1 - at, at), np.arange(x.shape[1])
        ways = np.stack([x, x[turn, cols]], axis=1)
        h = self._hidden(ways, keep)
        both = np.concatenate([h[:, 0], h[:, 1][turn, cols]], axis=2)
        return both @ self.p["V"] + self.p["c"], both, ways, (turn, cols)

    def decode(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each coded text, by Viterbi."""
        sizes = np.array([len(t) for t in texts])
        x = np.zeros((sizes.max(), len(texts)), np.int64)
        for b, t in enumerate(texts):
            x[: len(t), b] = t
        # tags before texts, so that the maximum over tags runs along contiguous rows of texts
        s = np.ascontiguousarray(self.scores(x, sizes)[0].transpose(0, 2, 1))
        trans, best = self.p["T"][:, :, None], np.empty_like(s)
        best[0] = s[0]
        for t in range(1, len(x)):
            np.max(best[t - 1][:, None] + trans, axis=0, out=best[t])
            best[t] += s[t]
        out, cols = np.zeros(x.shape, np.int8), np.arange(len(texts))
        tag = best[sizes - 1, :, cols].argmax(1)
        for t in range(len(x) - 1, -1, -1):
            inside = t < sizes
            out[t] = np.where(inside, tag, 0)
            if t:
                tag = np.where(inside, (best[t - 1] + self.p["T"][:, tag]).argmax(0), tag)
        return [out[:n, b] for b, n in enumerate(sizes)]

    def gradient(self, texts: list[np.ndarray], tags: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood per text and its gradient."""
        sizes = np.array([len(t) for t in texts])
        steps, batch, k = sizes.max(), len(texts), len(TAGS)
        x, y = np.zeros((steps, batch), np.int64), np.zeros((steps, batch), np.int64)
        for b, (t, g) in enumerate(zip(texts, tags)):
            x[: len(t), b], y[: len(t), b] = t, g
        kept: list = []
        s, both, ways, (turn, cols) = self.scores(x, sizes, kept)
        inside = np.arange(steps)[:, None] < sizes
        trans = self.p["T"]
        # forward and backward sums, scaled to one at every step; beyond a text's end nothing changes
        top = s.max(2, keepdims=True)
        es, et = np.exp(s - top), np.exp(trans)
        alpha, beta, scale = np.empty_like(es), np.ones_like(es), np.ones((steps, batch, 1), np.float32)
        for t in range(steps):
            a = es[t] if t == 0 else (alpha[t - 1] @ et) * es[t]
            scale[t] = np.where(inside[t][:, None], a.sum(1, keepdims=True), 1.0)
            alpha[t] = np.where(inside[t][:, None], a / scale[t], alpha[t - 1])
        reach = np.empty_like(es)
        for t in range(steps - 1, 0, -1):
            reach[t] = np.where(inside[t][:, None], es[t] * beta[t] / scale[t], 0.0)
            beta[t - 1] = np.where(inside[t][:, None], reach[t] @ et.T, 1.0)
        total = float((np.log(scale[..., 0].astype(np.float64)) + top[..., 0])[inside].sum())
        ds = alpha * beta * inside[..., None]
        dt = et * (alpha[:-1].reshape(-1, k).T @ reach[1:].reshape(-1, k))
        rows, pairs = np.arange(steps)[:, None], inside[1:]
        gold = float((s[rows, cols, y] * inside).sum() + (trans[y[:-1], y[1:]] * pairs).sum())
        ds[rows, cols, y] -= inside
        np.subtract.at(dt, (y[:-1][pairs], y[1:][pairs]), 1.0)
        ds /= batch
        g = {"T": dt / batch, "V": both.reshape(-1, 2 * HIDDEN).T @ ds.reshape(-1, k), "c": ds.sum((0, 1))}
        dh = ds @ self.p["V"].T
        self._back(ways, np.stack([dh[..., :HIDDEN], dh[..., HIDDEN:][turn, cols]], axis=1), kept, g)
        return (total - gold) / batch, g

    def _back(self, x: np.ndarray, dh: np.ndarray, kept: list, g: dict[str, np.ndarray]) -> None:
        p, (steps, _, batch) = self.p, x.shape
        ut, dz_all = p["U"].transpose(0, 1, 3, 2).copy(), np.empty((steps, 4, 2, batch, HIDDEN), np.float32)
        next_h, next_c = np.zeros((2, batch, HIDDEN), np.float32), np.zeros((2, batch, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            z, before, e, _ = kept[t]
            dht, dz = dh[t] + next_h, dz_all[t]
            dc = dht * z[2]
            dc *= 1 - e * e
            dc += next_c
            np.multiply(dc, z[3], out=dz[0])
            np.multiply(dc, before, out=dz[1])
            np.multiply(dht, e, out=dz[2])
            dz[:3] *= z[:3]
            dz[:3] *= 1 - z[:3]
            np.multiply(dc, z[0], out=dz[3])
            dz[3] *= 1 - z[3] * z[3]
            next_h, next_c = (dz @ ut).sum(0), dc * z[1]
        h = np.stack([k[3] for k in kept])
        g["E"] = np.zeros_like(p["E"])
        g["U"], g["W"], g["b"] = np.empty_like(p["U"]), np.empty_like(p["W"]), np.empty_like(p["b"])
        for d in range(2):
            hidden, ids = h[:, d].reshape(-1, HIDDEN), x[:, d].reshape(-1)
            order = np.argsort(ids, kind="stable")
            cut = np.flatnonzero(np.append(True, np.diff(ids[order]) > 0))
            used = ids[order][cut]
            for k in range(4):
                flat = dz_all[:, k, d].reshape(-1, HIDDEN)
                g["U"][k, d], g["b"][k, d] = hidden.T @ flat, flat.sum(0)
                summed = np.add.reduceat(flat[order], cut)
                g["W"][k, d] = p["E"][used].T @ summed
                g["E"][used] += summed @ p["W"][k, d].T


def train(texts: int = TEXTS, epochs: int = EPOCHS, seed: int = 7, log=None) -> Model:
    """Fit the tagger on ``texts`` generated labelled texts, whole; deterministic for a seed."""
    maker, r = Spans(seed), np.random.default_rng(seed)
    made = [maker.text() for _ in range(texts)]
    data = [(codes(t), labels(len(t), s)) for t, s in made if t]
    model = Model.new(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step, steps = 0, epochs * (-(-len(data) // BATCH))
    for epoch in range(epochs):
        # texts of like length together, batches in random order
        order = sorted(range(len(data)), key=lambda i: len(data[i][0]) + r.integers(0, 12))
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        losses = []
        for b in r.permutation(len(batches)):
            loss, g = model.gradient([data[i][0] for i in batches[b]], [data[i][1] for i in batches[b]])
            losses.append(loss)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            rate = RATE * min(1.0, step / 50) * (0.5 + 0.5 * np.cos(np.pi * step / steps)) + 1e-5
            for k, v in g.items():
                v *= min(1.0, 5.0 / (norm + 1e-9))
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                model.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        if log:
            log(f"epoch {epoch}: loss {np.mean(losses):.3f}")
    model.p["c"][1::2] += LEAN
    return model


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows over n characters."""
    out, at = [], 0
    while True:
        out.append((at, min(n, at + WINDOW)))
        if at + WINDOW >= n:
            return out
        at += WINDOW - OVERLAP


def tag_texts(model: Model, texts: list[str], batch: int = 256) -> list[np.ndarray]:
    """One tag per character of each text; windows of like length are decoded together."""
    coded = [codes(t) for t in texts]
    parts = [(k, s, e) for k, c in enumerate(coded) if len(c) for s, e in windows(len(c))]
    parts.sort(key=lambda w: w[2] - w[1])
    out = [np.zeros(len(c), np.int8) for c in coded]
    depth = [np.full(len(c), -1, np.int32) for c in coded]
    for at in range(0, len(parts), batch):
        group = parts[at : at + batch]
        for (k, s, e), tags in zip(group, model.decode([coded[k][s:e] for k, s, e in group])):
            # the ends of the text itself are no window ends
            left = np.arange(e - s) + (WINDOW if s == 0 else 0)
            right = np.arange(e - s)[::-1] + (WINDOW if e == len(coded[k]) else 0)
            here = np.minimum(left, right)
            deeper = here > depth[k][s:e]
            out[k][s:e][deeper] = tags[deeper]
            depth[k][s:e][deeper] = here[deeper]
    return out


def read_spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans of equal kind; a lone I- begins a span too."""
    kind = (tags.astype(np.int64) + 1) // 2
    fresh = (tags % 2 == 1) | np.append(True, kind[1:] != kind[:-1])[: len(kind)]
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(tags))
    return [(int(s), int(e), KINDS[k - 1]) for s, e, k in zip(starts, ends, kind[starts].tolist()) if k]
