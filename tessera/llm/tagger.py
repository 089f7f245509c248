"""Character-level bidirectional LSTM with a linear-chain CRF, trained and run in numpy.

The cells couple the input and forget gates (c' = c + i * (u - c), h = o * c); gates and candidates are clipped lines, so a
step is one matrix product and a few passes over arrays laid out as (feature, window). Transitions that no tagging can
hold (outside to inside, one kind's begin to another's inside) are forbidden.

Every text is read whole: it is cut into overlapping windows, the windows of many texts are read side by side, and a
position takes the tag of the window in which it lies farthest from an edge.

The parameters in tagger.npz are made by ``python -m tessera.llm.tagger`` from generated labelled windows (tagger_data).
"""

from __future__ import annotations

import sys
from functools import lru_cache
from pathlib import Path

import numpy as np

from .tagger_data import examples

KINDS = ("secret", "other")
#: Outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
HIDDEN, EMBED, CHARS = 12, 6, 100
#: Of a window when texts are read, and of the part that it shares with the next one.
WINDOW, OVERLAP, SIDE_BY_SIDE = 768, 64, 2800
#: Of training: characters of a window, labelled windows (the documented bound), batches.
LENGTH, TRAIN_WINDOWS, EPOCHS, BATCH, RATE, SEED = 144, 60_000, 14, 192, 0.012, 11
FORBIDDEN = -1e4
PARAMETERS = Path(__file__).with_name("tagger.npz")
PAD, LETTER, OTHER, NEWLINE = 0, 96, 97, 98


def _table() -> np.ndarray:
    """Id of each code point below 0xC0; the last entry is that of all others."""
    t = np.full(0xC1, OTHER, np.int8)
    t[33:127] = np.arange(2, 96)
    t[32], t[10], t[0xC0] = 1, NEWLINE, LETTER
    return t


_IDS = _table()


def char_ids(text: str) -> np.ndarray:
    """Printable ASCII by itself, letters beyond it as one, line ends, the rest as one."""
    return np.take(_IDS, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), mode="clip")


def allowed() -> np.ndarray:
    """(from, to): inside only after begin or inside of its kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


_ALLOWED = allowed()


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Parameters: E (embeddings), W* (gates i, o and candidate u by [h, e, 1]) and O* (scores) per direction, c, T."""

    def __init__(self, params: dict[str, np.ndarray]) -> None:
        self.p = params

    @classmethod
    def fresh(cls, seed: int = SEED, hidden: int = HIDDEN, embed: int = EMBED) -> Tagger:
        g = np.random.default_rng(seed)
        p = {"E": g.normal(0, 0.5, (embed, CHARS)), "c": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS))}
        for way in "fb":
            w = g.normal(0, 0.25, (3 * hidden, hidden + embed + 1))
            w[: 2 * hidden, -1], w[2 * hidden :, -1] = 0.5, 0.0
            p[f"W{way}"], p[f"O{way}"] = w, g.normal(0, 0.3, (TAGS, hidden))
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    @classmethod
    def load(cls, path: Path = PARAMETERS) -> Tagger:
        with np.load(path) as z:
            return cls({k: z[k] for k in z.files})

    def save(self, path: Path = PARAMETERS) -> None:
        np.savez(path, **self.p)

    def transitions(self) -> np.ndarray:
        return np.where(_ALLOWED, self.p["T"], FORBIDDEN).astype(np.float32)

    # reading

    def _read(self, x: np.ndarray, lengths: np.ndarray, way: str, out: np.ndarray, tape: list | None = None) -> None:
        """Adds the direction's scores to out (time, TAGS, n). x: (time, n) ids; lengths descend, so that the windows that
        have a step t are the first ones. A step's matrix product also gives the scores of the step before."""
        o_, table = self.p[f"O{way}"], self.p["E"]
        hidden, n = o_.shape[1], x.shape[1]
        table = np.concatenate([table, np.ones((1, table.shape[1]), np.float32)]).astype(np.float32)
        w = np.zeros((3 * hidden + TAGS, hidden + len(table)), np.float32)
        w[: 3 * hidden], w[3 * hidden :, :hidden] = self.p[f"W{way}"], o_
        have = np.searchsorted(-lengths, -np.arange(len(x)), "left").tolist()  # windows longer than t
        widths, width = [], n
        for m in have:  # arrays stay whole (and contiguous) until a fifth of their windows has ended
            width = m if m < 0.8 * width else width
            widths.append(width)
        s = c = z = np.zeros((0, 0), np.float32)
        before, was = -1, 0
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            m, width = have[t], widths[t]
            if not width:
                continue
            if width != c.shape[1]:
                if was > width:
                    out[before, :, :was] += o_ @ s[:hidden, :was]
                    was = 0
                keep, s0, c0 = min(width, c.shape[1]), s, c
                s, c, z = np.zeros((hidden + len(table), width), np.float32), np.zeros((hidden, width), np.float32), np.empty((len(w), width), np.float32)
                if keep:
                    s[:, :keep], c[:, :keep] = s0[:, :keep], c0[:, :keep]
            if way == "b" and was < m:  # windows that begin here
                s[:hidden, was:m] = c[:, was:m] = 0
            np.take(table, x[t, :width], axis=1, mode="clip", out=s[hidden:])
            np.matmul(w, s, out=z)
            if was:
                out[before, :, :was] += z[3 * hidden :, :was]
            gates, u = z[: 2 * hidden], z[2 * hidden : 3 * hidden]
            np.clip(gates, 0, 1, out=gates)
            np.clip(u, -1, 1, out=u)
            if tape is not None:
                tape.append((t, s.copy(), c.copy(), z[: 3 * hidden].copy()))
            np.subtract(u, c, out=u)
            np.multiply(u, gates[:hidden], out=u)
            np.add(c, u, out=c)
            np.multiply(c, gates[hidden:], out=s[:hidden])
            before, was = t, m
        if was:
            out[before, :, :was] += o_ @ s[:hidden, :was]

    def scores(self, x: np.ndarray, lengths: np.ndarray, tapes: dict[str, list] | None = None) -> np.ndarray:
        out = np.zeros((len(x), TAGS, x.shape[1]), np.float32)
        out += self.p["c"][None, :, None]
        for way in "fb":
            self._read(x, lengths, way, out, None if tapes is None else tapes[way])
        return out

    # decoding

    def forward(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Turns scores (time, TAGS, n) into the best scores of paths that end in each tag; those of whole windows (TAGS, n);
        and whether a window's best path is the all-outside one, whose score is summed beside them."""
        t = self.transitions()
        begin, own = [0, *range(1, TAGS, 2)], t[np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)][:, None]
        stay, into = t[np.arange(2, TAGS, 2), np.arange(2, TAGS, 2)][:, None], t[:, begin][:, :, None]
        n, have = scores.shape[2], np.searchsorted(-lengths, -np.arange(len(scores)), "left").tolist()
        out, last = scores[0, 0].copy(), scores[0].copy()
        ways, tops, inner, step = np.empty((TAGS, len(begin), n), np.float32), np.empty((len(begin), n), np.float32), np.empty((2, len(KINDS), n), np.float32), t[0, 0]
        for k in range(1, len(scores)):
            m = have[k]
            if not m:
                break
            if m < n:  # windows that end here keep their scores
                last[:, m : have[k - 1]] = scores[k - 1, :, m : have[k - 1]]
            a, b = scores[k - 1, :, :m], scores[k, :, :m]
            ways_, tops_, stay_, own_ = ways[:, :, :m], tops[:, :m], inner[0, :, :m], inner[1, :, :m]
            np.add(a[:, None], into, out=ways_)
            np.maximum.reduce(ways_, axis=0, out=tops_)
            np.add(a[2::2], stay, out=stay_)
            np.add(a[1::2], own, out=own_)
            np.maximum(stay_, own_, out=stay_)
            o = out[:m]
            np.add(o, step, out=o)
            np.add(o, b[0], out=o)
            b[2::2] += stay_
            b[0] += tops_[0]
            b[1::2] += tops_[1:]
        m = have[-1]
        last[:, :m] = scores[-1, :, :m]
        return last, last.max(axis=0) == out

    def backward(self, ahead: np.ndarray, last: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags (time, n) from forward()'s results; 0 beyond a window's length."""
        steps, _, n = ahead.shape
        t, out, at, rows = self.transitions(), np.zeros((steps, n), np.int8), last.argmax(axis=0), np.arange(n)
        for k in range(steps - 1, -1, -1):
            live = k < lengths
            out[k] = np.where(live, at, 0)
            if k:
                at = np.where(live, (ahead[k - 1] + t[:, at]).argmax(axis=0), at)
        return out

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tags (time, n) of windows in descending order of length, by Viterbi; paths are traced back where they leave outside."""
        s = self.scores(x, lengths)
        last, outside = self.forward(s, lengths)
        out, hard = np.zeros(x.shape, np.int8), np.flatnonzero(~outside)
        if len(hard):
            out[:, hard] = self.backward(s[:, :, hard], last[:, hard], lengths[hard])
        return out

    # training

    def crf(self, s: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean negative log-likelihood of tags y (time, n) and its gradients by scores (time, TAGS, n) and transitions."""
        steps, _, n = s.shape
        tr, rows, s = self.transitions().astype(np.float64), np.arange(n), s.astype(np.float64)
        a = np.empty_like(s)
        a[0] = s[0]
        for k in range(1, steps):
            a[k] = _lse(a[k - 1][:, None, :] + tr[:, :, None], 0) + s[k]
        z = _lse(a[-1], 0)
        b, gs, gt, gold = np.zeros((TAGS, n)), np.empty_like(s), np.zeros_like(tr), np.zeros(n)
        for k in range(steps - 1, -1, -1):
            gs[k] = np.exp(a[k] + b - z)
            gs[k, y[k], rows] -= 1
            gold += s[k, y[k], rows]
            if k:
                inner = tr[:, :, None] + (s[k] + b)[None]
                gt += np.exp(a[k - 1][:, None, :] + inner - z).sum(axis=2)
                np.add.at(gt, (y[k - 1], y[k]), -1)
                gold += tr[y[k - 1], y[k]]
                b = _lse(inner, 1)
        return float((z - gold).mean()), gs / n, np.where(_ALLOWED, gt, 0) / n

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients on windows (time, n) of full length."""
        lengths, tapes = np.full(x.shape[1], len(x)), {"f": [], "b": []}
        loss, gs, gt = self.crf(self.scores(x, lengths, tapes), y)
        g = {k: np.zeros(v.shape) for k, v in self.p.items()}
        g["T"], g["c"] = gt, gs.sum(axis=(0, 2))
        gs = gs.astype(np.float32)
        for way in "fb":
            w, o_ = self.p[f"W{way}"], self.p[f"O{way}"]
            hidden, n = o_.shape[1], x.shape[1]
            dh, dc, de = np.zeros((hidden, n), np.float32), np.zeros((hidden, n), np.float32), np.empty((len(x), n, len(self.p["E"])), np.float32)
            for t, s, c0, z in reversed(tapes[way]):
                i, o, u = z[:hidden], z[hidden : 2 * hidden], z[2 * hidden :]
                c = c0 + i * (u - c0)
                g[f"O{way}"] += gs[t] @ (o * c).T
                dh = dh + o_.T @ gs[t]
                dc = dc + dh * o
                dz = np.concatenate([dc * (u - c0) * ((i > 0) & (i < 1)), dh * c * ((o > 0) & (o < 1)), dc * i * (np.abs(u) < 1)])
                g[f"W{way}"] += dz @ s.T
                ds = w.T @ dz
                dh, dc, de[t] = ds[:hidden], dc * (1 - i), ds[hidden:-1].T
            flat, ids = de.reshape(-1, de.shape[2]), x.ravel()
            for k in range(flat.shape[1]):
                g["E"][k] += np.bincount(ids, flat[:, k], CHARS)
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED, rate: float = RATE, tell: bool = False) -> Tagger:
        """Adam over shuffled batches, the rate falling to nothing."""
        rng, m, v, step = np.random.default_rng(seed), {}, {}, 0
        total = epochs * -(-x.shape[1] // BATCH)
        for epoch in range(epochs):
            order, losses = rng.permutation(x.shape[1]), []
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                loss, g = self.gradients(x[:, part], y[:, part])
                losses.append(loss)
                step += 1
                norm = max(1.0, float(np.sqrt(sum((q**2).sum() for q in g.values()))) / 5)
                now = rate * min(1.0, step / 100) * max(0.02, 1 - step / total)
                for k, q in g.items():
                    q = q / norm
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * q
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * q * q
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            if tell:
                print(epoch, round(float(np.mean(losses)), 4), flush=True)
        return self


def encoded(windows: list[tuple[str, list[tuple[int, int, str]]]]) -> tuple[np.ndarray, np.ndarray]:
    """(time, n) ids and tags of windows of one length."""
    steps = max(len(t) for t, _ in windows)
    x, y = np.zeros((steps, len(windows)), np.int64), np.zeros((steps, len(windows)), np.int64)
    for i, (text, spans) in enumerate(windows):
        x[: len(text), i] = char_ids(text)
        for s, e, k in spans:
            y[s:e, i] = 2 + 2 * KINDS.index(k)
            if s:  # a span that goes on from before the window has no beginning in it
                y[s, i] -= 1
    return x, y


@lru_cache(maxsize=1)
def trained() -> Tagger:
    return Tagger.load()


def spans_of(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Maximal runs begin-inside of one kind. An inside tag without a begin opens a span."""
    out, at, last, kind = [], 0, -2, -1
    for i in np.flatnonzero(tags).tolist():
        t = int(tags[i])
        k = (t - 1) // 2
        if kind >= 0 and (i != last + 1 or k != kind or t % 2 == 1):
            out.append((at, last + 1, KINDS[kind]))
            kind = -1
        if kind < 0:
            at, kind = i, k
        last = i
    return [*out, (at, last + 1, KINDS[kind])] if kind >= 0 else out


def windows_of(length: int) -> list[tuple[int, int, int, int]]:
    """(start, end, first kept, end of kept) of a text's windows, of about equal lengths; the kept parts make up the text."""
    k = max(1, -(-(length - OVERLAP) // (WINDOW - OVERLAP)))
    stride = -(-(length - OVERLAP) // k)
    starts = [i * stride for i in range(k) if i == 0 or i * stride < length - OVERLAP]
    return [(s, min(length, s + stride + OVERLAP) if s != starts[-1] else length, s + OVERLAP // 2 if s else 0, s + stride + OVERLAP // 2 if s != starts[-1] else length) for s in starts]


def tag_texts(model: Tagger, texts: list[str]) -> dict[int, np.ndarray]:
    """Tags of every text that holds a span, by its place in texts. All characters of all texts are read."""
    ids = char_ids("".join(texts))
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    cuts = [(e - s, k, s, a, b) for k, t in enumerate(texts) if t for s, e, a, b in windows_of(len(t))]
    cuts.sort(key=lambda c: -c[0])
    tags: dict[int, np.ndarray] = {}
    each = -(-len(cuts) // max(1, -(-len(cuts) // SIDE_BY_SIDE)))
    for i in range(0, len(cuts), max(1, each)):
        part = cuts[i : i + each]
        lengths = np.array([c[0] for c in part])
        start = np.array([base[c[1]] + c[2] for c in part])
        x = np.take(ids, start[None] + np.arange(lengths[0])[:, None], mode="clip").astype(np.intp)
        got = model.decode(x, lengths)
        for j in np.flatnonzero(got.any(axis=0)).tolist():
            _, k, s, a, b = part[j]
            if k not in tags:
                tags[k] = np.zeros(len(texts[k]), np.int8)
            tags[k][a:b] = got[a - s : b - s, j]
    return {k: t for k, t in tags.items() if t.any()}


if __name__ == "__main__":
    Tagger.fresh().fit(*encoded(examples(TRAIN_WINDOWS, SEED, LENGTH)), tell=True).save(Path(sys.argv[1]) if len(sys.argv) > 1 else PARAMETERS)
