"""A character-level bidirectional LSTM with a CRF, in numpy, trained by gradient descent."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from joulecorpus.llm.pii_rules import KINDS, Span

#: Tags: 0 is outside; kind k begins with 1 + 2k and goes on with 2 + 2k.
TAGS = 1 + 2 * len(KINDS)
#: Character classes: ASCII as it is, then other letters, other digits, other characters, padding.
CLASSES = 132
PAD = 131
HIDDEN = 20
NEVER = -1e4


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    wide = np.flatnonzero(code >= 128)
    for k in wide.tolist():
        code[k] = 128 if text[k].isalpha() else 129 if text[k].isdigit() else 130
    return code


def tags(length: int, spans: dict[str, list[Span]]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for k, kind in enumerate(KINDS):
        for a, b in spans.get(kind, []):
            out[a:b] = 2 + 2 * k
            out[a] = 1 + 2 * k
    return out


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """Transition and start scores that forbid going on with a kind that has not begun."""
    move, start = np.zeros((TAGS, TAGS)), np.zeros(TAGS)
    for k in range(len(KINDS)):
        on = 2 + 2 * k
        start[on] = NEVER
        move[[t for t in range(TAGS) if t not in (on - 1, on)], on] = NEVER
    return move, start


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Tagger:
    """Weights; each direction has an input table, a recurrent matrix, and forget gates open at first."""

    seed: int = 0
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.weights:
            return
        rng = np.random.default_rng(self.seed)
        for way in ("fw", "bw"):
            table = rng.normal(0, 0.3, (CLASSES, 4 * HIDDEN))
            table[:, HIDDEN : 2 * HIDDEN] += 1
            self.weights[f"{way}_in"] = table
            self.weights[f"{way}_re"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        self.weights["out"] = rng.normal(0, 0.2, (2 * HIDDEN, TAGS))
        self.weights["bias"] = np.zeros(TAGS)
        self.weights["move"] = np.zeros((TAGS, TAGS))

    def _run(self, code: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states of (rows, time) classes; the states that training needs if ``keep``."""
        table, again = self.weights[f"{way}_in"], self.weights[f"{way}_re"]
        rows, time = code.shape
        h = np.zeros((rows, HIDDEN), table.dtype)
        c = np.zeros_like(h)
        out = np.empty((time, rows, HIDDEN), table.dtype)
        saved = []
        for t in range(time) if way == "fw" else range(time - 1, -1, -1):
            z = table[code[:, t]] + h @ again
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            squashed = np.tanh(new)
            if keep:
                saved.append((t, h, c, i, f, o, g, squashed))
            c, h = new, o * squashed
            out[t] = h
        return out, saved

    def emissions(self, code: np.ndarray) -> np.ndarray:
        """(time, rows, tags) scores."""
        hidden = np.concatenate([self._run(code, "fw", False)[0], self._run(code, "bw", False)[0]], axis=2)
        return hidden @ self.weights["out"] + self.weights["bias"]

    def gradient(self, code: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags, and its derivatives."""
        rows, time = code.shape
        fw, fw_saved = self._run(code, "fw", True)
        bw, bw_saved = self._run(code, "bw", True)
        hidden = np.concatenate([fw, bw], axis=2)
        score = hidden @ self.weights["out"] + self.weights["bias"]
        fixed, start = allowed()
        move = self.weights["move"] + fixed
        ahead = np.empty((time, rows, TAGS))
        ahead[0] = score[0] + start
        for t in range(1, time):
            ahead[t] = score[t] + _log_sum(ahead[t - 1][:, :, None] + move, 1)
        norm = _log_sum(ahead[-1], 1)
        behind = np.zeros((time, rows, TAGS))
        d_move = np.zeros((TAGS, TAGS))
        for t in range(time - 2, -1, -1):
            step = move + (score[t + 1] + behind[t + 1])[:, None, :]
            behind[t] = _log_sum(step, 2)
            d_move += np.exp(ahead[t][:, :, None] + step - norm[:, None, None]).sum(0)
        d_score = np.exp(ahead + behind - norm[:, None])
        at = (np.arange(time)[:, None], np.arange(rows)[None, :], truth.T)
        loss = norm.sum() - score[at].sum() - move[truth[:, :-1], truth[:, 1:]].sum()
        d_score[at] -= 1
        np.add.at(d_move, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), -1)
        d_score /= rows
        d_hidden = d_score @ self.weights["out"].T
        out = {
            "out": np.einsum("trh,trk->hk", hidden, d_score),
            "bias": d_score.sum((0, 1)),
            "move": d_move / rows,
        }
        for way, saved, part in (("fw", fw_saved, d_hidden[:, :, :HIDDEN]), ("bw", bw_saved, d_hidden[:, :, HIDDEN:])):
            out |= self._back(code, way, saved, part)
        return float(loss) / rows, out

    def _back(self, code: np.ndarray, way: str, saved: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        again = self.weights[f"{way}_re"]
        d_table, d_again = np.zeros_like(self.weights[f"{way}_in"]), np.zeros_like(again)
        d_h = np.zeros((code.shape[0], HIDDEN))
        d_c = np.zeros_like(d_h)
        d_all = np.empty((code.shape[1], *code.shape[:1], 4 * HIDDEN))
        for t, h, c, i, f, o, g, squashed in reversed(saved):
            d_h = d_h + d_out[t]
            d_c = d_c + d_h * o * (1 - squashed**2)
            d_z = np.concatenate([d_c * g * i * (1 - i), d_c * c * f * (1 - f), d_h * squashed * o * (1 - o), d_c * i * (1 - g**2)], axis=1)
            d_all[t] = d_z
            d_again += h.T @ d_z
            d_h, d_c = d_z @ again.T, d_c * f
        flat = code.T.ravel()
        order = np.argsort(flat, kind="stable")
        start = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
        d_table[flat[order][start]] = np.add.reduceat(d_all.reshape(len(flat), -1)[order], start, axis=0)
        return {f"{way}_in": d_table, f"{way}_re": d_again}

    def train(self, code: np.ndarray, truth: np.ndarray, epochs: int, batch: int = 32, rate: float = 0.02) -> list[float]:
        """Adam over shuffled batches, in an order that the seed fixes; returns the loss of each epoch."""
        rng = np.random.default_rng(self.seed + 1)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, losses = 0, []
        total = max(1, epochs * -(-len(code) // batch))
        for _ in range(epochs):
            order, loss = rng.permutation(len(code)), 0.0
            for a in range(0, len(order), batch):
                some = order[a : a + batch]
                value, slope = self.gradient(code[some], truth[some])
                loss += value * len(some)
                step += 1
                size = np.sqrt(sum((v**2).sum() for v in slope.values()))
                now = rate * (1 - step / (total + 1))
                for k, v in slope.items():
                    v = v * min(1.0, 5.0 / (size + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v**2
                    self.weights[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            losses.append(loss / max(1, len(code)))
        return losses

    def narrowed(self) -> Tagger:
        """The weights in single precision, for decoding."""
        return Tagger(self.seed, {k: v.astype(np.float32) for k, v in self.weights.items()})

    def decode(self, code: np.ndarray) -> list[list[tuple[int, int, str, float]]]:
        """(start, end, kind, score) spans of the best tag path of each row.

        The score is what the span's tags gain over leaving its characters outside.
        """
        score = self.emissions(code)
        time, rows, _ = score.shape
        fixed, start = allowed()
        move = (self.weights["move"] + fixed).astype(score.dtype)
        best = score[0] + start.astype(score.dtype)
        back = np.empty((time, rows, TAGS), np.int8)
        for t in range(1, time):
            ways = best[:, :, None] + move
            back[t] = ways.argmax(1)
            best = ways.max(1) + score[t]
        path = np.empty((time, rows), np.int64)
        path[-1] = best.argmax(1)
        for t in range(time - 1, 0, -1):
            path[t - 1] = back[t][np.arange(rows), path[t]]
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in range(rows)]
        begins = np.argwhere((path.T % 2) == 1)
        for row, a in begins.tolist():
            kind = (path[a, row] - 1) // 2
            b = a + 1
            while b < time and path[b, row] == 2 + 2 * kind:
                b += 1
            own = path[a:b, row]
            around = [0, *own.tolist(), 0] if b < time else [0, *own.tolist()]
            gain = (score[np.arange(a, b), row, own] - score[a:b, row, 0]).sum()
            gain += sum(move[p, q] - move[0, 0] for p, q in zip(around[:-1], around[1:], strict=True))
            out[row].append((a, b, KINDS[kind], float(gain)))
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)
