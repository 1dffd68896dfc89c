"""A small causal self-attention language model in numpy.

One attention layer with relative positions over overlapping windows: blocks of
``SPAN`` tokens, where a token sees its own block up to itself and the whole
block before, and is scored once.  The next token is predicted in two steps,
its class and then the token within the class, so that scoring costs the square
root of the vocabulary.  Tokens beyond the ``KNOWN`` most frequent are predicted
as the rare token, times their share of the rare tokens' corpus counts.
"""

from __future__ import annotations

import copy

import numpy as np

SPAN = 16
WIDTH = 16
CLASS = 32
#: Tokens in the model: the end of a text, the rare token, and the most frequent ones.
KNOWN = 1024
END, RARE = 0, 1
_FAR = np.float32(-1e4)


class Vocabulary:
    """Model ids of subword ids, and log10 of what a rare token costs on top."""

    def __init__(self, counts: np.ndarray, texts: int):
        top = np.argsort(-counts, kind="stable")[: KNOWN - 2]
        top = top[counts[top] > 0]
        self.of = np.full(len(counts), RARE, dtype=np.int32)
        self.of[top] = np.arange(len(top)) + 2
        rest = counts + 0.5
        rest[top] = 0
        self.extra = np.where(self.of == RARE, np.log10(np.maximum(rest, 1e-9) / max(rest.sum(), 1e-9)), 0.0)
        self.size = len(top) + 2
        self.padded = -(-self.size // CLASS) * CLASS
        share = np.full(self.padded, 1e-6)
        share[END], share[RARE] = texts + 0.5, counts[self.of == RARE].sum() + 0.5
        share[2 : self.size] = counts[top]
        self.log_share = np.log(share / share.sum()).astype(np.float32)
        self.log_share[self.size :] = _FAR


def blocks_of(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into blocks: inputs, targets (-1: none), the block before (0: padding), and the text of each block.

    tokens: model ids of all texts without ends; block 0 is padding (id -1).
    """
    sizes = np.diff(bounds) + 1  # with the end
    n = -(-sizes // SPAN)
    first = np.cumsum(n) - n + 1
    total = int(n.sum()) + 1
    x = np.full((total, SPAN), -1, dtype=np.int32)
    y = np.full((total, SPAN), -1, dtype=np.int32)
    fx, fy = x.reshape(-1), y.reshape(-1)
    shift = np.repeat(first * SPAN - bounds[:-1], sizes - 1)
    at = np.arange(len(tokens)) + shift
    fy[at] = tokens
    fx[at + 1 if len(at) else at] = tokens  # the input is the token before; a text's last token may precede its end
    fx[first * SPAN] = END
    last = first * SPAN + sizes - 1
    fy[last] = END
    # an input written past a text's blocks belongs to the next text's first place, which is END already
    before = np.arange(total) - 1
    before[first] = 0
    before[0] = 0
    return x, y, before, np.repeat(np.arange(len(sizes)), n)


#: A single-precision number's bits as a whole number are some 2**23 times its binary logarithm; the shift centres the error.
_STEEP, _SHIFT = np.float32((1 << 23) / np.log(2)), np.float32((127 << 23) - 366393)


def _exp(x: np.ndarray) -> np.ndarray:
    """Exponentials of -80 to 70 (what lies beyond counts as that); x is overwritten.

    In single precision these are straight lines between powers of two, within 3.1 %
    of the exponential and growing with x, at a third of its cost.  Every share is such
    a number divided by the sum of its like, in training and in scoring, so
    probabilities add up to 1 all the same.
    """
    if x.size and (x.max() > 70 or x.min() < -80):
        np.clip(x, -80, 70, out=x)
    if x.dtype != np.float32:
        return np.exp(x, out=x)
    x *= _STEEP
    bits = np.empty(x.shape, dtype=np.int32)
    np.add(x, _SHIFT, out=bits, casting="unsafe")
    return bits.view(np.float32)


class Attention:
    """Parameters, training, and scoring."""

    def __init__(self, vocab: Vocabulary, seed: int = 7):
        r = np.random.default_rng(seed)

        def make(*shape, scale):
            return (r.standard_normal(shape) * scale).astype(np.float32)

        k, d = vocab.padded, WIDTH
        share = np.exp(vocab.log_share).reshape(-1, CLASS)
        total = share.sum(1)
        self.vocab_size, self.classes = k, k // CLASS
        self.p = {
            "E": make(k, d, scale=0.3), "Q": make(d, d, scale=d**-0.5), "K": make(d, d, scale=d**-0.5), "V": make(d, d, scale=0.5 * d**-0.5), "pos": np.zeros(2 * SPAN, dtype=np.float32),
            "C": make(d, self.classes, scale=0.1), "bc": np.log(np.maximum(total, 1e-30)).astype(np.float32), "M": make(k, d, scale=0.1), "bm": np.log(
                np.maximum(share / total[:, None], 1e-30)
            ).astype(np.float32).reshape(-1),
        }
        i, j = np.arange(SPAN)[:, None], np.arange(2 * SPAN)[None, :]
        self.distance = np.clip(i + SPAN - j, 0, 2 * SPAN - 1)
        # 0 for tokens in the future, 1 for those that are seen
        self.future = (j - SPAN <= i).astype(np.float32)

    def weights(self) -> np.ndarray:
        """All parameters in one row."""
        return np.concatenate([v.reshape(-1) for v in self.p.values()])

    def _views(self, weights: np.ndarray) -> dict[str, np.ndarray]:
        """The parameters as parts of such a row."""
        cuts = np.cumsum([v.size for v in self.p.values()])[:-1]
        return {k: w.reshape(v.shape) for (k, v), w in zip(self.p.items(), np.split(weights, cuts), strict=True)}

    def take(self, weights: np.ndarray) -> None:
        """Set all parameters from such a row."""
        self.p = self._views(weights.astype(np.float32))

    def copy(self) -> Attention:
        """A model with parameters of its own."""
        other = copy.copy(self)
        other.p = {k: v.copy() for k, v in self.p.items()}
        return other

    # training

    def _step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean loss in nats and gradients; x: ids (batch, 2 SPAN), -1 is padding; y: targets (batch, SPAN), -1 is none."""
        p, d, s, rows = self.p, WIDTH, SPAN, self.vocab_size
        kind = p["E"].dtype
        scaled = p["Q"] * kind.type(d**-0.5)
        kv = np.concatenate([p["K"], p["V"]], 1)
        # embedding, key, value and query of every token, worked out once for the step; the last row is padding
        table = np.zeros((4, rows + 1, d), dtype=kind)
        table[0, :rows] = p["E"]
        np.matmul(table[0], np.stack([p["K"], p["V"], scaled]), out=table[1:])
        ids = np.where(x < 0, rows, x)
        e, k, v = (t.take(ids, axis=0) for t in table[:3])
        own, q = e[:, s:], table[3].take(ids[:, s:], axis=0)
        w = np.matmul(q, k.transpose(0, 2, 1))
        w += p["pos"][self.distance]
        w = _exp(w)
        w *= self.future
        # padding is a whole block before, or in the future of all targets
        w[x[:, 0] < 0, :, :s] = 0
        total = w.reshape(-1, 2 * s) @ np.ones((2 * s, 1), dtype=kind)
        one = 1 / np.maximum(total, 1e-30).reshape(-1, s, 1)
        told = w @ v
        told *= one
        # a target's vector carries a 1 for the biases; targets go by class
        use = np.flatnonzero(y >= 0)
        t = y.reshape(-1).take(use)
        order = np.argsort((t // CLASS).astype(np.uint16), kind="stable")
        use, t = use.take(order), t.take(order)
        g = np.ones((len(t), d + 1), dtype=kind)
        np.add(own, told).reshape(-1, d).take(use, axis=0, out=g[:, :d], mode="clip")
        c, m, at = t // CLASS, t % CLASS, np.arange(len(t))
        members = np.concatenate([p["M"].reshape(self.classes, CLASS, d), p["bm"].reshape(self.classes, CLASS, 1)], 2)
        edge = np.searchsorted(c, np.arange(self.classes + 1)).tolist()
        parts = [(n, slice(i, j)) for n, (i, j) in enumerate(zip(edge, edge[1:])) if j > i]
        pc = g @ np.concatenate([p["C"], p["bc"][None]])
        pm = np.empty((len(t), CLASS), dtype=kind)
        for cls, of in parts:
            np.matmul(g[of], members[cls].T, out=pm[of])
        n, loss, pc, pm = kind.type(1 / len(t)), 0.0, _exp(pc), _exp(pm)
        for part, target in ((pc, at * self.classes + c), (pm, at * CLASS + m)):
            part *= n / np.maximum(part @ np.ones((part.shape[1], 1), dtype=kind), 1e-30)
            flat = part.reshape(-1)
            right = flat.take(target)
            flat[target] = right - n
            loss -= float(np.mean(np.log(right / n + 1e-30)))
        gm, dg = np.zeros_like(members), np.empty((len(t), d), dtype=kind)
        for cls, of in parts:
            np.matmul(pm[of].T, g[of], out=gm[cls])
            np.matmul(pm[of], members[cls, :, :d], out=dg[of])
        dg += pc @ p["C"].T
        gc = g.T @ pc
        out = {"C": gc[:d], "bc": gc[d], "M": gm[:, :, :d].reshape(-1, d), "bm": gm[:, :, d].reshape(-1)}
        dh = np.zeros((y.size, d), dtype=kind)
        dh[use] = dg
        dh = dh.reshape(own.shape)
        part = dh * one
        ds = np.matmul(part, v.transpose(0, 2, 1))
        told *= part
        ds -= (told.reshape(-1, d) @ np.ones((d, 1), dtype=kind)).reshape(-1, s, 1)
        ds *= w
        out["pos"] = np.bincount(self.distance.reshape(-1), weights=ds.sum(0).reshape(-1), minlength=2 * s).astype(kind)
        dkv = np.empty((len(x), 2 * s, 2 * d), dtype=kind)
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :d])
        np.matmul(w.transpose(0, 2, 1), part, out=dkv[:, :, d:])
        dq = (ds @ k).reshape(-1, d)
        # each place's share in its token's embedding, summed by token; weights take theirs from the places
        e, dkv = e.reshape(-1, d), dkv.reshape(-1, 2 * d)
        gkv = e.T @ dkv
        out["K"], out["V"] = gkv[:, :d], gkv[:, d:]
        out["Q"] = own.reshape(-1, d).T @ dq * (p["Q"].dtype.type(d**-0.5))
        de = (dkv @ kv.T).reshape(len(x), 2 * s, d)
        dh += (dq @ scaled.T).reshape(dh.shape)
        de[:, s:] += dh
        out["E"] = self._by_token(ids, de)
        return loss, out

    def _by_token(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sums of rows by token; those of the padding go."""
        ids, rows = ids.reshape(-1), rows.reshape(ids.size, -1)
        order = np.argsort(ids.astype(np.uint16 if self.vocab_size < 1 << 16 else np.int64), kind="stable")
        ids = ids[order]
        head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        out = np.zeros((self.vocab_size + 1, rows.shape[1]), dtype=rows.dtype)
        # two numbers at a time, as the real and the imaginary part
        pairs = rows.take(order, axis=0).view(np.result_type(rows.dtype, np.complex64))
        out[ids[head]] = np.add.reduceat(pairs, head, axis=0).view(rows.dtype)
        return out[:-1]

    def _descend(self, x: np.ndarray, y: np.ndarray, before: np.ndarray, picks, rates) -> list[float]:
        """Adam steps on these picks of blocks at these rates; returns the losses."""
        # all parameters and their moments in one row each
        flat = self.weights()
        self.p = self._views(flat)
        g, first, second, now_at = np.empty_like(flat), np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
        into = self._views(g)
        losses = []
        for step, (pick, now) in enumerate(zip(picks, rates, strict=True), 1):
            loss, grad = self._step(np.concatenate([x[before[pick]], x[pick]], 1), y[pick])
            losses.append(loss)
            for k, v in grad.items():
                into[k][...] = v
            np.subtract(g, first, out=now_at)
            now_at *= np.float32(0.1)
            first += now_at
            g *= g
            g -= second
            g *= np.float32(0.01)
            second += g
            np.multiply(second, np.float32(1 / (1 - 0.99**step)), out=g)
            np.sqrt(g, out=g)
            g += np.float32(1e-8)
            np.divide(first, g, out=now_at)
            now_at *= np.float32(now / (1 - 0.9**step))
            flat -= now_at
        return losses

    def train(self, tokens: np.ndarray, bounds: np.ndarray, steps: int = 800, batch: int = 192, rate: float = 0.03, seed: int = 11) -> list[float]:
        """Adam on random blocks of the texts; returns the losses."""
        x, y, before, _ = blocks_of(tokens, bounds)
        if len(x) < 2:
            return []
        r = np.random.default_rng(seed)
        rates = [rate * min(1.0, step / 30) * (1 - 0.95 * step / steps) for step in range(1, steps + 1)]
        return self._descend(x, y, before, (r.integers(1, len(x), batch) for _ in range(steps)), rates)

    def train_once(self, tokens: np.ndarray, bounds: np.ndarray, rate: float, batch: int = 192, seed: int = 11) -> int:
        """Adam on every block of the texts, each once and in random order; returns the number of targets."""
        x, y, before, _ = blocks_of(tokens, bounds)
        if len(x) < 2:
            return 0
        order = np.random.default_rng(seed).permutation(np.arange(1, len(x)))
        picks = [order[i : i + batch] for i in range(0, len(order), batch)]
        self._descend(x, y, before, picks, [rate * min(1.0, step / 30) for step in range(1, len(picks) + 1)])
        return int((y >= 0).sum())

    # scoring

    def freeze(self) -> None:
        """Queries, keys and values of every token, values with a column that carries sums; the last row is padding."""
        p, d = self.p, WIDTH
        one, zero = np.ones((self.vocab_size, 1), dtype=np.float32), np.zeros((1, d + 1), dtype=np.float32)
        q, k = p["E"] @ p["Q"] * np.float32(d**-0.5), p["E"] @ p["K"]
        largest = float(np.linalg.norm(q, axis=1).max() * np.linalg.norm(k, axis=1).max() + p["pos"].max())
        if largest > 70:
            q *= np.float32(70 / largest)
        self.fq, self.fk = np.concatenate([q, zero[:, :d]]), np.concatenate([k, zero[:, :d]])
        self.fv = np.concatenate([np.concatenate([p["E"] @ p["V"], one], 1), zero])
        self.fe = np.concatenate([p["E"], zero[:, :d]])
        self.bias = p["pos"][self.distance]
        # the constant 1 of a row's last column takes the biases
        self.out = np.concatenate([p["C"], p["bc"][None]])
        self.members = np.concatenate([p["M"].reshape(self.classes, CLASS, d), p["bm"].reshape(self.classes, CLASS, 1)], 2).transpose(0, 2, 1).copy()
        self.fe = np.concatenate([self.fe, np.zeros((len(self.fe), 1), dtype=np.float32)], 1)

    def log_probs(self, x: np.ndarray, y: np.ndarray, before: np.ndarray, batch: int = 512) -> np.ndarray:
        """Natural log of each target's probability, 0 where there is none; each target is scored once."""
        d = WIDTH
        out = np.zeros(y.shape, dtype=np.float32)
        ones_c, ones_m = np.ones(self.classes, dtype=np.float32), np.ones(CLASS, dtype=np.float32)
        x = np.where(x < 0, self.vocab_size, x)
        kind = np.uint8 if self.classes <= 256 else np.int32
        for a in range(0, len(x), batch):
            own = x[a : a + batch]
            seen = np.concatenate([x[before[a : a + batch]], own], 1)
            w = self.fq.take(own, axis=0, mode="clip") @ self.fk.take(seen, axis=0, mode="clip").transpose(0, 2, 1)
            w += self.bias
            w = _exp(w)
            w *= self.future
            w[before[a : a + batch] == 0, :, :SPAN] = 0
            c = (w @ self.fv.take(seen, axis=0, mode="clip")).reshape(-1, d + 1)
            t = y[a : a + batch].reshape(-1)
            use = np.flatnonzero(t >= 0)
            if not len(use):
                continue
            t = t.take(use)
            order = np.argsort((t // CLASS).astype(kind), kind="stable")
            use, t = use.take(order), t.take(order)
            h = c.take(use, axis=0)
            h *= (1 / h[:, d])[:, None]
            h += self.fe.take(own.reshape(-1).take(use), axis=0, mode="clip")
            cls = t // CLASS
            rows = np.arange(len(t))
            lc = h @ self.out
            lc = _exp(lc)
            got = lc[rows, cls]
            total = lc @ ones_c
            edge = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
            lm = np.empty((len(t), CLASS), dtype=np.float32)
            for k in range(self.classes):
                i, j = edge[k], edge[k + 1]
                if j > i:
                    np.matmul(h[i:j], self.members[k], out=lm[i:j])
            lm = _exp(lm)
            got /= total
            got = np.log(got)
            # two logarithms, as the product may be too small for single precision
            got += np.log(lm[rows, t % CLASS] / (lm @ ones_m))
            out[a : a + batch].reshape(-1)[use] = got
        return out
