"""The gated recurrent network of `toxicity`, in numpy alone, so that training runs in a process without Spark."""

from __future__ import annotations

import pickle
import re
import sys
from collections.abc import Iterator

import numpy as np

WINDOW, STRIDE = 24, 16
HIDDEN, WORD_DIM, CHAR_DIM = 12, 8, 8
GRAMS, CHAR_ROWS = (3, 5), 1 << 16
#: Share of a batch's words whose own vector is hidden, so that their characters are learnt as well.
HIDDEN_WORDS = 0.4
MIN_COUNT, MAX_WORDS = 4, 20_000
#: Distinct words whose inputs a worker keeps.
KEPT_WORDS = 120_000

WORD = re.compile(r"[^\W_]+")


def split_words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def ngram_rows(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length of GRAMS, the rows of all words' character n-grams (edges marked); and the words' lengths.

    A word of n letters has n n-grams of each length.
    """
    codes = np.array([ord(c) for w in words for c in f"^{w}$$$"], np.uint64)
    sizes = np.array([len(w) for w in words])
    begin = np.cumsum(sizes + 4) - (sizes + 4)
    places = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    out = []
    for n in GRAMS:
        mixed = np.full(len(places), n, np.uint64)
        for j in range(n):
            mixed = (mixed ^ codes[places + j]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        out.append((mixed >> np.uint64(20)).astype(np.int64) % CHAR_ROWS)
    return out, sizes


def word_pieces(text: str | None, windows: int = 1250) -> Iterator[list[str]]:
    """The words of a text in pieces of up to so many windows, which together have the text's windows."""
    if not text or len(text) < 100_000:
        yield split_words(text)
        return
    size, held, first = STRIDE * (windows - 1) + WINDOW, [], True
    for found in WORD.finditer(text.lower()):
        held.append(found.group())
        if len(held) == size:
            yield held
            held, first = held[STRIDE * windows :], False
    if first or len(held) > WINDOW - STRIDE:
        yield held


def windows_of(count: int) -> list[int]:
    """First words of the overlapping windows that cover `count` words."""
    return list(range(0, max(1, count - WINDOW + STRIDE), STRIDE)) if count > WINDOW else [0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedNet:
    """Two gated recurrent directions, attention pooling, one logit."""

    PARTS = ("word", "char", "wf", "uf", "bf", "wb", "ub", "bb", "att", "out", "out_bias")

    def __init__(self, vocabulary: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        dim = WORD_DIM + CHAR_DIM
        self.index = {w: i + 1 for i, w in enumerate(vocabulary)}
        shape = {
            "word": (len(vocabulary) + 1, WORD_DIM),
            "char": (CHAR_ROWS, CHAR_DIM),
            "wf": (dim, 3 * HIDDEN),
            "wb": (dim, 3 * HIDDEN),
            "uf": (HIDDEN, 3 * HIDDEN),
            "ub": (HIDDEN, 3 * HIDDEN),
            "att": (2 * HIDDEN,),
            "out": (2 * HIDDEN,),
        }
        for name, size in shape.items():
            setattr(self, name, rng.normal(0, 0.3, size).astype(np.float32))
        self.bf, self.bb = np.zeros(3 * HIDDEN, np.float32), np.zeros(3 * HIDDEN, np.float32)
        self.out_bias = np.full(1, -1.0, np.float32)
        self.word *= 0.3
        self.char *= 0.3

    def start_from_counts(self, texts: Iterator[list[str]], labels: np.ndarray) -> None:
        """Begins the vectors of words and n-grams with how far their share of toxic texts is from chance."""
        share = labels.mean()
        words, chars = np.zeros((2, len(self.word))), np.zeros((2, CHAR_ROWS))
        for text, label in zip(texts, labels):
            own = sorted(set(text))
            if own:
                for counts, ids in (
                    (words, np.unique([self.index.get(w, 0) for w in own])),
                    (chars, np.unique(np.concatenate(ngram_rows(own)[0]))),
                ):
                    counts[0, ids] += 1
                    counts[1, ids] += label
        words[:, 0] = 0
        for part, (seen, toxic) in ((self.word, words), (self.char, chars)):
            far = (toxic - seen * share) / np.sqrt(seen * share * (1 - share) + 1)
            part[:, 0] += np.clip(far / 4, -1, 3)

    def inputs(self, words: list[str], ids: list[int] | None = None) -> np.ndarray:
        rows, sizes = ngram_rows(words)
        begin = np.cumsum(sizes) - sizes
        chars = sum(np.add.reduceat(self.char[x], begin, axis=0) for x in rows) / np.sqrt(sizes)[:, None]
        own = self.word[[self.index.get(w, 0) for w in words] if ids is None else ids]
        return np.hstack([own, chars]).astype(np.float32)

    @staticmethod
    def _gates(x, h, u):
        """One step: x is the projected input."""
        hu = h @ u
        zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        return z, r, n, hu

    def logits(self, table: np.ndarray, index: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of windows given as rows (n, WINDOW) of `table`, the words' projections for both directions."""
        n = len(index)
        states = np.zeros((WINDOW, n, 2 * HIDDEN), np.float32)
        for way, u in ((0, self.uf), (1, self.ub)):
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(WINDOW) if way == 0 else range(WINDOW - 1, -1, -1):
                z, _, new, _ = self._gates(table[way][index[:, t]], h, u)
                h = np.where((sizes > t)[:, None], new + z * (h - new), h)
                states[t, :, way * HIDDEN : (way + 1) * HIDDEN] = h
        weight = states @ self.att
        weight[np.arange(WINDOW)[:, None] >= np.maximum(sizes, 1)] = -1e9
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        return np.einsum("tn,tnh->nh", weight, states) @ self.out + self.out_bias[0]

    def project(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        x = self.inputs(words)
        return x @ self.wf + self.bf, x @ self.wb + self.bb

    def gradients(self, windows: list[list[str]], labels: np.ndarray, rng=None) -> dict[str, np.ndarray]:
        """Back-propagation through time of the mean log loss; with `rng`, some words' own vectors are hidden."""
        words = sorted({w for x in windows for w in x}) or ["-"]
        at = {w: i for i, w in enumerate(words)}
        n, H = len(windows), HIDDEN
        index, sizes = np.zeros((n, WINDOW), int), np.array([len(x) for x in windows])
        for i, x in enumerate(windows):
            index[i, : len(x)] = [at[w] for w in x]
        ids = [self.index.get(w, 0) for w in words]
        if rng is not None:
            ids = np.where(rng.random(len(ids)) < HIDDEN_WORDS, 0, ids)
        x = self.inputs(words, ids)
        table = (x @ self.wf + self.bf, x @ self.wb + self.bb)
        states = np.zeros((WINDOW, n, 2 * H), np.float32)
        past = {}
        for way, u in ((0, self.uf), (1, self.ub)):
            h = np.zeros((n, H), np.float32)
            for t in range(WINDOW) if way == 0 else range(WINDOW - 1, -1, -1):
                z, r, new, hu = self._gates(table[way][index[:, t]], h, u)
                live = (sizes > t)[:, None]
                past[way, t] = (h, z, r, new, hu, live)
                h = np.where(live, new + z * (h - new), h)
                states[t, :, way * H : (way + 1) * H] = h
        weight = states @ self.att
        weight[np.arange(WINDOW)[:, None] >= np.maximum(sizes, 1)] = -1e9
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        wrong = (_sigmoid(pooled @ self.out + self.out_bias[0]) - labels) / n
        grads = {"out": pooled.T @ wrong, "out_bias": np.array([wrong.sum()])}
        to_pooled = wrong[:, None] * self.out
        to_weight = np.einsum("nh,tnh->tn", to_pooled, states)
        to_score = weight * (to_weight - (weight * to_weight).sum(0))
        grads["att"] = np.einsum("tn,tnh->h", to_score, states)
        to_states = weight[:, :, None] * to_pooled + to_score[:, :, None] * self.att
        to_x = np.zeros_like(x)
        for way, u, w, names in ((0, self.uf, self.wf, "wf uf bf"), (1, self.ub, self.wb, "wb ub bb")):
            to_table, to_u = np.zeros_like(table[way]), np.zeros_like(u)
            back = np.zeros((n, H), np.float32)
            for t in range(WINDOW - 1, -1, -1) if way == 0 else range(WINDOW):
                h, z, r, new, hu, live = past[way, t]
                back = back + to_states[t, :, way * H : (way + 1) * H]
                own = back * live
                d_new = own * (1 - z) * (1 - new * new)
                d_z = own * (h - new) * z * (1 - z)
                d_r = d_new * hu[:, 2 * H :] * r * (1 - r)
                d_gate = np.hstack([d_z, d_r, d_new])
                d_hu = np.hstack([d_z, d_r, d_new * r])
                np.add.at(to_table, index[:, t], d_gate)
                to_u += h.T @ d_hu
                back = np.where(live, own * z + d_hu @ u.T, back)
            w_name, u_name, b_name = names.split()
            grads[w_name], grads[u_name], grads[b_name] = x.T @ to_table, to_u, to_table.sum(0)
            to_x += to_table @ w.T
        grads["word"] = np.zeros_like(self.word)
        np.add.at(grads["word"], ids, to_x[:, :WORD_DIM])
        rows, count = ngram_rows(words)
        grads["char"] = np.zeros_like(self.char)
        to_chars = np.repeat(to_x[:, WORD_DIM:] / np.sqrt(count)[:, None], count, axis=0)
        for own in rows:
            np.add.at(grads["char"], own, to_chars)
        return grads


class Adam:
    def __init__(self, net: GatedNet, rate: float = 0.01):
        self.net, self.rate, self.step = net, rate, 0
        self.first = {k: np.zeros_like(getattr(net, k)) for k in net.PARTS}
        self.second = {k: np.zeros_like(getattr(net, k)) for k in net.PARTS}

    def apply(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        shrink = min(1.0, 1.0 / (size + 1e-9))
        for k, g in grads.items():
            g = (g * shrink).astype(np.float32)
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.001 * (g * g - self.second[k])
            fixed = np.sqrt(self.second[k] / (1 - 0.999**self.step)) + 1e-8
            getattr(self.net, k).__isub__(self.rate * self.first[k] / (1 - 0.9**self.step) / fixed)


class Scorer:
    """Scores texts with a trained network; keeps the projected inputs of distinct words."""

    def __init__(self, net: GatedNet):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.room = np.zeros((2, 4096, 3 * HIDDEN), np.float32)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            while self.used + len(part) > self.room.shape[1]:
                self.room = np.concatenate([self.room, np.zeros_like(self.room)], axis=1)
            for way, rows in enumerate(self.net.project(part)):
                self.room[way, self.used : self.used + len(part)] = rows
            self.known.update(zip(part, range(self.used, self.used + len(part))))
            self.used += len(part)

    def window_logits(self, texts: list[list[str]], most: int = 2048) -> list[np.ndarray]:
        """Per text of words, the logits of all its windows."""
        new = {w for x in texts for w in x}.difference(self.known)
        if self.used + len(new) > KEPT_WORDS:
            self.clear()
            new = {w for x in texts for w in x}
        if new:
            self._learn(sorted(new))
        index, sizes, counts = [], [], []
        for words in texts:
            begin = windows_of(len(words))
            counts.append(len(begin))
            ids = np.zeros(begin[-1] + WINDOW, np.int64)
            ids[: len(words)] = [self.known[w] for w in words]
            own = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[::STRIDE]
            index.append(own[: len(begin)])
            sizes.append(np.minimum(WINDOW, len(words) - np.array(begin)))
        every, widths = np.concatenate(index), np.concatenate(sizes)
        logits = np.concatenate(
            [self.net.logits(self.room, every[at : at + most], widths[at : at + most]) for at in range(0, len(every), most)]
        )
        return np.split(logits, np.cumsum(counts)[:-1])


class Texts:
    """Texts as numbers of their words: four bytes a word, however often it occurs."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.number: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def add(self, text: str | None) -> None:
        words = split_words(text)
        for w in words:
            if w not in self.number:
                self.number[w] = len(self.names)
                self.names.append(w)
        self.rows.append(np.array([self.number[w] for w in words], np.int32))

    def words(self, row: np.ndarray) -> list[str]:
        return [self.names[i] for i in row]

    def counts(self, chosen: np.ndarray | None = None) -> np.ndarray:
        """In how many texts each word is."""
        out = np.zeros(len(self.names), np.int64)
        for i in range(len(self.rows)) if chosen is None else chosen:
            out[np.unique(self.rows[i])] += 1
        return out


def train(texts: Texts, labels: np.ndarray, rounds: int = 6, batch: int = 64, seed: int = 9) -> GatedNet:
    """A network from texts with labels 0 and 1."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(labels == 0), np.flatnonzero(labels == 1)
    seen, toxic = texts.counts(), texts.counts(bad)
    usual = sorted(np.flatnonzero(seen >= MIN_COUNT).tolist(), key=lambda i: (-seen[i], texts.names[i]))[:MAX_WORDS]
    net = GatedNet(sorted(texts.names[i] for i in usual))
    odds = np.log((toxic + 0.3) / (len(bad) + 1)) - np.log((seen - toxic + 0.3) / (len(good) + 1))
    hint = np.where(seen >= 3, odds, 0.0)
    net.start_from_counts((texts.words(np.unique(x)) for x in texts.rows), labels)
    adam = Adam(net)
    steps = max(60, 2 * len(texts.rows) // batch)
    for turn in range(rounds):
        scorer = Scorer(net)
        worst, other = [], []
        logits: list[np.ndarray] = []
        for at in range(0, len(texts.rows), 64) if turn else ():
            logits += scorer.window_logits([texts.words(x) for x in texts.rows[at : at + 64]])
        for i, row in enumerate(texts.rows):
            begin = windows_of(len(row))
            if turn:
                top = int(logits[i].argmax())
            else:  # the first choice follows words that toxic texts have more often
                top = int(np.argmax([hint[row[b : b + WINDOW]].max(initial=0) for b in begin]))
            worst.append(row[begin[top] : begin[top] + WINDOW])
            b = begin[int(rng.integers(len(begin)))]
            other.append(row[b : b + WINDOW])
        del scorer, logits
        for _ in range(steps):
            p, q, r = rng.choice(bad, batch // 2), rng.choice(good, batch // 3), rng.choice(good, batch - batch // 2 - batch // 3)
            own = [worst[i] for i in p] + [worst[i] for i in q] + [other[i] for i in r]
            truth = np.array([1.0] * len(p) + [0.0] * (len(q) + len(r)), np.float32)
            adam.apply(net.gradients([texts.words(x) for x in own], truth, rng))
        adam.rate *= 0.7
    return net


def train_from_input() -> None:
    """Reads pairs of a text and its label from the standard input, and writes the network to the standard output."""
    texts, labels = Texts(), []
    while (pair := pickle.load(sys.stdin.buffer)) is not None:
        texts.add(pair[0])
        labels.append(pair[1])
    texts.number.clear()
    sys.stdout.buffer.write(pickle.dumps(train(texts, np.array(labels))))
