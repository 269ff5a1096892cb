"""Forward passes of sequence encoders in numpy: embeddings, positions, attention, recurrence, poolers, heads.

Layers are functions of arrays with a mask (True: a token). They make up an encoder for
``encode.encode_with``: from lists of token ids to a matrix. Weights come from outside, or from a seed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

#: Numbers of the largest array a layer makes of the sequences encoded together, about: 2 MB, of which a layer holds a few.
NUMBERS = 1 << 18


def padded(seqs: list[list[int]], pad: int = 0, multiple: int = 1, left: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as a matrix, filled up to the longest (a multiple of ``multiple``), and its mask."""
    width = -(-max([1, *map(len, seqs)]) // multiple) * multiple
    ids, mask = np.full((len(seqs), width), pad, np.int64), np.zeros((len(seqs), width), bool)
    for k, s in enumerate(seqs):
        at = slice(width - len(s), width) if left else slice(0, len(s))
        ids[k, at], mask[k, at] = s, True
    return ids, mask


def padded_vectors(seqs: list[np.ndarray], dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of vectors (of ``dim`` numbers, if all are empty) filled up with zeros to the longest, and the mask."""
    dim = next((s.shape[1] for s in seqs if len(s)), dim or 1)
    out, mask = np.zeros((len(seqs), max([1, *map(len, seqs)]), dim)), np.zeros((len(seqs), max([1, *map(len, seqs)])), bool)
    for k, s in enumerate(seqs):
        out[k, : len(s)], mask[k, : len(s)] = s, True
    return out, mask


def parts_by_length(lengths: list[int], numbers: Callable[[int], int]) -> Iterator[list[int]]:
    """The places of sequences, from the shortest on, in parts that hold at most NUMBERS with padding; ``numbers``: of a sequence of some length. One that holds more is a part by itself."""
    part: list[int] = []
    for k in np.argsort(lengths, kind="stable").tolist():
        if part and (len(part) + 1) * numbers(lengths[k]) > NUMBERS:
            yield part
            part = []
        part.append(k)
    if part:
        yield part


def sinusoidal_positions(n: int, dim: int) -> np.ndarray:
    """sin(p / 10000 ** (2i / dim)) at even places and the cosine at odd ones."""
    angle = np.arange(n)[:, None] / 10000.0 ** (2 * (np.arange(dim) // 2)[None, :] / dim)
    return np.where(np.arange(dim)[None, :] % 2 == 0, np.sin(angle), np.cos(angle))


def layer_norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    x = x - x.mean(-1, keepdims=True)
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + eps) * scale + shift


def softmax(x: np.ndarray) -> np.ndarray:
    e = x - x.max(-1, keepdims=True)
    np.exp(e, out=e)
    e /= e.sum(-1, keepdims=True)
    return e


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * (x * x * x))))


ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"relu": lambda x: np.maximum(x, 0), "gelu": gelu, "tanh": np.tanh, "none": lambda x: x}


def attention(x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], heads: int) -> np.ndarray:
    """Attention of each token to the tokens of its sequence; ``w``: q, k, v, o matrices (dim x dim) with biases qb, kb, vb, ob.

    Scores are made for as many tokens at a time as NUMBERS has room for.
    """
    n, t, d = x.shape
    split = lambda y: y.reshape(n, t, heads, d // heads).transpose(0, 2, 1, 3)
    q, k, v = (split(x @ w[c] + w[c + "b"]) for c in "qkv")
    seen, step = np.empty_like(q), max(1, NUMBERS // max(1, n * heads * t))
    for at in range(0, t, step):
        scores = q[:, :, at : at + step] @ k.transpose(0, 1, 3, 2) / np.sqrt(d // heads)
        scores = np.where(mask[:, None, None, :], scores, -1e30)
        seen[:, :, at : at + step] = softmax(scores) @ v
    return seen.transpose(0, 2, 1, 3).reshape(n, t, d) @ w["o"] + w["ob"]


def transformer_layer(x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], heads: int, activation: str = "gelu", full: bool = True, norm_first: bool = False) -> np.ndarray:
    """Attention and, if ``full``, a feed-forward net, each added to its input and normalised behind (or before)."""
    if norm_first:
        x = x + attention(layer_norm(x, w["n1"], w["n1b"]), mask, w, heads)
    else:
        x = layer_norm(x + attention(x, mask, w, heads), w["n1"], w["n1b"])
    if not full:
        return x
    feed = lambda y: ACTIVATIONS[activation](y @ w["f1"] + w["f1b"]) @ w["f2"] + w["f2b"]
    if norm_first:
        return x + feed(layer_norm(x, w["n2"], w["n2b"]))
    return layer_norm(x + feed(x), w["n2"], w["n2b"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def recurrent(x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], kind: str = "lstm", backward: bool = False) -> np.ndarray:
    """States of an LSTM (gates i, f, g, o) or GRU (gates r, z, n); padding keeps the state and gives zeros. ``w``: wi, wh, bi, bh."""
    n, t, _ = x.shape
    size = w["wh"].shape[0]
    h, c = np.zeros((n, size)), np.zeros((n, size))
    out = np.zeros((n, t, size))
    for k in range(t - 1, -1, -1) if backward else range(t):
        a, b = x[:, k] @ w["wi"] + w["bi"], h @ w["wh"] + w["bh"]
        if kind == "lstm":
            i, f, g, o = np.split(a + b, 4, axis=1)
            new_c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
            new_h = sigmoid(o) * np.tanh(new_c)
        else:
            (ar, az, an), (br, bz, bn) = np.split(a, 3, axis=1), np.split(b, 3, axis=1)
            z = sigmoid(az + bz)
            new_h, new_c = (1 - z) * np.tanh(an + sigmoid(ar + br) * bn) + z * h, c
        on = mask[:, k, None]
        h, c = np.where(on, new_h, h), np.where(on, new_c, c)
        out[:, k] = np.where(on, new_h, 0)
    return out


def pooled(x: np.ndarray, mask: np.ndarray, how: str = "mean") -> np.ndarray:
    """One vector per sequence: mean or max over its tokens, its first or its last one, wherever the padding stands; zeros for an empty one."""
    some = mask.any(1)
    if how == "mean":
        return (x * mask[..., None]).sum(1) / np.maximum(mask.sum(1), 1)[:, None]
    if how == "max":
        return np.where(some[:, None], np.where(mask[..., None], x, -np.inf).max(1, initial=-np.inf), 0)
    at = mask.argmax(1) if how == "first" else mask.shape[1] - 1 - mask[:, ::-1].argmax(1)
    return np.where(some[:, None], x[np.arange(len(x)), at], 0)


def with_begin(x: np.ndarray, mask: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each sequence with the vector ``begin`` before it."""
    return np.concatenate([np.broadcast_to(begin, (len(x), 1, x.shape[2])), x], 1), np.concatenate([np.ones((len(x), 1), bool), mask], 1)


@dataclass
class SequenceEncoder:
    """Token vectors, positions, layers, pooling, and a dense layer behind it.

    ``kind``: average, transformer, lstm or gru. ``positions``: none, learned or sinusoidal. ``pool``: mean,
    max, first or last. Weights not given are drawn from ``seed``. The vocabulary is rounded up to a multiple of 8.
    """

    vocabulary: int
    dim: int = 32
    kind: str = "average"
    layers: int = 1
    heads: int = 4
    positions: str = "none"
    max_positions: int = 512
    pool: str = "mean"
    dense: int | None = None
    activation: str = "none"
    bidirectional: bool = False
    scaled: bool = False
    normalised: bool = False
    begin: bool = False
    full: bool = True
    norm_first: bool = False
    pad: int = 0
    seed: int = 1
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in ("average", "transformer", "lstm", "gru"):
            raise ValueError(f"no such encoder: {self.kind}")
        if self.kind == "transformer" and self.dim % self.heads:
            raise ValueError(f"{self.dim} numbers can't be dealt to {self.heads} heads")
        if self.bidirectional and self.dim % 2:
            raise ValueError("two directions need an even number of dimensions")
        rng = np.random.default_rng(self.seed)
        d, made = self.dim, {}
        draw = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
        made["tokens"] = rng.standard_normal((-(-self.vocabulary // 8) * 8, d))
        if self.positions == "learned":
            made["positions"] = rng.standard_normal((self.max_positions, d)) * 0.1
        if self.normalised:
            made |= {"tn": np.ones(d), "tnb": np.zeros(d)}
        if self.begin:
            made["begin"] = rng.standard_normal(d)
        for k in range(self.layers if self.kind != "average" else 0):
            if self.kind == "transformer":
                made |= {f"{k}.{c}": draw(d, d) for c in "qkvo"} | {f"{k}.{c}b": np.zeros(d) for c in "qkvo"}
                made |= {f"{k}.n{j}": np.ones(d) for j in (1, 2)} | {f"{k}.n{j}b": np.zeros(d) for j in (1, 2)}
                made |= {f"{k}.f1": draw(d, 4 * d), f"{k}.f1b": np.zeros(4 * d), f"{k}.f2": draw(4 * d, d), f"{k}.f2b": np.zeros(d)}
                continue
            size, gates = d // 2 if self.bidirectional else d, 4 if self.kind == "lstm" else 3
            for way in ("f", "b") if self.bidirectional else ("f",):
                made |= {f"{k}.{way}.wi": draw(d, gates * size), f"{k}.{way}.wh": draw(size, gates * size), f"{k}.{way}.bi": np.zeros(gates * size), f"{k}.{way}.bh": np.zeros(gates * size)}
        if self.dense:
            made |= {"dense": draw(d, self.dense), "denseb": np.zeros(self.dense)}
        for name, w in self.weights.items():
            if name in made and made[name].shape != w.shape:
                raise ValueError(f"weights {name} of shape {w.shape} instead of {made[name].shape}")
        self.weights = made | self.weights

    def _part(self, prefix: str) -> dict[str, np.ndarray]:
        return {k[len(prefix) :]: v for k, v in self.weights.items() if k.startswith(prefix)}

    def __call__(self, seqs: list[list[int]]) -> np.ndarray:
        tokens = self.weights["tokens"]

        def encoded(part: list[list[int]]) -> np.ndarray:
            ids, mask = padded(part, self.pad)
            x = tokens[ids % len(tokens)]
            return self.vectors(x * np.sqrt(self.dim) if self.scaled else x, mask)

        return self._in_parts([s or [self.pad] for s in seqs], encoded)

    def of_vectors(self, seqs: list[np.ndarray]) -> np.ndarray:
        """A vector for each sequence of vectors, however uneven they are."""
        return self._in_parts(seqs, lambda part: self.vectors(*padded_vectors(part, self.dim)))

    def _in_parts(self, seqs: list, encode: Callable[[list], np.ndarray]) -> np.ndarray:
        """``encode`` of all sequences, in parts of about the same length that a layer has room for."""
        heads = self.heads if self.kind == "transformer" else 0
        wide = self.dim if self.kind == "average" else 4 * self.dim
        out = np.empty((len(seqs), self.dense or self.dim))
        for part in parts_by_length([len(s) for s in seqs], lambda t: t * max(heads * t, wide)):
            out[part] = encode([seqs[k] for k in part])
        return out

    def vectors(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """A vector for each sequence of vectors, as of sentences or fragments."""
        w = self.weights
        if x.shape[2] != self.dim:
            raise ValueError(f"vectors of {x.shape[2]} numbers instead of {self.dim}")
        if self.begin:
            x, mask = with_begin(x, mask, w["begin"])
        if self.positions == "learned":
            x = x + w["positions"][np.minimum(np.arange(x.shape[1]), self.max_positions - 1)]
        elif self.positions == "sinusoidal":
            x = x + sinusoidal_positions(x.shape[1], self.dim)
        if self.normalised:
            x = layer_norm(x, w["tn"], w["tnb"])
        for k in range(self.layers if self.kind != "average" else 0):
            if self.kind == "transformer":
                x = transformer_layer(x, mask, self._part(f"{k}."), self.heads, full=self.full, norm_first=self.norm_first)
            else:
                ways = [recurrent(x, mask, self._part(f"{k}.{way}."), self.kind, way == "b") for way in (("f", "b") if self.bidirectional else ("f",))]
                x = np.concatenate(ways, axis=2)
        out = pooled(x, mask, self.pool)
        return ACTIVATIONS[self.activation](out @ w["dense"] + w["denseb"]) if self.dense else out


@dataclass
class HierarchicalEncoder:
    """Documents by levels: tokens to sentences, sentences to fragments, fragments to documents.

    ``sentence`` encodes token sequences; ``between`` (None: no such level) and ``document`` encode sequences of
    vectors; where there is no ``sentence`` level the whole document is one sequence. Widths must fit.
    """

    sentence: SequenceEncoder
    document: SequenceEncoder | None = None
    between: SequenceEncoder | None = None
    fragment: int = 16

    def __post_init__(self) -> None:
        width = self.sentence.dense or self.sentence.dim
        for level in (self.between, self.document):
            if level is not None:
                if level.dim != width:
                    raise ValueError(f"a level of {level.dim} numbers above one of {width}")
                width = level.dense or level.dim

    def __call__(self, docs: list[list[list[int]]]) -> np.ndarray:
        if self.document is None:
            return self.sentence([[t for s in d for t in s] for d in docs])
        flat = self.sentence([s for d in docs for s in (d or [[]])])
        rows, at = [], 0
        for d in docs:
            n = max(1, len(d))
            rows.append(flat[at : at + n])
            at += n
        if self.between is not None:
            parts = [r[k : k + self.fragment] for r in rows for k in range(0, len(r), self.fragment)]
            made, out, at = self.between.of_vectors(parts), [], 0
            for r in rows:
                n = -(-len(r) // self.fragment)
                out.append(made[at : at + n])
                at += n
            rows = out
        return self.document.of_vectors(rows)


def linear_head(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return x @ w + b


def mlp_head(x: np.ndarray, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray) -> np.ndarray:
    return np.tanh(x @ w1 + b1) @ w2 + b2
