"""Byte-level BPE over a whole partition with a pair occurrence index.

The words of a partition are laid out one behind the other as byte symbols. An index maps each
pair that has a merge rule to all its positions; the active ranks are taken in ascending order
from a heap, every occurrence of the pair is merged, and the lists of the pairs that arise or
vanish beside it are updated. A merge of rank r can only create pairs of a higher rank, so each
rank is met once, and each word comes out exactly as if it had been encoded alone.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Sequence

import numpy as np
import regex

#: The pattern that splits text before the merges (public tokenizer, byte_bpe_50k).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same language: only the first branch can begin with a letter, so it may stand first, and runs needn't be given back.
SPLIT = r""" ?\p{L}++|'(?:s|t|re|ve|m|ll|d)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"""

#: Lists of occurrences under this length are merged one by one.
SHORT = 24

#: Words whose ids a worker keeps from batch to batch; beyond that it starts anew. Only speed depends on it.
CACHE_WORDS = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1 stays, the rest follows from 256."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Numbers(dict):
    """Numbers words in the order in which they are first met."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = no = len(self)
        self.new.append(word)
        return no


class _Lists:
    """Lists of ids, one behind the other, by number."""

    def __init__(self) -> None:
        self.flat = np.empty(1 << 16, np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.n = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        k = len(sizes)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + k > len(self.sizes):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.sizes[self.n : self.n + k] = sizes
        self.starts[self.n : self.n + k] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.n += k

    def take(self, no: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers, one behind the other, and where each ends."""
        sizes = self.sizes[no]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        # the place of each id: its list's start plus the distance from the list's first id
        at = np.repeat(self.starts[no] - (ends - sizes), sizes)
        at += np.arange(total)
        return self.flat[at], ends


class PairIndexBPE:
    """Encoder for one vocabulary file of the ``tokenizers`` library (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        self.byte_id = np.zeros(256, np.int64)
        for stand_in, b in byte_alphabet().items():
            self.byte_id[b] = vocab[stand_in]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # rule r, in the order of the ranks, joins first[r] and second[r] to made[r]
        self.first = np.array([vocab[a] for a, _ in merges], np.int64)
        self.second = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = self.first << 32 | self.second
        self.rule_at = np.argsort(keys)
        self.keys = keys[self.rule_at]
        self.rules: dict[int, int] = dict(zip(keys.tolist(), range(len(keys))))
        self.split = regex.compile(SPLIT)
        self._reset()

    def _reset(self) -> None:
        self.word_no, self.words = _Numbers(), _Lists()

    def _rule_of(self, keys: np.ndarray) -> np.ndarray:
        """The rule number of each pair key, or -1."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.rule_at[at], -1)

    def merge_words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one behind the other, and the number of ids of each word.

        Long lists of occurrences are merged as arrays, short ones one by one over the same memory.
        """
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lengths + 1) - 1
        n = int(ends[-1]) + 1
        # one more place at the end stands for "nothing there"
        sym = np.full(n + 1, -1, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        sym[:-1][inside] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        prev = np.arange(-1, n, dtype=np.int64)
        prev[0] = n
        nxt = np.arange(1, n + 2, dtype=np.int64)
        nxt[n] = n
        first, second = self.first, self.second
        few: dict[int, list[int]] = {}
        many: dict[int, list[np.ndarray]] = {}
        active: list[int] = []
        known: set[int] = set()

        def note(positions: np.ndarray, rules: np.ndarray) -> None:
            """Put positions into the lists of their pairs."""
            kept = rules >= 0
            positions, rules = positions[kept], rules[kept]
            if len(rules) < SHORT:
                for p, r in zip(positions.tolist(), rules.tolist()):
                    if r in few:
                        few[r].append(p)
                    else:
                        few[r] = [p]
                    if r not in known:
                        known.add(r)
                        heapq.heappush(active, r)
                return
            order = np.argsort(rules, kind="stable")
            positions, rules = positions[order], rules[order]
            cuts = np.flatnonzero(np.diff(rules)) + 1
            for r, part in zip(rules[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts)):
                if len(part) < SHORT:
                    few.setdefault(r, []).extend(part.tolist())
                else:
                    many.setdefault(r, []).append(part)
                if r not in known:
                    known.add(r)
                    heapq.heappush(active, r)

        i0 = np.flatnonzero((sym[:-1] >= 0) & (sym[1:] >= 0))
        note(i0, self._rule_of(sym[i0] << 32 | sym[i0 + 1]))
        sym_at, prev_at, nxt_at = memoryview(sym), memoryview(prev), memoryview(nxt)
        get = self.rules.get
        while active:
            rule = heapq.heappop(active)
            known.discard(rule)
            a, b, new = int(first[rule]), int(second[rule]), int(self.made[rule])
            arrays, single = many.pop(rule, None), few.pop(rule, None)
            if arrays is None or a == b:
                at = sorted((single or []) + [p for x in arrays or () for p in x.tolist()])
                for i in at:
                    if sym_at[i] != a:
                        continue
                    j = nxt_at[i]
                    if sym_at[j] != b:
                        continue
                    sym_at[i] = new
                    sym_at[j] = -2
                    k = nxt_at[j]
                    nxt_at[i] = k
                    prev_at[k] = i
                    for p, pair in ((i, new << 32 | sym_at[k] if sym_at[k] >= 0 else -1), (h := prev_at[i], sym_at[h] << 32 | new if sym_at[h] >= 0 else -1)):
                        r = get(pair)
                        if r is not None:
                            if r in few:
                                few[r].append(p)
                            else:
                                few[r] = [p]
                            if r not in known:
                                known.add(r)
                                heapq.heappush(active, r)
                continue
            at = np.concatenate([*arrays, np.array(single, np.int64)]) if single else np.concatenate(arrays)
            at = at[sym[at] == a]
            j = nxt[at]
            fits = sym[j] == b
            at, j = at[fits], j[fits]
            sym[at] = new
            sym[j] = -2
            k = nxt[j]
            nxt[at] = k
            prev[k] = at
            prev[n] = n
            right = sym[k]
            is_ = right >= 0
            h = prev[at]
            left = sym[h]
            was = (left >= 0) & (left != new)  # an occurrence just before has this pair as its right one
            note(
                np.concatenate([at[is_], h[was]]),
                self._rule_of(np.concatenate([new << 32 | right[is_], left[was] << 32 | new])),
            )
        stands = sym[:-1] >= 0
        sums = np.concatenate([[0], np.cumsum(stands)])
        starts = np.concatenate([[0], ends[:-1] + 1])
        return sym[:-1][stands].astype(np.int32), sums[ends] - sums[starts]

    def _numbers(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word of all texts, and the number of words of each text."""
        if len(self.word_no) > CACHE_WORDS:
            self._reset()
        findall, number = self.split.findall, self.word_no.__getitem__
        parts = [np.empty(0, np.int64)]
        for t in texts:
            words = findall(t) if t else ()
            parts.append(np.fromiter(map(number, words), np.int64, len(words)))
        if self.word_no.new:
            self.words.add(*self.merge_words(self.word_no.new))
            self.word_no.new = []
        return np.concatenate(parts), np.fromiter(map(len, parts[1:]), np.int64, len(parts) - 1)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts as one array, and offsets of the texts in it; a null or empty text has none."""
        no, per_text = self._numbers(texts)
        ids, ends = self.words.take(no)
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]

    def count(self, texts: Sequence[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        no, per_text = self._numbers(texts)
        sums = np.concatenate([[0], np.cumsum(self.words.sizes[no], dtype=np.int64)])
        return np.diff(sums[np.concatenate([[0], np.cumsum(per_text)])])


_ENCODERS: dict[str, PairIndexBPE] = {}


def encoder(path: str) -> PairIndexBPE:
    """One encoder per worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PairIndexBPE(path)
    return _ENCODERS[path]
