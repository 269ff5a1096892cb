"""Problem 4: evaluation records that also stand, exactly or almost, in the training split."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import arrow_map, latest

#: Words (characters where the script has no spaces) of the longer text that must stand in the other.
SHARE = 0.8
#: Grams two texts must share among their rarest ones.
SHARED = 4
#: Characters of scripts without spaces for which one more gram must be shared.
WIDE_SHARED = 24
#: Words for which one more gram must be shared: the longer texts are, the more words any two of them have in common.
LONG_SHARED = 64
#: Counters of the frequency sketch: its size is fixed, whatever the corpus. It tells words that make up more than a millionth of a corpus
#: from others, which is what matters at any size; words that share a counter only look more frequent, and nothing is lost by the order.
SKETCH_BITS = 20
#: Texts that share a gram and meet in one task, about, on the evaluation side; a more frequent gram is split. Meetings are listed
#: in portions, so this bounds a task's time only, and each part of a split gram costs a copy of its training texts.
HOT_GRAM = 65_536
#: Indexed grams that one task holds, about, and the least number of parts they are dealt to.
PART_GRAMS, PARTS = 2_000_000, 32
#: Meetings looked at together.
PORTION = 1 << 18
#: Bits of the longest signature.
MOST_BITS = 4_096
#: Slots of the marks of texts to be compared: a fixed size, whatever the corpus; texts that share a slot are moved in vain.
MARK_BITS = 22
#: Texts of scripts without spaces that meet as many others in one task: each text is copied as often as there are blocks of about its length.
BLOCK = 16_384
#: Texts of a block that are compared with four times as many at once.
TILE = 512
#: Kinds of token told apart among a block's rare and frequent ones, and the share of its texts' tokens from which a kind is frequent.
RARE_KINDS, OFTEN = 64, 0.02
#: Pairs whose rare tokens are compared at once, and for each 64 of those tokens the least number of pairs for which that is worth it.
RARE_PAIRS, FEW_PAIRS = 8_192, 32
#: Ratio of the lengths that bound a band: texts that agree are at most 5 / 4 apart, so they lie in one band or in two side by side.
BAND = 1.26

#: Letters of scripts without spaces; the long mark of kana belongs to no script by itself.
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
TOKEN = regex.compile(rf"(?V1)[{UNSPACED}]|[[\p{{L}}\p{{M}}\p{{N}}]--[{UNSPACED}]]++")
#: The same for texts without such letters and without marks.
PLAIN_TOKEN = re.compile(r"[^\W_]+")
WIDE = regex.compile(f"[{UNSPACED}]")
HIDDEN = re.compile("[\xad͏؜​-‏‪-‮⁠-⁤︀-️﻿]")
LINES = re.compile("[^\n]*\n|[^\n]+")


@lru_cache(maxsize=1)
def _special() -> frozenset[str]:
    """The letters of scripts without spaces, and all marks."""
    every = "".join(chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return frozenset(regex.findall(rf"[\p{{M}}{UNSPACED}]", every))


def words(text: str) -> list[str]:
    """The words of a text, and the characters where its script has no spaces; case, spacing, punctuation and Unicode form aside."""
    text = HIDDEN.sub("", unicodedata.normalize("NFKC", text).casefold())
    return (PLAIN_TOKEN if text.isascii() or _special().isdisjoint(text) else TOKEN).findall(text)


def text_hash(text: str) -> bytes:
    """MD5 of the lines that aren't blank, with their line breaks."""
    kept = text if "\n" not in text and text.strip() else "".join(x for x in LINES.findall(text) if x.strip())
    return hashlib.md5(kept.encode("utf-8", "surrogatepass")).digest()


def word_key(text: str, w: list[str] | None = None) -> bytes:
    """Equal for texts of the same words; texts without words are told apart by what else they hold."""
    w = words(text) if w is None else w
    return hashlib.md5(("\x1f".join(w) if w else "\x1e" + "".join(text.split())).encode("utf-8", "surrogatepass")).digest()


def records(pairs: DataFrame, *keep: str) -> DataFrame:
    """ex_id, split, train, src, tgt, shash, thash and the columns ``keep`` of each record once, as it was loaded last.

    Hashes lose their case, spaces and prefix and become 16 bytes; what holds no MD5 is null. Splits
    other than train, dev and test, and records without an id, are left out.
    """

    def clean(c: str) -> Column:
        found = F.regexp_extract(F.lower(c), "(?:^|[^0-9a-f])([0-9a-f]{32})(?:[^0-9a-f]|$)", 1)
        return F.when(found != "", F.unhex(found)).alias(c)

    split = F.lower(F.trim("split")).alias("split")
    one = latest(pairs.select("ex_id", split, *keep, "src", "tgt", clean("shash"), clean("thash"), "loaded_at"), "ex_id")
    return one.where(F.col("split").isin("train", "dev", "test")).withColumn("train", F.col("split") == "train")


def _keys_of_texts(docs: DataFrame) -> DataFrame:
    """doc_id, md5, key (of its words), tokens (a number per word) and lone (those of scripts without spaces) of each text.

    One more row of each task, without a doc_id, has what it adds to the frequency sketch of grams:
    buckets and counts.
    """
    names = ["doc_id", "md5", "key", "tokens", "lone", "buckets", "counts"]
    lists = pa.list_(pa.int32()), pa.list_(pa.int64())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            md5s, keys_, rows, lones, seen = [], [], [], [], [np.empty(0, np.int64)]
            cache: dict[str, int] = {}
            for t in b.column("text").to_pylist():
                w = words(t)
                tokens = _tokens(w, cache)
                md5s.append(text_hash(t))
                keys_.append(word_key(t, w))
                rows.append(tokens.tobytes())
                lones.append(_lone(tokens))
                if _by_words(len(w), lones[-1]):
                    seen.append(_bucket(_grams(tokens)))
            often += np.bincount(np.concatenate(seen), minlength=len(often))
            none = [None] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(md5s, pa.binary()), pa.array(keys_, pa.binary()), pa.array(rows, pa.binary()), pa.array(lones, pa.int32()), *(pa.array(none, x) for x in lists)], names=names)
        at = np.flatnonzero(often)
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
        yield pa.RecordBatch.from_arrays([*(pa.array([None], k) for k in kinds), pa.array([at], lists[0]), pa.array([often[at]], lists[1])], names=names)

    texts = docs.select(F.col("doc_id").cast("bigint"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return texts.mapInArrow(keys, "doc_id bigint, md5 binary, key binary, tokens binary, lone int, buckets array<int>, counts array<bigint>")


def _tokens(w: list[str], cache: dict[str, int]) -> np.ndarray:
    """A number of 31 bits per word, by which words are compared from here on; the lowest bit tells characters of scripts without spaces."""
    for x in w:
        if x not in cache:
            cache[x] = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) >> 33 & ~1 | (len(x) == 1 and WIDE.match(x) is not None)
    return np.fromiter(map(cache.__getitem__, w), np.int32, len(w))


def _size(m: np.ndarray) -> np.ndarray:
    """The size of the signature of texts of ``m`` tokens, as the binary logarithm of its bits: 64 bits or more, and bits for five quarters of the tokens up to MOST_BITS."""
    return np.ceil(np.log2(np.clip(m * 1.25, 64, MOST_BITS))).astype(np.int64)


def _signature(grams: np.ndarray, size: int | None = None) -> np.ndarray:
    """A bit per class of numbered tokens, set where the text has an odd number of them. Signatures of two texts differ in at most as many bits as tokens have no counterpart."""
    bits = 1 << (int(_size(np.array([len(grams)]))[0]) if size is None else size)
    return np.packbits((np.bincount((grams ^ grams >> 32) & bits - 1, minlength=bits) & 1).astype(np.uint8), bitorder="little")


def _folded(signatures: np.ndarray) -> np.ndarray:
    """Signatures of half the bits, a row per text."""
    half = signatures.shape[1] // 2
    return signatures[:, :half] ^ signatures[:, half:]


def _lone(tokens: np.ndarray) -> int:
    """The characters of scripts without spaces."""
    return int((tokens & 1).sum())


def _by_length(m: int | Column, lone: int | Column) -> bool | Column:
    """Whether a text meets others by length: more than a fifth of its tokens are characters of scripts without spaces."""
    return lone * 5 > m


def _by_words(m: int | Column, lone: int | Column) -> bool | Column:
    """Whether a text meets others by its rarest words: at most two fifths of its tokens are such characters.

    Texts that agree have one of the two ways in common. Where one has at most a fifth of such
    characters, those are at most a quarter of the tokens in common, which are at least four fifths
    of the other text; with the fifth that is its own, it has at most two fifths.
    """
    return lone * 5 <= m * 2


def _numbered(grams: np.ndarray) -> np.ndarray:
    """The n-th of equal grams told apart, so that sets of them count like multisets."""
    out = grams.copy()
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    at = np.arange(len(ranked))
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.empty(0, bool)
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    with np.errstate(over="ignore"):
        out[order] = ranked + nth.astype(np.int64) * np.int64(0x632BE59BD9B4E019)
    return out


def _grams(tokens: np.ndarray, n: int = 1) -> np.ndarray:
    """Hashes of the runs of ``n`` tokens. Texts meet by n = 1, as one word in five may differ and no longer run is certain to be left whole; containment goes by n = 2."""
    g = np.zeros(max(0, len(tokens) - n + 1), np.int64)
    with np.errstate(over="ignore"):
        for k in range(n):
            g = g * np.int64(0x2545F4914F6CDD1D) + tokens[k : k + len(g)].astype(np.int64) * np.int64(0x5851F42D4C957F2D)
    return _numbered(g)


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> 33) & ((1 << SKETCH_BITS) - 1)


def shared_grams(a: np.ndarray, b: np.ndarray) -> int:
    """Runs of two tokens that stand in both, each as often as in the one that has it less often."""
    return len(np.intersect1d(_grams(a, 2), _grams(b, 2), assume_unique=True))


def least_shared(m: int, n: int) -> int:
    """Runs of two tokens that texts of ``m`` and ``n`` must share if four fifths of the longer one stand in order in the other: each token without a counterpart breaks at most one run."""
    common = -(-max(m, n) * 4 // 5)
    return 3 * common - m - n - 1


def _indexed(m: int, lone: int) -> tuple[int, int]:
    """How many of its rarest grams a text is indexed by, and how many of them a text that agrees must share."""
    miss = m // 5  # what a text that agrees may lack
    share = SHARED + m // LONG_SHARED + lone // WIDE_SHARED
    take = min(m, miss + share)
    return take, max(1, min(share, take - miss))


def common_order(a: list, b: list) -> int:
    """The most tokens of ``a`` that stand in the same order in ``b``: longest common subsequence, a bit per token of ``b``."""
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    ha, hb = len(a), len(b)
    while ha > low and hb > low and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
    where: dict = {}
    for k, t in enumerate(b[low:hb]):
        where[t] = where.get(t, 0) | 1 << k
    full = (1 << (hb - low)) - 1
    v = full
    for t in a[low:ha]:
        hit = v & where.get(t, 0)
        if hit:
            v = ((v + hit) | (v - hit)) & full
    return low + len(a) - ha + (hb - low - v.bit_count())


def _places(tokens: list[int]) -> dict[int, int]:
    """The places of each token, a bit per place."""
    where: dict[int, int] = {}
    for k, t in enumerate(tokens):
        where[t] = where.get(t, 0) | 1 << k
    return where


def _agree(a: list[int], n: int, where: dict[int, int]) -> bool:
    """Whether four fifths of the longer one's tokens of ``a`` and a text of ``n`` tokens at the places ``where`` stand in the same order.

    As in ``common_order``; given up once what is left of ``a`` can't make up for what is missing: its
    first p tokens lie in the first p + d of the other, d being what that may have for itself.
    """
    least = -(-max(len(a), n) * 4 // 5)
    full = (1 << n) - 1
    v, p = full, 0
    for part in range(1, 9):
        q = len(a) * part // 8
        for t in a[p:q]:
            hit = v & where.get(t, 0)
            if hit:
                v = ((v + hit) | (v - hit)) & full
        p, seen = q, min(n, q + n - least)
        if seen - (v & ((1 << seen) - 1)).bit_count() + len(a) - p < least:
            return False
    return True


class _Rare:
    """Which pairs of some texts may have ``least`` tokens in common order, told without comparing them in full.

    Tokens are parted into frequent kinds, of which two texts have no more in common than the lesser count of each, and rare
    ones, whose longest common subsequence is found for many pairs at once. Both together are never less than that of all tokens, however kinds are
    parted; rare kinds beyond RARE_KINDS go by those of others, which only makes it more. The kinds are told from some of the texts.
    """

    def __init__(self, tokens: list[np.ndarray], sizes: np.ndarray):
        n = len(tokens)
        some = np.unique(np.linspace(0, n - 1, min(n, 1024)).astype(np.int64))
        kinds, kind = np.unique(np.concatenate([tokens[k] for k in some]), return_inverse=True)
        of = np.unique(np.repeat(some, sizes[some]) * len(kinds) + kind)
        share = np.bincount(kind) / np.bincount(of % len(kinds), sizes[of // len(kinds)])
        code, often = np.zeros(len(kinds), np.int64), share > OFTEN
        for group, first in ((often, RARE_KINDS + 1), (~often, 0)):
            order = np.flatnonzero(group)[np.argsort(-share[group], kind="stable")]
            code[order] = np.arange(len(order)) % RARE_KINDS + first
        self.counts = np.zeros((n, RARE_KINDS), np.int32)
        rare = []
        for k, t in enumerate(tokens):
            at = np.minimum(np.searchsorted(kinds, t), len(kinds) - 1)
            c = np.where(kinds[at] == t, code[at], (t >> 1) % RARE_KINDS)
            self.counts[k] = np.bincount(c[c > RARE_KINDS] - RARE_KINDS - 1, minlength=RARE_KINDS)
            rare.append(c[c < RARE_KINDS].astype(np.uint8))
        self.sizes = np.array([len(r) for r in rare], np.int64)
        self.rare = np.full((n, max(1, self.sizes.max())), RARE_KINDS, np.uint8)
        for k, r in enumerate(rare):
            self.rare[k, : len(r)] = r
        # by word, text and kind: the places of the kind, a bit each; there once a text is asked for
        self.places, self.known = np.zeros((-(-self.rare.shape[1] // 64), n, RARE_KINDS + 1), np.uint64), np.zeros(n, bool)

    def may(self, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether texts ``i`` and ``j`` may have ``least`` tokens in common order."""
        left = least - np.minimum(self.counts[i], self.counts[j]).sum(1)
        out = left <= np.minimum(self.sizes[i], self.sizes[j])
        # in groups of about as many rare tokens; fewer pairs are sooner compared in full
        open_ = np.flatnonzero(out & (left > 0))
        size = np.maximum(self.sizes[i], self.sizes[j])[open_]
        group = np.floor(np.log(size) / np.log(BAND))
        for g in np.unique(group).tolist():
            x = open_[group == g]
            if len(x) >= FEW_PAIRS * -(-int(size[group == g].max()) // 64):
                out[x] = self._common(i[x], j[x], left[x])
        return out

    def _common(self, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
        new = np.unique(j[~self.known[j]])
        row, at = np.nonzero(self.rare[new] < RARE_KINDS)
        n = self.places.shape[1]
        np.add.at(self.places.reshape(-1), ((at >> 6) * n + new[row]) * (RARE_KINDS + 1) + self.rare[new[row], at], np.uint64(1) << (at & 63).astype(np.uint64))
        self.known[new] = True
        words, steps = max(1, -(-int(self.sizes[j].max()) // 64)), int(self.sizes[i].max())
        tables = [t.reshape(-1) for t in self.places[:words]]
        out, live = np.zeros(len(i), bool), np.arange(len(i))
        text, base, v = self.rare[i, :steps].astype(np.int64), j * (RARE_KINDS + 1), np.full((words, len(i)), np.iinfo(np.uint64).max, np.uint64)
        done = 0
        for part in range(4, 9):
            for step in range(done, steps * part // 8):
                where, carry = base + text[:, step], None
                for w in range(words):
                    hit = tables[w].take(where)
                    hit &= v[w]
                    total = v[w] + hit
                    over = total < hit
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    v[w] ^= hit
                    v[w] |= total
                    carry = over.astype(np.uint64)
            done = steps * part // 8
            common = words * 64 - np.bitwise_count(v).sum(0, dtype=np.int64)
            keep = common + np.maximum(self.sizes[i] - done, 0) >= least
            live, i, least, base, text, v = live[keep], i[keep], least[keep], base[keep], text[keep], v[:, keep]
        out[live] = True
        return out


def _together(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs in portions of about ``n``."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for x in pairs:
        held.append(x)
        size += len(x[0])
        if size >= n:
            yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
            held, size = [], 0
    if size:
        yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])


def _near_by_signature(signs: np.ndarray, sizes: np.ndarray, one: np.ndarray, two: np.ndarray, roles: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of texts of ``one`` and ``two`` (both by size), of use to each other and of about the same length, whose signatures are near enough for texts of that length, each once.

    Products of matrices of 1 and -1 tell in how many bits folded signatures differ; only near ones are looked at in full.
    """
    same, folded = len(one) == len(two) and (one == two).all(), signs.view(np.uint8)
    while folded.shape[1] * 8 > max(64, 2.5 * sizes.max()):
        folded = _folded(folded)
    bits = folded.shape[1] * 8
    marks = lambda rows: np.unpackbits(folded[rows], axis=1).astype(np.float32) * 2 - 1
    m, n = sizes[one], sizes[two]
    for at in range(0, len(one), TILE):
        own, left = m[at : at + TILE], marks(one[at : at + TILE])
        low = at if same else int(np.searchsorted(n * 5, own[0] * 4))
        high = int(np.searchsorted(n * 4, own[-1] * 5, side="right"))
        # texts that agree have at most two fifths of the shorter one's tokens without a counterpart
        least = (bits - 2 * (own * 2 // 5) - 0.5).astype(np.float32)[:, None]
        for to in range(low, high, 4 * TILE):
            x, y = np.nonzero(left @ marks(two[to : min(high, to + 4 * TILE)]).T >= least)
            x, y = x + at, y + to
            ok = (x < y) if same else np.ones(len(x), bool)
            most, less = np.maximum(m[x], n[y]), np.minimum(m[x], n[y])
            may = most + less - 2 * -(-most * 4 // 5)
            ok &= (may >= 0) & ((roles[one[x]] & 1) * (roles[two[y]] & 2) + (roles[one[x]] & 2) * (roles[two[y]] & 1) > 0)
            i, j, may = one[x[ok]], two[y[ok]], may[ok]
            for k in range(0, len(i), PORTION >> 4):
                z = slice(k, k + (PORTION >> 4))
                near = np.bitwise_count(signs[i[z]] ^ signs[j[z]]).sum(1, dtype=np.int32) <= may[z]
                yield i[z][near], j[z][near]


def _meet(rows: pa.Table) -> pa.Table:
    """a, b: texts of the rows' one block, or of one of its two blocks and the other, that agree by their tokens' numbers and are of use."""
    rows = rows.take(np.argsort(rows.column("m").to_numpy(), kind="stable"))
    sizes, roles, reps = (rows.column(x).to_numpy().astype(np.int64) for x in ("m", "roles", "rep"))
    tokens = [np.frombuffer(x, np.int32) for x in rows.column("tokens").to_pylist()]
    bits = int(np.clip(np.ceil(np.log2(sizes.max() * 4)), 6, 13))
    signs = np.stack([_signature(_grams(t), bits) for t in tokens]).view(np.uint64)
    side = rows.column("band").to_numpy().astype(np.int64) << 32 | rows.column("block").to_numpy()
    one, two = (np.flatnonzero(side == x) for x in (side.min(), side.max()))
    told = _Rare(tokens, sizes)
    places: dict[int, dict[int, int]] = {}
    lists: dict[int, list[int]] = {}
    left, right = [], []
    for i, j in _together(_near_by_signature(signs, sizes, one, two, roles), RARE_PAIRS):
        may = told.may(i, j, -(-np.maximum(sizes[i], sizes[j]) * 4 // 5))
        for x, y in zip(i[may].tolist(), j[may].tolist()):
            for k in (x, y):
                if k not in lists:
                    lists[k] = tokens[k].tolist()
            if y not in places:
                places[y] = _places(lists[y])
            if _agree(lists[x], len(lists[y]), places[y]):
                left.append(min(reps[x], reps[y]))
                right.append(max(reps[x], reps[y]))
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _met_by_length(nodes: DataFrame) -> DataFrame:
    """a, b: representatives, a < b, of texts mostly in scripts without spaces that agree in four fifths of the longer one's tokens.

    No gram is certain to be left whole where every fifth character may differ, and single
    characters are too frequent to be looked up. So texts of about the same length meet in blocks, and
    those whose signatures are near enough are compared.
    """
    spark = nodes.sparkSession
    rows = nodes.where("by_length").select("rep", "m", "roles", "tokens", F.floor(F.log("m") / F.log(F.lit(BAND))).cast("int").alias("band"))
    blocks = {r["band"]: -(-r["count"] // BLOCK) for r in rows.groupBy("band").count().collect()}  # a row per band
    tasks, no = [], 0
    for band, n in blocks.items():
        own = [(band, k) for k in range(n)]
        above = [(band + 1, k) for k in range(blocks.get(band + 1, 0))]
        for k, x in enumerate(own):
            for y in own[k:] + above:
                tasks += [(no, *z) for z in {x, y}]
                no += 1
    dealt = spark.createDataFrame(tasks, "task long, band int, block int")
    count = spark.createDataFrame(list(blocks.items()), "band int, n int")
    placed = rows.join(F.broadcast(count), "band").withColumn("block", F.pmod(F.xxhash64("rep"), "n").cast("int")).drop("n")
    return placed.join(F.broadcast(dealt), ["band", "block"]).groupBy("task").applyInArrow(_meet, "a bigint, b bigint")


#: What a part holds of a text: its representative, tokens, roles, the grams a text that agrees must share with it, and how many of its grams fall into the part.
ENTRY = np.dtype([("rep", "<i8"), ("m", "<i4"), ("need", "<i4"), ("roles", "u1"), ("n", "<i4")])
#: A gram's hash within the part, and its place in the text where it stands there once.
GRAM = np.dtype([("hash", "<u4"), ("at", "<u2")])
NOWHERE = 0xFFFF


def _indexed_parts(often: np.ndarray, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, rows: the rarest grams of the batches' texts dealt to parts by gram, with what tells in a part whether two texts may agree."""
    for b in batches:
        if not b.num_rows:
            continue
        found, places, sizes, needs, signs = [], [], [], [], []
        for t in b.column("tokens").to_pylist():
            tokens = np.frombuffer(t, np.int32)
            g = _grams(tokens)
            take, need = _indexed(len(g), _lone(tokens))
            rare = np.lexsort((g, often[_bucket(g)]))[:take]
            _, kind, times = np.unique(tokens, return_inverse=True, return_counts=True)
            found.append(g[rare])
            places.append(np.where((times[kind[rare]] == 1) & (rare < NOWHERE), rare, NOWHERE))
            sizes.append(take)
            needs.append(need)
            signs.append(_signature(g).tobytes())
        rep, m, roles = (b.column(c).to_numpy().astype(np.int64) for c in ("rep", "m", "roles"))
        n = np.array(sizes, np.int64)
        grams, at, text = np.concatenate(found), np.concatenate(places), np.repeat(np.arange(b.num_rows), n)
        role = roles[text]
        times = np.maximum(1, -(-often[_bucket(grams)] // HOT_GRAM))
        # a split gram: a text of use in training goes to all its parts, one of use in evaluation to one of them as such
        copies = np.where(role & 2 > 0, times, 1)
        own = rep[text].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        own = (own % times.astype(np.uint64)).astype(np.int64)
        row = np.repeat(np.arange(len(grams)), copies)
        each = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
        each = np.where(role[row] & 2 > 0, each, own[row])
        role = np.where(each == own[row], role[row], 2)
        with np.errstate(over="ignore"):
            grams = (grams[row] + each * np.int64(0x1000193ABCDEF01)).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        at, text = at[row], text[row]
        part = (grams >> np.uint64(32)).astype(np.int64) % parts
        order = np.lexsort((grams, role, text, part))
        part, text, role, grams, at = part[order], text[order], role[order], grams[order], at[order]
        new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (text[1:] != text[:-1]) | (role[1:] != role[:-1])]))
        entries = np.zeros(len(new), ENTRY)
        which = text[new]
        entries["rep"], entries["m"], entries["need"], entries["roles"] = rep[which], m[which], np.array(needs)[which], role[new]
        entries["n"] = np.diff(np.append(new, len(part)))
        rows = np.zeros(len(part), GRAM)
        rows["hash"], rows["at"] = grams & np.uint64(0xFFFFFFFF), at
        names, low = np.unique(part[new], return_index=True)
        out = []
        for x, y in zip(low, np.append(low[1:], len(new))):
            to = new[y] if y < len(new) else len(part)
            e = entries[x:y]
            columns = [np.ascontiguousarray(e[c]).tobytes() for c in ENTRY.names] + [np.ascontiguousarray(rows[new[x] : to][c]).tobytes() for c in GRAM.names]
            out.append(len(e).to_bytes(4, "little") + zstandard.compress(b"".join([*columns, *(signs[k] for k in which[x:y])]), 1))
        yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(out, pa.binary())], names=["part", "rows"])


def _opened(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries, grams and signatures (one after the other) of a part."""
    entries, grams, signs = [], [], []
    for r in rows:
        data, at = memoryview(zstandard.decompress(r[4:])), 0
        e = np.zeros(int.from_bytes(r[:4], "little"), ENTRY)
        for c in ENTRY.names:
            e[c] = np.frombuffer(data, ENTRY[c], len(e), at)
            at += len(e) * ENTRY[c].itemsize
        g = np.zeros(int(e["n"].sum()), GRAM)
        for c in GRAM.names:
            g[c] = np.frombuffer(data, GRAM[c], len(g), at)
            at += len(g) * GRAM[c].itemsize
        entries.append(e)
        grams.append(g)
        signs.append(np.frombuffer(data, np.uint8, offset=at))
    return np.concatenate(entries), np.concatenate(grams), np.concatenate(signs)


def _meet_by_words(part: pa.Table) -> pa.Table:
    """a, b, n, need: texts of a part, a < b, of use to each other, that share ``n`` of its grams and may agree by their lengths, by the grams' places and by their signatures."""
    e, g, signs = _opened(part.column("rows").to_pylist())
    m = e["m"].astype(np.int64)
    size = _size(m)
    starts = np.cumsum(1 << size - 3) - (1 << size - 3)
    # by size, the signatures of that size and the folded ones of the next
    tables, row = {}, np.zeros((2, len(e)), np.int64)
    for s in np.unique(size).tolist():
        here = np.flatnonzero(size == s)
        own = signs[starts[here][:, None] + np.arange(1 << s - 3)]
        if s > 6:
            fold = _folded(own)
            row[1, here] = np.arange(len(here)) + len(tables.get(s - 1, ()))
            tables[s - 1] = np.concatenate([tables[s - 1], fold]) if s - 1 in tables else fold
        row[0, here] = np.arange(len(here))
        tables[s] = own
    del signs
    tables = {s: np.ascontiguousarray(t).view(np.uint64) for s, t in tables.items()}
    key = g["hash"].astype(np.int64) << 31 | np.repeat(m, e["n"])
    order = np.argsort(key)
    key, text, at = key[order], np.repeat(np.arange(len(e), dtype=np.int32), e["n"])[order], g["at"][order].astype(np.int64)
    del order
    m_of = m[text]
    ends = np.searchsorted(key, key - m_of + m_of * 5 // 4, side="right")
    n = ends - np.arange(len(key)) - 1
    total = np.concatenate([[0], np.cumsum(n)])
    roles, rep = e["roles"], e["rep"]
    kept, k = [np.empty(0, np.int64)], 0
    while total[k] < total[-1]:
        to = max(k + 1, int(np.searchsorted(total, total[k] + PORTION, side="right")) - 1)
        x = np.repeat(np.arange(k, to), n[k:to])
        y = x + 1 + np.arange(len(x)) - np.repeat(total[k:to] - total[k], n[k:to])
        i, j, p, q = text[x], text[y], at[x], at[y]
        most, less = m[j], m[i]
        common = -(-most * 4 // 5)
        # the most tokens in common order that a pair of tokens at p and q may be one of
        through = np.minimum(p, q) + 1 + np.minimum(less - 1 - p, most - 1 - q)
        ok = ((roles[i] & 1) * (roles[j] & 2) + (roles[i] & 2) * (roles[j] & 1) > 0) & (rep[i] != rep[j]) & ((p == NOWHERE) | (q == NOWHERE) | (through >= common))
        i, j, may = i[ok], j[ok], (less + most - 2 * common)[ok]
        level = np.minimum(size[i], size[j])
        near = np.zeros(len(i), bool)
        for s in np.unique(level).tolist():
            z = np.flatnonzero(level == s)
            a, b = i[z], j[z]
            apart = tables[s][row[size[a] - s, a]] ^ tables[s][row[size[b] - s, b]]
            near[z] = np.bitwise_count(apart).sum(1, dtype=np.int32) <= may[z]
        kept.append(i[near].astype(np.int64) << 32 | j[near])
        k = to
    pair, times = np.unique(np.concatenate(kept), return_counts=True)
    i, j = pair >> 32, pair & 0xFFFFFFFF
    a, b, need = np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j]), np.minimum(e["need"][i], e["need"][j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(times, pa.int32()), "need": pa.array(need, pa.int32())})


def _met_by_words(nodes: DataFrame, counters: DataFrame) -> DataFrame:
    """a, b: representatives, a < b, of texts that share enough of their rarest grams and may agree.

    Texts meet, and meetings are dropped, within the parts the grams are dealt to: their number grows with the square of the corpus where the
    vocabulary doesn't grow, and only what is left of them is written.
    """
    # a fixed number of counters comes to the driver
    sums = counters.select(F.explode(F.arrays_zip("buckets", "counts")).alias("c")).groupBy("c.buckets").agg(F.sum("c.counts").alias("n")).toArrow()
    frequency = np.zeros(1 << SKETCH_BITS, np.int64)
    frequency[sums.column("buckets").to_numpy()] = sums.column("n").to_numpy()
    shared = nodes.sparkSession.sparkContext.broadcast(frequency)
    rows = nodes.where("by_words").select("rep", "m", "roles", "tokens")
    total = rows.agg(F.sum(F.floor(F.col("m") / 5) + F.floor(F.col("m") / LONG_SHARED) + SHARED)).first()[0] or 0
    parts = max(PARTS, -(-total // PART_GRAMS))
    dealt = rows.mapInArrow(lambda batches: _indexed_parts(shared.value, parts, batches), "part int, rows binary")
    met = dealt.groupBy("part").applyInArrow(_meet_by_words, "a bigint, b bigint, n int, need int")
    return met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where("n >= need").select("a", "b")


def _marked(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows whose ``rep`` may stand in ``pairs``, so that few others are moved for the comparison."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << MARK_BITS)).cast("int")
    # a fixed number of slots at most comes to the driver
    marks = pairs.select(F.explode(F.array("a", "b")).alias("rep")).select(slot("rep").alias("slot")).distinct().toArrow()
    known = np.zeros(1 << MARK_BITS, bool)
    known[marks.column("slot").to_numpy()] = True
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(known))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            yield b.filter(pa.array(known[b.column("slot").to_numpy()])).select(["rep", "tokens"])

    return rows.select("rep", "tokens", slot("rep").alias("slot")).mapInArrow(kept, "rep bigint, tokens binary")


def near_texts(nodes: DataFrame, counters: DataFrame) -> DataFrame:
    """a, b: representatives, a < b, of texts that agree in four fifths of the longer one's words, one of each pair of use in evaluation and the other in training; a_in_b, b_in_a: the share of the one's runs of two words that the other has.

    ``nodes``: rep (a doc_id), m, tokens, by_length, by_words, roles (1: evaluation, 2: training,
    3: both), a row per sequence of words in use. ``counters``: buckets, counts of the frequency sketch. The
    hashes of the texts' rarest grams (those the frequency sketch has least of) are dealt out by
    gram, where evaluation texts meet training texts: as many as another text may lack, and SHARED more, so that texts that
    agree share SHARED of them. Texts in scripts without spaces meet by length instead. Meetings of texts whose lengths, places of the gram or
    signatures are too far apart are dropped where they happen; of the pairs that share enough grams, those that contain too few of each other's
    runs of two words are dropped, and the rest is compared word by word.
    A gram of more than HOT_GRAM texts is split: each of its evaluation texts goes to one part, each training text to all.
    """
    pairs = stored(_met_by_words(nodes, counters).unionByName(_met_by_length(nodes)).distinct())
    # AQE sends the pairs to all executors where they are few, and deals out the tokens by text where they aren't
    texts = _marked(nodes, pairs)
    left = texts.select(F.col("rep").alias("a"), F.col("tokens").alias("s")).join(pairs, "a")
    right = texts.select(F.col("rep").alias("b"), F.col("tokens").alias("t"))

    def compare(b: pa.RecordBatch) -> pa.RecordBatch:
        keep, forth, back = [], [], []
        for s, t in zip(b.column("s").to_pylist(), b.column("t").to_pylist()):
            one, two = np.frombuffer(s, np.int32), np.frombuffer(t, np.int32)
            m, n = len(one), len(two)
            both = shared_grams(one, two)
            agree = both >= least_shared(m, n) and common_order(one.tolist(), two.tolist()) * 5 >= max(m, n) * 4
            keep.append(agree)
            forth.append(both / max(1, m - 1))
            back.append(both / max(1, n - 1))
        return pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(forth, pa.float64()), pa.array(back, pa.float64())], names=["a", "b", "a_in_b", "b_in_a"]).filter(pa.array(keep, pa.bool_()))

    return arrow_map(left.join(right, "b").select("a", "b", "s", "t"), "a bigint, b bigint, a_in_b double, b_in_a double", compare)


def _keyed(recs: DataFrame, texts: DataFrame) -> DataFrame:
    """ex_id, train, ks, kt: each record by the texts its sides stand for; ``texts``: doc_id, md5, rep.

    A text goes by the least doc_id of those with its words, a hash of no text at hand by a negative
    number. The sides are resolved once each, however many records name them.
    """
    mark = lambda h: F.coalesce(F.xxhash64(h), F.lit(0)).cast("bigint")
    none = F.lit(-1).cast("bigint")
    named = recs.select(F.explode(F.array(*[F.struct(F.coalesce(d, none).alias("doc_id"), F.col(h).alias("h")) for d, h in (("src", "shash"), ("tgt", "thash"))])).alias("s")).select("s.*").distinct()
    seen = named.join(texts, "doc_id", "left")
    own = seen.where("rep IS NOT NULL").select("doc_id", "h", F.col("rep").alias("node"))
    # a hash that isn't the text's own stands for another text, or for one that isn't at hand
    by_hash = texts.groupBy(F.col("md5").alias("h")).agg(F.min("rep").alias("other"))
    strange = seen.where("h IS NOT NULL AND (md5 IS NULL OR h <> md5)").select("doc_id", "h").join(by_hash, "h", "left")
    strange = strange.select("doc_id", "h", F.coalesce("other", -2 - F.xxhash64("h").bitwiseAND(F.lit((1 << 62) - 1))).alias("node"))
    sides = own.unionByName(strange).select("doc_id", mark("h").alias("m"), "node").distinct()
    out = recs.select("ex_id", "train", F.coalesce("src", none).alias("src"), mark("shash").alias("sm"), F.coalesce("tgt", none).alias("tgt"), mark("thash").alias("tm"))
    out = out.join(sides.select(F.col("doc_id").alias("src"), F.col("m").alias("sm"), F.col("node").alias("ks")), ["src", "sm"]).drop("src", "sm")
    return out.join(sides.select(F.col("doc_id").alias("tgt"), F.col("m").alias("tm"), F.col("node").alias("kt")), ["tgt", "tm"]).select("ex_id", "train", "ks", "kt")


def _resolved(recs: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records by the texts of their sides (ex_id, train, ks, kt), and the pairs of near texts, as from ``near_texts``."""
    told = stored(_keys_of_texts(docs))
    keys = told.where("doc_id IS NOT NULL")
    by_key = keys.groupBy("key").agg(F.min("doc_id").alias("rep"))
    texts = keys.select("doc_id", "md5", "key").join(by_key, "key").select("doc_id", "md5", "rep")
    keyed = stored(_keyed(recs, texts))
    sides = keyed.select(F.when(F.col("train"), 2).otherwise(1).alias("role"), F.explode(F.array("ks", "kt")).alias("rep")).where("rep >= 0").distinct()
    used = sides.groupBy("rep").agg(F.sum("role").cast("int").alias("roles"))
    nodes = keys.select(F.col("doc_id").alias("rep"), "tokens", "lone", (F.length("tokens") / 4).cast("int").alias("m")).where("m > 0").join(used, "rep")
    nodes = nodes.select("rep", "tokens", "m", "roles", _by_length(F.col("m"), F.col("lone")).alias("by_length"), _by_words(F.col("m"), F.col("lone")).alias("by_words"))
    return keyed, stored(near_texts(stored(nodes), told.where("doc_id IS NULL").select("buckets", "counts")))


def _matching_classes(keyed: DataFrame, near: DataFrame) -> DataFrame:
    """ks, kt, s, t: sides of evaluation records and of the training records they agree with, each once however many records have them."""
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = keyed.where(~F.col("train")).select("ks", "kt").distinct()
    t = keyed.where("train").select(F.col("ks").alias("s"), F.col("kt").alias("t")).distinct()
    by_src = e.withColumn("s", F.col("ks")).unionByName(e.join(both.select(F.col("a").alias("ks"), F.col("b").alias("s")), "ks").select("ks", "kt", "s"))
    by_both = by_src.withColumn("t", F.col("kt")).unionByName(by_src.join(both.select(F.col("a").alias("kt"), F.col("b").alias("t")), "kt").select("ks", "kt", "s", "t"))
    return by_both.join(t, ["s", "t"], "left_semi")


def cross_split_overlaps(recs: DataFrame, docs: DataFrame) -> DataFrame:
    """eval_id, train_id: each pair of a record of dev or test and one of train that agree in both sides.

    ``recs``: as from ``records``. ``docs``: doc_id (unique), text. Sides agree if their hashes are
    equal, or if their texts have the same words, or four fifths of the longer one's in the same
    order. A side with neither text nor hash agrees with none; empty texts agree with each other.
    Texts are first reduced to one per sequence of words, so copies are compared once however many
    there are, and records meet on both sides at once: neither a frequent text nor a frequent source
    multiplies anything but the pairs to be found. Texts that no record names are left out, and evaluation texts meet training texts only.
    """
    keyed, near = _resolved(recs, docs)
    e = keyed.where(~F.col("train")).select(F.col("ex_id").alias("eval_id"), "ks", "kt")
    t = keyed.where("train").select(F.col("ex_id").alias("train_id"), F.col("ks").alias("s"), F.col("kt").alias("t"))
    return _matching_classes(keyed, near).join(e, ["ks", "kt"]).join(t, ["s", "t"]).select("eval_id", "train_id")


def near_classes(recs: DataFrame, docs: DataFrame) -> DataFrame:
    """eval_doc, train_doc (the least doc_id with the words of each), containment: the share of the evaluation text's runs of two words that the near training text has."""
    keyed, near = _resolved(recs, docs)
    side = lambda train: keyed.where(F.col("train") == train).select(F.explode(F.array("ks", "kt")).alias("rep")).distinct()
    both = near.select(F.col("a").alias("eval_doc"), F.col("b").alias("train_doc"), F.col("a_in_b").alias("containment"))
    both = both.unionByName(near.select(F.col("b").alias("eval_doc"), F.col("a").alias("train_doc"), F.col("b_in_a").alias("containment")))
    return both.join(side(False).withColumnRenamed("rep", "eval_doc"), "eval_doc").join(side(True).withColumnRenamed("rep", "train_doc"), "train_doc").select("eval_doc", "train_doc", "containment")


def overlap_report(recs: DataFrame, docs: DataFrame) -> DataFrame:
    """Per split and ds: records, records that overlap with train, and pairs; ``recs`` with ds. Counted by classes, without a row per pair."""
    keyed, near = _resolved(recs, docs)
    train = keyed.where("train").groupBy(F.col("ks").alias("s"), F.col("kt").alias("t")).agg(F.count("*").alias("_n"))
    by_class = _matching_classes(keyed, near).join(train, ["s", "t"]).groupBy("ks", "kt").agg(F.sum("_n").alias("_pairs"))
    found = keyed.where(~F.col("train")).join(by_class, ["ks", "kt"]).select("ex_id", "_pairs")
    rows = recs.where(~F.col("train")).select("ex_id", "split", "ds").join(found, "ex_id", "left")
    return rows.groupBy("split", "ds").agg(
        F.count("*").alias("records"), F.count("_pairs").alias("overlapping"), F.coalesce(F.sum("_pairs"), F.lit(0)).alias("pairs")
    )
