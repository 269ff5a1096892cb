"""Problem 3: items over a size limit cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map

#: Configurations a call takes at most; they are settings, not data, and are held in memory.
MAX_CONFS = 10_000
#: Characters whose sparse table is held at a time (a longer text has a table of its own).
TABLE_CHARS = 1_000_000

# Classes of characters
OTHER, SPACE, BREAK, STOP, WIDE_STOP, COMMA, WIDE_COMMA, CLOSER, JOINED = range(9)
# Strengths of a cut: none may stand before a combining mark or inside a CR LF
FORBIDDEN, ANYWHERE, AT_SPACE, AT_CLAUSE, AT_SENTENCE, AT_LINE, AT_PARAGRAPH = range(7)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of each code point."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if ch.isspace():
            table[c] = SPACE
        elif kind in ("Mn", "Mc", "Me"):
            table[c] = JOINED
        elif kind in ("Pe", "Pf") or ch in "\"'":
            table[c] = CLOSER
    for chars, k in (
        ("\n\r\x0b\x0c\x85\u2028\u2029", BREAK),
        (".!?\u2026\u0964\u0965\u061f\u06d4", STOP),
        ("\u3002\uff01\uff1f\uff61\uff0e\u203c\u2047", WIDE_STOP),
        (",;:\u2013\u2014\u060c\u061b", COMMA),
        ("\uff0c\u3001\uff1b\uff1a", WIDE_COMMA),
        ("\u200c\u200d\ufe0e\ufe0f", JOINED),
    ):
        for ch in chars:
            table[ord(ch)] = k
    return table


def cut_strengths(cp: np.ndarray) -> np.ndarray:
    """For each position the strength of a cut before it; ``cp``: code points."""
    n = len(cp)
    kind = char_classes()[cp]
    out = np.full(n, ANYWHERE, np.uint8)
    if n == 0:
        return out
    at = np.arange(n)
    white = (kind == SPACE) | (kind == BREAK)
    # the last character before each position that is neither white space nor closing
    solid = np.maximum.accumulate(np.where(white | (kind == CLOSER), -1, at))
    word = np.maximum.accumulate(np.where(white, -1, at))
    before = kind[:-1]
    ends = np.where(solid[:-1] >= 0, kind[solid[:-1]], OTHER)
    last = np.where(word[:-1] >= 0, kind[word[:-1]], OTHER)
    s = out[1:]
    here = white[:-1] & ~white[1:]
    s[white[:-1]] = AT_SPACE
    s[((here & (last == COMMA)) | (before == WIDE_COMMA))] = AT_CLAUSE
    wide = (ends == WIDE_STOP) & (white[:-1] | (before == CLOSER) | (before == WIDE_STOP))
    s[((here & ((ends == STOP))) | wide) & (kind[1:] != CLOSER) & (kind[1:] != WIDE_STOP)] = AT_SENTENCE
    broken = before == BREAK
    s[broken & (kind[1:] != BREAK)] = AT_LINE
    two = np.zeros(n - 1, bool)
    lf = cp == 10
    # a line break after which, white space aside, another one came
    breaks = np.cumsum(lf)
    at_word = np.maximum(word[:-1], 0)
    two[:] = (breaks[:-1] - np.where(word[:-1] >= 0, breaks[at_word], 0)) >= 2
    s[broken & two & (kind[1:] != BREAK)] = AT_PARAGRAPH
    s[(cp[:-1] == 13) & (cp[1:] == 10)] = FORBIDDEN
    s[kind[1:] == JOINED] = FORBIDDEN
    out[0] = FORBIDDEN
    return out


class StrongestCut:
    """Sparse table of range maxima over cut strengths; equal strengths go to the position further right."""

    def __init__(self, strengths: np.ndarray, longest: int):
        wide = len(strengths) >= 1 << 28
        self.shift = 60 if wide else 28
        kind = np.int64 if wide else np.int32
        level = strengths.astype(kind) << self.shift | np.arange(len(strengths), dtype=kind)
        self.levels = [level]
        step = 1
        while 2 * step <= min(longest, len(level)):
            level = np.maximum(level[:-step], level[step:])
            self.levels.append(level)
            step *= 2
        self.views = [memoryview(x) for x in self.levels]

    def query(self, lo: int, hi: int) -> tuple[int, int]:
        """Strength and position of the strongest cut in lo..hi (both included)."""
        k = min((hi - lo + 1).bit_length() - 1, len(self.views) - 1)
        step = 1 << k
        v = self.views[k]
        best = v[lo]
        if (last := v[hi - step + 1]) > best:
            best = last
        at = lo + step
        while at + step <= hi:  # only where the window is longer than the table was made for
            best = max(best, v[at])
            at += step
        return best >> self.shift, best & ((1 << self.shift) - 1)


def piece_bounds(table: StrongestCut, start: int, end: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of the text at start..end of at most ``limit`` characters, each from ``overlap`` before the last cut.

    A cut is looked for in the latter half of what is permitted, then in all of it.
    """
    overlap = min(max(overlap, 0), limit - 1)
    pieces = []
    while end - start > limit:
        hi, low = start + limit, start + overlap + 1
        strength, cut = table.query(min(hi, max(low, start + (limit + overlap + 1) // 2)), hi)
        if strength <= ANYWHERE:
            strength, cut = table.query(low, hi)
            if strength == FORBIDDEN:
                cut = hi
        pieces.append((start, cut))
        start = cut - overlap
    pieces.append((start, end))
    return pieces


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about TABLE_CHARS characters."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > TABLE_CHARS:
            yield first, k
            first, size = k, 0
        size += len(t or "")
    if first < len(texts):
        yield first, len(texts)


def split_oversized(docs: DataFrame, confs: DataFrame, default_size: int = 512, with_text: bool = False) -> DataFrame:
    """Pieces of each text that is longer than a configuration's ``max_chunk_size``.

    ``docs``: doc_id, text. ``confs``: conf_id, split_input, max_chunk_size (null: ``default_size``),
    chunk_overlap (null: 0). Returns doc_id, conf_id and pieces, an array of (start_pos, end_pos[, text])
    in code points. A text of exactly the limit, a null or an empty one has no row; a limit under 1
    counts as 1; an overlap as large as the limit is lowered to one less. Repeated rows give repeated
    rows; further columns are not read. One pass without a shuffle: a text is never taken apart
    between tasks, and its table takes 4 bytes a character and level.
    """
    rows = confs.where(F.col("split_input")).select("conf_id", "max_chunk_size", "chunk_overlap").limit(MAX_CONFS + 1).collect()
    if len(rows) > MAX_CONFS:
        raise ValueError(f"more than {MAX_CONFS} configurations")
    settings = [(r[0], max(1, default_size if r[1] is None else r[1]), r[2] or 0) for r in rows]
    longest = max([1, *(s for _, s, _ in settings)])
    least = min([s for _, s, _ in settings], default=0)
    source = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.char_length("text") > least))
    if not settings:
        source = source.where("false")
    fields = [T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())]
    if with_text:
        fields.append(T.StructField("text", T.StringType()))
    piece = T.StructType(fields)
    schema = T.StructType([source.schema["doc_id"], T.StructField("conf_id", confs.schema["conf_id"].dataType), T.StructField("pieces", T.ArrayType(piece))])
    arrow_piece = pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), *([("text", pa.string())] if with_text else [])])
    conf_type = pa.int32() if isinstance(confs.schema["conf_id"].dataType, T.IntegerType) else pa.int64()

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column("text").to_pylist()
        row: list[int] = []
        conf: list[int] = []
        sizes: list[int] = [0]
        starts: list[int] = []
        ends: list[int] = []
        out_texts: list[str] = []
        for first, last in _groups(texts):
            joined = "".join(texts[first:last])
            # a lone surrogate can't come from a string column, but must not end a task
            cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            table = StrongestCut(cut_strengths(cp), longest + 1)
            at = 0
            for k in range(first, last):
                t = texts[k]
                for conf_id, limit, overlap in settings:
                    if len(t) > limit:
                        found = piece_bounds(table, at, at + len(t), limit, overlap)
                        row.append(k)
                        conf.append(conf_id)
                        sizes.append(len(found))
                        starts += [s - at for s, _ in found]
                        ends += [e - at for _, e in found]
                        if with_text:
                            out_texts += [t[s - at : e - at] for s, e in found]
                at += len(t)
        arrays = [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), *([pa.array(out_texts, pa.string())] if with_text else [])]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(arrow_piece)))
        return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(conf, conf_type), lists], names=["doc_id", "conf_id", "pieces"])

    return arrow_map(source, schema, cut)


def pieces_of(split: DataFrame) -> DataFrame:
    """One row per piece: doc_id, conf_id, piece_no, start_pos, end_pos[, text]."""
    return split.select("doc_id", "conf_id", F.posexplode("pieces").alias("piece_no", "p")).select("doc_id", "conf_id", "piece_no", "p.*")


def splitting_faults(docs: DataFrame, confs: DataFrame, pieces: DataFrame, default_size: int = 512) -> DataFrame:
    """Per conf_id: texts that are split, and what must be 0: texts without all of their characters, pieces over the limit, overlaps of wrong length, pieces that aren't the text's. ``pieces``: as from ``pieces_of``, with text."""
    limits = confs.where("split_input").select("conf_id", F.greatest(F.coalesce("max_chunk_size", F.lit(default_size)), F.lit(1)).alias("_size"), F.coalesce("chunk_overlap", F.lit(0)).alias("_overlap"))
    # at most MAX_CONFS rows, as ``split_oversized`` checks
    cut_ = pieces.join(F.broadcast(limits), "conf_id").join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id")
    wrong = F.substring("_text", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos")) != F.col("text")
    per = cut_.groupBy("conf_id", "doc_id").agg(
        F.array_sort(F.collect_list(F.struct("piece_no", "start_pos", "end_pos"))).alias("p"), F.first(F.char_length("_text")).alias("n"),
        F.first("_size").alias("size"), F.first("_overlap").alias("overlap"), F.count_if(wrong).alias("wrong"),
    )
    steps = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: a["end_pos"] - b["start_pos"])
    ends = (F.element_at("p", 1)["start_pos"] != 0) | (F.element_at("p", -1)["end_pos"] != F.col("n"))
    rows = per.select(
        "conf_id", ends.alias("missing"), F.size(F.filter("p", lambda x: x["end_pos"] - x["start_pos"] > F.col("size"))).alias("long"),
        F.size(F.filter(steps, lambda x: x != F.least("overlap", F.col("size") - 1))).alias("apart"), "wrong",
    )
    return rows.groupBy("conf_id").agg(
        F.count("*").alias("texts"), F.count_if("missing").alias("missing"), F.sum("long").alias("too_long"), F.sum("apart").alias("overlap_wrong"), F.sum("wrong").alias("text_wrong")
    )
