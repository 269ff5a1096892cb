"""Batches under budgets: greedy folds, length buckets, and batches without near-duplicates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .order import ranked, ranked_within, seeded_hash

#: Items folded together, in order, in one task.
BLOCK_ITEMS = 50_000


def greedy_batches(items: DataFrame, max_sents: int, max_tokens: int, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """id, tokens, block and batch (from 0 in each block): items in the order of their ids, a new batch where an item would exceed either limit.

    ``items``: id (unique), tokens (null or 0: 1, for a padding token)[, sents: the sentences of a text; else each item is one].
    The first item of a batch always fits. The fold is
    sequential, so items are first cut into blocks of ``block_items`` in their order; each block
    begins a batch, and no task holds more than a block.
    """
    sents = F.greatest(F.coalesce(F.col("sents"), F.lit(1)), F.lit(1)) if "sents" in items.columns else F.lit(1)
    sized = items.select("id", F.greatest(F.coalesce(F.col("tokens"), F.lit(0)), F.lit(1)).cast("bigint").alias("tokens"), sents.cast("bigint").alias("sents"))
    rows = ranked(sized, F.col("id"), name="_no").withColumn("block", F.floor((F.col("_no") - 1) / block_items))

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        out, batch, n, held = [], 0, 0, 0
        for x, s in zip(t.column("tokens").to_pylist(), t.column("sents").to_pylist()):
            if n and (n + s > max_sents or held + x > max_tokens):
                batch, n, held = batch + 1, 0, 0
            n, held = n + s, held + x
            out.append(batch)
        return t.drop_columns(["_no", "sents"]).append_column("batch", pa.array(out, pa.int64()))

    schema = rows.drop("_no", "sents").withColumn("batch", F.lit(0).cast("bigint")).schema
    return rows.select("id", "tokens", "sents", "_no", "block").groupBy("block").applyInArrow(fold, schema)


def length_chunks(items: DataFrame, max_items: int, max_tokens: int, block: str = "block") -> DataFrame:
    """Adds chunk: in each block, items from the longest on, under both limits counted with the padding to the longest item of the chunk.

    ``items``: block, id, tokens. The order of the input is in ``id`` and can be restored by it.
    """

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by([("tokens", "descending"), ("id", "ascending")])
        out, chunk, n, longest = [], 0, 0, 0
        for x in t.column("tokens").to_pylist():
            if n and (n + 1 > max_items or (n + 1) * longest > max_tokens):
                chunk, n = chunk + 1, 0
            longest = x if not n else longest
            n += 1
            out.append(chunk)
        return t.append_column("chunk", pa.array(out, pa.int64()))

    return items.groupBy(block).applyInArrow(fold, T.StructType(items.schema.fields + [T.StructField("chunk", T.LongType())]))


def fixed_batches(items: DataFrame, size: int) -> DataFrame:
    """Adds batch: items in the order of their ids in batches of ``size``."""
    return ranked(items, F.col("id"), name="_no").withColumn("batch", F.floor((F.col("_no") - 1) / size)).drop("_no")


def bucket_order(lengths: DataFrame) -> DataFrame:
    """Adds place: in each bucket, sources by length (longest first) and hash, positives before negatives, short targets first. A bucket may be of any size."""
    return ranked_within(lengths, ["bucket"], F.col("slen").desc(), F.col("shash"), F.col("label").desc(), F.col("tlen"), F.col("ex_id"))


def apart_from_duplicates(
    items: DataFrame, batch_size: int, max_sents: int | None = None, max_tokens: int | None = None, multiple: int = 1, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """id, block, batch, negatives (ids) and fill (ids): batches in which no item names another one as its duplicate.

    ``items``: id, tokens, dups (array of ids; null: none)[, negatives: array of (id, tokens)]. In each block, items go from the longest
    on (those with fewer duplicates first) into the batch being filled; an item that names, or is
    named by, one in it waits for a later batch, before shorter ones. A batch is closed by the number of items, by ``max_sents`` (two for an
    item and one for each negative) or by ``max_tokens``; an item beyond a limit by itself is a batch of its own. ``negatives``: those of the item that
    aren't in the batch yet, by itself or as an item's or its duplicates' id. ``fill`` (of a batch's first item): negatives of its items' block that
    bring a batch of eight targets or more to a ``multiple``, as far as there are any. What a block can't fill up goes to a last block of its
    own, once more in blocks, so a block's short batches are filled as far as may be. Duplicates in other blocks can't meet.
    """
    none = F.array().cast("array<struct<id:bigint,tokens:bigint>>")
    hard = F.coalesce(F.col("negatives").cast("array<struct<id:bigint,tokens:bigint>>"), none) if "negatives" in items.columns else none
    rows = items.select("id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), F.coalesce("dups", F.array().cast("array<bigint>")).alias("dups"), hard.alias("negatives"))
    rows = ranked(rows, F.col("id"), name="_no").withColumn("block", F.floor((F.col("_no") - 1) / block_items)).drop("_no")
    schema = "id bigint, block bigint, batch bigint, negatives array<bigint>, fill array<bigint>, short boolean"

    def deal(t: pa.Table) -> pa.Table:
        cols = (t.column(c).to_pylist() for c in ("id", "tokens", "dups", "negatives"))
        every = sorted(zip(*cols), key=lambda x: (-x[1], len(x[2]), x[0]))
        spare = [(n["id"], n["tokens"]) for x in every for n in x[3]]
        out, batch = [], 0
        while every:
            barred: set[int] = set()  # what is in the batch, and what duplicates that
            inside: set[int] = set()
            taken, wait, sents, held = [], [], 0, 0
            for k, (i, n, dups, negatives) in enumerate(every):
                if i in barred or not inside.isdisjoint(dups):
                    wait.append(every[k])
                    continue
                new = {x["id"]: x["tokens"] for x in negatives if x["id"] not in barred and x["id"] != i and x["id"] not in dups}
                more, size = 2 + len(new), 2 * n + sum(new.values())
                if taken and (len(taken) + 1 > batch_size or max_sents is not None and sents + more > max_sents or max_tokens is not None and held + size > max_tokens):
                    wait += every[k:]
                    break
                inside.add(i)
                barred.update(dups, new, [i])
                taken.append((i, list(new)))
                sents, held = sents + more, held + size
            fill: list[int] = []
            targets = len(taken) + sum(len(x) for _, x in taken)
            if multiple > 1 and targets >= 8:
                for x, n in spare:
                    if (targets + len(fill)) % multiple == 0 or max_sents is not None and sents + len(fill) >= max_sents or max_tokens is not None and held + n > max_tokens:
                        break
                    if x not in barred:
                        barred.add(x)
                        fill.append(x)
                        held += n
            short = len(taken) < batch_size and not wait
            out += [(i, batch, x, fill if k == 0 else [], short) for k, (i, x) in enumerate(taken)]
            every, batch = wait, batch + 1
        block = t.column("block")[0].as_py()
        ids = pa.list_(pa.int64())
        return pa.table({"id": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([block] * len(out), pa.int64()), "batch": pa.array([x[1] for x in out], pa.int64()), "negatives": pa.array([x[2] for x in out], ids), "fill": pa.array([x[3] for x in out], ids), "short": pa.array([x[4] for x in out], pa.bool_())})

    first = cut(rows.groupBy("block").applyInArrow(deal, schema))
    # the last batch of each block, if it isn't full, goes to blocks after all others
    left = first.where("short").select("id").join(rows.drop("block"), "id")
    again = ranked(left, F.col("id"), name="_no").withColumn("block", -1 - F.floor((F.col("_no") - 1) / block_items)).drop("_no")
    again = again.select("id", "tokens", "dups", "negatives", "block").groupBy("block").applyInArrow(deal, schema)
    return first.where("NOT short").unionByName(again).drop("short")


def source_batches(
    lengths: DataFrame, max_docs: int, max_tokens: int, positives: tuple[int, int] = (1, 2), negatives: tuple[int, int] = (1, 2), seed: int = 3, max_sents: int | None = None, per_block: int = 1_000, acceptable: float = 0.5
) -> DataFrame:
    """block, batch, src, tgt, label, thash, new (whether the text is new in its batch), cut (tokens it is cut to; null: whole): training batches of sources with their targets.

    ``lengths``: ex_id, src, tgt, label, slen, tlen, shash, thash[, ssents, tsents]. Of each source that has positives, as many
    positives and negatives as a seeded hash says, within the two ranges, are drawn; each task keeps the most that may be of a source before
    any are shuffled, so no source is large from there on. Blocks of ``per_block`` sources, by hash, are folded: sources from the longest on,
    each with one positive and one negative, then with others in turn while documents, sentences and tokens last; a text that is in the batch already costs
    nothing. A source that doesn't fit closes the batch; one that doesn't fit into a batch of its own has its texts cut in proportion, unless
    more than ``acceptable`` would be lost on average: then it is left out. A batch of one source with nothing but positives is left out.
    """
    sents = [F.coalesce(F.col(c), F.lit(1)).alias(c) if c in lengths.columns else F.lit(1).alias(c) for c in ("ssents", "tsents")]
    rows = lengths.where(F.col("shash").isNotNull()).select("ex_id", "src", "tgt", "label", "slen", "tlen", "shash", "thash", *sents)
    most = F.when(F.col("label") == 1, positives[1]).otherwise(negatives[1])
    least = F.when(F.col("label") == 1, positives[0]).otherwise(negatives[0])
    h = seeded_hash(seed, F.col("src"), F.col("tgt"), F.col("ex_id"))
    digit = F.conv(F.substring(seeded_hash(seed, F.col("src"), F.col("label")), 1, 4), 16, 10).cast("bigint")
    rows = rows.withColumn("_no", F.row_number().over(Window.partitionBy("src", "label").orderBy(h, "ex_id"))).where(F.col("_no") <= max(positives[1], negatives[1]))
    rows = rows.where(F.col("_no") <= least + F.pmod(digit, most - least + 1))
    rows = rows.join(rows.where("label = 1").select("src").distinct(), "src", "left_semi")
    numbered = ranked(rows.select("shash", "src").distinct(), F.col("shash"), F.col("src"), name="_s")
    rows = rows.join(numbered.select("src", F.floor((F.col("_s") - 1) / per_block).alias("block")), "src")
    limit = max_sents if max_sents is not None else 1 << 60

    def fold(t: pa.Table) -> pa.Table:
        names = ("src", "slen", "shash", "ssents", "_no", "label", "tgt", "tlen", "tsents", "thash")
        by: dict[tuple, list] = {}
        for s, n, h_, k, no, *target in zip(*(t.column(c).to_pylist() for c in names)):
            by.setdefault((-n, h_, s, k), []).append((no, -target[0], *target))
        out: list[tuple] = []
        batch: list[tuple] = []
        inside: set[str] = set()
        state = [0, 0, 0]  # documents, sentences, tokens

        def flush() -> None:
            sources, wrong = {x[0] for x in batch}, any(x[2] != 1 for x in batch)
            if batch and (len(sources) > 1 or wrong):
                no = out[-1][0] + 1 if out else 0
                out.extend((no, *x) for x in batch)
            batch.clear()
            inside.clear()
            state[:] = [0, 0, 0]

        def pick(s: int, n: int, k: int, targets: list) -> tuple[list, list[int], bool]:
            """The targets taken, what they cost, and whether the first ones fit."""
            # one positive and one negative first, then in turn
            order = sorted(targets)
            cost, taken, seen = [1, k, n], [], set(inside)
            need = {x[2] for x in order if x[0] == 1}
            for no, _, label, g, m, e, h_ in order:
                new = h_ not in seen
                add = [1, e, m] if new else [0, 0, 0]
                after = [state[j] + cost[j] + add[j] for j in range(3)]
                if (after[0] > max_docs or after[1] > limit or after[2] > max_tokens) and not (no == 1 and label in need):
                    break
                cost = [x + y for x, y in zip(cost, add)]
                seen.add(h_)
                taken.append((s, g, label, h_, new, m))
            return taken, cost, state[0] + cost[0] <= max_docs and state[1] + cost[1] <= limit and state[2] + cost[2] <= max_tokens

        for (n, _, s, k), targets in sorted(by.items()):
            taken, cost, fits = pick(s, -n, k, targets)
            if not fits and batch:
                flush()
                taken, cost, fits = pick(s, -n, k, targets)
            cuts: list[int | None] = [None] * len(taken)
            if not fits:
                total = cost[2]
                if cost[0] > max_docs or cost[1] > limit:
                    continue
                short = [max_tokens * x[5] // total for x in taken]
                if sum(1 - a / max(1, x[5]) for a, x in zip(short, taken)) > acceptable * len(taken):
                    continue
                cuts, cost[2] = short, max_tokens
            batch.extend((s, g, label, h_, new, c) for (s, g, label, h_, new, _), c in zip(taken, cuts))
            inside.update(x[3] for x in taken)
            state[:] = [x + y for x, y in zip(state, cost)]
        flush()
        block = t.column("block")[0].as_py()
        kinds = [("batch", pa.int64()), ("src", pa.int64()), ("tgt", pa.int64()), ("label", pa.int32()), ("thash", pa.string()), ("new", pa.bool_()), ("cut", pa.int64())]
        return pa.table({"block": pa.array([block] * len(out), pa.int64())} | {name: pa.array([x[j] for x in out], kind) for j, (name, kind) in enumerate(kinds)})

    return rows.groupBy("block").applyInArrow(fold, "block bigint, batch bigint, src bigint, tgt bigint, label int, thash string, new boolean, cut bigint")


def sampling_statistics(batches: DataFrame) -> DataFrame:
    """One row: batches, sources, positives, negatives, texts that were in their batch already, texts cut, and the most sources of a batch. Sums of counts, so parts can be added."""
    per = batches.groupBy("block", "batch").agg(
        F.countDistinct("src").alias("s"), F.count_if((F.col("label") == 1) & F.col("new")).alias("p"), F.count_if((F.col("label") != 1) & F.col("new")).alias("n"),
        F.count_if(~F.col("new")).alias("again"), F.count_if(F.col("cut").isNotNull()).alias("cut"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(F.count("*").alias("batches"), total("s").alias("sources"), total("p").alias("positives"), total("n").alias("negatives"), total("again").alias("in_batch"), total("cut").alias("cut"), F.max("s").alias("most_sources"))
