"""Packing documents into sequences by a grouping genetic algorithm on islands.

Pieces are dealt into groups of bounded size. Each group is solved on several islands: a population of packings
evolves by injecting whole well-filled bins of one parent into the other, removing the bins that hold duplicates
and best-fitting what was displaced. After each epoch the islands' best packings migrate to all islands of the
group. Poorly filled bins of all groups are dissolved and packed again together, until one group is left.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from momentlake.llm.common import durable, slices, text_bytes, whole_text
from momentlake.llm.tokens import memo_of

GROUP_ROWS = 4000


def cut_pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids followed by ``end_id``, cut at ``size``.
    Null and empty texts consist of ``end_id`` alone; repeated rows give repeated pieces; a null doc_id stays null."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        memo = memo_of(path)
        for b in slices(batches):
            rows: list[list] = [[], [], [], [], []]
            for doc, ids in zip(b.column("doc_id").to_pylist(), memo.encode(text_bytes(b)), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at:at + 4 * size]
                    for col, v in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(v)
            types = (b.column("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(pieces: DataFrame, size: int = 2048, islands: int = 2, epochs: int = 2, population: int = 4, generations: int = 4,
         group_rows: int = GROUP_ROWS, well_filled: float = 0.995, seed: int = 7) -> DataFrame:
    """Adds ``sequence_id`` (long) and ``offset`` (long, gapless from 0) to ``pieces`` (needs ``length``, 1 to ``size``).

    Pieces of full length are sequences of their own. Ties between equal lengths fall by the row's place in the
    table; repeated rows are packed each; other columns are kept; an empty table gives an empty result.
    """
    pieces = durable(pieces.withColumn("_uid", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") >= size).select("_uid", (F.col("_uid") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    left = pieces.where(F.col("length") < size).select("_uid", "length")
    placed, turn = [full], 0
    while True:
        n = left.count()
        if n == 0:
            break
        groups = max(1, round(n / group_rows))
        items = left.withColumn("grp", F.pmod(F.xxhash64("_uid", F.lit(turn)), F.lit(groups)).cast("int"))
        bins = durable(_evolve(items, size, islands, epochs, population, generations, seed + turn, turn))
        if groups == 1:
            placed.append(bins.select("_uid", "sequence_id", "offset"))
            break
        keep = F.col("fill") >= well_filled * size
        placed.append(bins.where(keep).select("_uid", "sequence_id", "offset"))
        rest = bins.where(~keep)
        m = rest.count()
        if m > 0.5 * n:  # hard lengths: another deal would not fill these bins better
            placed.append(rest.select("_uid", "sequence_id", "offset"))
            break
        left, turn = rest.select("_uid", "length"), turn + 1
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return pieces.join(out, "_uid").drop("_uid")


def _evolve(items: DataFrame, size, islands, epochs, population, generations, seed, turn) -> DataFrame:
    """Best packing of each group: ``_uid, length, sequence_id, offset, fill``. A group's lengths, sorted, are its genes;
    packings refer to them by place, so islands and epochs exchange them as arrays of bin numbers."""
    spark = items.sparkSession
    groups = durable(items.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("neg"), "_uid"))).alias("g"))
                     .select("grp", F.transform("g", lambda x: -x["neg"]).cast("array<int>").alias("lengths"), F.transform("g", lambda x: x["_uid"]).alias("uids")))
    elites = None
    for epoch in range(epochs):
        work = groups.select("grp", "lengths", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"))
        if elites is None:
            work = work.withColumn("elites", F.lit(None).cast("array<array<int>>"))
        else:
            work = work.join(elites.groupBy("grp").agg(F.collect_list("bins").alias("elites")), "grp")
        work = work.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "grp", "island")
        elites = durable(work.mapInPandas(_island(size, population, generations, seed, epoch), "grp int, island int, used int, filled double, bins array<int>"))
    best = elites.groupBy("grp").agg(F.min_by("bins", F.struct("used", -F.col("filled"), "island")).alias("bins"))
    rows = groups.join(best, "grp").select("grp", F.explode(F.arrays_zip("lengths", "uids", "bins")).alias("x"))
    rows = rows.select("grp", F.col("x.uids").alias("_uid"), F.col("x.lengths").cast("bigint").alias("length"), F.col("x.bins").alias("b"))
    from pyspark.sql import Window as W
    inside = W.partitionBy("grp", "b").orderBy(F.desc("length"), "_uid")
    number = F.lit(turn).cast("bigint") * F.lit(1 << 56) + F.col("grp").cast("bigint") * F.lit(1 << 24) + F.col("b")
    return rows.select("_uid", "length", number.alias("sequence_id"), (F.sum("length").over(inside) - F.col("length")).alias("offset"),
                       F.sum("length").over(W.partitionBy("grp", "b")).alias("fill"))


class Packing:
    """Bins of item places; best fit by one bit per remaining room."""

    def __init__(self, lengths: list[int], size: int):
        self.lengths, self.size, self.bins, self.room, self.at, self.mask = lengths, size, {}, {}, {}, 0
        self.next = 0

    def add(self, items: list[int]) -> None:
        b, self.next = self.next, self.next + 1
        self.bins[b] = items
        self._file(b, self.size - sum(self.lengths[i] for i in items))

    def _file(self, b: int, room: int) -> None:
        self.room[b] = room
        self.at.setdefault(room, set()).add(b)
        self.mask |= 1 << room

    def _unfile(self, b: int) -> int:
        room = self.room.pop(b)
        here = self.at[room]
        here.discard(b)
        if not here:
            self.mask &= ~(1 << room)
        return room

    def drop(self, b: int) -> list[int]:
        self._unfile(b)
        return self.bins.pop(b)

    def fit(self, items: list[int]) -> None:
        """Best fit, longest first (places are sorted by falling length)."""
        for i in sorted(items):
            n = self.lengths[i]
            wide = self.mask >> n
            if wide:
                b = min(self.at[n + (wide & -wide).bit_length() - 1])
                room = self._unfile(b)
                self.bins[b].append(i)
                self._file(b, room - n)
            else:
                self.add([i])

    def score(self) -> tuple[int, float]:
        return len(self.bins), -float(sum((1 - r / self.size) ** 2 for r in self.room.values()))

    def genes(self) -> np.ndarray:
        out = np.zeros(len(self.lengths), np.int32)
        for k, items in enumerate(self.bins.values()):
            out[items] = k
        return out

    @classmethod
    def of(cls, lengths: list[int], size: int, genes) -> Packing:
        new, bins = cls(lengths, size), {}
        for i, b in enumerate(genes):
            bins.setdefault(int(b), []).append(i)
        for items in bins.values():
            new.add(items)
        return new


def crossover(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """A child of ``a`` with a random share of ``b``'s best-filled bins; bins of ``a`` with duplicates go, their other
    items are best-fitted."""
    ranked = sorted(b.bins, key=lambda k: (b.room[k], k))
    given = rng.sample(ranked[: max(1, len(ranked) // 2)], max(1, len(ranked) // 10))
    inject = [list(b.bins[k]) for k in given]
    taken = {i for items in inject for i in items}
    child, displaced = Packing(a.lengths, a.size), []
    for items in a.bins.values():
        if taken.isdisjoint(items):
            child.add(list(items))
        else:
            displaced += [i for i in items if i not in taken]
    for items in inject:
        child.add(items)
    mutate(child, displaced, rng)
    return child


def mutate(p: Packing, displaced: list[int], rng: random.Random) -> None:
    """Empties the worst-filled bins together with the displaced items, then best-fits all of them."""
    worst = sorted(p.bins, key=lambda k: (-p.room[k], k))[: 1 + len(p.bins) // 50]
    for k in worst:
        displaced += p.drop(k)
    p.fit(displaced)


def _island(size, population, generations, seed, epoch):
    def run(batches):
        for pdf in batches:
            for grp, island, lengths, elites in zip(pdf["grp"], pdf["island"], pdf["lengths"], pdf["elites"], strict=True):
                lengths = [int(x) for x in lengths]
                rng = random.Random(f"{seed}/{grp}/{island}/{epoch}")
                people = [] if elites is None else [Packing.of(lengths, size, e) for e in elites]
                while len(people) < population:
                    p = Packing(lengths, size)
                    if people:  # random bins first, for variety
                        order = list(range(len(lengths)))
                        first = set(rng.sample(order, len(order) // 8))
                        p.fit(list(first))
                        p.fit([i for i in order if i not in first])
                    else:
                        p.fit(list(range(len(lengths))))
                    people.append(p)
                for _ in range(generations):
                    people.sort(key=Packing.score)
                    child = crossover(people[0], rng.choice(people[1:]), rng) if len(people) > 1 else people[0]
                    other = crossover(rng.choice(people), people[0], rng)
                    people = sorted([*people, child, other], key=Packing.score)[:population]
                best = min(people, key=Packing.score)
                used, filled = best.score()
                yield pd.DataFrame({"grp": [grp], "island": [island], "used": [used], "filled": [-filled], "bins": [best.genes()]}).astype({"grp": "int32", "island": "int32", "used": "int32"})
    return run
