"""Ordered computations that stay parallel when one key holds most of the rows.

``Window.partitionBy(media_id)`` puts a whole recording into one task. Everything in
this module cuts an ordered key into *chunks* instead: each task sees one chunk, a tiny
per-chunk summary is scanned per key, and the carry is joined back on (key, chunk).
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHUNK_ROWS = 1 << 16
CHUNK_MS = 3_600_000
CHUNK = "_chunk"


def chunk_by_pos(df: DataFrame, pos: str = "pos", rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunk id for tables with a dense position per key."""
    return df.withColumn(CHUNK, F.expr(f"{pos} div {rows}"))


def chunk_by_time(df: DataFrame, t: str = "t_ms", ms: int = CHUNK_MS) -> DataFrame:
    """Chunk id for tables ordered by a millisecond time."""
    return df.withColumn(CHUNK, F.expr(f"cast(floor({t} / {ms}) as bigint)"))


def share_shuffle(summary: DataFrame) -> DataFrame:
    """Keep ``_pin`` (a value over every column of the main branch) alive in the summary.

    Column pruning would otherwise give the two branches different shuffles, and Spark would read
    and shuffle the rows twice; with equal columns it reuses the first shuffle. The condition holds
    for every row.
    """
    return summary.where(F.xxhash64("_pin") >= F.lit(-(1 << 63))).drop("_pin")


def pin(columns: Sequence[str]) -> Column:
    return F.max(F.xxhash64(*columns)).alias("_pin")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    lead: Mapping[str, str] | None = None,
    lag: Mapping[str, str] | None = None,
    before: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    chunk: str = CHUNK,
    few: bool = False,
) -> DataFrame:
    """Two-level ordered scan of ``df`` (which must carry a chunk column). With ``few`` chunks (of ``CHUNK_ROWS`` rows, say)
    their carries go to the rows, which stay where they are.

    lead / lag  value of a non-null column on the next / previous row
    before      last non-null value strictly before the row
    after       first non-null value strictly after the row
    sums        sum over the rows strictly before (0 when there are none)
    maxes       max over the rows strictly before (null when there are none)
    """
    lead, lag, before = dict(lead or {}), dict(lag or {}), dict(before or {})
    after, sums, maxes = dict(after or {}), dict(sums or {}), dict(maxes or {})
    keys = list(keys)
    part = W.partitionBy(*keys, chunk).orderBy(*order)
    past = part.rowsBetween(W.unboundedPreceding, -1)
    future = (W.partitionBy(*keys, chunk).orderBy(*[F.desc(c) for c in order])
              .rowsBetween(W.unboundedPreceding, -1))
    rank = F.struct(*order)
    exprs: dict[str, Column] = {}
    ends: list[Column] = []
    carry_over = W.partitionBy(*keys).orderBy(chunk)
    carry_back = W.partitionBy(*keys).orderBy(F.desc(chunk)).rowsBetween(W.unboundedPreceding, -1)
    past_chunks = carry_over.rowsBetween(W.unboundedPreceding, -1)
    carries: dict[str, Column] = {}
    for out, col in lead.items():
        exprs[out] = F.lead(col).over(part)
        ends.append(F.min_by(F.col(col), rank).alias(f"_s_{out}"))
        carries[out] = F.lead(f"_s_{out}").over(carry_over)
    for out, col in lag.items():
        exprs[out] = F.lag(col).over(part)
        ends.append(F.max_by(F.col(col), rank).alias(f"_s_{out}"))
        carries[out] = F.lag(f"_s_{out}").over(carry_over)
    for out, col in before.items():
        exprs[out] = F.last(col, ignorenulls=True).over(past)
        ends.append(F.max_by(col, F.when(col.isNotNull(), rank)).alias(f"_s_{out}"))
        carries[out] = F.last(f"_s_{out}", ignorenulls=True).over(past_chunks)
    for out, col in after.items():
        exprs[out] = F.last(col, ignorenulls=True).over(future)
        ends.append(F.min_by(col, F.when(col.isNotNull(), rank)).alias(f"_s_{out}"))
        carries[out] = F.last(f"_s_{out}", ignorenulls=True).over(carry_back)
    for out, col in sums.items():
        exprs[out] = F.coalesce(F.sum(col).over(past), F.lit(0))
        ends.append(F.sum(col).alias(f"_s_{out}"))
        carries[out] = F.sum(f"_s_{out}").over(past_chunks)
    for out, col in maxes.items():
        exprs[out] = F.max(col).over(past)
        ends.append(F.max(col).alias(f"_s_{out}"))
        carries[out] = F.max(f"_s_{out}").over(past_chunks)
    # keys living in a single chunk need no carry: only the others enter the join
    summary = df.groupBy(*keys, chunk).agg(*ends, pin(df.columns))
    summary = share_shuffle(summary)
    carry = summary.select(
        *keys, chunk, *[c.alias(f"_c_{o}") for o, c in carries.items()]
    )
    carry = carry.where(" or ".join(f"_c_{o} is not null" for o in carries))
    local = df.select("*", *[c.alias(o) for o, c in exprs.items()])
    joined = local.join(F.broadcast(carry) if few else carry, [*keys, chunk], "left")
    final = []
    for o in exprs:
        if o in sums:
            final.append((F.col(o) + F.coalesce(f"_c_{o}", F.lit(0))).alias(o))
        elif o in maxes:
            final.append(F.greatest(o, f"_c_{o}").alias(o))
        else:
            final.append(F.coalesce(o, f"_c_{o}").alias(o))
    return joined.select(*df.columns, *final)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Column,
            out: str = "island") -> DataFrame:
    """Number the runs that start wherever ``breaks`` is true (inclusive running count)."""
    flagged = df.withColumn("_brk", F.coalesce(breaks.cast("long"), F.lit(0)))
    return (scan(flagged, keys, order, sums={out: F.col("_brk")})
            .withColumn(out, F.col(out) + F.col("_brk")).drop("_brk"))


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Column) -> DataFrame:
    """Position inside the current run (``run_pos``, from 0) and the index of the run's first row
    (``run_start``); a run starts wherever ``breaks`` is true, and on the first row."""
    keys = list(keys)
    part = W.partitionBy(*keys, CHUNK).orderBy(*order)
    w = df.withColumn("_b", F.coalesce(breaks, F.lit(False))).withColumn("_rn", F.row_number().over(part).cast("bigint"))
    w = w.withColumn("_lb", F.max(F.when(F.col("_b"), F.col("_rn"))).over(part.rowsBetween(W.unboundedPreceding, 0)))
    s = w.groupBy(*keys, CHUNK).agg(F.count("*").alias("_n"), F.max(F.when(F.col("_b"), F.col("_rn"))).alias("_l"), pin(df.columns))
    s = share_shuffle(s)
    past = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("_off", F.sum("_n").over(past))
    s = s.withColumn("_g", F.last(F.coalesce("_off", F.lit(0)) + F.col("_l"), True).over(past)).where("_off is not null")
    j = w.join(s.select(*keys, CHUNK, "_off", "_g"), [*keys, CHUNK], "left").withColumn("_off", F.coalesce("_off", F.lit(0)))
    j = j.withColumn("_st", F.when(F.col("_lb").isNotNull(), F.col("_off") + F.col("_lb")).otherwise(F.coalesce("_g", F.lit(1))))
    return j.select(*df.columns, (F.col("_off") + F.col("_rn") - F.col("_st")).alias("run_pos"), (F.col("_st") - 1).alias("run_start"))


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, bucket: Column) -> DataFrame:
    """Distinct values per key with their count and the number of rows below; chunked by value
    bucket (monotone in the value) so that no key is sorted in one task."""
    d = df.groupBy(*keys, value).agg(F.count("*").alias("n")).withColumn(CHUNK, bucket)
    return scan(d, keys, [value], sums={"below": F.col("n")}).drop(CHUNK)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, ps: Mapping[str, Column], bucket: Column) -> DataFrame:
    """Exact percentiles with linear interpolation; ``ps`` maps output names to shares in [0, 1]
    (columns constant per key)."""
    total = df.groupBy(*keys).agg(F.count("*").alias("_total"), *[F.max(p).alias(f"_p_{o}") for o, p in ps.items()])
    r = value_ranks(df, keys, value, bucket).join(total, list(keys))
    aggs = []
    for o in ps:
        at = F.col(f"_p_{o}") * (F.col("_total") - 1)
        lo, hi = F.floor(at), F.ceil(at)

        def pick(i):
            return F.max(F.when((F.col("below") <= i) & (i < F.col("below") + F.col("n")), F.col(value)))
        aggs += [pick(lo).alias(f"_lo_{o}"), pick(hi).alias(f"_hi_{o}"), F.max(at - lo).alias(f"_f_{o}")]
    g = r.groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[(F.col(f"_lo_{o}") + (F.col(f"_hi_{o}") - F.col(f"_lo_{o}")) * F.col(f"_f_{o}")).alias(o) for o in ps])


def spread(df: DataFrame, lo: Column, hi: Column, width: int, out: str = "_bucket") -> DataFrame:
    """Copy an interval row into every time bucket it touches."""
    w = F.lit(float(width))
    return df.withColumn(out, F.explode(F.sequence(F.floor(lo / w), F.floor(hi / w))))


def bucket_of(t: Column, width: int) -> Column:
    return F.floor(t / F.lit(float(width)))


def range_join(points: DataFrame, spans: DataFrame, t: str, lo: Column, hi: Column,
               keys: Sequence[str] = ("media_id",), width: int = 60_000,
               how: str = "inner") -> DataFrame:
    """Join point rows to the spans with ``lo <= t <= hi`` on (keys, time bucket).

    Only equi keys reach the join, so it hashes or sort-merges; a hot key is divided over
    its buckets. ``points`` is the left side. Column names must not clash.
    """
    left = points.withColumn("_bucket", bucket_of(F.col(t), width))
    right = spread(spans.withColumns({"_lo": lo, "_hi": hi}), F.col("_lo"), F.col("_hi"), width)
    right = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                         *[c for c in right.columns if c not in keys])
    on = [left[k] == right[f"_k_{k}"] for k in keys]
    on += [left["_bucket"] == right["_bucket"], left[t] >= right["_lo"], left[t] <= right["_hi"]]
    out = left.join(right, on, how)
    if how in ("left_semi", "left_anti"):
        return out.drop("_bucket")
    return out.drop(left["_bucket"]).drop(right["_bucket"]).drop("_lo", "_hi",
                                                                *[f"_k_{k}" for k in keys])


def local_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` (inner or left) that leaves rows where they are when both sides are partitioned alike by
    some of ``on``: a join would shuffle both by all of them, a window over their union asks for no more than that. For sides
    that meet in few rows per key: a row of ``left`` carries its matches."""
    on, rest = list(on), [c for c in right.columns if c not in on]
    seen = right.select(*on, F.struct(*rest).alias("_s"), F.lit(0).alias("_k"))
    both = left.withColumn("_k", F.lit(1)).unionByName(seen, allowMissingColumns=True)
    met = F.collect_list("_s").over(W.partitionBy(*on).orderBy("_k"))
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    both = both.withColumn("_m", F.when(known, met)).where("_k = 1")
    rows = F.explode_outer("_m") if how == "left" else F.explode("_m")
    return both.select(*left.columns, rows.alias("_x")).select(*left.columns, *[F.col(f"_x.{c}").alias(c) for c in rest])


def overlap_join(points: DataFrame, spans: DataFrame, lo: Column, hi: Column, s_lo: Column, s_hi: Column,
                 keys: Sequence[str] = ("media_id",), width: int = 60_000) -> DataFrame:
    """Inner join of rows whose intervals overlap (``hi > s_lo and lo < s_hi``), on (keys, bucket).
    A pair is emitted only in the bucket where the overlap starts, so nothing repeats."""
    a, b = spread(points, lo, hi, width), spread(spans, s_lo, s_hi, width)
    return local_join(a, b, [*keys, "_bucket"]).where(
        (hi > s_lo) & (lo < s_hi) & (F.col("_bucket") == bucket_of(F.greatest(lo, s_lo), width))).drop("_bucket")


def _shared(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="momentlake-ckpt-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage on shared storage (``spark.checkpoint.dir``); tests fall back to /tmp."""
    _shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``durable`` for many wide rows: compressed columns, of which a step reads what it needs. Parquet has no void columns."""
    if "void" in df.schema.simpleString():
        return durable(df)
    path = f"{_shared(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits that say which rows are kept, a hit by chance costs time only.
KEPT_BITS = 1 << 24


def rows_of(rows: DataFrame, ids: DataFrame, key: str = "_id") -> DataFrame:
    """The rows whose ``key`` is among ``ids``, few of many: a table of bits, bounded in size, drops most others where they are."""
    place = F.pmod(F.xxhash64(key), F.lit(KEPT_BITS))
    bit = F.lit(1).cast("bigint")
    words = ids.select(F.shiftright(place, 6).alias("_word"), F.pmod(place, F.lit(64)).cast("int").alias("_b")).distinct().groupBy("_word").agg(F.bit_or(F.call_function("shiftleft", bit, "_b")).alias("_bits"))
    met = F.call_function("shiftright", F.col("_bits"), F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(bit) == 1
    # the column joined on needs both sides, else Spark would do the second join, which moves all rows, before the first
    near = rows.withColumn("_word", F.shiftright(place, 6)).join(F.broadcast(words), "_word").withColumn("_met", F.when(met, F.col(key))).where("_met is not null")
    return near.join(ids.select(F.col(key).alias("_met")), "_met", "left_semi").select(*rows.columns)


def _whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    held: list[pa.RecordBatch] = []  # the group that may go on
    for b in batches:
        first, size = np.flatnonzero(b.column("_n").to_numpy() == 1), sum(x.num_rows for x in held)
        if len(first) and (held or first[-1] > 0):
            table = pa.Table.from_batches([*held, b.slice(0, first[-1])])
            yield table.drop_columns("_n").combine_chunks(), [*([0] if held else []), *(first + size).tolist()]
            held = []
        held.append(b.slice(first[-1]) if len(first) else b)
    if held:
        table = pa.Table.from_batches(held)
        yield table.drop_columns("_n").combine_chunks(), [0, table.num_rows]


def map_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable, schema) -> DataFrame:
    """``groupBy(keys).applyInArrow`` for many small groups. ``fn(table, edges)`` gets whole groups one after the other, each
    in ``order``; group i has the rows from ``edges[i]`` up to ``edges[i + 1]``. A task holds its largest group and one batch."""
    placed = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])))

    def run(batches):
        for table, edges in _whole_groups(b for b in batches if b.num_rows):
            yield from fn(table, edges).to_batches()

    return placed.mapInArrow(run, schema)


def overlap_above(limit: float):
    """Conflict rule: intersection over union of two spans exceeds ``limit``."""
    def rule(lo, hi, los, his):
        inter = np.maximum(0, np.minimum(hi, his) - np.maximum(lo, los))
        union = (hi - lo) + (his - los) - inter
        return np.where(union > 0, inter / np.maximum(union, 1), 0.0) > limit
    rule.length_ratio = limit  # spans in conflict differ in length by less than this factor
    rule.shift_ratio = 1.0 - limit  # and begin less than this share of the longer one apart
    return rule


def closer_than(gap: int):
    """Conflict rule: two points lie less than ``gap`` apart."""
    def rule(lo, hi, los, his):
        return np.abs(los - lo) < gap
    return rule


def greedy_select(
    df: DataFrame,
    keys: Sequence[str],
    rank: Sequence[Column],
    lo: str,
    hi: str,
    conflict: Callable,
    reach_ms: int | None = None,
    *,
    chunk_ms: int | None = None,
) -> DataFrame:
    """Exact greedy suppression: take rows by ``rank`` ascending (a total order), drop those in
    conflict with a row already taken.

    ``conflict`` may only hold for rows whose ``lo`` differ by at most ``reach_ms`` (default: the longest span, for
    rules that need an overlap). The rows are computed once; the rounds move keys, ranks and bounds only, and whole
    rows are joined back to what is kept. Each task handles one time chunk plus a halo. A row next to a chunk edge
    stays *open* while a stronger open neighbour is out of sight; later rounds move the edges by half a chunk until no
    row is open. The strongest open row always closes, so the loop ends; keys shorter than a chunk close in the first
    round.

    Chunks follow the data: their width is halved while one holds more than ``CHUNK_ROWS`` rows, down to four halos
    (``chunk_ms`` fixes it). Where the rule bounds the ratio of lengths, spans over a quarter of ``CHUNK_MS`` fall into
    classes of their own with wider chunks, which see the neighbouring classes only: a few long spans do not widen the
    chunks of the others.
    """
    keys = list(keys)
    ranks = {f"_r{i}": c for i, c in enumerate(rank)}
    rows = stored(df.withColumn("_id", F.monotonically_increasing_id()))
    ratio = getattr(conflict, "length_ratio", 0.0)
    growth = max(4.0, 1.0 / ratio) if ratio >= 0.01 and reach_ms is None else None
    size = F.col(hi) - F.col(lo)
    level = F.lit(0)
    if growth:
        level = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(size, F.lit(1)) / F.lit(CHUNK_MS / 4.0)) / F.lit(float(np.log(growth))))).cast("int")
    state = rows.select(*keys, "_id", *[c.alias(n) for n, c in ranks.items()], F.col(lo).alias("_lo"), F.col(hi).alias("_hi"),
                        F.lit(False).alias("_kept"), level.alias("_cls"))
    longest = {r["_cls"]: int(r["m"]) for r in state.groupBy("_cls").agg(F.max(F.col("_hi") - F.col("_lo")).alias("m")).collect()}
    reach = {c: max(1, reach_ms if reach_ms is not None else max(longest.get(x, 0) for x in ((c, c + 1) if growth else longest))) for c in longest}
    if growth:
        reach = {c: max(1, min(r, int(longest[c] / ratio) + 1)) for c, r in reach.items()}
    if reach_ms is None and hasattr(conflict, "shift_ratio"):
        reach = {c: int(r * conflict.shift_ratio) + 1 for c, r in reach.items()}
    width = {c: max(chunk_ms, 4 * r) if chunk_ms else _chunk_width(state.where(F.col("_cls") == c), keys, 4 * r) for c, r in reach.items()}
    half = False
    while longest:
        state = durable(_greedy_round(state, keys, list(ranks), conflict, reach, width, half))
        if state.where(~F.col("_kept")).isEmpty():
            break
        half = not half
    return rows_of(rows, state.select("_id")).select(*df.columns)


def _chunk_width(state: DataFrame, keys: list[str], unit: int) -> int:
    """The widest of ``unit`` * 2^j up to ``CHUNK_MS`` whose chunks all hold at most ``CHUNK_ROWS`` rows; at least ``unit``."""
    steps = max(0, int(np.ceil(np.log2(CHUNK_MS / unit)))) if unit < CHUNK_MS else 0
    if not steps:
        return unit
    counts = state.groupBy(*keys, F.floor(F.col("_lo") / F.lit(float(unit))).alias("_u")).agg(F.count("*").alias("_n"))
    wide = counts.select(*keys, "_n", F.posexplode(F.array(*[F.floor(F.col("_u") / F.lit(float(1 << j))) for j in range(steps + 1)])).alias("_j", "_b"))
    full = {r["_j"]: r["m"] for r in wide.groupBy(*keys, "_j", "_b").agg(F.sum("_n").alias("_n")).groupBy("_j").agg(F.max("_n").alias("m")).collect()}
    fit = [j for j in range(steps + 1) if full.get(j, 0) <= CHUNK_ROWS]
    return unit << (max(fit) if fit else 0)


def _greedy_round(state, keys, ranks, conflict, reach, width, half):
    def at(t, c):
        return F.floor((t + (width[c] // 2 if half else 0)) / F.lit(float(width[c])))

    place = "array<struct<c:int,at:bigint>>"
    tasks = [F.when(F.col("_cls").between(c - 1, c + 1), F.array_distinct(F.array(
        *[F.struct(F.lit(c).alias("c"), at(t, c).alias("at")) for t in (F.col("_lo") - reach[c], F.col("_lo"), F.col("_lo") + reach[c])]))).otherwise(F.array().cast(place))
        for c in reach]
    home = F.lit(None).cast("bigint")
    for c in reach:
        home = F.when(F.col("_cls") == c, at(F.col("_lo"), c)).otherwise(home)
    columns = list(state.columns)
    placed = state.withColumn("_home", home).withColumn("_to", F.explode(F.concat(*tasks)))
    placed = placed.select(*columns, F.col("_to.c").alias("_c"), F.col("_to.at").alias("_at"),
                           ((F.col("_to.c") == F.col("_cls")) & (F.col("_to.at") == F.col("_home"))).alias("_core"))

    def settle(los, his, core, kept, near_ms):
        """Marks what one place keeps in ``kept``; returns what is dropped."""
        dead = np.zeros(len(los), dtype=bool)
        unsure = ~core & ~kept
        live = np.argsort(los, kind="stable")  # what a kept row may drop
        sure = live[~unsure[live] & ~kept[live]]  # what an unsure row may make unsure; each row leaves but once
        at, begins, gone, marked = los[live], los[sure], 0, 0

        def weaker(i, rows, starts):
            first, end = np.searchsorted(starts, los[i] - near_ms), np.searchsorted(starts, los[i] + near_ms, side="right")
            near = rows[first:end]
            near = near[near > i]
            return near[conflict(los[i], his[i], los[near], his[near])]

        for i in range(len(los)):
            if dead[i]:
                continue
            if kept[i] or not unsure[i]:
                kept[i] = True
                hit = weaker(i, live, at)
                dead[hit] = True
                gone += len(hit)
                if gone * 2 > len(live):
                    live, gone = live[~dead[live]], 0
                    at = los[live]
            elif len(sure):
                hit = weaker(i, sure, begins)
                unsure[hit] = True
                marked += len(hit) + 1
                if marked * 4 > len(sure):
                    sure, marked = sure[~unsure[sure] & ~dead[sure] & ~kept[sure] & (sure > i)], 0
                    begins = los[sure]
        return dead

    def close(table: pa.Table, edges: list[int]) -> pa.Table:
        los, his, core, kept = (table[c].to_numpy() for c in ("_lo", "_hi", "_core", "_kept"))
        kept, dead, classes = kept.copy(), np.zeros(len(los), dtype=bool), table["_c"].to_numpy()
        for a, b in zip(edges, edges[1:]):
            # places that own no row or have no open one change nothing
            if core[a:b].any() and not kept[a:b].all():
                dead[a:b] = settle(los[a:b], his[a:b], core[a:b], kept[a:b], reach[int(classes[a])])
        out = table.select(columns)
        out = out.set_column(out.schema.get_field_index("_kept"), "_kept", pa.array(kept))
        return out.filter(pa.array(core & ~dead))

    return map_groups(placed, [*keys, "_c", "_at"], ranks, close, state.schema)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k, out: str | None = None) -> DataFrame:
    """Best ``k`` rows per key; Spark cuts each partition to k rows before the shuffle when k is a number."""
    name = out or "_n"
    w = W.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(w))
    cut = ranked.where(F.col(name) <= (F.col(k) if isinstance(k, str) else k))
    return cut if out else cut.drop(name)


def _records(t: np.ndarray, value: np.ndarray, gap: int):
    """For every row: the threshold left behind by the chain that starts on it."""
    n = len(t)
    peak = np.maximum.accumulate(value)
    jump = np.searchsorted(peak, t + gap, side="left")
    leave = np.empty(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        j = jump[i]
        if j <= i:  # an earlier, longer row hides the real successor
            j = i + 1
            while j < n and value[j] < t[i] + gap:
                j += 1
            jump[i] = j
        leave[i] = t[i] + gap if j >= n else leave[j]
    return peak, jump, leave


def chain_marks(df: DataFrame, key: str, order: Sequence[str], t: str, gap: Column | int,
                value: str | None = None, out: str = "anchor", chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Mark the rows visited by the chain: first row, then the first later row whose ``value``
    (default ``t``) reaches ``t + gap`` of the current one, and so on.

    A chunk maps an incoming threshold to an outgoing one by a step function with few steps;
    only those steps are scanned per key, so no task holds a whole recording. Keys of one chunk need no steps.
    """
    value = value or t
    base = chunk_by_time(df.withColumn("_gap", F.lit(gap).cast("long") if isinstance(gap, int) else gap.cast("long")),
                         t, chunk_ms)
    base = base.where(F.col(key).isNotNull())
    several = base.groupBy(key).agg(F.min(CHUNK).alias("_a"), F.max(CHUNK).alias("_z")).where("_a < _z").select(key)
    lean = base.select(F.col(key), CHUNK, "_gap", *[c for c in dict.fromkeys([*order, t, value])]).join(several, key, "left_semi")
    ktype = df.schema[key].dataType.simpleString()

    def steps(ids, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        ts, vs = pdf[t].to_numpy(np.int64), pdf[value].to_numpy(np.int64)
        g = int(pdf["_gap"].iloc[0])
        peak, _, leave = _records(ts, vs, g)
        bound = int(ids[1]) * chunk_ms + g
        fresh = np.flatnonzero(np.r_[True, peak[1:] > peak[:-1]])
        prior = np.r_[np.iinfo(np.int64).min, peak[fresh][:-1]]
        fresh = fresh[prior < bound]
        exits = leave[fresh]
        same = np.r_[exits[1:] == exits[:-1], False]  # merge steps with equal exits
        fresh, exits = fresh[~same], exits[~same]
        return pd.DataFrame({key: ids[0], CHUNK: ids[1], "_upto": peak[fresh], "_exit": exits})

    table = lean.groupBy(key, CHUNK).applyInPandas(
        steps, f"{key} {ktype}, {CHUNK} bigint, _upto bigint, _exit bigint")

    def carry(ids, pdf: pd.DataFrame) -> pd.DataFrame:
        rows, theta = [], np.iinfo(np.int64).min
        for c, part in pdf.sort_values([CHUNK, "_upto"]).groupby(CHUNK, sort=True):
            rows.append((ids[0], c, theta))
            hit = np.searchsorted(part["_upto"].to_numpy(), theta, side="left")
            if hit < len(part):
                theta = int(part["_exit"].iloc[hit])
        return pd.DataFrame(rows, columns=[key, CHUNK, "_theta"])

    thetas = table.groupBy(key).applyInPandas(carry, f"{key} {ktype}, {CHUNK} bigint, _theta bigint")
    full = base.join(thetas, [key, CHUNK], "left")
    schema = T.StructType([f for f in full.schema if f.name not in ("_theta", "_gap", CHUNK)]
                          + [T.StructField(out, T.BooleanType())])

    def mark(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        ts, vs = table[t].to_numpy().astype(np.int64), table[value].to_numpy().astype(np.int64)
        peak, jump, _ = _records(ts, vs, table["_gap"][0].as_py())
        hit = np.zeros(len(ts), dtype=bool)
        theta = table["_theta"][0].as_py()
        i = 0 if theta is None else int(np.searchsorted(peak, theta, side="left"))
        while i < len(ts):
            hit[i] = True
            i = int(jump[i])
        return table.drop_columns(["_theta", "_gap", CHUNK]).append_column(out, pa.array(hit)).select(schema.names)

    return full.groupBy(key, CHUNK).applyInArrow(mark, schema)


def state_machine(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start, summary: Callable, run: Callable, settle: Callable,
                  out: str, chunk: str = CHUNK) -> DataFrame:
    """Run a state machine over ordered rows without holding a whole key in one task.

    ``summary(rows)`` says how a chunk maps the state it is entered with to the state it is left with. These small maps
    are scanned per key: ``settle(map, state)`` gives the state after the chunk for a true state before it. Then each
    chunk is replayed from its true state: ``run(rows, state)`` gives the output rows (values for ``out``, the columns
    after the keys) and the leaving state. Maps and states are JSON values. Keys of one chunk need no map.
    """
    keys = list(keys)
    rows = rows.where(" and ".join(f"`{c}` is not null" for c in (*keys, chunk)))
    several = rows.groupBy(*keys).agg(F.min(chunk).alias("_a"), F.max(chunk).alias("_z")).where("_a < _z").select(*keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, chunk).schema)

    def records(table: pa.Table) -> list[dict]:
        return table.sort_by([(c, "ascending") for c in order]).to_pylist()

    def first(table: pa.Table, n: int) -> list:
        return [table[c].take(pa.array([0] * n, pa.int64())) for c in (*keys, chunk)]

    def maps(table: pa.Table) -> pa.Table:
        r = records(table)
        found = json.dumps(summary(r))
        return pa.table([*first(table, 1), pa.array([found])], names=[*keys, chunk, "_map"])

    def walk(table: pa.Table) -> pa.Table:
        table, state, states = table.sort_by(chunk), start, []
        for m in table["_map"].to_pylist():
            states.append(json.dumps(state))
            state = settle(json.loads(m), state)
        return table.set_column(table.schema.get_field_index("_map"), "_state", pa.array(states, pa.string()))

    entered = rows.join(several, keys, "left_semi").groupBy(*keys, chunk).applyInArrow(maps, f"{kinds}, _map string").groupBy(*keys).applyInArrow(walk, f"{kinds}, _state string")
    schema = T.StructType([*rows.select(*keys).schema, *T.StructType.fromDDL(out)])
    target = to_arrow_schema(schema)

    def replay(table: pa.Table, edges: list[int]) -> pa.Table:
        r, made, owners = table.drop_columns("_state").to_pylist(), [], []
        for a, b in zip(edges, edges[1:]):
            state = table["_state"][a].as_py()
            got, _ = run(r[a:b], start if state is None else json.loads(state))
            made += got
            owners += [a] * len(got)
        left = [table[c].take(pa.array(owners, pa.int64())) for c in keys]
        right = [pa.array([m[i] for m in made], f.type) for i, f in enumerate(list(target)[len(keys):])]
        return pa.table([*left, *right], names=schema.names)

    return map_groups(rows.join(entered, [*keys, chunk], "left"), [*keys, chunk], order, replay, schema)


def recurrence(rows: DataFrame, keys: Sequence[str], t: str, run: Callable, out: str, warm_ms: int, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Run a forgetting recurrence (a filter) over ordered rows, equal to the plain loop to the last bit.

    ``run(rows, state)`` gives the output rows (values for ``out``, the columns after the keys) and the leaving state, a
    JSON value; the state before the first row is None. Each chunk warms up on the ``warm_ms`` before it and so guesses
    its entering state. Where the guess equals what the chunk before leaves, both are right; the others run again from
    the true state, until all agree. Keys of one chunk need no guess. ``t`` orders the rows and is unique per key.
    """
    keys = list(keys)
    base = chunk_by_time(rows, t, chunk_ms)
    several = base.groupBy(*keys).agg(F.min(CHUNK).alias("_a"), F.max(CHUNK).alias("_z")).where("_a < _z").select(*keys, "_a")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*keys, CHUNK).schema)

    def lists(table: pa.Table) -> list[dict]:
        return table.sort_by(t).to_pylist()

    def named(table: pa.Table, **values) -> pa.Table:
        left = [table[c].take(pa.array([0], pa.int64())) for c in (*keys, CHUNK)]
        return pa.table([*left, *(pa.array([v], pa.string()) for v in values.values())], names=[*keys, CHUNK, *values])

    def guess(table: pa.Table) -> pa.Table:
        r, at = lists(table), table[CHUNK][0].as_py()
        warm = [x for x in r if x["_own"] != at]
        entering = run(warm, None)[1] if warm else None
        return named(table, _guess=json.dumps(entering), _exit=json.dumps(run([x for x in r if x["_own"] == at], entering)[1]))

    def again(table: pa.Table) -> pa.Table:
        state = table["_state"][0].as_py()
        return named(table, _guess=state, _exit=json.dumps(run(lists(table), json.loads(state))[1]))

    def walk(table: pa.Table) -> pa.Table:
        table, state, states = table.sort_by(CHUNK), "null", []
        agree = []
        for g, e in zip(table["_guess"].to_pylist(), table["_exit"].to_pylist(), strict=True):
            states.append(state)
            agree.append(state == g)
            state = e if state is not None and state == g else None  # behind a wrong guess nothing is known yet
        return pa.table([*(table[c] for c in (*keys, CHUNK)), pa.array(states, pa.string()), pa.array(agree)], names=[*keys, CHUNK, "_state", "_agree"])

    many = base.join(several, keys)
    ahead = F.expr(f"cast(floor(({t} + {warm_ms}) / {chunk_ms}) as bigint)")
    placed = many.withColumn("_own", F.col(CHUNK)).withColumn(CHUNK, F.explode(F.sequence(F.col(CHUNK), ahead))).drop("_a")
    there = many.select(*keys, CHUNK).distinct()
    guesses = durable(placed.join(there, [*keys, CHUNK], "left_semi").groupBy(*keys, CHUNK).applyInArrow(guess, f"{kinds}, _guess string, _exit string"))
    while True:
        walked = durable(guesses.groupBy(*keys).applyInArrow(walk, f"{kinds}, _state string, _agree boolean"))
        wrong = walked.where("not _agree and _state is not null").select(*keys, CHUNK, "_state")
        if wrong.isEmpty():
            break
        fixed = base.join(wrong, [*keys, CHUNK]).groupBy(*keys, CHUNK).applyInArrow(again, f"{kinds}, _guess string, _exit string")
        guesses = durable(guesses.join(wrong, [*keys, CHUNK], "left_anti").unionByName(fixed))
    schema = T.StructType([*base.select(*keys).schema, *T.StructType.fromDDL(out)])
    target = list(to_arrow_schema(schema))[len(keys):]

    def replay(table: pa.Table) -> pa.Table:
        made, _ = run(lists(table.drop_columns("_state")), json.loads(table["_state"][0].as_py() or "null"))
        left = [table[c].take(pa.array([0] * len(made), pa.int64())) for c in keys]
        return pa.table([*left, *(pa.array([m[i] for m in made], f.type) for i, f in enumerate(target))], names=schema.names)

    return base.join(walked.select(*keys, CHUNK, "_state"), [*keys, CHUNK], "left").groupBy(*keys, CHUNK).applyInArrow(replay, schema)


def session(name: str = "momentlake", cpus: str = "8") -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own settings."""
    return (SparkSession.builder.master(f"local[{cpus}]").appName(name)
            .config("spark.sql.shuffle.partitions", cpus)
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.driver.memory", "16g")
            # wide feature projections: methods over 8000 bytes are never compiled by the JVM
            .config("spark.sql.codegen.hugeMethodLimit", "8000")
            .config("spark.ui.enabled", "false")
            .getOrCreate())
