"""Blocks of time: how a long series is spread over many tasks.

A window partitioned by series alone puts one whole series in one task. There are two kinds of blocks instead.

Operators that look a number of steps away use blocks with halos: every row gets a block number, the wall-clock bin it
falls in, and is copied into each neighbouring block that has to see it. Rows see each other only when they are whole
steps apart, so windows are partitioned by (series, split, block, phase), the phase being the remainder modulo the step. A
phase has a stamp a step at most, so a group never holds more rows than a block and its halo have steps, however
dense the readings are. Only home rows are kept, so the answer is the same for any block size.

Operators that need the order of all rows (ranks, neighbours, running totals) use blocks bounded by rows: a directory
counts the rows of each bin and divides crowded bins anew until none is crowded. Its blocks lie one after the other, so
what a block needs of those before it comes from a table with a row for each block.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from evenstep.functions.stamps import floor_to, stamp_micros
from evenstep.schema import FRAME_START, TS, join_on, keys_of
from evenstep.sources.storage import settle

MICROS, BLOCK, HOME, GRIDDED, PHASE = "_micros", "_block", "_home", "_gridded", "_phase"

#: Steps per bin that a directory counts first.
TOTALS_BLOCK = 16_384
#: Rows of a block of a directory at most, and into how many bins a crowded one is divided.
MOST_ROWS, FINER = 65_536, 1_024


def block_steps(reach: int) -> int:
    """Steps per block for a total look-back plus look-ahead.

    A short reach leaves block and halo within the 4,096 rows a window buffers in memory by default; a long
    one gets blocks so much longer that at most about one row in sixteen is copied.
    """
    return max(4_000 - reach, 16 * reach)


def to_blocks(
    frame: DataFrame, step: int, back: int = 0, ahead: int = 0, steps_per_block: int | None = None
) -> DataFrame:
    """Add ``_micros``, ``_phase``, ``_block``, ``_home``; home rows see ``back`` steps behind and ``ahead`` in front.

    A frame that knows where its slices start has its phases counted from there and also gets ``_gridded``: whether
    the row sits a whole number of steps after that start. Rows that do not are not copied.

    The rows are spread by (series, split, block, phase) explicitly. Left to itself, a window would accept rows
    already spread by series alone, after a join on it say, and put a hot series into one task after all.
    """
    width = step * (steps_per_block or block_steps(back + ahead))
    micros = F.col(MICROS)
    framed = frame.withColumn(MICROS, stamp_micros(TS))
    anchored = FRAME_START in frame.columns
    start = stamp_micros(FRAME_START) if anchored else F.lit(0)
    framed = framed.withColumn(PHASE, F.pmod(micros - start, F.lit(step)))
    if anchored:
        framed = framed.withColumn(GRIDDED, F.col(PHASE) == 0)
    home = floor_to(micros, width)
    if back == 0 and ahead == 0:
        blocked = framed.withColumns({BLOCK: home, HOME: F.lit(True)})
    else:
        # A row is needed by every block that holds a stamp within its reach: `ahead` before it to `back` after it.
        seen_by = F.sequence(floor_to(micros - ahead * step, width), floor_to(micros + back * step, width))
        copied = framed.withColumn(BLOCK, F.explode(F.when(F.col(GRIDDED), seen_by).otherwise(F.array(home)) if anchored else seen_by))
        blocked = copied.withColumn(HOME, F.col(BLOCK) == home)
    return spread(blocked, *keys_of(frame), BLOCK, PHASE)


def spread(frame: DataFrame, *columns: str) -> DataFrame:
    """Hash rows over as many tasks as the session shuffles into.

    The count is explicit because windows cost far more per byte than the size-based merging of small
    partitions assumes; merged by bytes, a million rows would end up in a task or two.
    """
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def in_block(frame: DataFrame) -> WindowSpec:
    """Rows of one block and phase in time order. Operators that look steps away use this one spec, hence one shuffle and one sort."""
    return Window.partitionBy(*keys_of(frame), BLOCK, PHASE).orderBy(MICROS)


def home_rows(frame: DataFrame) -> DataFrame:
    return frame.where(F.col(HOME)).drop(MICROS, BLOCK, HOME, GRIDDED, PHASE)


def steps_between(spec: WindowSpec, start: int, end: int, step: int) -> WindowSpec:
    """Elapsed-time frame: stamps from ``start`` to ``end`` steps away, whatever rows lie between."""
    return spec.rangeBetween(start * step, end * step)


@dataclass(frozen=True)
class Directory:
    """Consecutive blocks of time of every group, each with ``MOST_ROWS`` rows at most, or all of one stamp.

    ``counts`` has a row for each block: keys, ``_block`` (its first microsecond) and ``_rows``. ``crowded`` has, for each
    level of division, the bins that were divided; where no bin is crowded, rows are placed without any join.
    """

    keys: list[str]
    widths: list[int]
    crowded: list[DataFrame] = field(default_factory=list)
    counts: DataFrame | None = None

    def _start(self, micros: Column, level: int) -> Column:
        """First microsecond of the bin of a level: of bins that divide the one of the level above."""
        start = floor_to(micros, self.widths[0]) * self.widths[0]
        for width in self.widths[1 : level + 1]:
            start = start + floor_to(micros - start, width) * width
        return start

    def _inside(self, rows: DataFrame, level: int, stamp: str) -> DataFrame:
        """``rows`` with ``_inside``: whether their bin of a level was divided."""
        marked = rows.withColumn("_start", self._start(stamp_micros(stamp), level))
        found = self.crowded[level].select(*self.keys, "_start", F.lit(True).alias("_found"))
        joined = join_on(marked, found, [*self.keys, "_start"], "left")
        return joined.withColumn("_inside", F.coalesce("_found", F.lit(False))).drop("_start", "_found")

    def place(self, rows: DataFrame, stamp: str = TS) -> DataFrame:
        """``rows`` with ``_block``."""
        block = self._start(stamp_micros(stamp), 0)
        for level in range(len(self.crowded)):
            rows = self._inside(rows, level, stamp).withColumn(f"_inside_{level}", F.col("_inside")).drop("_inside")
            below = self._start(stamp_micros(stamp), level + 1)
            for outer in range(level, -1, -1):
                below = F.when(F.col(f"_inside_{outer}"), below)
            block = F.coalesce(below, block)
        return rows.withColumn(BLOCK, block).drop(*[f"_inside_{level}" for level in range(len(self.crowded))])


def directory(
    rows: DataFrame,
    keys: list[str],
    step: int,
    stamp: str = TS,
    steps_per_block: int = TOTALS_BLOCK,
    most_rows: int = MOST_ROWS,
) -> Directory:
    """Blocks of every group of ``keys``: bins of ``steps_per_block`` steps, crowded ones divided until none is left.

    Rows are counted where they are read, so a row for each bin and task is shuffled. Pass a stored frame: a level of
    division reads it once more (readings a thousand times as dense as their step have one).
    """
    made = Directory(keys, [step * steps_per_block])
    micros = stamp_micros(stamp)
    rows = rows.select(*keys, stamp).where(F.col(stamp).isNotNull())
    inside, finished = rows, []
    while True:
        level = len(made.crowded)
        binned = inside.select(*keys, made._start(micros, level).alias(BLOCK))
        counted = settle(binned.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_rows")))
        width = made.widths[-1]
        over = counted.where(F.col("_rows") > most_rows)
        if width == 1 or over.isEmpty():
            finished.append(counted)
            break
        finished.append(counted.where(F.col("_rows") <= most_rows))
        made.crowded.append(over.withColumnRenamed(BLOCK, "_start"))
        inside = made._inside(inside, level, stamp).where("_inside").drop("_inside")
        made.widths.append(max(1, -(-width // FINER)))
    counts = finished[0]
    for more in finished[1:]:
        counts = counts.unionByName(more)
    return Directory(keys, made.widths, made.crowded, counts)


def rows_before(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``counts`` of a directory with ``_before``, the rows of all earlier blocks, and ``n``, those of the group."""
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    return counts.withColumns({"_before": before, "n": F.sum("_rows").over(Window.partitionBy(*keys))})


def stamps_at(
    rows: DataFrame,
    positions: dict[str, Column],
    keys: list[str],
    stamp: str = TS,
    step: int = 3_600_000_000,
    steps_per_block: int = TOTALS_BLOCK,
    most_rows: int = MOST_ROWS,
) -> DataFrame:
    """The stamps found at given positions of each group, without sorting any group whole.

    ``positions`` maps a name to a zero-based position, an expression over ``n`` (rows in the group).
    The directory's counts, summed up in block order, tell the block in which each position falls, and only the
    rows of those blocks are ranked. Returns one row per group: the keys, ``n`` and one stamp per name, null
    where the position lies past the end.
    """
    blocks = directory(rows, keys, step, stamp, steps_per_block, most_rows)
    totals = rows_before(blocks.counts, keys)
    wanted = {"_first": F.lit(0), **positions}
    entries = F.array(
        *[F.struct(F.lit(name).alias("name"), at.cast("bigint").alias("at")) for name, at in wanted.items()]
    )
    cuts = (
        totals.select("*", F.inline(entries))
        .where((F.col("at") >= F.col("_before")) & (F.col("at") < F.col("_before") + F.col("_rows")))
        .select(*keys, BLOCK, "n", "name", (F.col("at") - F.col("_before")).alias("_offset"))
    )
    placed = blocks.place(rows.select(*keys, F.col(stamp).alias("_stamp")), "_stamp")
    # The cuts are a row per group and position. Stored, their size is known, so that they are the side to send.
    ranked = join_on(placed, settle(cuts), [*keys, BLOCK]).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys, BLOCK, "name").orderBy("_stamp")) - 1
    )
    return (
        ranked.where(F.col("_rank") == F.col("_offset"))
        .groupBy(*keys)
        .agg(
            F.max("n").alias("n"),
            *[F.max(F.when(F.col("name") == name, F.col("_stamp"))).alias(name) for name in positions],
        )
    )
