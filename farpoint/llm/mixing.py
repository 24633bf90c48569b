"""Mixing sources to target weights: Pfair scheduling of source blocks."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farpoint.llm.common import bucket, pieces

#: Rows of a block, slots of a schedule's period, and rows that are numbered together.
BLOCK, PERIOD, GROUP = 32, 1_024, 20_000
#: Sources of one mix; their weights, block counts and schedules pass through the driver.
SOURCES = 1_024
#: Groups of a source whose sizes are summed together.
SET = 4_096


def shares(weights: dict, period: int = PERIOD) -> dict:
    """Slots of each source in a period: weights times the period, rounded by largest remainders, one at least."""
    total = sum(weights.values())
    names = sorted(weights, key=lambda s: (s is None, s))
    period = max(period, 2 * len(names))
    exact = {s: weights[s] / total * period for s in names}
    got = {s: max(1, int(exact[s])) for s in names}
    rest = period - sum(got.values())
    for s in sorted(names, key=lambda s: got[s] - exact[s]):
        if rest <= 0:
            break
        got[s] += 1
        rest -= 1
    for s in sorted(names, key=lambda s: -got[s]):  # ones that were rounded up to 1
        while rest < 0 and got[s] > 1:
            got[s] -= 1
            rest += 1
    return got


def schedule(slots: dict) -> dict:
    """Each source's slots in a period, by earliest deadline first.

    Block i of a source with weight w = slots / period is released at floor(i / w) and due at ceil((i + 1) / w). Weights
    sum to 1, so each block gets a slot between the two, and after any number of slots each source is less than one
    block from its share.
    """
    period, out = sum(slots.values()), {s: [] for s in slots}
    names = list(slots)
    later = sorted((i * period // slots[s], n, i) for n, s in enumerate(names) for i in range(slots[s]))[::-1]
    due: list[tuple[int, int, int]] = []
    for t in range(period):
        while later and later[-1][0] <= t:
            _, n, i = later.pop()
            heapq.heappush(due, (-(-(i + 1) * period // slots[names[n]]), n, i))
        end, n, _ = heapq.heappop(due)
        assert t < end
        out[names[n]].append(t)
    return out


@dataclass(frozen=True)
class Phase:
    """From ``start`` on, each source's blocks from ``first`` are dealt by a schedule of ``period`` slots."""

    start: int
    period: int
    first: dict
    count: dict
    slots: dict


def phases(blocks: dict, weights: dict, period: int = PERIOD) -> list[Phase]:
    """The schedule up to the last block. When a source has run out, the others go on by their weights among each other."""
    left, done, start, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        slots = schedule(shares({s: weights[s] for s in left}, period))
        length = sum(map(len, slots.values()))
        # the slot of a source's last block; the phase ends with the first such
        end = 1 + min((n - 1) // len(slots[s]) * length + slots[s][(n - 1) % len(slots[s])] for s, n in left.items())
        count = {s: end // length * len(slots[s]) + sum(t < end % length for t in slots[s]) for s in left}
        out.append(Phase(start, length, {s: done[s] for s in left}, count, slots))
        for s, n in count.items():
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        start += end
    return out


def smoothed(rows: dict, power: float) -> dict:
    """Weights in proportion to each source's rows to a power: 1 keeps the proportions, 0 weighs all alike."""
    return {s: n**power for s, n in rows.items()}


def mix(docs: DataFrame, weights: dict | None = None, power: float = 0.5, source: str = "source", doc_id: str = "doc_id", block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """``docs`` with all rows and columns, and where each stands in the mix: mix_block (of its source), mix_phase,
    mix_release, mix_deadline and mix_slot (of its block, in blocks) and mix_position (of the row, from 0, without gaps).

    weights: the target weight of each source; a source that has none gets the least one given. None: in proportion to
    the sources' rows to ``power``. Rows of a source follow in the order of a hash of their id and row, ``block`` rows
    make a block (the last may be smaller), and blocks are dealt as ``phases`` says: while all sources last, and again
    among those left when one has run out, the mix is less than one block from the targets after any number of blocks.
    No row is dropped or repeated. A null source is a source of its own; null ids and repeated rows are rows like any
    other; an empty table gives an empty table. Columns of the new names are replaced. Weights must be positive.

    Rows are numbered within groups of about GROUP rows of one source, and groups start where counts of the groups
    before them say, so a source with a third of all rows is many tasks. The driver gets the sources' counts and
    schedules; more than SOURCES sources are refused.
    """
    new = ("mix_block", "mix_phase", "mix_release", "mix_deadline", "mix_slot", "mix_position")
    keep = [c for c in docs.columns if c not in new]
    kinds = dict(docs.dtypes)
    row = F.struct(*[F.col(f"`{c}`") for c in keep])  # apart from the columns made here, whatever they are called
    hashed = F.xxhash64(F.col(f"`{doc_id}`"), *[F.col(f"`{c}`") for c in keep if "map<" not in kinds[c] and kinds[c] != "variant"])
    name = F.col(f"`{source}`").cast("string")
    # the source, and the same without nulls, so that rows are dealt by plain keys once
    base = docs.select(row.alias("row"), name.alias("s"), F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("k"), F.col(f"`{doc_id}`").alias("i"), hashed.alias("r"))
    counts = {r[0]: r[1] for r in base.groupBy("s").agg(F.count("*")).limit(SOURCES + 1).collect()}
    if len(counts) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    if weights is None:
        weights = smoothed(counts, power)
    else:
        weights = {s: weights.get(s, min(weights.values(), default=1.0)) for s in counts}
    groups = pieces(sum(counts.values()), GROUP) * 4

    # rows before each group of a source, by way of sets of SET groups
    base = base.withColumn("g", bucket(F.col("r"), groups, 5))
    sizes = base.groupBy("k", "g").agg(F.count("*").alias("n")).withColumn("u", F.floor(F.col("g") / SET))
    sets = sizes.groupBy("k", "u").agg(F.sum("n").alias("n"))
    sets = sets.select("k", "u", (F.sum("n").over(Window.partitionBy("k").orderBy("u")) - F.col("n")).alias("earlier"))
    inside = sizes.withColumn("b", F.sum("n").over(Window.partitionBy("k", "u").orderBy("g")) - F.col("n"))
    before = inside.join(sets, ["k", "u"]).select("k", "g", (F.col("b") + F.col("earlier")).alias("before"))
    at = F.row_number().over(Window.partitionBy("k", "g").orderBy("r", "i"))
    numbered = base.withColumn("n", at).join(before, ["k", "g"])
    numbered = numbered.select("row", "k", (F.col("before") + F.col("n") - 1).alias("n")).withColumn("mix_block", F.floor(F.col("n") / block).cast("long"))

    plan = phases({s: pieces(n, block) for s, n in counts.items()}, weights, period)
    table = [(s, i, p.start, p.period, p.first[s], p.first[s] + p.count[s], p.slots[s]) for i, p in enumerate(plan) for s in p.first]
    spark = docs.sparkSession
    deal = spark.createDataFrame(table, "source string, mix_phase int, start long, period long, lo long, hi long, slots array<int>")
    deal = deal.withColumn("k2", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    on = (F.col("k") == F.col("k2")) & (F.col("mix_block") >= F.col("lo")) & (F.col("mix_block") < F.col("hi"))
    out = numbered.join(F.broadcast(deal), on)
    k, size, i = F.col("mix_block") - F.col("lo"), F.size("slots"), F.col("period")
    out = out.withColumns(
        {
            "mix_slot": (F.col("start") + F.floor(k / size) * i + F.get("slots", (k % size).cast("int"))).cast("long"),
            "mix_release": (F.col("start") + F.floor(k * i / size)).cast("long"),
            "mix_deadline": (F.col("start") + F.ceil((k + 1) * i / size)).cast("long"),
        }
    )
    # rows before a block: full blocks, but for last blocks of sources that ended
    short = [(slot, block - (counts[s] - (b - 1) * block)) for s, b, slot in last_blocks(counts, plan, block) if counts[s] % block]
    ends = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).alias("m")) for t, m in short]) if short else None
    lost = F.aggregate(F.filter(ends, lambda x: x["t"] < F.col("mix_slot")), F.lit(0), lambda a, x: a + x["m"]) if short else F.lit(0)
    out = out.withColumn("mix_position", (F.col("mix_slot") * block - lost + F.col("n") % block).cast("long"))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], *new)


def last_blocks(counts: dict, plan: list[Phase], block: int) -> list[tuple]:
    """(source, its blocks, the slot of its last block)."""
    out = []
    for s, n in counts.items():
        b = pieces(n, block)
        for p in plan:
            if s in p.first and p.first[s] <= b - 1 < p.first[s] + p.count[s]:
                k = b - 1 - p.first[s]
                out.append((s, b, p.start + k // len(p.slots[s]) * p.period + p.slots[s][k % len(p.slots[s])]))
    return out


def in_order(mixed: DataFrame, each: int = GROUP) -> DataFrame:
    """The rows in the order of the mix: part i holds the i-th ``each`` positions, sorted."""
    rows = mixed.agg(F.max("mix_position")).first()[0]
    n = pieces((rows or 0) + 1, each)
    part = F.floor(F.col("mix_position") / each).cast("int")
    return mixed.repartitionById(n, part).sortWithinPartitions("mix_position")
