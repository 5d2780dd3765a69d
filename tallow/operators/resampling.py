"""Bootstrap paths over the multiples of runs of any length: terminal R and ruin.

A run's multiples lie in chunks, dealt by a hash of the trade, of a bounded number of trades. A run of one chunk is drawn from
there. A longer one whose multiples take few values is a table of values and how often each occurs: a block of paths draws from
it, a path is walked until it is ruined, and what the rest of it adds is drawn as how often each value comes (a multinomial),
so that no draw leaves its task. For the others each block of paths and part of steps first draws how many of its draws fall on each chunk (a
multinomial of the chunks' sizes), each chunk draws its own, and these meet again by block and part, where every path's
draws are put in random order. That is the same as drawing trades one by one. A part leaves its sum, product, highest and
lowest point, which compose over parts. Parts are walked in turns, and only by paths that are not ruined: what the steps behind
a ruin add does not depend on their order, so each chunk draws its share of them and leaves their sum alone. So no task holds a
whole run or a whole path, and what is shuffled are the draws of steps that are walked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .quantiles import _checkpoints

#: Most trades of a chunk: 2 MB of multiples.
CHUNK = 1 << 18
#: A long run of at most so many different multiples for each trade of a chunk is a table: 16 MB.
TABLE = 4
#: A table that goes to every block of paths is worth it from so many trades a multiple.
TRADES = 16
#: Trades of a run of one chunk for which it goes to one more task.
SHARE = 1 << 14
#: Most steps of a part: with 250 paths a block, 8 MB of draws.
STEPS = 4096
#: Steps of the first part; each has twice those of the one before.
FIRST = 512
#: Multiples that a table of the sums of two is made of: 65,536 sums, a number of 16 bits draws one.
_PAIRED = 256
#: Above every byte of a name: what follows in a generator's seed is a part or a chunk.
_ABOVE = 256


def draws(rs: np.ndarray, paths: int, rng: np.random.Generator, step: int = STEPS) -> Iterator[np.ndarray]:
    """Matrices (a row a path) of drawn multiples, a block of steps at a time, as many steps as there are multiples."""
    for done in range(0, len(rs), step):
        yield rs[rng.integers(0, len(rs), (paths, min(step, len(rs) - done)))]


def resampled_paths(rs: np.ndarray, paths: int, rng: np.random.Generator, risk: float = 0.01, ruin: float = 0.6, step: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Terminal R and ruin of `paths` bootstrap paths, all at once: a matrix of draws a block of steps, of which running
    products and running peaks are taken along the steps and carried to the next block."""
    total, wealth, peak, ruined = np.zeros(paths), np.ones(paths), np.ones(paths), np.zeros(paths, bool)
    for drawn in draws(rs, paths, rng, step):
        part, grown, high, low, fell = summary(drawn, risk, ruin)
        total += part
        ruined |= fell | (wealth * low <= (1.0 - ruin) * peak)
        peak = np.maximum(peak, wealth * high)
        wealth = wealth * grown
    return total, ruined


def summary(drawn: np.ndarray, risk: float, ruin: float) -> tuple[np.ndarray, ...]:
    """Sum, product, highest and lowest point of each row of draws from a start of 1, and whether it fell by ruin inside."""
    curve = np.cumprod(np.maximum(0.0, 1.0 + risk * drawn), axis=1)
    fell = (curve <= (1.0 - ruin) * np.maximum.accumulate(curve, axis=1)).any(axis=1)
    return drawn.sum(axis=1), curve[:, -1], curve.max(axis=1), curve.min(axis=1), fell


def shares(key: list[int], sizes: np.ndarray, paths: int, steps: int) -> np.ndarray:
    """How many of each path's draws fall on each chunk (a row a path)."""
    return np.random.default_rng(key).multinomial(steps, sizes / sizes.sum(), size=paths)


def parts_of(n: int, steps: int) -> list[tuple[int, int]]:
    """Beginning and number of steps of each part of a path of n steps."""
    found, at, each = [], 0, min(FIRST, steps)
    while at < n:
        found.append((at, min(each, n - at)))
        at, each = at + each, min(2 * each, steps)
    return found


def own_draws(key: list[int], chunk: int, values: np.ndarray, many: int) -> np.ndarray:
    return values[np.random.default_rng([*key, _ABOVE + chunk]).integers(0, len(values), many)]


def own_sums(values: np.ndarray, counts: list[np.ndarray], rngs: list[np.random.Generator]) -> list[np.ndarray]:
    """Sums of so many draws a path (an array a block of paths, each with its generator). How many fall on each few multiples is
    drawn first; of these, two draws are one from the sums of two, of which all pairs are as likely."""
    each = np.bincount(np.arange(len(values)) // _PAIRED)
    dealt = [np.ascontiguousarray(rng.multinomial(many, each / len(values)).T) for many, rng in zip(counts, rngs)]
    sums = [np.zeros(len(many)) for many in counts]
    for g in range(len(each)):
        own = values[g * _PAIRED : (g + 1) * _PAIRED]
        pairs = np.add.outer(own, own).ravel()
        for of, rng, into in zip(dealt, rngs, sums):
            two, some = of[g] // 2, of[g] > 1
            into += own[rng.integers(0, len(own), len(two))] * (of[g] % 2)
            if some.any():
                into[some] += np.add.reduceat(pairs.take(_indices(rng, len(pairs), int(two.sum()))), (np.cumsum(two) - two)[some])
    return sums


def _indices(rng: np.random.Generator, below: int, many: int) -> np.ndarray:
    if below < 1 << 16:
        return rng.integers(0, below, many, dtype=np.uint16)
    return rng.integers(0, 1 << 64, -(-many // 4), dtype=np.uint64).view(np.uint16)[:many]  # four numbers at once


def shuffled(key: list[int], counts: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    """A matrix (a row a path) of the chunks' draws, each row in random order."""
    paths = len(counts[0])
    whose = np.concatenate([np.repeat(np.arange(paths), c) for c in counts])
    rows = np.concatenate(values)[np.argsort(whose, kind="stable")].reshape(paths, -1)
    return np.random.default_rng([*key, (1 << 32) - 1]).permuted(rows, axis=1)


def alias(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walker's tables of weights: a cell is itself with probability keep, else the other one."""
    keep, other = counts * (len(counts) / counts.sum()), np.arange(len(counts), dtype=np.int32)
    small, large = (np.flatnonzero(t).tolist() for t in (keep < 1, keep >= 1))
    weights = keep.tolist()
    while small and large:
        a, b = small.pop(), large[-1]
        other[a], keep[a] = b, weights[a]
        weights[b] -= 1 - weights[a]
        if weights[b] < 1:
            small.append(large.pop())
    keep[small + large] = 1.0
    return keep, other


def tabled_paths(values: np.ndarray, counts: np.ndarray, paths: int, rng: np.random.Generator, risk: float = 0.01, ruin: float = 0.6, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Terminal R and ruin of `paths` bootstrap paths over values that occur so many times. Draws are independent, so what
    the steps behind a path's ruin add depends on their number alone: they are drawn by value, not one by one, where that is less work."""
    n, k = int(counts.sum()), len(values)
    each = n // np.gcd.reduce(counts) if k else 0
    spread = np.repeat(values, counts // (n // each)) if k and each <= 2 * k else None  # copies of a table: one of them
    keep, other = (None, None) if spread is not None or not k else alias(counts)
    moved = None if other is None else values[other]

    def drawn(many: int, steps: int) -> np.ndarray:
        if spread is not None:
            return spread[rng.integers(0, len(spread), (many, steps), dtype=np.int32)]
        x = rng.random((many, steps)) * k
        cell = np.minimum(x.astype(np.int32), k - 1)
        return np.where(x - cell < keep[cell], values[cell], moved[cell])

    total, ruined = np.zeros(paths), np.zeros(paths, bool)
    wealth, peak, alive, done = np.ones(paths), np.ones(paths), np.arange(paths), 0
    while len(alive) and done < n:
        part, grown, high, low, fell = summary(drawn(len(alive), min(step, n - done)), risk, ruin)
        total[alive] += part
        fell |= wealth * low <= (1.0 - ruin) * peak
        peak, wealth, done = np.maximum(peak, wealth * high), wealth * grown, min(n, done + step)
        ruined[alive[fell]] = True
        rest = n - done
        for path in alive[fell] if rest else ():
            if rest > 8 * k:
                total[path] += float(rng.multinomial(rest, counts / n) @ values)
            else:
                total[path] += sum(float(drawn(1, min(1 << 20, rest - at)).sum()) for at in range(0, rest, 1 << 20))
        alive, wealth, peak = alive[~fell], wealth[~fell], peak[~fell]
    return total, ruined


def monte_carlo(trades: DataFrame, paths: int = 10_000, seed: int = 0, block: int = 250, risk: float = 0.01, ruin: float = 0.6, chunk: int = CHUNK, steps: int = STEPS) -> DataFrame:
    """run_id, p05, p95 (of terminal R), ruin (share of paths) of trades (run_id, trade_id: unique in a run, r).

    Blocks of paths have generators of their own from seed, run and block (and part and chunk), so that the result does not
    depend on how the work is dealt. Null multiples are no trades; a run that has no others ends at 0 and is not ruined. A
    null run is a run. Further columns are ignored.
    """
    ends = _ends(trades, paths, seed, block, risk, ruin, chunk, steps, True)
    return ends.groupBy("run_id").agg(F.percentile("total", 0.05).alias("p05"), F.percentile("total", 0.95).alias("p95"), F.avg(F.col("ruined").cast("int")).alias("ruin"))


def risk_of_ruin(trades: DataFrame, paths: int = 10_000, seed: int = 0, block: int = 250, risk: float = 0.01, ruin: float = 0.6, chunk: int = CHUNK, steps: int = STEPS) -> DataFrame:
    """run_id, ruin of monte_carlo alone, for which a path of several chunks ends where it is ruined."""
    return _ends(trades, paths, seed, block, risk, ruin, chunk, steps, False).groupBy("run_id").agg(F.avg(F.col("ruined").cast("int")).alias("ruin"))


def _ends(trades: DataFrame, paths: int, seed: int, block: int, risk: float, ruin: float, chunk: int, steps: int, totals: bool) -> DataFrame:
    """run_id, total, ruined of every path."""
    spark = trades.sparkSession
    ship(spark)
    r = F.col("r").cast("double")
    rows = trades.select(F.col("run_id").cast("string").alias("run_id"), F.col("trade_id").alias("id"), r.alias("r"), F.xxhash64("trade_id", r).alias("h"))
    # the driver has a row for each long run
    sizes = rows.groupBy("run_id").agg(F.count("r").alias("n")).filter(F.col("n") > chunk).collect()
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-paths // block) - 1))).alias("block")
    tasks = 4 * spark.sparkContext.defaultParallelism
    if not sizes:
        return _local(rows, tasks, paths, seed, block, risk, ruin, steps)

    def known(df: DataFrame, runs: list[tuple], schema: str, how: str) -> DataFrame:
        return df.join(F.broadcast(spark.createDataFrame(runs, f"of_run string, {schema}")), F.col("run_id").eqNullSafe(F.col("of_run")), how).drop("of_run")

    # chunks of half the bound on average, so that chance leaves none above it
    long = {s.run_id: (s.n, -(-2 * s.n // chunk)) for s in sizes}
    different = known(rows, [(k, True) for k in long], "long boolean", "inner").groupBy("run_id").agg(F.approx_count_distinct("r").alias("k")).collect()
    few = {d.run_id for d in different if d.k <= TABLE * chunk and d.k * TRADES <= long[d.run_id][0]}
    named = known(rows, [(k, c, k in few) for k, (_, c) in long.items()], "chunks bigint, few boolean", "left")
    ends = _local(named.filter("chunks is null"), tasks, paths, seed, block, risk, ruin, steps)
    if few:
        values = named.filter("few and r is not null").groupBy("run_id", "r").agg(F.count("*").alias("times"))
        ends = ends.unionByName(_tabled(values, blocks, tasks, paths, seed, block, risk, ruin))
    if len(few) < len(long):
        ends = ends.unionByName(_spread(named.filter("not few and r is not null"), tasks, paths, seed, block, risk, ruin, steps, totals))
    return ends


def _values() -> Column:
    """The multiples of a group in order of trades."""
    pair = F.when(F.col("r").isNotNull(), F.struct("id", "r"))
    return F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["r"]).alias("rs")


def _floats(cell) -> np.ndarray:
    return np.asarray(cell.values.to_numpy(zero_copy_only=False), float)


def _local(rows: DataFrame, tasks: int, paths: int, seed: int, block: int, risk: float, ruin: float, steps: int) -> DataFrame:
    """run_id, total, ruined of every path, for runs of one chunk. A run goes to a task for each so many of its trades, with a share of the blocks."""
    schema = pa.schema([("run_id", pa.string()), ("total", pa.float64()), ("ruined", pa.bool_())])
    blocks = -(-paths // block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run_id, rs, span, first in zip(*(batch.column(i) for i in range(4))):
                name, values = run_id.as_py(), _floats(rs)
                for k in range(first.as_py(), min(first.as_py() + span.as_py(), blocks)):
                    many = min(block, paths - k * block)
                    rng = np.random.default_rng([seed, k, *(name or "").encode()])
                    total, ruined = resampled_paths(values, many, rng, risk, ruin, steps)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * many, pa.string()), pa.array(total), pa.array(ruined)], schema=schema)

    held = rows.groupBy("run_id").agg(_values())
    held = held.withColumn("span", F.greatest(F.lit(1), F.floor(F.lit(blocks * SHARE) / F.greatest(F.size("rs"), F.lit(SHARE)))).cast("int"))
    first = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1), F.col("span"))).alias("first")
    return held.select("run_id", "rs", "span", first).repartition(tasks, "run_id", "first").mapInArrow(run, "run_id string, total double, ruined boolean")


def _tabled(values: DataFrame, blocks: Column, tasks: int, paths: int, seed: int, block: int, risk: float, ruin: float) -> DataFrame:
    """run_id, total, ruined of every path, for long runs of few different multiples (run_id, r, times)."""
    schema = pa.schema([("run_id", pa.string()), ("total", pa.float64()), ("ruined", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run_id, rs, times, k in zip(*(batch.column(i) for i in range(4))):
                name, many = run_id.as_py(), min(block, paths - k.as_py() * block)
                rng = np.random.default_rng([seed, k.as_py(), *(name or "").encode()])
                total, ruined = tabled_paths(_floats(rs), times.values.to_numpy(), many, rng, risk, ruin)
                yield pa.RecordBatch.from_arrays([pa.array([name] * many, pa.string()), pa.array(total), pa.array(ruined)], schema=schema)

    held = values.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("r", "times"))).alias("table"))
    held = held.select("run_id", F.col("table.r").alias("rs"), F.col("table.times").alias("times"), blocks)
    return held.repartition(tasks, "run_id", "block").mapInArrow(run, "run_id string, total double, ruined boolean")


def _spread(rows: DataFrame, tasks: int, paths: int, seed: int, block: int, risk: float, ruin: float, steps: int, totals: bool) -> DataFrame:
    """run_id, total, ruined of every path, for runs of several chunks. Without totals, total is that of the steps walked."""
    held = _kept(rows.groupBy("run_id", F.pmod("h", F.col("chunks")).alias("chunk")).agg(_values()))
    sizes: dict[str | None, dict[int, int]] = {}
    for found in held.select("run_id", "chunk", F.size("rs").alias("n")).orderBy("chunk").collect():  # a number a chunk
        sizes.setdefault(found.run_id, {})[found.chunk] = found.n
    each = {run: np.array(list(of.values())) for run, of in sizes.items()}
    place = {(run, chunk): at for run, of in sizes.items() for at, chunk in enumerate(of)}
    # a chunk goes to as many tasks as keep them all busy, with so many blocks of paths
    blocks = -(-paths // block)
    span = min(blocks, max(1, blocks * len(place) // (2 * tasks)))
    met = held.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1), F.lit(span)))).repartition(2 * tasks, "run_id", "chunk", "first")
    drawn_schema = pa.schema([("run_id", pa.string()), ("block", pa.int32()), ("part", pa.int32()), ("at", pa.int32()), ("paths", pa.binary()), ("counts", pa.binary()), ("drawn", pa.binary())])
    sums_schema = pa.schema([("run_id", pa.string()), ("block", pa.int32()), ("at", pa.int32()), ("sums", pa.binary())])

    def of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Name, place and multiples of chunks, and of each of their blocks its number and how far its paths were walked."""
        for batch in batches:
            for run_id, chunk, rs, first, *walked in zip(*(batch.column(i) for i in range(batch.num_columns))):
                name, numbers = run_id.as_py(), range(first.as_py(), min(first.as_py() + span, blocks))
                far = walked[0].values.to_numpy() if walked else np.full(paths, -1)
                yield name, place[name, chunk.as_py()], _floats(rs), [(k, far[k * block : (k + 1) * block]) for k in numbers]

    def draws_of(begin: int, end: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for name, at, values, of_blocks in of_chunks(batches):
                some = parts_of(int(each[name].sum()), steps)[begin:end]
                for number, walked in of_blocks:
                    alive = walked < 0
                    for part, (_, length) in enumerate(some if alive.any() else (), begin):
                        key = [seed, number, _ABOVE + part, *(name or "").encode()]
                        counts = shares(key, each[name], len(alive), length)[:, at]
                        drawn = own_draws(key, at, values, int(counts.sum()))[np.repeat(alive, counts)]
                        cells = [name, number, part, at, np.flatnonzero(alive).astype(np.int32).tobytes(), counts[alive].astype(np.int32).tobytes(), drawn.tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, drawn_schema)], schema=drawn_schema)

        return run

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        name, number, part = (k.as_py() for k in key)
        table = table.sort_by("at")
        counts, values = ([np.frombuffer(c.as_py(), kind) for c in table.column(of)] for of, kind in (("counts", np.int32), ("drawn", np.float64)))
        rows = shuffled([seed, number, _ABOVE + part, *(name or "").encode()], counts, values)
        n = int(each[name].sum())
        at, length = parts_of(n, steps)[part]
        of = [pa.array([name] * len(rows), pa.string()), pa.array([part] * len(rows), pa.int32()), pa.array(np.frombuffer(table.column("paths")[0].as_py(), np.int32).astype(np.int64) + number * block)]
        walked = [pa.array(np.full(len(rows), k, np.int64)) for k in (at + length, n - at - length)]
        return pa.Table.from_arrays([*of, *walked, *(pa.array(c) for c in summary(rows, risk, ruin))], names=["run_id", "part", "path", "walked", "ahead", "total", "grown", "high", "low", "fell"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, at, values, of_blocks in of_chunks(batches):
            keys = [[seed, k, (1 << 32) - 1, *(name or "").encode()] for k, _ in of_blocks]
            n = each[name].sum()
            counts = [np.random.default_rng(key).multinomial(n - np.abs(walked), each[name] / n)[:, at] for key, (_, walked) in zip(keys, of_blocks)]
            sums = own_sums(values, counts, [np.random.default_rng([*key, _ABOVE + at]) for key in keys])
            of = [[name] * len(sums), [k for k, _ in of_blocks], [at] * len(sums), [x.tobytes() for x in sums]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(of, sums_schema)], schema=sums_schema)

    def added(key: tuple, table: pa.Table) -> pa.Table:
        sums = np.sum([np.frombuffer(c.as_py(), np.float64) for c in table.sort_by("at").column("sums")], axis=0)
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(sums), pa.string()), pa.array(np.arange(len(sums), dtype=np.int64) + key[1].as_py() * block), pa.array(sums)], names=["of_run", "of_path", "rest"])

    def with_walked(ends: DataFrame) -> DataFrame:
        """Chunks and how far the paths of their run were walked, below zero if they are not ruined."""
        far = F.when(F.col("ruined"), F.col("walked")).otherwise(-F.col("walked"))
        of = ends.groupBy(F.col("run_id").alias("of_run")).agg(F.transform(F.array_sort(F.collect_list(F.struct("path", far.alias("far")))), lambda x: x["far"]).alias("far"))
        return met.join(F.broadcast(of), F.col("run_id").eqNullSafe(F.col("of_run"))).drop("of_run")  # a number a path of a long run

    parts, ends, done = None, None, 0
    while ends is None or not ends.filter("not ruined and ahead > 0").isEmpty():
        upto = done + max(1, done // 2)
        drawn = (met if ends is None else with_walked(ends)).mapInArrow(draws_of(done, upto), "run_id string, block int, part int, at int, paths binary, counts binary, drawn binary")
        walked = _kept(drawn.groupBy("run_id", "block", "part").applyInArrow(meet, "run_id string, part int, path bigint, walked bigint, ahead bigint, total double, grown double, high double, low double, fell boolean"))
        parts, done = walked if parts is None else parts.unionByName(walked), upto
        ends = _composed(parts, ruin)
    if not totals:
        return ends.select("run_id", "total", "ruined")
    sums = with_walked(ends).mapInArrow(rest, "run_id string, block int, at int, sums binary").groupBy("run_id", "block").applyInArrow(added, "of_run string, of_path bigint, rest double")
    joined = ends.join(sums, F.col("run_id").eqNullSafe(F.col("of_run")) & (F.col("path") == F.col("of_path")))
    return joined.select("run_id", (F.col("total") + F.col("rest")).alias("total"), "ruined")


def _composed(parts: DataFrame, ruin: float) -> DataFrame:
    """run_id, path, walked, ahead, total, ruined: the parts of each path after each other."""
    before = Window.partitionBy("run_id", "path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("wealth", F.coalesce(F.product("grown").over(before), F.lit(1.0)))
    parts = parts.withColumn("peak", F.greatest(F.lit(1.0), F.max(F.col("wealth") * F.col("high")).over(before)))
    fell = F.col("fell") | (F.col("wealth") * F.col("low") <= (1.0 - ruin) * F.col("peak"))
    upto = F.sum("total").over(before.rowsBetween(Window.unboundedPreceding, 0))  # in order of parts, so that sums are the same each time
    ends = parts.select("run_id", "path", "part", "walked", "ahead", upto.alias("upto"), fell.alias("fell"))
    return ends.groupBy("run_id", "path").agg(F.max("walked").alias("walked"), F.min("ahead").alias("ahead"), F.max_by("upto", "part").alias("total"), F.max("fell").alias("ruined"))


def _kept(df: DataFrame) -> DataFrame:
    return df.checkpoint() if _checkpoints(df) else df.persist()
