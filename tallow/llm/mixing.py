"""Mixing sources to target weights, natively: hash-random keys, prefix sums by key range, an exact cut.

Every row gets a uniform key from its id. The keys of a source are split into equal ranges of about
``rows_a_range`` rows; sizes are summed by range and prefix sums over the ranges show in which one a
source's budget ends. Only that range is sorted, and its prefix sum gives the key at which to cut. Rows that share it
(repeated or null ids) are cut the same way by a key of their texts, and rows that share both, which are equal, by their
number, counted by task. What follows for a row depends on its source alone (whole epochs, the two cut keys, the words
left there), so that the decision joins back without moving the rows; only equal rows at the cut are set apart.

Cases: null text has size 0; the null source is a source of its own, last in order; rows that share an id are cut like
others, so that a source's taken words are its target's to the word; a source of size 0 has target 0; an empty table gives an
empty result; other columns are kept by `mixed_documents`, whatever their names, and ignored by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources the table of decisions (48 bytes each) is broadcast; beyond, Spark plans the join.
MOST_BROADCAST = 100_000


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("bigint")


def random_key(key: str) -> Column:
    """60 uniform bits of the id's MD5."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _few(table: DataFrame, n: int) -> DataFrame:
    return F.broadcast(table) if n <= MOST_BROADCAST else table


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """source, n_rows, source_size, rank, target from rows of (source, size).

    A target is the lesser of `most` times the source's size and one level times its weight, where the
    level makes the targets sum up to `share` times all sizes: sources by rising cap per weight, those
    are capped whose cap the level left after the ones before would exceed.
    """
    by_source = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    everything, before = Window.partitionBy(), Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    t = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    t = t.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumn("budget", F.sum("source_size").over(everything) * share).withColumn("all_weight", F.sum("weight").over(everything))
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    free = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    t = t.withColumn("capped", left * F.col("weight") >= F.col("cap") * free)
    spent = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    taken = F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(everything)
    level = F.try_divide(F.col("budget") - spent, F.col("all_weight") - taken)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return t.withColumn("target", target.cast("double")).select("source", "n_rows", "source_size", "rank", "target")


def _cut(rows: DataFrame, plan: DataFrame, n_sources: int, rows_a_range: int) -> DataFrame:
    """Per rank of a source: cut (the key at which its `rest` ends), left (words left there), at_cut (rows there).

    rows: source, key, size; plan: source, rank, n_rows, rest. No row where the rest is 0 or takes all.
    """
    ranged = plan.select(F.col("source").alias("s"), "rank", F.ceil(F.col("n_rows") / rows_a_range).alias("n_ranges"), "rest")
    placed = rows.join(_few(ranged, n_sources), F.col("source").eqNullSafe(F.col("s")))
    placed = placed.withColumn("range", F.floor(F.col("key") / float(1 << 60) * F.col("n_ranges"))).select("rank", "range", "key", "size", "rest")
    upto = Window.partitionBy("rank").orderBy("range")
    ranges = placed.groupBy("rank", "range").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    ranges = ranges.withColumn("end", F.sum("size").over(upto)).withColumn("begin", F.col("end") - F.col("size"))
    cut_ranges = ranges.filter("begin <= rest and rest < end").select(F.col("rank").alias("r"), F.col("range").alias("g"), "begin")
    near = placed.join(_few(cut_ranges, n_sources), (F.col("rank") == F.col("r")) & (F.col("range") == F.col("g")))
    by_key = near.groupBy("rank", "key").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.first("rest").alias("rest"), F.first("begin").alias("begin"))
    upto = Window.partitionBy("rank").orderBy("key")
    by_key = by_key.withColumn("end", F.col("begin") + F.sum("size").over(upto)).withColumn("before", F.col("end") - F.col("size"))
    cut = by_key.filter("before <= rest and rest < end")
    return cut.select("rank", F.col("key").alias("cut"), (F.col("rest") - F.col("before")).alias("left"), F.col("n").alias("at_cut"))


def decisions(rows: DataFrame, by_source: DataFrame, n_sources: int, rows_a_range: int = 4096) -> DataFrame:
    """Per source: epochs (whole repeats), cut_key, cut_text (keys of id and text at which the rest ends), cut_rest (words left there),
    cut_rows (rows with both keys).

    rows: source, key, text_key, size.
    """
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    plan = by_source.withColumn("epochs", F.coalesce(F.try_divide(budget, F.col("source_size")).cast("bigint"), F.lit(0).cast("bigint")))
    plan = plan.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    first = stored(_cut(rows, plan, n_sources, rows_a_range), "cut")
    by_id = first.select(F.col("rank").alias("r"), F.col("cut").alias("cut_key"), "left", F.col("at_cut").alias("n"))
    inner = plan.join(by_id, F.col("rank") == F.col("r")).select("source", "rank", F.col("n").alias("n_rows"), F.col("left").alias("rest"), "cut_key")
    tied = rows.join(_few(inner.select(F.col("source").alias("s"), "cut_key"), n_sources), F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("cut_key")))
    by_text = _cut(tied.select("source", F.col("text_key").alias("key"), "size"), inner, n_sources, rows_a_range)
    by_text = by_text.select(F.col("rank").alias("t"), F.col("cut").alias("cut_text"), F.col("left").alias("cut_rest"), F.col("at_cut").alias("cut_rows"))
    both = by_id.select("r", "cut_key").join(by_text, F.col("r") == F.col("t"))
    whole = plan.join(both, F.col("rank") == F.col("r"), "left").select("source", "source_size", "target", "epochs", "cut_key", "cut_text", "cut_rest", "cut_rows")
    out = stored(whole, "cuts")
    discard(first)
    return out


def plan_for(rows: DataFrame, rows_a_range: int = 4096) -> tuple[DataFrame, int, bool]:
    """The stored decisions of all sources, how many sources there are, and whether any has several rows with its two cut keys."""
    by_source = stored(targets(rows), "targets")
    n = by_source.count()
    plan = decisions(rows, by_source, n, rows_a_range)
    discard(by_source)
    return plan, n, not plan.filter("cut_rows > 1").isEmpty()


def _numbered(tied: DataFrame, source: str, own: str) -> DataFrame:
    """tied, stored, with {own}_number: from 0 on among the rows of a source. Numbers go by task and by place in the task, and the
    sums behind them are a row a source and task."""
    task, place, before = f"{own}_task", f"{own}_place", f"{own}_before"
    held = stored(tied.withColumn(place, F.monotonically_increasing_id()).withColumn(task, F.shiftright(place, 33)), "tied")
    counts = held.groupBy(F.col(source).alias(f"{own}_s"), F.col(task).alias(f"{own}_t")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(f"{own}_s").orderBy(f"{own}_t").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    here = F.row_number().over(Window.partitionBy(source, task).orderBy(place)) - 1
    met = held.withColumn(f"{own}_here", here).join(counts, F.col(source).eqNullSafe(F.col(f"{own}_s")) & (F.col(task) == F.col(f"{own}_t")))
    return met.withColumn(f"{own}_number", F.col(before) + F.col(f"{own}_here"))


def _decided(rows: DataFrame, source: str, own: str, plan: DataFrame, n: int, several: bool) -> DataFrame:
    """rows (with {own}_key, {own}_text, {own}_size) and {own}_epochs, {own}_part (words beyond whole epochs), {own}_source_size,
    {own}_target."""
    c = lambda name: F.col(f"{own}_{name}")
    named = plan.select(*(F.col(x).alias(f"{own}_{x}") for x in plan.columns))
    joined = rows.join(_few(named, n), F.col(source).eqNullSafe(c("source")))
    before = (c("key") < c("cut_key")) | ((c("key") == c("cut_key")) & (c("text") < c("cut_text")))
    at = F.coalesce((c("key") == c("cut_key")) & (c("text") == c("cut_text")), F.lit(False))
    part = F.when(at, F.least(c("size"), c("cut_rest"))).when(before, c("size")).otherwise(F.lit(0)).cast("bigint")
    if not several:
        return joined.withColumn(f"{own}_part", part)
    tied = at & (c("cut_rows") > 1)
    numbered = _numbered(joined.filter(tied), source, own)
    each = F.greatest(F.lit(0), F.least(c("size"), c("cut_rest") - c("number") * c("size"))).cast("bigint")
    rest = joined.filter(~F.coalesce(tied, F.lit(False))).withColumn(f"{own}_part", part)
    return rest.unionByName(numbered.withColumn(f"{own}_part", each).select(*rest.columns))


def _keyed(docs: DataFrame, key: str, text: str, own: str) -> DataFrame:
    return docs.withColumns({f"{own}_key": random_key(key), f"{own}_text": random_key(text), f"{own}_size": n_words(text)})


def _sizes(keyed: DataFrame, source: str, own: str) -> DataFrame:
    return keyed.select(F.col(source).alias("source"), F.col(f"{own}_key").alias("key"), F.col(f"{own}_text").alias("text_key"), F.col(f"{own}_size").alias("size"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", rows_a_range: int = 4096) -> DataFrame:
    """key, source, size, source_size, target, taken of every row."""
    rows = _keyed(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")), "doc_id", "text", "mix").drop("text")
    rows = stored(rows, "sizes")
    plan, n, several = plan_for(_sizes(rows, "source", "mix"), rows_a_range)
    decided = _decided(rows, "source", "mix", plan, n, several)
    taken = F.col("mix_epochs") * F.col("mix_size") + F.col("mix_part")
    return decided.select("doc_id", "source", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken.cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", rows_a_range: int = 4096) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each epoch of a document; the copy at the cut keeps its
    first words only. Rows stay where they are. n_chars, where there is one, follows the text."""
    own = fresh(docs, "mix")
    c = lambda name: F.col(f"{own}_{name}")
    keyed = _keyed(docs, key, text, own)
    sizes = stored(_sizes(keyed, source, own), "sizes")
    plan, n, several = plan_for(sizes, rows_a_range)
    discard(sizes)
    decided = _decided(keyed, source, own, plan, n, several)
    copies = c("epochs") + (c("part") > 0).cast("bigint")
    copied = decided.filter(copies > 0).withColumn(f"{own}_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    last = (c("copy") > c("epochs")) & (c("part") < c("size"))
    shorter = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), c("part").cast("int")), "")
    out = copied.withColumn(text, F.when(last, shorter).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(last, F.length(F.col(text)).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


ORACLE = r"""
with rows as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as key, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::bigint as text_key
  from documents),
per as (select source, sum(size)::bigint as source_size from rows group by source),
ranked as (select *, row_number() over (order by source nulls last) as rk from per),
weighted as (select *, case (rk - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w, 2 * source_size as cap from ranked),
ordered as (
  select *, 1.5::double * sum(source_size) over () as budget, sum(w) over () as all_w,
         coalesce(sum(cap) over (order by cap / w::double, rk rows between unbounded preceding and 1 preceding), 0) as cap_before,
         coalesce(sum(w) over (order by cap / w::double, rk rows between unbounded preceding and 1 preceding), 0) as w_before
  from weighted),
flagged as (select *, (budget - cap_before) * w >= cap * (all_w - w_before) as capped from ordered),
leveled as (
  select *, (budget - sum(case when capped then cap else 0 end) over ()) /
            nullif(all_w - sum(case when capped then w else 0 end) over (), 0) as level
  from flagged),
targets as (select source, source_size, case when capped then cap::double else level * w end::double as target from leveled),
placed as (
  select r.doc_id, r.size, t.source_size, t.target, floor(t.target + 0.5)::bigint as budget,
         sum(r.size) over (partition by r.source order by r.key, r.text_key rows unbounded preceding)::bigint as upto
  from rows r join targets t on r.source is not distinct from t.source)
select doc_id, size, source_size, target,
       case when source_size = 0 then 0 else
         (budget // source_size) * size + greatest(0, least(size, budget % source_size - (upto - size))) end::bigint as taken
from placed
"""
