"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target size (water filling under a cap).  Its documents are to be taken with unequal expectations:
e = min(max_copies, c * w), where the weight w grows with the logarithm of the document's size and c is the constant of
the source for which the expected words, the sum of e * size, are the target.  floor(e) whole copies are certain; the
rest f = e - floor(e) is an inclusion probability.  Documents are ranked by

    q = (u / (1 - u)) / (f / (1 - f)),    u uniform in (0, 1) from a hash of seed and id,

and the smallest q are selected until the words taken come nearest to what the source still lacks: a sample of fixed
size, in words.  The order is total, so the choice is a prefix of it.

Sizes fall into classes (a class is a power of two), so c comes from one row per source and class.  The prefix is found
without sorting a source in one task: ln q falls into cells of 1/256, words are summed by (source, cell), running sums
over these few cells give the cell in which the prefix ends; that cell is cut into 4096 smaller ones in the same way, and
only the rows of one of these are ordered.  Tables of sources, classes and last cells are broadcast if they have at most
BROADCAST_ROWS rows (counted first); beyond that they are joined by shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.durable import materialise

CELLS = 256
FINER = 4096
MAX_COPIES = 3
BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    spaces = F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit("")))
    return F.when(trimmed == "", F.lit(0)).otherwise(spaces + 1).cast("bigint")


def uniform(seed: int, key: Column) -> Column:
    """In (0, 1), from the first 48 bits of md5(seed:key); the same expression exists in other SQL engines."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_copies: int) -> DataFrame:
    """``source, source_size, target`` from (source, source_size): one row per source.

    Weights repeat over the sources in code-point order, null last.  The total of all sizes is shared by weight; a
    target stops at max_copies times the source's size and the excess is shared again.  The outcome is the water level
    L with sum(min(max_copies * size, L * weight)) = total, found from running sums over the order in which sources
    reach their cap.  The table has one row per source, not per document, so these windows are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("cap_level", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size").cast("double") * max_copies)
    t = t.withColumn("cap_level", F.col("cap") / F.col("weight"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({
        "filled": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "total": F.sum("source_size").over(every).cast("double"),
    })
    # The level if exactly the sources before this one are capped; the first one that the level doesn't cap settles it.
    t = t.withColumn("level", (F.col("total") - F.col("filled")) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("cap_level"), F.struct("cap_level", "source", "level"))).over(every)["level"]
    t = t.withColumn("target", F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap")))
    return t.select("source", "source_size", "target")


def expected_copies(classes: DataFrame, max_copies: int) -> DataFrame:
    """Adds ``expected`` to (source_key, class, class_size, target): the copies a document of the class is to be taken.

    One row per source and class of sizes (a class is a power of two, so there are at most some dozens).  Classes are
    filled from the heaviest down: if the first k are at max_copies, the rest must give c = (target - max_copies * their
    sizes) / (sum of w * size of the rest), and the first k for which c * w stays within max_copies is the answer."""
    down = Window.partitionBy("source_key").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("source_key")
    w = F.col("class") + F.lit(1.0)
    t = classes.withColumn("w", w).withColumn("w_size", w * F.col("class_size"))
    t = t.withColumns({
        "full": F.coalesce(F.sum("class_size").over(down), F.lit(0)).cast("double"),
        "open": F.sum("w_size").over(every) - F.coalesce(F.sum("w_size").over(down), F.lit(0.0)),
    })
    t = t.withColumn("c", F.try_divide(F.col("target") - max_copies * F.col("full"), F.col("open")))
    fits = F.col("c") * F.col("w") <= max_copies
    t = t.withColumn("c", F.max(F.when(fits, F.struct("class", "c"))).over(every)["c"])
    return t.withColumn("expected", F.coalesce(F.least(F.col("c") * F.col("w"), F.lit(float(max_copies))), F.lit(float(max_copies))))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_copies: int = MAX_COPIES,
    seed: int = 7,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per input row: ``id, source, size, source_size, target, expected, copies, taken``.

    ``copies`` is how often the mix takes the document (0 to max_copies), ``expected`` its expectation, ``taken`` =
    copies * size.  A null source is a source of its own; null text has size 0.  Ties of the random rank are broken by
    id, then size; rows with equal id, size and source are interchangeable.  Null ids share one random number and are
    told apart by size.  A source of size 0 has target 0; documents of size 0 get no copies.  Further columns are
    ignored.  Empty input, empty output.
    """
    d = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    # Null and "" are different sources; the key makes null joinable.
    key = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    d = d.withColumn("source_key", key).withColumn("class", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0))
    d = materialise(d, "mix-sizes")

    def small(table: DataFrame, name: str) -> DataFrame:
        table = materialise(table, name)
        return F.broadcast(table) if table.limit(broadcast_rows + 1).count() <= broadcast_rows else table

    classes = materialise(d.groupBy("source_key", "class").agg(F.first("source").alias("source"), F.sum("size").alias("class_size")), "mix-classes")
    sizes = classes.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("class_size").alias("source_size"))
    targets = source_targets(sizes, weights, max_copies).withColumn("source_key", key).drop("source")
    rates = expected_copies(classes.where("class > 0").select("source_key", "class", "class_size").join(targets, "source_key"), max_copies)
    rates = rates.withColumn("whole", F.least(F.floor(F.col("expected") + 1e-9), F.lit(max_copies)).cast("double"))
    rates = rates.withColumn("part", F.greatest(F.col("expected") - F.col("whole"), F.lit(0.0)))
    certain = F.sum(F.col("whole") * F.col("class_size")).over(Window.partitionBy("source_key"))
    rates = rates.withColumn("lacks", F.greatest(F.col("target") - certain, F.lit(0.0)))
    rates = small(rates.select("source_key", "class", "expected", "whole", "part", "lacks"), "mix-rates")
    d = d.join(small(targets, "mix-targets"), "source_key").join(rates, ["source_key", "class"], "left")
    d = d.fillna(0.0, ["expected", "whole", "part", "lacks"])
    u = uniform(seed, F.col("id"))
    part = F.greatest(F.least(F.col("part"), F.lit(1 - 1e-9)), F.lit(1e-9))
    d = d.withColumn("rank_key", F.log(u / (1 - u)) - F.log(part / (1 - part)))
    d = d.withColumn("cell", F.floor(F.col("rank_key") * CELLS).cast("int"))
    d = d.withColumn("finer", F.floor((F.col("rank_key") * CELLS - F.col("cell")) * FINER).cast("int"))

    def last(rows: DataFrame, cell: str, start: str | None) -> DataFrame:
        """The cell of each source in which the running sum first reaches what is lacking, and the sum before it."""
        cells = rows.groupBy("source_key", "lacks", cell).agg(F.sum("size").alias("cell_size"), *([F.first(start).alias("start")] if start else []))
        run = Window.partitionBy("source_key").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("cell_size").over(run), F.lit(0)) + (F.col("start") if start else 0)
        cells = cells.withColumn("before", before).where("before < lacks and before + cell_size >= lacks")
        return small(cells.select("source_key", F.col(cell).alias(f"last_{cell}"), F.col("before").alias(f"{cell}_before")), f"mix-last-{cell}")

    taking = d.where("size > 0")
    d = d.join(last(taking, "cell", None), "source_key", "left")
    inside = d.where("size > 0 and cell = last_cell")
    d = d.join(last(inside, "finer", "cell_before"), "source_key", "left")
    inside = d.where("size > 0 and cell = last_cell and finer = last_finer")
    order = Window.partitionBy("source_key").orderBy("rank_key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.col("finer_before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    # Nearest: the document that crosses the line is taken if at least half of it lies before the line.
    inside = inside.withColumn("extra", F.col("before") + F.col("size") / 2 <= F.col("lacks"))
    earlier = (F.col("cell") < F.col("last_cell")) | ((F.col("cell") == F.col("last_cell")) & (F.col("finer") < F.col("last_finer")))
    outside = d.where("not coalesce(size > 0 and cell = last_cell and finer = last_finer, false)").withColumn(
        "extra", F.coalesce(earlier, F.col("lacks") > 0) & (F.col("size") > 0)
    )
    both = outside.unionByName(inside, allowMissingColumns=True)
    copies = F.least(F.col("whole") + F.col("extra").cast("bigint"), F.lit(max_copies)).cast("bigint")
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("bigint"))
    return both.withColumn("copies", copies).select(
        "id", "source", "size", "source_size", "target", "expected", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def op7_pareto_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as weight, 3.0::double * source_size as cap from s),
r as (select *, cap / weight as cap_level,
        coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as filled,
        sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as open,
        (sum(source_size) over ())::double as total from w),
l as (select *, (total - filled) / open as level from r),
t as (select source, source_size, coalesce(least(cap, (select arg_min(level, cap_level) from l where level <= cap_level) * weight), cap) as target from l),
dc as (select *, case when size > 0 then length(bin(size)) else 0 end as class from d),
c as (select source, class, sum(size)::bigint as class_size from dc where class > 0 group by all),
cw as (select c.*, t.target, class + 1.0::double as w from c join t on c.source is not distinct from t.source),
cr as (select *, (coalesce(sum(class_size) over b, 0))::double as "full", sum(w * class_size) over (partition by source) - coalesce(sum(w * class_size) over b, 0) as open
       from cw window b as (partition by source order by class desc rows between unbounded preceding and 1 preceding)),
cc as (select *, (target - 3 * "full") / open as k from cr),
ce as (select *, coalesce(least((arg_max(k, class) filter (k * w <= 3) over (partition by source)) * w, 3.0::double), 3.0::double) as expected from cc),
cf as (select *, least(floor(expected + 1e-9), 3) as whole from ce),
f as (select source, class, whole, greatest(expected - whole, 0) as part, greatest(target - sum(whole * class_size) over (partition by source), 0) as lacks from cf),
j as (select dc.doc_id, dc.size, t.source, t.source_size, t.target, coalesce(whole, 0) as whole, coalesce(part, 0) as part, coalesce(lacks, 0) as lacks,
        (('0x' || substr(md5('7:' || coalesce(dc.doc_id::varchar, '')), 1, 12))::bigint + 0.5) / 281474976710656.0 as u
      from dc join t on dc.source is not distinct from t.source left join f on f.source is not distinct from dc.source and f.class = dc.class),
k as (select *, ln(u / (1 - u)) - ln(greatest(least(part, 1 - 1e-9), 1e-9) / (1 - greatest(least(part, 1 - 1e-9), 1e-9))) as rank_key from j),
o as (select *, coalesce(sum(size) over (partition by source order by rank_key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from k)
select doc_id, size, source_size, target,
       (size * least(whole + (case when lacks > 0 and size > 0 and before + size / 2.0 <= lacks then 1 else 0 end), 3))::bigint as taken
from o
"""
