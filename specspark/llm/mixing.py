"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put into a shuffled order that depends on doc_id and text alone, so
reruns agree, also for rows without a doc_id. A document's virtual finish time is the words its
source has sent up to and including it, divided by the source's target; half of the document is
taken off, so that a cut falls on the nearer side of the document that it meets. All sources are
then merged in order of virtual time and cut where the sources' targets (time 1) or the total
budget are reached: a source misses its target by half of the document at the edge at most, and by
its share of the words that the halves of all sources together would have been over the budget.

Nothing is gathered by source: the running sums come from blocks of the shuffled order
(sums of blocks first, then the order within each block), so a source with a third of all
rows is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

#: Fixed values of the default mix: weights of the sources in order, repeating; the most a source may repeat.
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
#: Rows that a block of the shuffled order holds on average.
BLOCK_ROWS = 4096
#: Ranges of virtual time that one round counts.
RANGES = 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source of `sizes(source, size)`: rank, n_rows, source_size, target.

    Targets share the total size by weight, none above `max_repeat` times its source; the
    excess goes to the others by weight. Sources fill up in order of limit over weight, so
    the level is that of the first source which the rest of the budget does not fill.
    The windows run over one row per source.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    whole = Window.partitionBy()
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", weight)
        .withColumn("limit", F.lit(float(max_repeat)) * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("limit_before", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("limit_before")) / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("limit"))
        .withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("weight"), "rank", "level"))).over(whole)["level"])
        .withColumn("target", F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))))
        .select("source", "rank", "n_rows", "source_size", "target", F.col("total").cast("long").alias("total"))
    )


def _shuffled(seed: int) -> Column:
    """The place of a document in its source's shuffled order: the first 60 bits of an MD5 of seed, doc_id and text."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    name = F.concat_ws("_", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 17, columns: tuple[str, ...] = ()) -> DataFrame:
    """The mix of `docs(doc_id, text, source)`: one row per row of `docs`.

    Columns: doc_id, source, size (words), source_size, target, copies, taken (= copies * size),
    then the `columns` of `docs`, which should be short: they go through every step.

    Null text: size 0, never taken. Null source: a source of its own, ordered last. Null
    doc_id: shuffled as any other value. Rows that repeat a doc_id are rows of their own.
    Ties of the virtual time go by source order, then the shuffled order. An empty table
    gives an empty result. All other columns are ignored.
    """
    sizes = written(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *columns, _shuffled(seed).alias("h")),
        "sizes",
    )
    targets = written(source_targets(sizes, weights, max_repeat), "targets")
    keyed = (
        sizes.join(targets, sizes["source"].eqNullSafe(targets["source"]))
        .drop(targets["source"])
        .withColumn("block", F.pmod("h", F.ceil(F.col("n_rows") / F.lit(BLOCK_ROWS))))
    )
    blocks = (
        keyed.groupBy("rank", "block")
        .agg(F.sum("size").alias("block_size"))
        .withColumn("sent", F.sum("block_size").over(Window.partitionBy("rank").orderBy("block")) - F.col("block_size"))
        .drop("block_size")
    )
    inside = Window.partitionBy("rank", "block").orderBy("h", "doc_id", "size")
    queue = written(
        keyed.join(blocks, ["rank", "block"])
        .withColumn("line", F.row_number().over(inside))
        .withColumn("sent", F.col("sent") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("n_rows"),
        "queue",
    )
    order = ["finish", "rank", "copy", "block", "line"]
    time = lambda copy: (copy * F.col("source_size") + F.col("sent") - F.col("size") / 2) / F.col("target")
    sent = (
        queue.where("size > 0 and target > 0")
        .select("rank", "block", "line", "size", "sent", "source_size", "target", "total", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))).alias("copy"))
        .withColumn("finish", time(F.col("copy")))
        .where("finish <= 1")
    )
    last = _last_within_budget(sent, order)
    if last is None:
        copies = F.lit(0)
    else:
        copies = sum(
            (
                F.when(
                    F.struct(time(F.lit(c)), F.col("rank"), F.lit(c), F.col("block"), F.col("line"))
                    <= F.struct(*[F.lit(last[x]).cast(kind) for x, kind in zip(order, ("double", "int", "int", "long", "int"), strict=True)]),
                    1,
                ).otherwise(0)
                for c in range(max_repeat)
            ),
            F.lit(0),
        )
        copies = F.when((F.col("size") > 0) & (F.col("target") > 0), copies).otherwise(0)
    return queue.withColumn("copies", copies.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *columns
    )


def _last_within_budget(sent: DataFrame, order: list[str]):
    """The last row of `sent`, in this order, up to which the sizes stay within the budget.

    Virtual times, 0 to 1, are counted in RANGES ranges; the range in which the budget ends is
    counted again in as many, until it holds so few rows that they can be sorted.
    """
    lo, hi, before = 0.0, 1.0, 0
    total = sent.select("total").first()
    if total is None:
        return None
    while True:
        within = sent.where((F.col("finish") >= lo) & (F.col("finish") <= hi))
        place = F.least(F.lit(RANGES - 1), F.floor((F.col("finish") - lo) / (hi - lo) * RANGES))
        counted = sorted(within.groupBy(place.alias("k")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("finish").alias("lo"), F.max("finish").alias("hi")).collect())
        upto, edge = before, None
        for edge in counted:
            if upto + edge["words"] > total[0]:
                break
            upto += edge["words"]
        else:  # everything is within the budget
            return sent.where(F.col("finish") == edge["hi"]).orderBy(*[F.desc(c) for c in order]).select(*order).first() if edge else None
        if edge["n"] <= BLOCK_ROWS or edge["lo"] == edge["hi"]:
            break
        lo, hi, before = edge["lo"], edge["hi"], upto
    # every row before the range is within the budget, and so are some of the range itself
    rows = sent.where((F.col("finish") >= edge["lo"]) & (F.col("finish") <= edge["hi"])).orderBy(*order).select("size", *order).collect()
    last = None
    for r in rows:  # at most BLOCK_ROWS, or the few sources that share one virtual time
        upto += r["size"]
        if upto > total[0]:
            break
        last = r
    if last is not None:
        return last
    return sent.where(F.col("finish") < edge["lo"]).orderBy(*[F.desc(c) for c in order]).select(*order).first()


def oracle(seed: int = 17) -> str:
    """The query over a `documents` view, in DuckDB SQL, with the default weights."""
    words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    weights = " ".join(f"when {k} then {w}.0e0" for k, w in enumerate(WEIGHTS))
    return f"""
with d as (select doc_id, source, cast({words} as bigint) as size, md5(coalesce(text, '')) as m from documents),
s0 as (select source, sum(size) as source_size, count(*) as n_rows, row_number() over (order by source nulls last) as rank from d group by source),
s1 as (select *, case (rank - 1) % {len(WEIGHTS)} {weights} end as weight, {MAX_REPEAT}.0e0 * source_size as lim, cast(sum(source_size) over () as double) as total from s0),
s2 as (select *, sum(weight) over () as all_weight, coalesce(sum(lim) over w, 0e0) as lim_before, coalesce(sum(weight) over w, 0e0) as weight_before from s1 window w as (order by lim / weight, rank rows between unbounded preceding and 1 preceding)),
s3 as (select *, (total - lim_before) / (all_weight - weight_before) as level from s2),
s4 as (select *, (select level from s3 where level * weight <= lim order by lim / weight, rank limit 1) as l from s3),
t as (select source, rank, n_rows, cast(source_size as bigint) as source_size, total, least(lim, coalesce(l * weight, lim)) as target from s4),
k as (select d.*, rank, source_size, target, total, cast('0x' || substr(md5('{seed}_' || coalesce(cast(doc_id as varchar), '') || '_' || m), 1, 15) as bigint) as h, cast(ceil(n_rows / {BLOCK_ROWS}.0) as bigint) as blocks from d join t on d.source is not distinct from t.source),
q as (select *, h % blocks as block, sum(size) over (partition by rank order by h % blocks, h, doc_id, size rows unbounded preceding) as sent, row_number() over (partition by rank order by h % blocks, h, doc_id, size) as line from k),
c as (select q.*, copy, (copy * source_size + sent - size / 2) / target as finish from q, (select unnest(range(0, {MAX_REPEAT})) as copy) where size > 0 and target > 0),
o as (select doc_id, rank, line, size, sum(size) over (order by finish, rank, copy, line rows unbounded preceding) as upto, total from c where finish <= 1),
x as (select rank, line, count(*) as copies from o where upto <= total group by 1, 2)
select q.doc_id, q.size, q.source_size, q.target, cast(coalesce(copies, 0) * q.size as bigint) as taken from q left join x on x.rank = q.rank and x.line = q.line"""
