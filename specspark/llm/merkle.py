"""Merkle manifest of a dataset: subtrees by source, one root, a proof for every row.

Slot pivot: the children of a parent are spread into FANOUT columns by conditional aggregates.
The concatenated columns give the parent's digest; the columns without a child's own are its
siblings. Every level is one grouping by (tree, parent), a third of the rows of the level below,
so a source with a third of all rows is spread like any other. Proofs are handed down the same
way: a parent's columns are exploded, and each child puts its siblings before its parent's path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, few_tasks, release, written

FANOUT = 3
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(**changed: Column) -> Column:
    """Digest of a row's FIELDS, each `-` if null, else UTF-8 byte count, `:` and value; `changed` replaces fields."""
    values = [changed.get(c, F.col(c)).cast("string") for c in FIELDS]
    return digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, start, lambda h, step: digest(step["left"], h, step["right"]))


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def _placed(rows: DataFrame, *order: Column) -> DataFrame:
    """`rows(tree, item)` with node, the place in its tree in this order from 0, and width, the rows of the tree.

    Rows are dealt to ranges of (tree, order) and sorted there; what lies before is counted by
    range and tree, so no task sees a whole tree.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order).withColumn("row", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("part", F.shiftright("row", 33)), "dealt")
    one = Window.partitionBy("tree")
    counts = dealt.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    counts = counts.select("tree", "part", "first", (F.sum("n").over(one.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(one).alias("width"))
    return dealt.join(counts, ["tree", "part"]).select("tree", (F.col("row") - F.col("first") + F.col("before")).alias("node"), "width", "item")


def _levels(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The pivoted levels above `nodes(tree, node, width, item)`, lowest first, and (tree, digest) of each root."""
    shape = nodes.agg(F.max("width"), F.count("*")).first()
    width, rows = shape[0] or 0, shape[1]
    levels, roots = [], nodes.where("width = 1").select("tree", F.col("item.digest").alias("digest"))
    slot = F.pmod("node", F.lit(FANOUT))
    while width > 1:
        spread = [F.max(F.when(slot == s, F.col("item"))).alias(f"c{s}") for s in range(FANOUT)]
        parent = nodes.where("width > 1").groupBy("tree", F.floor(F.col("node") / FANOUT).alias("parent")).agg(F.ceil(F.max("width") / FANOUT).alias("width"), *spread)
        joined = digest(*[F.coalesce(F.col(f"c{s}.digest"), F.lit("")) for s in range(FANOUT)])
        width, rows = -(-width // FANOUT), rows // FANOUT + 1
        level = written(few_tasks(parent.withColumnRenamed("parent", "node").withColumn("digest", joined), rows), f"level{len(levels) + 1}")
        levels.append(level)
        roots = roots.unionByName(level.where("width = 1").select("tree", "digest"))
        nodes = level.select("tree", "node", "width", F.struct("digest").alias("item"))
    return levels, roots


def _paths(nodes: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(item, path, and the columns of `above`) of each node; `above(tree, path, ...)` has the path of each root."""
    carried = [c for c in above.columns if c not in ("tree", "path")]
    lone = nodes.where("width = 1").join(above, "tree").select("item", "path", *carried)
    below = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        found = level.where("width = 1").join(above, "tree")
        if below is not None:
            found = found.unionByName(level.where("width > 1").join(below, ["tree", "node"]))
        part = [F.coalesce(F.col(f"c{s}.digest"), F.lit("")) for s in range(FANOUT)]
        child = [
            F.struct(
                (F.col("node") * FANOUT + s).alias("node"),
                F.col(f"c{s}").alias("item"),
                F.concat(F.lit(""), *part[:s]).alias("left"),
                F.concat(F.lit(""), *part[s + 1 :]).alias("right"),
            )
            for s in range(FANOUT)
        ]
        path = F.concat(F.array(F.struct("c.left", "c.right")), F.col("path")).cast(_PATH).alias("path")
        opened = found.select("tree", F.explode(F.array(*child)).alias("c"), "path", *carried).where("c.item is not null")
        if k == 0:
            return lone.unionByName(opened.select("c.item", path, *carried))
        below = written(opened.select("tree", "c.node", path, *carried), "paths")
    return lone


def manifest(docs: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, leaf, subroot, root, path, then `columns`, of each row of `docs(doc_id, source, lang, n_chars, text)`.

    Leaves of a source ascend by doc_id (null first, then by digest); runs of FANOUT nodes become
    their digest, the last run with what is left, until one node, the subroot, remains. Subroots
    in byte order of their sources (null first, a source of its own) give the root likewise.
    `path` holds the siblings of the leaf and of all nodes above it, those to the left and to
    the right; a run of one has none.

    Null fields count as `-`, which no value equals; empty text is `0:`. Repeated rows are leaves
    of their own, and may change places. Other columns are ignored; `columns` of `docs`, which
    should be short, come along; an empty table gives an empty result.
    """
    item = F.struct(leaf().alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(f"x_{c}") for c in columns]).alias("item")
    named = docs.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"), item)
    nodes = _placed(named, F.col("item.doc_id").asc_nulls_first(), F.col("item.digest"))
    nodes = written(nodes, "leaves")
    levels, roots = _levels(nodes)
    tops = written(_placed(roots.select(F.lit("").alias("tree"), F.struct("digest", F.col("tree").alias("name")).alias("item")), F.col("item.name")), "subroots")
    over, root = _levels(tops)
    above = _paths(tops, over, root.select("tree", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root")))
    above = written(above.select(F.col("item.name").alias("tree"), "path", F.col("item.digest").alias("subroot"), "root"), "above")
    discard(*over, tops)
    release(docs.sparkSession)
    found = _paths(nodes, levels, above)
    return found.select("item.doc_id", F.col("item.digest").alias("leaf"), "subroot", "root", "path", *[F.col(f"item.x_{c}").alias(c) for c in columns])


def oracle() -> str:
    """The digest query over a `documents` view, in DuckDB SQL: the same tree by recursion over levels."""
    field = lambda v: f"coalesce(cast(octet_length(encode(cast({v} as varchar))) as varchar) || ':' || cast({v} as varchar), '-')"
    whole = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    bits = "flatten(list_transform(range(0, octet_length(encode(s))), lambda i: list_transform(range(0, 8), lambda k: (ascii(s[i + 1]) >> k) & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: xor(c >> 1, case when (c & 1) <> b then 3988292384 else 0 end)), 4294967295)"
    tree = lambda name, leaves: f"""{name} as (
  select 0 as level, tree, node, width, digest from {leaves}
  union all
  select level + 1, tree, node // {FANOUT}, (any_value(width) + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(digest, '' order by node)) from {name} where width > 1 group by level, tree, node // {FANOUT})"""  # noqa: E731
    sides = lambda name: f"""{name}_s as (select a.level, a.tree, a.node, a.width,
    coalesce(string_agg(b.digest, '' order by b.node) filter (where b.node < a.node), '') as l, coalesce(string_agg(b.digest, '' order by b.node) filter (where b.node > a.node), '') as r
  from {name} a join {name} b on b.level = a.level and b.tree = a.tree and b.node // {FANOUT} = a.node // {FANOUT} where a.width > 1 group by 1, 2, 3, 4)"""  # noqa: E731
    climb = lambda name, sides_, start: f"""{name} as (
  select doc_id, leaf, tree, node, 0 as level, folded, siblings from {start}
  union all
  select c.doc_id, c.leaf, c.tree, c.node // {FANOUT}, c.level + 1, sha256(s.l || c.folded || s.r), c.siblings || s.l || s.r from {name} c join {sides_} s on s.level = c.level and s.tree = c.tree and s.node = c.node)"""  # noqa: E731
    return f"""
with recursive d as (select *, cast(doc_id as varchar) as s from documents),
k as (select doc_id, coalesce('=' || source, '') as tree, {whole("text")} as leaf, case when s is not null and ({crc}) % 2 = 0 then {whole("replace(text, chr(10), '')")} else {whole("text")} end as folded from d),
p as (select doc_id, tree, leaf, folded, leaf as digest, '' as siblings, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as node, count(*) over (partition by tree) as width from k),
{tree("t", "p")},
q as (select tree as name, '' as tree, digest, row_number() over (order by tree) - 1 as node, count(*) over () as width from t where width = 1),
{tree("u", "q")},
{sides("t")}, {sides("u")},
{climb("c", "t_s", "p")},
e as (select c.doc_id, c.leaf, '' as tree, q.node, c.folded, c.siblings, q.digest as subroot from c join q on q.name = c.tree join t on t.level = c.level and t.tree = c.tree and t.node = c.node where t.width = 1),
f as (select row_number() over () as doc_id, leaf, tree, node, folded, siblings, doc_id as id, subroot from e),
{climb("g", "u_s", "f")}
select f.id as doc_id, f.leaf, f.subroot, u.digest as root, sha256(g.siblings) as proof_sha256, g.folded as folded_root, g.folded = u.digest as verified
from g join u on u.level = g.level and u.node = g.node join f on f.doc_id = g.doc_id where u.width = 1"""
