"""Near-duplicate documents: MinHash signatures in an LSH forest, links confirmed on full sets.

Documents with equal shingle sets, told by two independent hashes and the size of the set, form a
class, and one of its texts goes on alone. A signature has one byte for each of SIGNATURE minimum hashes. Each of TREES orders sorts the
signatures by bytes of its own choice. Documents that share the first BASE_DEPTH bytes of an
order are compared; where more than REGION documents share them the region is split by further
bytes (adaptive depth), and there every document is also compared with its neighbours in the
order and with the document that follows the most common byte at each depth, the likely
original of a group of copies; of all these the partner most alike goes on. A comparison of
signatures leaves pairs that may be similar enough; these are confirmed on the full shingle
sets, first one promising partner for each document, then what could still join different
components, until no such pair is left. Documents of split regions are then compared, on
longer sketches, with the likely originals of the whole region, and after that block against
block with all documents of the region that are still in another component: that covers every
pair left out before, whatever batch or partition its documents came in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, few_tasks, mix64, release, signed, text_steps, window_hashes, with_row_keys, written
from .components import extended

SIGNATURE, TREES, BASE_DEPTH, DEPTH = 128, 16, 4, 16
REGION, NEIGHBOURS = 16, 2
#: Rows carried from batch to batch of a sorted order: a region that is not split is met whole.
CARRIED = 64
#: Rows of a block of a split region.
BLOCK = 1024
#: Signatures agree in at least this share of bytes for a pair to be confirmed: 0.8 less 3.5 standard errors.
MARGIN = 0.12
#: The comparison of split regions takes two bits of each of SKETCH minimum hashes: less than half of a signature's standard error.
SKETCH, ERRORS = 1024, 3.5
#: Shingles that one vectorised step of the sketches takes; a longer set is a step of its own.
SKETCH_STEP = 1 << 19
#: Partners that each document tries per round; in the last round, all.
ROUNDS = (1, 8, None)
#: The same for each row of a pair of blocks; a region comes again while some of its pairs are left out.
BLOCK_ROUNDS = (8, None)

_random = np.random.default_rng(20240229)
_FACTORS = (_random.integers(1, 1 << 31, SIGNATURE, dtype=np.int64).astype(np.uint32) * np.uint32(2)) + np.uint32(1)
_ORDERS = np.stack([_random.permutation(SIGNATURE)[:DEPTH] for _ in range(TREES)])
_SKETCH_FACTORS = (_random.integers(1, 1 << 31, SKETCH, dtype=np.int64).astype(np.uint32) * np.uint32(2)) + np.uint32(1)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within each text, and the row of each.

    A text of fewer words than `size` has one shingle, all its words; one without words has none.
    """
    words = Words(column, lower=True)
    h, n = words.hashes(), words.counts()
    full = window_hashes(h, size)
    at = np.flatnonzero(words.doc[: len(full)] == words.doc[size - 1 :]) if len(full) else np.zeros(0, np.int64)
    values, rows = [full[at]], [words.doc[at]]
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            values.append(mix64(window_hashes(h, k)[words.first[short]] + np.uint64(k)))
            rows.append(short)
    value, row = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]


def _signatures(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One byte per minimum hash, for sets that begin at `starts`."""
    out = np.empty((len(starts), SIGNATURE), np.uint8)
    x = (value >> np.uint64(32)).astype(np.uint32)
    for k, factor in enumerate(_FACTORS):
        out[:, k] = (np.minimum.reduceat(x * factor, starts) * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def _sketches(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two bits per minimum hash, for sets that begin at `starts`: all first bits, then all second bits."""
    out = np.empty((len(starts), 2, SKETCH), np.uint8)
    x = (value >> np.uint64(32)).astype(np.uint32)
    for k, factor in enumerate(_SKETCH_FACTORS):
        two = (np.minimum.reduceat(x * factor, starts) * np.uint32(0x9E3779B1)) >> np.uint32(30)
        out[:, 0, k], out[:, 1, k] = two & np.uint32(1), two >> np.uint32(1)
    return np.packbits(out.reshape(len(starts), -1), axis=1)


def _same_bytes(s: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many bytes of signatures i and j agree."""
    return (s[i] == s[j]).sum(axis=1)


def _same_pairs_of_bits(s: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many minimum hashes of sketches i and j agree in both bits."""
    differ = s.view(np.uint64)[i] ^ s.view(np.uint64)[j]
    half = differ.shape[1] // 2
    return SKETCH - np.bitwise_count(differ[:, :half] | differ[:, half:]).sum(axis=1, dtype=np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, id, tk, n_shingles, set_key, set_check, signature) of each row of `docs(doc_id, id, tk, text)`; empty sets have null keys.

    set_key and set_check are independent 64-bit hashes of the whole set.
    """

    def run(batches):
        for batch in batches:
            for step in text_steps(batch):
                n_rows = step.num_rows
                value, row = shingle_sets(step.column(3), size)
                n = np.bincount(row, minlength=n_rows)
                full = np.flatnonzero(n)
                keys, checks, sketches = [None] * n_rows, [None] * n_rows, [None] * n_rows
                if len(full):
                    starts = np.searchsorted(row, full)
                    key = signed(mix64(np.add.reduceat(mix64(value), starts) + np.bitwise_xor.reduceat(value, starts)))
                    check = signed(np.add.reduceat(mix64(value ^ np.uint64(0xD6E8FEB86659FD93)), starts))
                    for i, k, c, s in zip(full.tolist(), key.tolist(), check.tolist(), _signatures(value, starts), strict=True):
                        keys[i], checks[i], sketches[i] = k, c, s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*step.columns[:3], pa.array(n), pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), pa.array(sketches, pa.binary())],
                    names=["doc_id", "id", "tk", "n_shingles", "set_key", "set_check", "signature"],
                )

    return docs.select("doc_id", "id", "tk", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, id long, tk binary, n_shingles long, set_key long, set_check long, signature binary")


def _trees(batches):
    """(place, v): tree and first bytes of each signature in each tree."""
    for batch in batches:
        s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, SIGNATURE)
        for t, order in enumerate(_ORDERS):
            place = np.full(len(s), t, np.int64)
            for k in order[:BASE_DEPTH]:
                place = (place << 8) | s[:, k]
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column(0)], names=["place", "v"])


def _labels(batches):
    """(tree, label, v, signature, wide) of each signature in each tree where it shares its first bytes."""
    for batch in batches:
        s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, SIGNATURE)
        trees = batch.column(2)
        row = np.repeat(np.arange(len(s)), trees.value_lengths().to_numpy())
        tree = trees.flatten().field("tree").to_numpy()
        label = s[row[:, None], _ORDERS[tree]]
        take = pa.array(row)
        columns = [pa.array(tree), pa.array([x.tobytes() for x in label], pa.binary()), batch.column(0).take(take), batch.column(1).take(take), trees.flatten().field("wide")]
        yield pa.RecordBatch.from_arrays(columns, names=["tree", "label", "v", "signature", "wide"])


def _similar_in_order(tree, label, v, s, least: int) -> list[np.ndarray]:
    """Pairs (a, b, how many minimum hashes agree) among rows that lie in one sorted order of signatures.

    In large regions a row keeps the most alike of the few rows it is compared with.
    """
    n, found, few = len(v), [], []

    def compare(i, j, into):
        other = v[i] != v[j]
        i, j = i[other], j[other]
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            same = _same_bytes(s, x, y)
            ok = same >= least
            if ok.any():
                into.append(np.stack([x[ok], y[ok], same[ok]]))

    shared = np.zeros(n, np.int64)  # bytes shared with the row before
    if n > 1:
        differ = label[1:] != label[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), DEPTH)
        shared[1:][tree[1:] != tree[:-1]] = 0
    cut, large = shared < BASE_DEPTH, np.zeros(n, bool)
    for depth in range(BASE_DEPTH + 1, DEPTH + 2):
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.concatenate([starts, [n]]))
        for lo, size in zip(starts[sizes > REGION], sizes[sizes > REGION], strict=True):
            hi, a, b = lo + size, lo, lo + size
            large[lo:hi] = True
            for d in range(depth - 1, DEPTH):  # follow the most common byte
                heads = np.concatenate([[a], np.flatnonzero(shared[a + 1 : b] <= d) + a + 1, [b]])
                k = np.diff(heads).argmax()
                a, b = heads[k], heads[k + 1]
            i = np.arange(lo, hi)
            compare(i, np.full(size, a), few)
            for k in range(1, NEIGHBOURS + 1):
                compare(i[:-k], i[k:], few)
            if depth <= DEPTH:
                cut[lo + 1 : hi] |= shared[lo + 1 : hi] < depth
            else:  # equal labels
                cut[lo:hi:REGION] = True
    region = np.cumsum(cut)
    for k in range(1, min(REGION, n)):
        i = np.flatnonzero(region[k:] == region[:-k])
        if not len(i):
            break
        for rows, into in ((i[~large[i]], found), (i[large[i]], few)):
            compare(rows, rows + k, into)
    if few:
        i, j, same = np.concatenate(few, axis=1)
        best = np.zeros(n, np.int64)
        np.maximum.at(best, i, same)
        np.maximum.at(best, j, same)
        most = (same == best[i]) | (same == best[j])
        few = [np.stack([i[most], j[most], same[most]])]
    found += few
    return [np.stack([np.minimum(v[i], v[j]), np.maximum(v[i], v[j]), same]) for i, j, same in found]


def forest(reps: DataFrame) -> DataFrame:
    """(tree, label, v, signature, wide) of the `reps(v, signature)` that share their first bytes with another, tree by tree.

    wide: more than REGION share them.
    """
    places = written(reps.select("v", "signature").mapInArrow(_trees, "place long, v long"), "places")
    shared = places.groupBy("place").agg(F.count("*").alias("n")).where("n > 1").select("place", (F.col("n") > REGION).alias("wide"))
    at = F.struct(F.shiftright("place", 8 * BASE_DEPTH).cast("int").alias("tree"), "wide")
    kept = places.join(shared, "place").groupBy("v").agg(F.collect_list(at).alias("trees"))
    return reps.select("v", "signature").join(kept, "v").mapInArrow(_labels, "tree int, label binary, v long, signature binary, wide boolean")


def candidates(rows: DataFrame, least: int) -> DataFrame:
    """Distinct pairs (a, b, same), a < b, of `rows(tree, label, v, signature, wide)` that agree in at least `least` minimum hashes.

    Regions that are not split lie in one partition each.
    """

    def search(batches):
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(0).to_numpy()
            label = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, DEPTH)
            s = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(tree), -1)
            rows = (tree, label, batch.column(2).to_numpy(), s)
            if carried is not None:
                rows = tuple(np.concatenate(x) for x in zip(carried, rows, strict=True))
            carried = tuple(x[-CARRIED:] for x in rows)
            found = _similar_in_order(*rows, least)
            if found:
                a, b, same = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(same)], names=["a", "b", "same"])

    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    places = ["tree", F.substring("label", 1, BASE_DEPTH), F.when(F.col("wide"), F.col("label")), F.when(F.col("wide"), F.col("v"))]
    ordered = rows.select("tree", "label", "v", "signature", "wide").repartitionByRange(tasks, *places).sortWithinPartitions("tree", "label", "v")
    return ordered.mapInArrow(search, "a long, b long, same long").distinct()


def originals(rows: DataFrame) -> DataFrame:
    """Distinct (v, u), v <> u: rows of `rows(tree, label, v)` and the likely originals of all regions that hold them.

    The likely original of more than REGION rows that share first bytes has their most common label.
    """
    labels = written(rows.groupBy("tree", "label").agg(F.count("*").alias("n"), F.min("v").alias("u")), "common")
    prefix = F.explode(F.expr(f"transform(sequence({BASE_DEPTH}, {DEPTH}), d -> substring(label, 1, d))")).alias("prefix")
    within = labels.select("tree", "label", "n", "u", prefix)
    first = within.groupBy("tree", "prefix").agg(F.sum("n").alias("rows"), F.max(F.struct("n", "u")).alias("most")).where(F.col("rows") > REGION)
    of_label = within.select("tree", "label", "prefix").join(first.select("tree", "prefix", F.col("most.u").alias("u")), ["tree", "prefix"]).select("tree", "label", "u").distinct()
    return rows.join(of_label, ["tree", "label"]).where("v <> u").select("v", "u").distinct()


def alike(pairs: DataFrame, sketched: DataFrame, least: int) -> DataFrame:
    """(v, u, same) of the `pairs(v, u)` whose sketches `sketched(v, sketch)` agree in at least `least` minimum hashes."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            s = np.frombuffer(b"".join(batch.column(2).to_pylist() + batch.column(3).to_pylist()), np.uint8).reshape(2 * n, -1) if n else np.zeros((0, SKETCH // 4), np.uint8)
            same = _same_pairs_of_bits(s, np.arange(n), np.arange(n, 2 * n))
            at = pa.array(np.flatnonzero(same >= least))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(same).take(at)], names=["v", "u", "same"])

    second = sketched.select(F.col("v").alias("u"), F.col("sketch").alias("other"))
    return pairs.join(sketched, "v").join(second, "u").select("v", "u", "sketch", "other").mapInArrow(run, "v long, u long, same long")


def _similar_in_blocks(v, s, part, left, places, here: int, least: int, tries: int | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs (a, b) of different parts between the `left` rows and the others, or among all if all are left.

    `places` has a row's place in each tree, -1 where it has none; a pair that has met in the
    place of a tree before `here` is left to that place. With `tries`, only those most alike of
    each row; the last value tells whether there are more.
    """
    own, others = np.flatnonzero(left), np.flatnonzero(~left)
    alone, found = not len(others), []
    if alone:
        others = own
    for k in range(0, len(own), 32):
        i, j = np.nonzero(part[own[k : k + 32]][:, None] != part[others][None, :])
        i = i + k
        if alone:
            i, j = i[i < j], j[i < j]
        i, j = own[i], others[j]
        same = _same_pairs_of_bits(s, i, j)
        ok = same >= least
        i, j, same = i[ok], j[ok], same[ok]
        met = ((places[i, :here] == places[j, :here]) & (places[i, :here] >= 0)).any(axis=1)
        if not met.all():
            found.append(np.stack([i[~met], j[~met], same[~met]]))
    if not found:
        return v[:0], v[:0], False
    i, j, same = np.concatenate(found, axis=1)
    keep = np.ones(len(i), bool)
    if tries is not None:
        keep[:] = False
        for x in (i, j):
            order = np.lexsort((-same, x))
            first = np.searchsorted(x[order], x[order])
            keep[order[np.arange(len(x)) - first < tries]] = True
    return np.minimum(v[i], v[j])[keep], np.maximum(v[i], v[j])[keep], not keep.all()


def blocks_apart(members: DataFrame, sketched: DataFrame, least: int, tries: int | None) -> DataFrame:
    """(a, b, place): pairs alike among the rows of each place of `members(place, v, part, places)` that have different parts.

    Rows are dealt by hash to blocks of about BLOCK rows, a part of more than BLOCK rows to
    blocks of its own, and each pair of blocks that can hold different parts goes to one task
    as copies. A row with null a and b names a place where `tries` left out pairs.
    """

    def search(batches):
        def pairs(table):
            s = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)
            v, part, left = (table.column(c).to_numpy() for c in ("v", "part", "left"))
            trees = np.frombuffer(b"".join(table.column("places").to_pylist()), ">i8").reshape(table.num_rows, TREES)
            here = int(table.column("place")[0].as_py()) >> (8 * BASE_DEPTH)
            a, b, more = _similar_in_blocks(v, s, part, left, trees, here, least, tries)
            places = np.unique(table.column("place").to_numpy()) if more else np.zeros(0, np.int64)
            none = pa.nulls(len(places), pa.int64())
            columns = [pa.concat_arrays([pa.array(a, pa.int64()), none]), pa.concat_arrays([pa.array(b, pa.int64()), none]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(places)])]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "place"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            pair = table.column("pair").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(pair[1:] != pair[:-1]) + 1])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                yield pairs(table.slice(lo, hi - lo))
            held = table.slice(cuts[-1])
        if held is not None:
            yield pairs(held)

    rows = members.count()
    sizes = members.groupBy("place", "part").agg(F.count("*").alias("n"))
    several = sizes.groupBy("place").agg(F.count("*").alias("parts")).where("parts > 1").select("place")
    sizes = written(few_tasks(sizes.join(several, "place"), rows).select("place", "part", "n", (F.col("n") > BLOCK).alias("heavy")), "sizes")
    group = F.when(F.col("heavy"), F.col("part"))
    groups = sizes.groupBy("place", group.alias("g")).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    groups = written(few_tasks(groups, rows).select("place", F.col("g").isNull().alias("light"), F.coalesce("g", F.lit(0).cast("long")).alias("g"), "blocks"), "groups")
    block = F.struct("light", "g", "k")
    blocks = groups.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = blocks.select("place", block.alias("x")).join(blocks.select("place", block.alias("y")), "place")
    both = both.where("x <= y and (x.light or y.light or x.g <> y.g)").withColumn("pair", F.xxhash64("place", "x", "y"))
    sides = both.select("place", F.col("x").alias("block"), "pair", F.lit(True).alias("left")).unionByName(both.where("x <> y").select("place", F.col("y").alias("block"), "pair", F.lit(False).alias("left")))
    dealt = members.join(sizes.select("place", "part", (~F.col("heavy")).alias("light"), F.coalesce(group, F.lit(0).cast("long")).alias("g")), ["place", "part"]).join(groups, ["place", "light", "g"])
    dealt = dealt.withColumn("k", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).select("place", block.alias("block"), "v", "part", "places")
    tasks = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    copies = dealt.join(sides, ["place", "block"]).select("pair", "place", "left", "v", "part", "places").join(sketched, "v")
    return copies.repartition(tasks, "pair").sortWithinPartitions("pair").mapInArrow(search, "a long, b long, place long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets `sets(v, shingles)` have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    first = sets.select(F.col("v").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("v").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(v, shingles, wide) of the texts of `docs(id, tk, text)` named by `wanted(v, id, tk, wide)`."""

    def run(batches):
        for batch in batches:
            for step in text_steps(batch):
                value, row = shingle_sets(step.column(1), size)
                cuts = np.searchsorted(row, np.arange(step.num_rows + 1))
                shingles = pa.array([value[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([step.column(0), shingles, step.column(2)], names=["v", "shingles", "wide"])

    texts = docs.select("id", "tk", "text").join(wanted.hint("merge"), ["id", "tk"]).select("v", "text", "wide")
    return texts.mapInArrow(run, "v long, shingles binary, wide boolean")


def sketches(sets: DataFrame) -> DataFrame:
    """(v, sketch) of each of `sets(v, shingles)`, none of them empty."""

    def run(batches):
        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) // 8
            steps = np.cumsum(lengths) // SKETCH_STEP
            for step in np.unique(steps):
                at = np.flatnonzero(steps == step)
                part = batch.slice(at[0], len(at))
                value = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64)
                starts = np.cumsum(lengths[at]) - lengths[at]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in _sketches(value, starts)], pa.binary())], names=["v", "sketch"])

    return sets.select("v", "shingles").mapInArrow(run, "v long, sketch binary")


def link_components(docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame | None:
    """(v, c) for the classes of `reps(v, id, tk, signature)` that have a confirmed link; None without any candidate."""
    spark = docs.sparkSession
    rows = written(forest(reps), "labels")
    pairs = written(candidates(rows, int(np.ceil((percent / 100 - MARGIN) * SIGNATURE))), "candidates")
    release(spark)
    n_pairs = pairs.count()
    degree = written(few_tasks(pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("degree")), 2 * n_pairs), "degree")
    wide = rows.where("wide").select("v", "wide").unionByName(degree.select("v", F.lit(False).alias("wide"))).groupBy("v").agg(F.max("wide").alias("wide"))
    sets = written(_sets(docs, wide.join(reps.select("v", "id", "tk"), "v"), size).dropDuplicates(["v"]), "sets")
    release(spark)
    of = lambda table, column, name: table.select(F.col("v").alias(name), F.col(column).alias(f"{column}_{name}"))
    left = written(few_tasks(pairs.join(of(degree, "degree", "a"), "a").join(of(degree, "degree", "b"), "b"), n_pairs), "pairs")
    found = None
    for tries in ROUNDS if left.head(1) else ():
        likely = (F.col("same") >= percent * SIGNATURE / 100).alias("likely")
        ways = left.select(F.col("a").alias("v"), F.struct(likely, F.col("degree_b").alias("degree"), "same", F.col("b").alias("u")).alias("r")).unionByName(
            left.select(F.col("b").alias("v"), F.struct(likely, F.col("degree_a").alias("degree"), "same", F.col("a").alias("u")).alias("r"))
        )
        if tries is None:
            chosen = left.select("a", "b")
        else:  # `tries` partners of each document, one for each residue of the partner's hash
            best = ways.groupBy("v", F.pmod(F.xxhash64("r.u"), F.lit(tries)).alias("k")).agg(F.max("r").alias("r"))
            chosen = best.select(F.least("v", "r.u").alias("a"), F.greatest("v", "r.u").alias("b")).distinct()
        chosen = written(few_tasks(chosen, n_pairs), "chosen")
        new = written(confirm(chosen, sets, percent), "links")
        if new.head(1):
            found = extended(found, new)
            left = left.join(of(found, "c", "a"), "a", "left").join(of(found, "c", "b"), "b", "left")
            left = left.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).drop("c_a", "c_b")
        if tries is not None:
            left = written(few_tasks(left.join(chosen, ["a", "b"], "left_anti"), n_pairs), "left")
            if not left.head(1):
                break
        release(spark)
    agree = (1 + 3 * percent / 100) / 4  # by chance, one in four minimum hashes agrees in two bits
    least = int(np.ceil(agree * SKETCH - ERRORS * np.sqrt(agree * (1 - agree) * SKETCH)))
    split = rows.where("wide").select("tree", "label", "v")
    if not split.head(1):
        return found
    sketched = written(sketches(sets.where("wide")), "sketches")

    def with_part(table, name):
        """`table` and `part_<name>`: the component of each, which has one row for every value of `name`."""
        if found is None:
            return table.withColumn(f"part_{name}", F.col(name))
        return table.join(of(found, "c", name), name, "left").withColumn(f"part_{name}", F.coalesce(f"c_{name}", name)).drop(f"c_{name}")

    def linked(chosen):
        new = written(confirm(chosen, sets, percent), "links")
        return extended(found, new) if new.head(1) else found

    # components are looked up once for a row or an original, not once for each of their pairs
    pairs_of = with_part(originals(split).groupBy("v").agg(F.collect_list("u").alias("us")), "v").select("v", "part_v", F.explode("us").alias("u"))
    heads = with_part(pairs_of.select("u").distinct(), "u")
    first = alike(pairs_of.join(heads, "u").where("part_v <> part_u").select("v", "u"), sketched, least)
    best = first.groupBy("v").agg(F.max(F.struct("same", "u")).alias("r")).select(F.least("v", "r.u").alias("a"), F.greatest("v", "r.u").alias("b")).distinct()
    chosen = written(few_tasks(best.join(pairs, ["a", "b"], "left_anti"), split.count()), "chosen")
    found = linked(chosen)
    tried = pairs.select("a", "b").unionByName(chosen)
    release(spark)
    place = F.shiftleft(F.col("tree").cast("long"), 8 * BASE_DEPTH) + F.conv(F.hex(F.substring("label", 1, BASE_DEPTH)), 16, 10).cast("long")
    # the place of a row in each tree, -1 where it shares its first bytes with too few, as big-endian bytes
    by_tree = F.concat(*[F.unhex(F.lpad(F.hex(F.coalesce(F.max(F.when(F.col("tree") == t, place)), F.lit(-1).cast("long"))), 16, "0")) for t in range(TREES)])
    members = written(split.groupBy("v").agg(by_tree.alias("places"), F.collect_set(place).alias("open")), "members")
    for tries in BLOCK_ROUNDS:
        placed = with_part(members, "v").select(F.explode("open").alias("place"), "v", F.col("part_v").alias("part"), "places")
        search = written(blocks_apart(written(placed, "placed"), sketched, least, tries), "apart")
        rest = written(search.where("a is not null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "rest")
        release(spark)
        if rest.head(1):
            found = linked(rest)
            tried = tried.unionByName(rest)
        again = search.where("a is null").select("place").distinct()
        if not again.head(1):
            break
        left_out = members.select("v", "places", F.explode("open").alias("place")).join(again, "place", "left_semi")
        members = written(left_out.groupBy("v", "places").agg(F.collect_set("place").alias("open")), "members")
    return found


def grouped(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, id, tk, n_shingles, group, component_id of each row of `docs(doc_id, text)`.

    (id, tk) is the row's key (see `with_row_keys`); rows that can be reached from each other
    share `group`, which is null for texts without words; component_id is the smallest doc_id
    of the group that is not null.
    """
    keyed = with_row_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    signed_docs = written(signatures(keyed, size), "signatures")
    full = signed_docs.where("set_key is not null")
    whole = ["set_key", "set_check", "n_shingles"]
    classes = full.groupBy(*whole).agg(F.min(F.struct("id", "tk")).alias("r"), F.min("doc_id").alias("least"))
    # sets that share set_key alone are classes of their own
    nth = F.row_number().over(Window.partitionBy("set_key").orderBy("set_check", "n_shingles")) - 1
    classes = written(classes.withColumn("v", F.col("set_key").bitwiseXOR(nth)), "classes")
    reps = full.join(classes, whole).where("id = r.id and tk = r.tk").select("v", "id", "tk", "signature").dropDuplicates(["v"])
    reps = written(reps, "reps")
    release(docs.sparkSession)
    found = link_components(keyed, reps, size, percent)
    if found is not None:
        classes = classes.join(found, "v", "left").select(*whole, "least", F.coalesce("c", "v").alias("group"))
        classes = written(classes, "groups")
        least = written(classes.groupBy("group").agg(F.min("least").alias("component_id")), "least")
        classes = classes.join(least, "group").select(*whole, "group", "component_id")
    else:
        classes = classes.select(*whole, F.col("v").alias("group"), F.col("least").alias("component_id"))
    joined = signed_docs.select("doc_id", "id", "tk", *whole).join(classes, whole, "left")
    alone = F.col("set_key").isNull()
    return joined.select("doc_id", "id", "tk", "n_shingles", "group", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of `docs(doc_id, text)`.

    Shingles are `size` words of the text with A-Z in lower case; documents are linked if
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable.
    kept: doc_id = component_id, or both are null. Null or wordless text: no shingles, linked
    with nothing. Rows are told apart by their texts, so rows that share a doc_id may be in
    different components; in one component they are kept or not together. A null doc_id is never
    the smallest: such rows are linked like all others, and kept if they reach no row with a
    doc_id. doc_id is an integer. Other columns are ignored; an empty table gives an empty result.
    """
    return grouped(docs, size, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def oracle(size: int = 4, percent: int = 80) -> str:
    """The query over a `documents` view with distinct doc_ids, in DuckDB SQL: all pairs that share a shingle."""
    body = r"trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'))"
    return f"""
with recursive d as (select doc_id, case when {body} = '' then cast([] as varchar[]) else string_split({body}, ' ') end as w from documents),
sh as materialized (select distinct doc_id, md5(array_to_string(w[i : i + {size - 1}], ' ')) as s from (select doc_id, w, unnest(range(1, greatest(1, len(w) - {size - 1}) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by 1),
pairs as (select x.doc_id as a, y.doc_id as b, count(*) as shared from sh x join sh y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
links as materialized (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= {percent} * (x.n + y.n - shared)),
ways as materialized (select a, b from links union all select b, a from links),
reach as (select a, b from ways union select r.a, w.b from reach r join ways w on r.b = w.a),
least_ as (select a as doc_id, min(b) as c from reach group by 1)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(c, d.doc_id)) as kept
from d left join n on n.doc_id = d.doc_id left join least_ l on l.doc_id = d.doc_id"""
