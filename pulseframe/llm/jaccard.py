"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (a shorter text is one shingle), which stand as 64-bit hashes:
"equal" and "verified exactly" below are said of the hashed shingles, and sets are told apart by 128
bits. Texts of equal sets are copies: they form one node, and are never paired.

Candidates come from the buckets of nodes that share a band of MinHash values, bucket by bucket: the
values are compared 16 at a time, and a pair is dropped once the posterior probability that its
Jaccard similarity reaches the threshold falls below the tolerance, given how many values agree (a
uniform prior makes that a binomial tail). Here the low bytes of the values do, which never show less
agreement. Buckets return only the links that join their nodes, so that no pair is emitted; a node
that is already joined is not compared again.

Nodes so joined are a group. In a group all pairs are pruned by the whole values, and survivors are
verified on their whole shingle sets. Large groups are cut into blocks of bounded rows and bytes,
each pair of blocks is one unit of work, and a unit returns how many links each node has and a
spanning forest of them. Counting every link of a group of n different near copies takes a number
of comparisons that grows with the square of n, and each node goes to every block of its own group
(n nodes make n times n / :data:`BLOCK_ROWS` rows); other nodes are not touched by that. No task,
output or driver memory grows so.

Nodes that no candidate reaches are dropped before shingles are gathered; a bit table of bounded
size tells which texts to shingle again.

The chance to miss a pair at the threshold is about 4e-6 by banding and 1e-5 by pruning. Pairs below
the threshold are no links, whatever share of their words they have in common.

Nulls, ties, repeats: a text without words (null, empty) links to nothing and is its own class;
rows that repeat an id or a text are rows of their own; the class id is the least id in the class,
null if all are null; very long texts are shingled whole, in segments; an empty table gives an empty result. Other columns are not carried by
:func:`near_duplicates`; :func:`keep_one` returns rows as they came, whatever their columns' names.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, discard, hash_runs, map_texts, mix, shuffle_partitions, stored
from .graph import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-5
#: Rows of a block of a large bucket. Buckets under 16 blocks get smaller ones.
BUCKET_ROWS = 1024
#: Buckets of so many rows are compared by distance in one sweep, larger ones one by one.
SWEPT = 12
#: Bounds of a block of a group, and of what small groups are packed into. Groups under 16 blocks get smaller ones.
BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20
#: Most bits of the table of candidates.
MOST_BITS = 1 << 26


@cache
def _hash_parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(271828)
    return rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(chunk: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, text by text in ascending order, and the n + 1 places where texts begin."""
    h, at = chunk.runs(SHINGLE)
    owner = chunk.doc[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((chunk.n_words > 0) & (chunk.n_words < SHINGLE))
    if len(short):
        own = [hash_runs(chunk.hashes[chunk.word_at[d] : chunk.word_at[d + 1]], int(chunk.n_words[d]))[0] for d in short]
        h, owner = np.concatenate([h, np.array(own, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(chunk.n + 1))


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values, one row of 32-bit numbers per text that has shingles."""
    some = np.flatnonzero(np.diff(at))
    out = np.empty((len(some), HASHES), np.uint32)
    a, b = _hash_parameters()
    for j in range(HASHES if len(some) else 0):
        out[:, j] = np.minimum.reduceat(((h * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32), at[some])
    return out


def _set_keys(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that depend on the set only."""
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), at[some])
    two = np.add.reduceat(mix(h + np.uint64(0x14057B7EF767814F)), at[some])
    return one.view(np.int64), two.view(np.int64)


def _masked(values: np.ndarray, has: np.ndarray, kind: pa.DataType) -> pa.Array:
    out = np.zeros(len(has), values.dtype)
    out[has] = values
    return pa.array(out, kind, mask=~has)


def signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: key, ``text_hash``, ``s1`` and ``s2`` (the set's fingerprint), ``n`` shingles, ``signature`` and ``sketch`` (the low bytes of its values)."""

    def make():
        def sign(chunk: Texts):
            h, at = shingles(chunk)
            n = np.diff(at)
            has = n > 0
            one, two = _set_keys(h, at)
            made = signatures(h, at)
            values, low = iter(made), iter(made.astype(np.uint8))
            return [
                _masked(one, has, pa.int64()),
                _masked(two, has, pa.int64()),
                pa.array(n.astype(np.int64)),
                pa.array([next(values).tobytes() if x else None for x in has], pa.binary()),
                pa.array([next(low).tobytes() if x else None for x in has], pa.binary()),
            ]

        return sign

    hashed = docs.select(F.col(key), F.col(text), F.xxhash64(text).alias("text_hash"))
    return map_texts(hashed, text, [key, "text_hash"], "s1 long, s2 long, n long, signature binary, sketch binary", make)


@cache
def least_matches() -> tuple[int, ...]:
    """For 16, 32, ... compared values: the fewest agreements that keep a pair.

    With a uniform prior, the posterior that similarity is t or more after m of n agreements is the
    chance of at most m successes in n + 1 trials of probability t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 2):
            total += comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
            if total >= TOLERANCE:
                out.append(m)
                break
    return tuple(out)


def pruned_pairs(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a and b (of a alone: each once) that pruning by MinHash values leaves."""
    other = a if b is None else b
    found = []
    for lo in range(0, len(a), 256):
        part = a[lo : lo + 256]
        agree = np.zeros((len(part), len(other)), np.int16)
        for j in range(STEP):
            agree += part[:, j, None] == other[None, :, j]
        keep = agree >= least_matches()[0]
        if b is None:
            keep &= np.arange(len(other))[None, :] > (lo + np.arange(len(part)))[:, None]
        x, y = np.nonzero(keep)
        count = agree[x, y]
        for i, least in enumerate(least_matches()[1:], 1):
            for z in range(0, len(x), 1 << 18):
                part_x, part_y = x[z : z + (1 << 18)], y[z : z + (1 << 18)]
                for j in range(STEP * i, STEP * (i + 1)):
                    count[z : z + (1 << 18)] += part[part_x, j] == other[part_y, j]
            keep = count >= least
            x, y, count = x[keep], y[keep], count[keep]
        found.append((x + lo, y))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def verified(x: np.ndarray, y: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Whether the sets of each pair have the threshold's Jaccard similarity."""
    size = np.array([len(s) for s in sets])
    common = np.zeros(len(x), np.int64)
    used = np.unique(np.concatenate([x, y]))
    if len(x) <= 4 * len(used):
        for i, (p, q) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
            common[i] = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
    else:  # many pairs of few sets: matrix products over runs of shingles
        place = np.zeros(len(sets), np.int64)
        place[used] = np.arange(len(used))
        row = np.repeat(np.arange(len(used)), size[used])
        _, column = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        total = np.zeros((len(used), len(used)), np.float32)
        for lo in range(0, int(column[-1]) + 1, 2048):
            i, j = np.searchsorted(column, [lo, lo + 2048])
            has = np.zeros((len(used), 2048), np.float32)
            has[row[i:j], column[i:j] - lo] = 1
            total += has @ has.T
        common = total[place[x], place[y]].astype(np.int64)
    return common * 10 >= THRESHOLD_TENTHS * (size[x] + size[y] - common)


THRESHOLD_TENTHS = round(THRESHOLD * 10)


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least row of each row's component under the links x-y."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _link(table: pa.Table) -> pa.Table:
    """One unit: the groups (or pair of blocks) in it -> links and local root of each node."""
    group = table.column("root").to_numpy()
    order = np.lexsort((table.column("node").to_numpy(), group))
    table, group = table.take(pa.array(order)), group[order]
    node, copies, block, first, second = (table.column(c).to_numpy() for c in ("node", "copies", "block", "first", "second"))
    signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
    texts, docs, root = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), node.copy()
    cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        rows = np.arange(lo, hi)
        if first[lo] == second[lo]:
            x, y = pruned_pairs(signature[rows], None)
            x, y = rows[x], rows[y]
        else:
            left, right = rows[block[rows] == first[lo]], rows[block[rows] == second[lo]]
            x, y = pruned_pairs(signature[left], signature[right])
            x, y = left[x], right[y]
        if not len(x):
            continue
        same = verified(x, y, sets)
        x, y = x[same], y[same]
        np.add.at(texts, x, 1), np.add.at(texts, y, 1)
        np.add.at(docs, x, copies[y]), np.add.at(docs, y, copies[x])
        root[lo:hi] = node[lo + _forest(hi - lo, x - lo, y - lo)]
    some = texts > 0
    columns = [node[some], texts[some], docs[some], root[some]]
    return pa.table({n: pa.array(c) for n, c in zip(("node", "texts", "docs", "root"), columns, strict=True)})


def _linked_unit(table: pa.Table) -> pa.Table:
    out = _link(table)
    return out.append_column("whole", pa.array([table.column("whole")[0].as_py()] * out.num_rows, pa.bool_()))


def _surviving(values: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows x, y those that pruning leaves."""
    kept = []
    for lo in range(0, len(x), 1 << 16):
        a, b = x[lo : lo + (1 << 16)], y[lo : lo + (1 << 16)]
        count = np.zeros(len(a), np.int16)
        for i, least in enumerate(least_matches()):
            part = slice(STEP * i, STEP * (i + 1))
            count += (values[a, part] == values[b, part]).sum(axis=1, dtype=np.int16)
            keep = count >= least
            a, b, count = a[keep], b[keep], count[keep]
        kept.append((a, b))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(k[i] for k in kept)]) for i in (0, 1))


def _joined(values: np.ndarray) -> np.ndarray:
    """For each row the first row of those that surviving pairs join it with.

    Rows in reach of a seed are found step by step; rows found already are not compared again.
    """
    root = np.arange(len(values))
    rest = np.arange(len(values))
    while len(rest):
        seed, rest = rest[0], rest[1:]
        reached = np.array([seed])
        while len(reached) and len(rest):
            new = []
            for lo in range(0, len(reached), 256):
                _, hit = pruned_pairs(values[reached[lo : lo + 256]], values[rest])
                mask = np.zeros(len(rest), bool)
                mask[hit] = True
                new.append(rest[mask])
                rest = rest[~mask]
            reached = np.concatenate(new)
            root[reached] = seed
    return root


def _bucket_links(table: pa.Table) -> pa.Table:
    """One unit of buckets -> links (u, v) that join the nodes of each as its surviving pairs do."""
    bucket, node = table.column("bucket").to_numpy(), table.column("node").to_numpy()
    order = np.lexsort((node, bucket))
    bucket, node = bucket[order], node[order]
    values = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES)[order]
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    size = np.repeat(np.diff(cuts), np.diff(cuts))
    found = []
    for apart in range(1, SWEPT):
        x = np.flatnonzero((bucket[apart:] == bucket[:-apart]) & (size[apart:] <= SWEPT))
        x, y = _surviving(values, x, x + apart)
        found.append((node[x], node[y]))
    for lo, hi in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        if hi - lo > SWEPT:
            root = _joined(values[lo:hi])
            other = np.flatnonzero(root != np.arange(hi - lo))
            found.append((node[lo + root[other]], node[lo + other]))
    return pa.table({"u": pa.array(np.concatenate([f[0] for f in found])), "v": pa.array(np.concatenate([f[1] for f in found]))})


def _candidates(nodes: DataFrame) -> DataFrame:
    """(node, root): groups of nodes that pruning joins, pair by pair or through others."""
    spark = nodes.sparkSession
    width = 4 * ROWS
    bands = nodes.select(
        "node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring("signature", i * width + 1, F.lit(width)))).alias("band", "values")
    ).select("node", F.xxhash64("band", "values").alias("bucket"))
    shared = stored(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shared-bands")
    # a bucket of several blocks: every pair of blocks is a unit, which holds the rows of both
    block_rows = F.greatest(F.lit(BUCKET_ROWS // 4), F.least(F.lit(BUCKET_ROWS), F.col("members") / 16))
    blocks = F.ceil(F.col("members") / block_rows).cast("int")
    small = shared.where(blocks == 1).agg(F.sum("members")).first()[0] or 0
    packs = max(4 * shuffle_partitions(spark), -(-int(small) // (16 * BUCKET_ROWS)))
    members = bands.join(shared, "bucket").join(nodes.select("node", "sketch"), "node")
    placed = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", F.lit("bucket")), F.col("blocks")).cast("int"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")))
    paired = placed.withColumn("other", F.explode(others))
    block = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    units = paired.select(
        F.when(F.col("blocks") == 1, F.pmod(F.col("bucket"), F.lit(packs))).otherwise(block).alias("unit"),
        F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(block).alias("bucket"), "node", "sketch",
    )
    edges = units.groupBy("unit").applyInArrow(_bucket_links, "u long, v long").distinct()
    out = components(edges, "candidate-groups")
    discard(shared)
    return out


def _shingled(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """The shingle sets of the wanted nodes (s1, s2), from the texts once more.

    A bit table of at most :data:`MOST_BITS` bits says which sets may be wanted; what it lets
    through in error falls out in the join.
    """
    spark = docs.sparkSession
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * wanted.count()).bit_length()))
    bit = F.col("s1").bitwiseAND(F.lit(bits - 1))
    words = wanted.groupBy(F.shiftright(bit, 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31)).cast("int"))).alias("b"))
    table = np.zeros(bits // 32, np.uint32)
    for batch in words.toArrow().to_batches():  # at most bits / 32 rows
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint32)
    sent = spark.sparkContext.broadcast(table)

    def make():
        table = sent.value

        def take(chunk: Texts):
            h, at = shingles(chunk)
            has = np.diff(at) > 0
            one, two = _set_keys(h, at)
            low = one & (bits - 1)
            maybe = np.zeros(chunk.n, bool)
            maybe[has] = (table[low >> 5] >> (low & 31).astype(np.uint32)) & 1 > 0
            starts = at.tolist()
            return [
                _masked(one, has, pa.int64()),
                _masked(two, has, pa.int64()),
                pa.array([h[starts[d] : starts[d + 1]].tobytes() if maybe[d] else None for d in range(chunk.n)], pa.binary()),
            ]

        return take

    made = map_texts(docs, text, [], "s1 long, s2 long, shingles binary", make).where("shingles IS NOT NULL")
    return made.groupBy("s1", "s2").agg(F.first("shingles").alias("shingles"))


def _classified(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (key, text_hash, s1, s2, n) and, by s1 and s2, what is found of each set: its class and links."""
    spark = docs.sparkSession
    rows = stored(signed(docs, key, text), "signed")
    grouped = rows.where("n > 0").groupBy("s1", "s2").agg(
        F.min(key).alias("least"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")
    )
    nodes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    groups = _candidates(nodes)
    wanted = stored(nodes.select("node", "s1", "s2", "copies", "n", "signature").join(groups, "node"), "wanted")

    size = wanted.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("n") * 8 + 4 * HASHES).alias("bytes"))
    block_rows = F.greatest(F.lit(BLOCK_ROWS // 4), F.least(F.lit(BLOCK_ROWS), F.col("rows") / 16))
    blocks = F.greatest(F.ceil(F.col("rows") / block_rows), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    size = stored(size.select("root", blocks.alias("blocks"), "bytes"), "group-sizes")
    small = size.where("blocks = 1").agg(F.sum("bytes")).first()[0] or 0
    packs = max(4 * shuffle_partitions(spark), -(-int(small) // BLOCK_BYTES))

    sets = wanted.join(_shingled(docs, key, text, wanted.select("s1", "s2")), ["s1", "s2"]).join(size.select("root", "blocks"), "root")
    block = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    placed = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = placed.select(
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(packs))).otherwise(F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"))).alias("unit"),
        (F.col("blocks") == 1).alias("whole"),
        "root", "node", "copies", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "signature", "shingles",
    )
    linked = units.groupBy("unit", "whole", "first", "second").applyInArrow(
        _linked_unit, "node long, texts long, docs long, root long, whole boolean",
    )
    links = stored(linked, "links")
    counts = links.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    roots = links.where("whole").select("node", "root")
    parts = links.where("NOT whole AND node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    classes = None if parts.isEmpty() else components(parts, "classes")
    if classes is not None:
        roots = roots.unionByName(classes)
    placed_nodes = nodes.select("node", "s1", "s2", "least", "copies").join(counts, "node", "left").join(roots, "node", "left")
    placed_nodes = stored(placed_nodes.withColumn("root", F.coalesce("root", "node")), "placed")
    discard(nodes, groups, wanted, size, links, *([] if classes is None else [classes]))
    classes = placed_nodes.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_rows"))
    found = placed_nodes.join(classes, "root").select(
        "s1", "s2", "root", "class_id", "class_rows",
        (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0).cast("long")).alias("n_text_links"),
    )
    return rows.drop("signature", "sketch"), found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its key, ``class_id``, ``n_links`` (other rows at the threshold, copies included),
    ``n_text_links`` (other texts) and ``class_rows`` (rows of its class)."""
    rows, found = _classified(docs, key, text)
    worded = rows.where("n > 0").select(key, "s1", "s2").join(found, ["s1", "s2"]).select(key, "class_id", "n_links", "n_text_links", "class_rows")
    zero = F.lit(0).cast("long")
    alone = rows.where("n = 0").select(key, F.col(key).alias("class_id"), zero.alias("n_links"), zero.alias("n_text_links"), F.lit(1).cast("long").alias("class_rows"))
    return worded.unionByName(alone)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that have an earlier one in their class.

    Earlier is the lesser id (nulls last), then the lesser hash of the text; of rows that repeat both
    the one whose columns, as JSON, come first. Rows without words stay.
    """
    rows, found = _classified(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_key", "_text")
    worded = rows.where("n > 0").join(found.select("s1", "s2", "root"), ["s1", "s2"])
    each = worded.groupBy("root", "_key", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    own = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("text_hash").alias("hash"), "rows")
    first = stored(each.groupBy("root").agg(F.min(own).alias("w")).select("w.key", "w.hash", "w.rows"), "first-of-class")
    silent = rows.where("n = 0").select(F.col("_key").alias("key"), F.col("text_hash").alias("hash"), F.lit(1).cast("long").alias("rows")).distinct()
    packed = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"))
    met = packed.join(first.unionByName(silent), F.col("_key").eqNullSafe(F.col("key")) & (F.col("_hash") == F.col("hash")))
    out = met.where("rows = 1").select("_row")
    if not first.where("rows > 1").isEmpty():
        out = out.unionByName(met.where("rows > 1").groupBy("_key", "_hash").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row"))
    return out.select("_row.*")
