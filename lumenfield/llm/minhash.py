"""Near duplicates of texts by an LSH forest over MinHash signatures.

1. Every whole text becomes its set of distinct word shingles and a MinHash signature.
2. Texts with equal sets collapse into one class, so copies never meet pairwise.
3. Each of ``TREES`` trees orders the classes by a part of the signature. Neighbours share a
   prefix of ``DEPTHS[0]`` values. A region with more than ``REGION`` classes is cut deeper, in
   ``FAN`` orders at once, which go on with the values of different trees.
4. In a region, classes whose whole signatures agree enough to reach the threshold (with a margin
   of four standard deviations) are candidates; a union-find hands on a spanning forest only.
5. Candidate groups are compared on their full sets, dealt to blocks of ``BLOCK`` classes. A pair
   already joined through others is skipped; only confirmed links leave the task.
6. Components of the confirmed links give each document its class.

What is too large for one task (a region still crowded at the last depth, a candidate group of many
blocks) is compared exactly as well: first within blocks, then one class of each part found so far
meets those of other blocks, until that joins little; then all classes outside the
largest part meet each other and that part, in pairs of blocks.

Defined results: null or empty texts have empty sets and link with nothing. Rows with a null
doc_id are returned with a null component and ``kept`` true, and link nothing. Rows that repeat a
doc_id are each judged by their own text, and ``component_id`` is the smallest doc_id that the row's
text reaches. A similarity of exactly the threshold links. Very long texts are shingled whole. An empty table gives no rows.
Extra columns are ignored, whatever their names.

A pair at exactly the threshold of 0.8 shares a prefix of 3 values in some tree with a
probability above 0.9999. Where every region is crowded this is 0.9999 for prefixes of 5 values
and 0.997 for those of 8, by simulation; at 0.85 it is 0.9999 for both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .textkit import BYTE_TABLES, WHITESPACE, Words, lowered, mix, rolling, slices
from .workspace import Workspace

TREES, LABEL, FAN = 16, 8, 4
HASHES = TREES * LABEL
DEPTHS = (3, 5, 8)
REGION = 2048
BLOCK = 256

_MULTIPLIERS = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, width: int, separators: np.ndarray = WHITESPACE) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): each text's sorted distinct shingle hashes, words lower-cased in A-Z."""
    words = Words(column, separators)
    h = words.hashes(lowered(BYTE_TABLES[0]))
    roll = rolling(h, width)
    out, offsets = [], [0]
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= width:
            v = np.unique(roll[a : b - width + 1])
        elif b > a:
            salt = np.uint64(0x9E3779B97F4A7C15 * (b - a) & 0xFFFFFFFFFFFFFFFF)
            v = mix(rolling(h[a:b], b - a, 1) ^ salt)
        else:
            v = roll[:0]
        out.append(v)
        offsets.append(offsets[-1] + len(v))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(offsets)


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each set (zeros for an empty one): first bytes of all HASHES values, then their second bytes."""
    n = len(offsets) - 1
    sig = np.zeros((n, 2 * HASHES), np.uint8)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        at = offsets[full]
        for j in range(HASHES):
            low = np.minimum.reduceat(values * _MULTIPLIERS[j], at)
            value = mix(low)
            sig[full, j], sig[full, HASHES + j] = (value >> np.uint64(40)).astype(np.uint8), (value >> np.uint64(48)).astype(np.uint8)
    return sig


def _binary(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows)
    width = raw.strides[0]
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, (len(raw) + 1) * width, width, dtype=np.int32)), pa.py_buffer(raw)])


def _ragged(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 8).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def sign(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, t, c1, c2, sig): t names the text, c1 and c2 the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, off = shingle_sets(part.column("text"), width)
                size = np.diff(off)
                total = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(salt)))]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                c = [(t[off[1:]] - t[off[:-1]]).view(np.int64) for t in total]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size.astype(np.int64)), part.column("t"), pa.array(c[0]), pa.array(c[1]), _binary(signatures(values, off))],
                    ["doc_id", "n_shingles", "t", "c1", "c2", "sig"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return rows.mapInArrow(run, "doc_id long, n_shingles long, t long, c1 long, c2 long, sig binary")


def spanning(label: np.ndarray, meets: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Spanning forest, by relabelling, of the rows that ``meets(i, others)`` finds; rows of one label are joined already."""
    label, src, dst = label.copy(), [], []
    for i in range(len(label) - 1):
        rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if len(rest) and len(hit := meets(i, rest)):
            old, one = np.unique(label[hit], return_index=True)
            src += [i] * len(one)
            dst += hit[one].tolist()
            label[np.isin(label, old)] = label[i]
    return src, dst


def _agreeing(sig: np.ndarray, least: int) -> Callable[[int, np.ndarray], np.ndarray]:
    return lambda i, rest: rest[(sig[rest] == sig[i]).sum(1) >= least]


def _marks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _region_task(least: int):
    """mapInArrow over rows (key, node, marks) sorted by key, which names the region."""

    def flush(keys, nodes, sig):
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        ok = two[(sig[two] == sig[two + 1]).sum(1) >= least]
        src, dst = [nodes[ok]], [nodes[ok + 1]]
        for a, n in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            i, j = spanning(np.arange(n), _agreeing(sig[a : a + n], least))
            if i:
                src.append(nodes[a + np.array(i)])
                dst.append(nodes[a + np.array(j)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, nodes = (batch.column(c).to_numpy() for c in ("key", "node"))
            held.append((key, nodes, _marks(batch.column("marks"))))
            if held[0][0][0] != key[-1]:  # all but the last region are complete
                whole = [np.concatenate(c) for c in zip(*held)]
                done = int(np.searchsorted(whole[0], key[-1]))
                yield flush(*(c[:done] for c in whole))
                held = [tuple(c[done:] for c in whole)]
        if held:
            yield flush(*(np.concatenate(c) for c in zip(*held)))

    return run


def _pairs(table: pa.Table, judge: Callable[[pa.Array], Callable[[int, np.ndarray], np.ndarray]]) -> pa.Table:
    """Links between the classes of a block or a pair of blocks, as a spanning forest; ``part`` names what is joined already."""
    table = table.sort_by("node")
    nodes = table.column("node").to_numpy()
    label = np.unique(table.column("part").to_numpy(), return_inverse=True)[1]
    src, dst = spanning(label, judge(table.column("payload").combine_chunks()))
    return pa.table({"src": pa.array(nodes[src], pa.int64()), "dst": pa.array(nodes[dst], pa.int64())})


def _signed_alike(least: int):
    """applyInArrow: signatures that agree in ``least`` values."""
    return lambda table: _pairs(table, lambda payload: _agreeing(_marks(payload), least))


def _similar(numerator: int):
    """applyInArrow: sets whose similarity reaches ``numerator`` per cent."""

    def judge(raw: pa.Array) -> Callable[[int, np.ndarray], np.ndarray]:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw]
        size = np.array([len(s) for s in sets])
        off = np.concatenate([[0], np.cumsum(size)])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(int(ids.max()) + 1, bool)

        def meets(i: int, rest: np.ndarray) -> np.ndarray:
            rest = rest[100 * np.minimum(size[rest], size[i]) >= numerator * np.maximum(size[rest], size[i])]
            if not len(rest):
                return rest
            own, lens = ids[off[i] : off[i + 1]], size[rest]
            mark[own] = True
            at = np.cumsum(lens) - lens
            where = np.arange(int(lens.sum())) + np.repeat(off[rest] - at, lens)
            both = np.add.reduceat(mark[ids[where]], at, dtype=np.int64)
            mark[own] = False
            return rest[100 * both >= numerator * (lens + size[i] - both)]

        return meets

    return lambda table: _pairs(table, judge)


def _prefix(depth: int) -> Column:
    """The first ``depth`` values of an order: DEPTHS[0] of its tree, then those of the tree that its fan names."""
    cut = lambda tree, first, n: [F.substring(F.col("sig"), tree * LABEL + half + first + 1, F.lit(n)) for half in (0, HASHES)]
    head = cut(F.col("tree"), 0, DEPTHS[0])
    return F.concat(*head, *(cut((F.col("tree") + F.col("fan")) % TREES, DEPTHS[0], depth - DEPTHS[0]) if depth > DEPTHS[0] else []))


def _candidates(ws: Workspace, classes: DataFrame, least: int) -> DataFrame:
    """Spanning edges of the candidate graph over classes (node, sig)."""
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    order = ["tree", "fan"]
    # the second bytes of the values tell enough to compare; a clash only adds comparisons
    marks = classes.select("node", F.substring("sig", HASHES + 1, HASHES).alias("marks"))
    trees = classes.select("node", upto(F.lit(TREES)).alias("tree"), F.lit(0).alias("fan"), "sig")
    parts = []
    for level, depth in enumerate(DEPTHS):
        if level:  # only what lies in a crowded region goes on
            trees = trees.withColumn("region", _prefix(DEPTHS[level - 1])).join(crowded.select(*order, "region"), [*order, "region"], "left_semi")
        if level == 1:
            trees = trees.select("node", "tree", upto(F.lit(FAN)).alias("fan"), "sig")
        keyed = trees.select("node", *order, _prefix(depth).alias("region"))
        counts = ws.save(keyed.groupBy(*order, "region").count().where("count > 1"), f"regions{depth}")
        crowded = counts.where(F.col("count") > REGION)
        named = F.xxhash64(*order, F.lit(depth), "region")
        parts.append(keyed.join(counts.where(F.col("count") <= REGION), [*order, "region"]).select(named.alias("key"), "node"))
        if more := not crowded.isEmpty():
            continue
        break
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.join(marks, "node").repartition("key").sortWithinPartitions("key")
    edges = rows.mapInArrow(_region_task(least), "src long, dst long")
    if not more:
        return edges
    # sets that agree in a whole order, too many for one task: an order leads each region's classes to the same groups
    names = ws.save(keyed.join(crowded, [*order, "region"]).select(named.alias("group"), "node"), "crowded")
    return _across(ws, names, marks.withColumnRenamed("marks", "payload"), ws.save(edges, "candidates"), _signed_alike(least), REGION)


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """Rows (group, node, ...) with the number of their group's blocks and their own."""
    sizes = rows.groupBy("group").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    return rows.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))


def _across(ws: Workspace, names: DataFrame, payload: DataFrame, links: DataFrame, compare, size: int) -> DataFrame:
    """The links, and those that ``compare`` finds within the groups of ``names`` (group, node), block by block.

    payload: (node, payload). A group's classes that the links do not join all meet.
    """
    schema = "src long, dst long"

    def parted() -> DataFrame:
        joined = connected_components(ws, links).select("node", F.col("component").alias("part"))
        return ws.save(names.join(joined, "node", "left").select("group", "node", F.coalesce("part", "node").alias("part")), "parts")

    rows = parted()
    while True:
        # one class stands for each part of a group
        first = rows.groupBy("group", "part").agg(F.min("node").alias("node"))
        several = first.groupBy("group").count().where("count > 1").select("group")
        met = _dealt(first.join(several, "group", "left_semi"), size).join(payload, "node").select("group", "block", "node", "part", "payload")
        new = ws.save(met.groupBy("group", "block").applyInArrow(compare, schema), "links")
        found = new.count()
        if not found:
            break
        links = ws.save(links.unionByName(new), "links")
        before = rows.select("part").distinct().count()
        rows = parted()
        if found * 20 < before:
            break
    sizes = rows.groupBy("group", "part").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("group").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("n"), (F.sum("n") - F.max("n")).alias("others"))
    blocks = lambda c: F.ceil(F.col(c) / size).cast("int")
    still = rows.join(groups.where("others > 0").select("group", "main", blocks("n").alias("mains"), blocks("others").alias("rests")), "group")
    # other blocks are 0, 1, ...; those of the largest part -1, -2, ...
    is_main = F.col("part") == F.col("main")
    still = still.withColumn("own", F.pmod(F.xxhash64("node"), F.when(is_main, F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    upto = lambda c, f: F.transform(F.sequence(F.lit(0), F.col(c) - 1), f)
    pair = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    with_rest = upto("rests", lambda o: pair(F.least("own", o), F.greatest("own", o)))
    with_main = upto("mains", lambda m: pair(F.col("own"), -1 - m))
    meets = F.when(is_main, upto("rests", lambda o: pair(o, -1 - F.col("own")))).otherwise(F.concat(with_rest, with_main))
    shipped = still.join(payload, "node").select("group", "node", "part", "payload", F.explode(meets).alias("at")).select("group", "at.low", "at.high", "node", "part", "payload")
    return links.unionByName(shipped.groupBy("group", "low", "high").applyInArrow(compare, schema))


def near_duplicates(documents: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash, first: one row for each row of ``documents``.

    ``first`` marks one id and text of each component, the smallest id with one of its texts; where ids do
    not repeat it is ``kept``. ``text_hash`` is Spark's xxhash64 of the text, to tell the texts of an id.
    """
    ws = Workspace(documents.sparkSession, "minhash")
    numerator = round(100 * threshold)
    match = threshold + (1 - threshold) / 256  # marks have 8 bits
    least = int(np.floor(HASHES * match - 4.1 * np.sqrt(HASHES * match * (1 - match))))
    signed = ws.save(sign(documents, width), "signed")
    ours = signed.where("doc_id is not null and n_shingles > 0")
    # equal sets have equal signatures, so any of them serves the class; its number is fixed once it is written
    classes = ours.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "t")).alias("at"), F.max("sig").alias("sig"))
    classes = ws.save(classes.select("c1", "c2", "at.doc_id", "at.t", "sig", F.monotonically_increasing_id().alias("node")), "classes")
    groups = ws.save(connected_components(ws, _candidates(ws, classes.select("node", "sig"), least)).select(F.col("component").alias("group"), "node"), "groups")
    placed = _dealt(groups, BLOCK).join(classes.select("node", "doc_id", "t"), "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, off = shingle_sets(part.column("text"), width)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("group", "node", "blocks", "block")), _ragged(values, off)], ["group", "node", "blocks", "block", "payload"])

    # the candidates are a share of the corpus: one plan for every size, never a broadcast
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text").hint("merge").join(placed, ["doc_id", "t"])
    # of rows that repeat an id and its text one is enough
    if not ours.groupBy("doc_id", "t").count().where("count > 1").isEmpty():
        texts = texts.groupBy("doc_id", "t", "node", "group", "blocks", "block").agg(F.first("text").alias("text"))
    held = ws.save(texts.mapInArrow(sets, "group long, node long, blocks int, block int, payload binary"), "sets")
    met = held.select("group", "block", "node", F.col("node").alias("part"), "payload")
    links = ws.save(met.groupBy("group", "block").applyInArrow(_similar(numerator), "src long, dst long"), "links")
    large = held.where("blocks > 1")
    if not large.isEmpty():
        links = _across(ws, large.select("group", "node"), large.select("node", "payload"), links, _similar(numerator), BLOCK)
    linked = connected_components(ws, links)
    leasts = linked.join(classes.select("node", "doc_id", "t"), "node").groupBy("component").agg(F.min(F.struct("doc_id", "t")).alias("least"))
    # every row takes the smallest id and text of its set's component
    by_class = classes.select("node", "c1", "c2", "doc_id", "t").join(linked.join(leasts, "component"), "node", "left")
    by_class = by_class.select("c1", "c2", F.coalesce("least", F.struct("doc_id", "t")).alias("least"))
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = signed.drop("sig").join(by_class, ["c1", "c2"], "left")
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), F.col("t").alias("text_hash"), (alone | (kept & (F.col("t") == F.col("least.t")))).alias("first"))
