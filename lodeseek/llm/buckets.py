"""From buckets of signature bands to components of confirmed links, without making all pairs of a bucket.

``verify`` gets pairs (a, b) of class keys and returns those that are links. First each class is compared with two
classes at most: of the most popular class of each of its buckets, the one that it shares most buckets with and the
most popular one. A class is popular if its buckets are large, so copies meet the original they were made from. The
links form a forest, which pointer jumping flattens. Two classes of a bucket that are then in one component need no
comparison. The buckets left with several components are gathered by their largest one, and there every class
outside it, a stated query set, is compared with all classes, block by block, so no table holds a row for each
pair. Every two classes that share a band are thus compared or already in one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.llm.shingles import mix64
from lodeseek.llm.union_find import components
from lodeseek.plans.staging import discard, stage

#: Classes in a block, and bytes of what is compared.
BLOCK, BLOCK_BYTES = 256, 16 << 20
#: A band with more than one in so many of all band rows is hot; there are twice as many hot bands at most.
SHARE = 4096
#: Band rows that one task sorts in memory, and that one task packs at once.
SORTED, PACKED = 1 << 22, 1 << 20
#: Rows of one band that one task of a join gets.
DEALT = 4096


def longs_of(values: pa.Array) -> np.ndarray:
    """The bytes of all values, none null, end to end as longs."""
    if not len(values):
        return np.zeros(0, np.int64)
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.int64, (int(offsets[-1]) - int(offsets[0])) // 8, int(offsets[0])) if data is not None else np.zeros(0, np.int64)


def _flat(bands: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All band hashes in order, and how many each row has. A row's are a list, or the bytes of its longs, which cost the engine less."""
    if pa.types.is_binary(bands.type):
        return longs_of(bands.drop_null()), pc.binary_length(bands).fill_null(0).to_numpy(zero_copy_only=False) // 8
    return bands.flatten().to_numpy(), bands.value_lengths().fill_null(0).to_numpy()


def _hot_bands(classes: DataFrame) -> tuple[DataFrame, int, int]:
    """(hot), their number, and that of all band rows. Hot are the bands that hold more than 1 in ``SHARE`` of all band rows, and some with half as many.

    Each task keeps a Misra-Gries summary, which misses no band of that share and holds twice ``SHARE`` counts at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts, total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            own, _ = _flat(batch.column("bands"))
            total += len(own)
            own, n = np.unique(own, return_counts=True)
            values, inverse = np.unique(np.concatenate([values, own]), return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate([counts, n]), minlength=len(values)).astype(np.int64)
            if len(values) > 2 * SHARE:
                counts = counts - np.partition(counts, -2 * SHARE - 1)[-2 * SHARE - 1]
                values, counts = values[counts > 0], counts[counts > 0]
        # one more row, of no band, says how many rows there were
        yield pa.RecordBatch.from_arrays([pa.array([*values.tolist(), None], pa.int64()), pa.array([*counts.tolist(), 0], pa.int64()), pa.array([0] * len(values) + [total], pa.int64())], ["hot", "n", "total"])

    found = stage(classes.select("bands").mapInArrow(run, "hot long, n long, total long").groupBy("hot").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "band-counts")
    total = found.agg(F.sum("total")).first()[0] or 0
    hot = stage(found.filter(F.col("n") > max(DEALT, total // (2 * SHARE))).select("hot"), "hot-bands")
    discard(found)
    return hot, hot.count(), total


def _columns(keys: pa.Array) -> np.ndarray:
    """Keys of one length, or longs, as rows of longs."""
    if pa.types.is_int64(keys.type):
        return keys.to_numpy().reshape(-1, 1)
    return longs_of(keys).reshape(len(keys), -1)


def _packed(classes: DataFrame, hot: DataFrame, parts: int) -> DataFrame:
    """(part, bands, keys): the rows of each band that isn't hot have one part; up to ``PACKED`` of a task go out at once, as one row of bytes for each part."""
    left_out = np.sort(np.array([r.hot for r in hot.collect()], np.int64))  # 2 * SHARE at most

    def deal(bands: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        part = (mix64(bands.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, bands, keys = part[order], bands[order], keys[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)]))
        blobs = [pa.array([x[lo:hi].tobytes() for lo, hi in spans], pa.binary()) for x in (bands, keys)]
        return pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), *blobs], ["part", "bands", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            bands, n_bands = _flat(batch.column("bands"))
            keys = np.repeat(_columns(batch.column("key")), n_bands, axis=0)
            if len(left_out):
                at = np.minimum(np.searchsorted(left_out, bands), len(left_out) - 1)
                rest = left_out[at] != bands
                bands, keys = bands[rest], keys[rest]
            if len(bands):
                held.append((bands, keys))
                n += len(bands)
            if n >= PACKED:
                yield deal(*(np.concatenate(x) for x in zip(*held)))
                held, n = [], 0
        if held:
            yield deal(*(np.concatenate(x) for x in zip(*held)))

    return classes.select("key", "bands").mapInArrow(run, "part int, bands binary, keys binary")


def _of_hot(classes: DataFrame, hot: DataFrame) -> DataFrame:
    """(band, key): the rows of the hot bands; may repeat."""
    wanted = np.sort(np.array([r.hot for r in hot.collect()], np.int64))  # 2 * SHARE at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, n_bands = _flat(batch.column("bands"))
            at = np.minimum(np.searchsorted(wanted, bands), len(wanted) - 1)
            hit = wanted[at] == bands
            own = pa.array(np.repeat(np.arange(len(n_bands)), n_bands)[hit])
            yield pa.RecordBatch.from_arrays([pa.array(bands[hit]), batch.column("key").take(own)], ["band", "key"])

    kind = T.StructType([T.StructField("band", T.LongType()), T.StructField("key", classes.schema["key"].dataType)])
    return classes.select("key", "bands").mapInArrow(run, kind)


def _runs(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Bands, keys and number of keys of the bands with two keys at least, by band and key; repeats once."""
    held = []
    for batch in batches:
        for band, key in zip(batch.column("bands"), batch.column("keys")):
            band = np.frombuffer(band.as_py(), np.int64)
            held.append((band, np.frombuffer(key.as_py(), np.int64).reshape(len(band), -1)))
    if not held:
        return None
    bands, keys = (np.concatenate(x) for x in zip(*held))
    held.clear()
    order = np.argsort(bands)
    bands, keys = bands[order], keys[order]
    alone = np.ones(len(bands) + 1, bool)
    alone[1:-1] = bands[1:] != bands[:-1]
    near = ~(alone[1:] & alone[:-1])
    bands, keys = bands[near], keys[near]
    order = np.lexsort((*keys.T, bands))
    bands, keys = bands[order], keys[order]
    heads = np.ones(len(bands), bool)
    heads[1:] = bands[1:] != bands[:-1]
    fresh = heads.copy()
    fresh[1:] |= (keys[1:] != keys[:-1]).any(axis=1)
    bands, keys, heads = bands[fresh], keys[fresh], np.flatnonzero(heads[fresh])
    sizes = np.diff(np.append(heads, len(bands)))
    sizes = np.repeat(sizes, sizes)
    many = sizes > 1
    return bands[many], np.ascontiguousarray(keys[many]), sizes[many]


def _rows(bands: np.ndarray, keys: np.ndarray, whole: bool, **more: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(band, key) and more columns, 100,000 rows at a time."""
    for i in range(0, len(bands), 100_000):
        own = keys[i : i + 100_000]
        named = pa.array(own[:, 0]) if whole else pa.array([x.tobytes() for x in own], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(bands[i : i + 100_000]), named, *[pa.array(x[i : i + 100_000]) for x in more.values()]], ["band", "key", *more])


def _shared_runs(dealt: DataFrame, kind: T.DataType) -> DataFrame:
    """(band, key, size) of the bands with two keys at least, from packed rows dealt by part; repeats once. A task holds its partition, ``SORTED`` rows or so."""
    whole = isinstance(kind, T.LongType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := _runs(batches):
            yield from _rows(found[0], found[1], whole, size=found[2])

    return dealt.mapInArrow(run, _schema(kind, "size"))


def _schema(kind: T.DataType, *more: str) -> T.StructType:
    return T.StructType([T.StructField("band", T.LongType()), T.StructField("key", kind), *[T.StructField(x, T.LongType()) for x in more]])


def _sets(dealt: DataFrame, parts: int) -> DataFrame:
    """(part, names, bands, sizes, keys): packed buckets, those of equal sets of keys with one part. ``names`` are 128 bits of the set, by sums of hashes of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _runs(batches)
        if not found or not len(found[0]):
            return
        bands, keys, sizes = found
        heads = np.flatnonzero(np.diff(bands, prepend=bands[0] ^ 1))
        sums = []
        for salt in (1, 2):
            h = np.full(len(keys), salt, np.uint64)
            for column in keys.view(np.uint64).T:
                h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + column)
            sums.append(np.add.reduceat(h, heads))
        names, bands, sizes = np.stack(sums, axis=1), bands[heads], sizes[heads]
        large = sizes > DEALT // 4  # such a set's buckets need not meet in one task
        names[large] = np.stack([mix64(bands[large].view(np.uint64)), bands[large].view(np.uint64)], axis=1)
        part = (mix64(names[:, 0]) % np.uint64(parts)).astype(np.int64)
        keys = keys[np.argsort(np.repeat(part, sizes), kind="stable")]
        order = np.argsort(part, kind="stable")
        part, names, bands, sizes = part[order], names[order], bands[order], sizes[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(cuts[1:], len(part))
        at = np.append(0, np.cumsum(sizes))
        spans = list(zip(cuts.tolist(), ends.tolist()))
        blobs = [pa.array([x[lo:hi].tobytes() for lo, hi in spans], pa.binary()) for x in (names, bands, sizes)]
        blobs.append(pa.array([keys[at[lo] : at[hi]].tobytes() for lo, hi in spans], pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), *blobs], ["part", "names", "bands", "sizes", "keys"])

    return dealt.mapInArrow(run, "part int, names binary, bands binary, sizes binary, keys binary")


def _first_of_sets(dealt: DataFrame, kind: T.DataType) -> DataFrame:
    """(band, key, size, times): of the buckets with one set of keys that of the smallest band, and how many they are."""
    whole = isinstance(kind, T.LongType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for row in zip(*[batch.column(x) for x in ("names", "bands", "sizes", "keys")]):
                names, bands, sizes, keys = (np.frombuffer(x.as_py(), np.int64) for x in row)
                held.append((names.reshape(-1, 2), bands, sizes, keys.reshape(int(sizes.sum()), -1)))
        if not held:
            return
        names, bands, sizes, keys = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((bands, sizes, *names.T))
        new = np.ones(len(order), bool)
        new[1:] = (names[order[1:]] != names[order[:-1]]).any(axis=1) | (sizes[order[1:]] != sizes[order[:-1]])
        heads = np.flatnonzero(new)
        times, own = np.diff(np.append(heads, len(order))), order[heads]
        starts, n = (np.cumsum(sizes) - sizes)[own], sizes[own]
        rows = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield from _rows(np.repeat(bands[own], n), keys[rows], whole, size=np.repeat(n, n), times=np.repeat(times, n))

    return dealt.mapInArrow(run, _schema(kind, "size", "times"))


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(band, key, size) of the buckets that hold two keys at least, from rows (key, bands); staged. Rows may repeat a key; bands are longs, as a list or as bytes.

    Bands are dealt out once, packed, to as many tasks as their number needs. A hot band goes its own way: its keys are counted and made distinct with partial sums, so
    that no task gets them all. ``size`` is the number of keys.
    """
    return _buckets(classes, False)


def distinct_buckets(classes: DataFrame) -> DataFrame:
    """(band, key, size, times): as shared_buckets, but of several bands that hold one and the same set of keys only one; ``times`` is their number.

    Classes that are alike share many bands, so most buckets hold the same keys as others. Hot bands, and those of more than a quarter of ``DEALT`` keys, are left as they are.
    """
    return _buckets(classes, True)


def _buckets(classes: DataFrame, once: bool) -> DataFrame:
    hot, n_hot, total = _hot_bands(classes)
    parts, kind = max(-(-total // SORTED), int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))), classes.schema["key"].dataType
    dealt = _packed(classes, hot, parts).repartitionById(parts, "part")
    found = _first_of_sets(_sets(dealt, parts).repartitionById(parts, "part"), kind) if once else _shared_runs(dealt, kind)
    if n_hot:
        own = _of_hot(classes, hot).distinct()
        sizes = own.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1").withColumnRenamed("band", "hot")
        own = own.join(F.broadcast(sizes), F.col("band") == F.col("hot")).select("band", "key", "size")
        found = found.unionByName(own.withColumn("times", F.lit(1).cast("long")) if once else own)
    out = stage(found, "buckets")
    discard(hot)
    return out


def _dealt(many: DataFrame, few: DataFrame, a: str, b: str, size: str, parts: str) -> DataFrame:
    """``many`` joined with ``few`` on a = b, a key's rows dealt to one task for each ``DEALT``: column ``size`` of ``many`` says how many
    rows its key has, ``parts`` of ``few`` is the largest such number."""
    left = many.withColumn("__s", F.pmod(F.xxhash64("key"), F.ceil(F.col(size) / DEALT)).cast("long"))
    right = few.withColumn("__t", F.explode(F.sequence(F.lit(0), F.ceil(F.col(parts) / DEALT).cast("long") - 1)))
    return left.join(right, (F.col(a) == F.col(b)) & (F.col("__s") == F.col("__t"))).drop("__s", "__t")


def _first_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b, rank): each class and the two, at most, that it meets first."""
    popular = buckets.groupBy("key").agg(F.sum(F.col("size") * F.col("times")).alias("p")).withColumnRenamed("key", "who")
    ranked = stage(buckets.join(popular, F.col("key") == F.col("who")).select("band", "key", "size", "times", F.struct("p", "key").alias("x")), "ranked")
    tops = ranked.groupBy("band").agg(F.max("x").alias("top"), F.max("size").alias("parts")).withColumnRenamed("band", "of")
    votes = _dealt(ranked, tops, "band", "of", "size", "parts").filter("x < top").groupBy("x", "top").agg(F.sum("times").alias("n"))
    best = votes.groupBy("x").agg(F.max(F.struct("n", "top")).alias("near"), F.max("top").alias("high"))
    met = F.array_distinct(F.array("near.top", "high"))
    return best.select(F.col("x.key").alias("a"), F.explode(met).alias("y")).select("a", F.col("y.key").alias("b"), F.col("y.p").alias("rank"))


def _roots(links: DataFrame) -> DataFrame:
    """(node, component) where each node's only link (a, b) leads up, b being of a higher rank."""
    up = stage(links.select(F.col("a").alias("node"), F.col("b").alias("component")), "parents")
    while True:
        above = up.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        step = stage(up.join(above, F.col("component") == F.col("n2"), "left").select("node", F.coalesce("c2", "component").alias("component"), F.col("c2").isNotNull().alias("moved")), "parents")
        discard(up)
        up = step
        if not step.filter("moved").limit(1).count():
            return up.select("node", "component")


def _relabelled(joined: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: their ends are first replaced by the components they are in, which leaves few."""
    for end in ("a", "b"):
        named = joined.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        links = links.join(named, F.col(end) == F.col("n2"), "left").withColumn(end, F.coalesce("c2", end)).select("a", "b")
    tops = components(links.filter("a != b"))
    if not tops.limit(1).count():
        return joined
    tops = tops.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
    moved = joined.join(tops, F.col("component") == F.col("n2"), "left").select("node", F.coalesce("c2", "component").alias("component"))
    # a component's own name may have no row in ``joined``
    return stage(moved.unionByName(tops.select(F.col("n2").alias("node"), F.col("c2").alias("component"))).groupBy("node").agg(F.min("component").alias("component")), "joined")


def _block_pairs(buckets: DataFrame, joined: DataFrame, nodes: DataFrame, weight: Column) -> DataFrame:
    """Rows of two blocks of classes: (askers, others), arrays of structs of ``nodes``' columns and ``c``.

    Buckets with several components are gathered by their largest component into families. The classes of a family
    outside that component are its askers, a stated query set; they meet all classes of the family in blocks.
    """
    names = joined.select(F.col("node").alias("n2"), "component")
    tagged = stage(buckets.join(names, F.col("key") == F.col("n2"), "left").select("band", "key", "size", F.coalesce("component", "key").alias("c")), "tagged")
    sizes = tagged.groupBy("band", "c").agg(F.count("*").alias("k"), F.max("size").alias("size")).groupBy("band").agg(F.count("*").alias("kinds"), F.max(F.struct("k", "c")).alias("main"), F.max("size").alias("parts"))
    sizes = sizes.filter("kinds > 1").select(F.col("band").alias("open"), F.col("main.c").alias("family"), "parts")
    rest = _dealt(tagged, sizes, "band", "open", "size", "parts").select("family", "key", "c").distinct()
    own = F.struct(*[F.col(c) for c in nodes.columns], "c").alias("x")
    told = stage(rest.join(nodes, "key").select("family", "key", "c", weight.alias("w"), own), "families")
    asks = F.col("c") != F.col("family")
    size = told.groupBy("family").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.count_if(asks).alias("asks"), F.sum(F.when(asks, F.col("w"))).alias("aw")).filter("asks > 0")
    blocks = lambda n, w: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(w) / BLOCK_BYTES)).cast("int")
    size = stage(size.select("family", "n", blocks("n", "w").alias("nb"), blocks("asks", "aw").alias("sb")), "family-sizes")
    # every family is dealt alike, as its rows do not know its size
    spread = size.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(15))))
    told = told.withColumn("s", F.pmod(F.xxhash64("key"), F.lit(16)).cast("int")).join(spread, ["family", "s"])
    block = lambda df, n: df.select("family", F.pmod(F.xxhash64("key"), F.col(n)).cast("int").alias("i"), "x").groupBy("family", "i").agg(F.collect_list("x").alias("xs"))
    askers, others = block(told.filter("c != family"), "sb"), block(told, "nb")
    pairs = size.select("family", "nb", F.explode(F.sequence(F.lit(0), F.col("sb") - 1)).alias("i")).select("family", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
    first = pairs.join(askers.withColumnRenamed("xs", "askers"), ["family", "i"])
    return first.join(others.select("family", F.col("i").alias("j"), F.col("xs").alias("others")), ["family", "j"]).select("askers", "others")


def bucket_components(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], nodes: DataFrame, compare: Callable[[DataFrame], DataFrame], weight: Column) -> DataFrame:
    """(node, component) of classes with links; others are their own components. ``buckets`` are distinct_buckets; ``weight``: bytes of a row of ``nodes``.

    ``compare`` takes rows of two blocks and returns links (a, b) between classes of different components, one
    link at least wherever the blocks' links join two components.
    """
    pairs = stage(_first_pairs(buckets), "first-pairs")
    links = stage(verify(pairs.select("a", "b")), "first-links")
    parents = links.join(pairs, ["a", "b"]).groupBy("a").agg(F.max(F.struct("rank", "b")).alias("y")).select("a", "y.b")
    joined = _roots(parents)
    more = compare(_block_pairs(buckets, joined, nodes, weight))
    return _relabelled(joined, stage(links.unionByName(more), "all-links"))


def least_of_components(joined: DataFrame, values: DataFrame) -> DataFrame:
    """(node, least): the smallest ``value`` of values (node, value) in each linked node's component.

    ``joined`` is what bucket_components gives. Nodes of one component are dealt to 16 tasks, so that a giant one does not go to one.
    """
    # the node that names a component has no row of its own
    members = joined.unionByName(joined.select(F.col("component").alias("node"), "component").distinct()).groupBy("node").agg(F.min("component").alias("component"))
    members = stage(members.join(values, "node").withColumn("s", F.pmod(F.xxhash64("node"), F.lit(16)).cast("int")), "members")
    least = members.groupBy("component", "s").agg(F.min("value").alias("least")).groupBy("component").agg(F.min("least").alias("least"))
    return members.join(least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["component", "s"]).select("node", "least")


def spanning(a: list, b: list, component_of: dict, confirmed: Callable[[int], bool], order: Iterable[int], root: dict | None = None) -> list[int]:
    """Positions of confirmed pairs that join two components, those already joined within this task being passed over. ``root`` remembers them from call to call."""
    root = {} if root is None else root
    for c in component_of.values():
        root.setdefault(c, c)

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for i in order:
        x, y = find(component_of[a[i]]), find(component_of[b[i]])
        if x != y and confirmed(i):
            root[x] = y
            out.append(i)
    return out
