import random
from collections import defaultdict

import numpy as np

from lodeseek.llm.buckets import distinct_buckets, shared_buckets


def want(rows):
    held = defaultdict(set)
    for key, bands in rows:
        for band in bands or ():
            held[band].add(key)
    return sorted((band, key, len(keys)) for band, keys in held.items() if len(keys) > 1 for key in keys)


def test_shared_buckets_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(-400, 400), rng.choice([None, [], [rng.randrange(-300, 300) << 40 for _ in range(4)]])) for _ in range(1500)]
    # one band is hot: it holds more rows than one task of a join is dealt
    rows += [(k, [7, -k]) for k in range(1000, 6500)]
    rows += rows[:200]
    for kind, key in (("long", lambda k: k), ("binary", lambda k: bytes(8) + (k + 1000).to_bytes(8, "big"))):
        own = [(key(k), bands) for k, bands in rows]
        got = shared_buckets(spark.createDataFrame(own, f"key {kind}, bands array<long>").repartition(3))
        assert sorted((r.band, bytes(r.key) if kind == "binary" else r.key, r.size) for r in got.collect()) == want(own)
        assert shared_buckets(spark.createDataFrame([], f"key {kind}, bands array<long>")).count() == 0


def test_bands_as_bytes(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(-400, 400), rng.choice([None, [rng.randrange(-300, 300) << 40 for _ in range(4)]])) for _ in range(1500)]
    rows += [(k, [7, -k]) for k in range(1000, 6500)]
    packed = [(key, None if bands is None else np.array(bands, np.int64).tobytes()) for key, bands in rows]
    got = shared_buckets(spark.createDataFrame(packed, "key long, bands binary").repartition(3))
    assert sorted(map(tuple, got.collect())) == want(rows)


def test_buckets_of_equal_sets_come_once(spark):
    rng = random.Random(5)
    rows = []
    for group in range(300):  # keys of a group share four bands, some of them one more
        for _ in range(rng.randrange(1, 5)):
            rows.append((rng.randrange(1 << 40), [group * 10 + k for k in range(5 if rng.random() < 0.5 else 4)]))
    rows += [(k, [-7, -k]) for k in range(1000, 6500)] + rows[:50]
    held = defaultdict(set)
    for band, key, _ in want(rows):
        held[band].add(key)
    sets = defaultdict(list)
    for band, keys in held.items():
        sets[frozenset(keys)].append(band)
    wanted = sorted((min(bands), key, len(keys), len(bands)) for keys, bands in sets.items() for key in keys)
    for kind, name in (("long", lambda k: k), ("binary", lambda k: bytes(8) + k.to_bytes(8, "big"))):
        got = distinct_buckets(spark.createDataFrame([(name(k), bands) for k, bands in rows], f"key {kind}, bands array<long>").repartition(3)).collect()
        assert sorted((r.band, int.from_bytes(r.key, "big") if kind == "binary" else r.key, r.size, r.times) for r in got) == wanted
        assert len(got) < len(want(rows))
    assert distinct_buckets(spark.createDataFrame([], "key long, bands array<long>")).count() == 0
