"""N-gram Jaccard join (operator 3): token-combination prefixes.

A document is the set of its distinct 5-word shingles (A-Z lower-cased); two
documents link when ``100 * common >= 80 * union``.  The join is exact and in
five steps.

1. Equal sets are one class; only classes are joined.  A class is known by its
   128-bit key and has a number of its own, whatever ids its rows have.
2. Prefixes: under one order of all shingles, rarest first, a set of ``n``
   keeps the first ``n / 5 + k`` shingles (``n / 5`` rounded down; the extension ``k`` grows with ``n``).  Linked
   sets share at least ``k`` of their prefix shingles.  The order is by hash,
   with the most frequent shingles of a sample of documents (a list of at most
   ``HOT_SHINGLES``) last; any order gives the same links.
3. Shingles in the prefix of one class only are dropped, and with them the
   classes that keep too few.
4. Shingles of at most ``RARE`` classes are indexed singly: classes that share
   enough of them are a candidate pair.  Frequent shingles are indexed by
   combinations of two: they fall into ``k - 1`` sub-classes by hash, so ``k``
   shared ones put two into one sub-class.  Classes connected by combinations
   form a cluster.
5. Verification on the whole sets: candidate pairs one by one; clusters in
   blocks of ``BLOCK`` classes, by products of their shingle matrices.  Every
   block also holds the cluster's first class.  Classes that end up connected
   to it need no comparison with each other.  A rest of up to ``BLOCK`` classes
   is compared with all blocks.  A larger rest (texts of one template that share
   much, but too little to link) is first split: with the rarest shingles of
   these classes in front, and by fine levels of size, the prefixes that linked
   sets must share are much shorter, and only classes connected by them are
   compared.  Blocks return only links that connect (a spanning forest), never
   all pairs.

The components of the links (between numbers of classes) come from distributed
label propagation; each is named by the smallest known ``doc_id`` of its classes.

Special cases: null and blank texts have no shingles and link with nothing;
with 1 to 4 words the whole sequence is the only shingle; sets under four
shingles link only with equal sets; null ``doc_id`` counts as larger than all
others and is a null component where no id is known; repeated rows are copies;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recentlake.llm.common import HashIndex, discard, mix64, run_hashes, runs, saved, text_blocks, windows
from recentlake.llm.components import components

SHINGLE = 5
#: Linked at this percentage of the union, and more.
PERCENT = 80
HOT_SHINGLES = 65_536
HOT_SAMPLE = 32
HOT_LEAST = 3
RARE = 32
BLOCK = 400
LAST_ID = (1 << 63) - 1
#: Sets smaller than this link with equal sets only.
LEAST = 4
#: Text bytes whose shingles a worker hashes at once: a word takes some
#: hundred bytes of arrays, which a worker keeps between its tasks.
HASHED_BYTES = 1 << 19


def _bands(most: int = 1 << 40) -> np.ndarray:
    """First sizes of the size bands: linked sets are in one or in adjacent ones."""
    limits = [1]
    while limits[-1] < most:
        limits.append(limits[-1] * 5 // 4 + 1)
    return np.array(limits)


BANDS = _bands()
#: Sub-classes of frequent shingles when the larger set is of a band.
SUBCLASSES = np.maximum(2, BANDS // 40)


def band_of(sizes) -> np.ndarray:
    return np.searchsorted(BANDS, sizes, side="right") - 1


def prefix_length(n: int) -> int:
    """``n / 5`` shingles may be missing in a linked set; the rest extends."""
    return min(n, n - -(-n * PERCENT // 100) + int(SUBCLASSES[band_of(n) + 1]) + 1)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block."""
    starts, ends, firsts = runs(data, offs)
    words = run_hashes(data, starts, ends, lower=True)
    hashes, _ = windows(words, firsts, SHINGLE)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(hashes[a:b - SHINGLE + 1]))
        elif b > a:
            whole, _ = windows(words[a:b], np.array([0, b - a]), b - a)
            out.append(mix64(whole[:1] + np.uint64(b - a)))
        else:
            out.append(hashes[:0])
    return out


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set, as two signed longs."""
    if not len(shingles):
        return 0, 0
    a = mix64(shingles ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    b = mix64(shingles ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def hot_shingles(docs: DataFrame) -> np.ndarray:
    """The most frequent shingles in a sample of the documents, rarest first."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0).select(F.col("text").cast("string").alias("text"))

    def emit(batches):
        for batch in batches:
            for _, _, data, offs in text_blocks(batch.column("text"), HASHED_BYTES):
                found = shingle_sets(data, offs)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["shingle"])

    counts = sample.mapInArrow(emit, "shingle bigint").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "shingle").limit(HOT_SHINGLES)
    rows = top.collect()  # at most HOT_SHINGLES hashes
    return np.array([r["shingle"] for r in rows[::-1]], np.int64).view(np.uint64)


# -- prefixes ------------------------------------------------------------------------


def prefixes(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """``doc_id, tag, n, k1, k2, prefix`` of every row; ``tag`` tells rows of
    one ``doc_id`` apart by their text."""
    picked = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.xxhash64("text").alias("tag"),
                         F.col("text").cast("string").alias("text"))

    def run(batches):
        order = np.argsort(hot)
        index = HashIndex(hot[order])
        for batch in batches:
            n, k1, k2, prefix = [], [], [], []
            for _, _, data, offs in text_blocks(batch.column("text"), HASHED_BYTES):
                for own in shingle_sets(data, offs):
                    a, b = set_key(own)
                    n.append(len(own))
                    k1.append(a)
                    k2.append(b)
                    if len(own) < LEAST:
                        prefix.append(own[:0])
                        continue
                    at = index.find(own)
                    late = at >= 0
                    if late.any():
                        own = np.concatenate([own[~late], hot[np.sort(order[at[late]])]])
                    prefix.append(own[:prefix_length(len(own))])
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *prefix]).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("tag"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], ["doc_id", "tag", "n", "k1", "k2", "prefix"])

    return picked.mapInArrow(run, "doc_id bigint, tag bigint, n bigint, k1 bigint, k2 bigint, prefix array<bigint>")


def _by_band(values: np.ndarray, band):
    """The value of a band, by a column of bands."""
    return F.element_at(F.array(*(F.lit(int(v)) for v in values[:80])), (band + 1).cast("int")).cast("long")


def _band(n):
    """Band of a size column: bands up to a size of 2^30."""
    return F.size(F.filter(F.array(*(F.lit(int(v)).cast("long") for v in BANDS[:80])), lambda v: v <= n)) - 1


def shared_shingles(found: DataFrame, paths: list[str]) -> DataFrame:
    """``shingle, key, n, band, df``: prefix shingles of two classes and more,
    of the classes that keep enough of them to be linked."""
    # Copies first become one row of their class, map-side where they can: a
    # row is two longs, and a class has each shingle once.  Then one exchange
    # counts and chooses: even a shingle of a third of all classes is a small
    # part of the rows; a window reads it as a stream and spills.
    rows = found.where(F.size("prefix") > 0).select(F.explode("prefix").alias("shingle"), F.col("k1").alias("key")).distinct()
    of = Window.partitionBy("shingle")
    several = F.min("key").over(of) != F.max("key").over(of)
    kept = saved(rows.select("shingle", "key", several.alias("__several")).where("__several").select("shingle", "key"), "shared", paths)
    sizes = found.where(F.size("prefix") > 0).select(F.col("k1").alias("key"), "n").distinct()
    enough = kept.groupBy("key").agg(F.count(F.lit(1)).alias("__count")).join(sizes, "key")
    enough = enough.withColumn("band", _band(F.col("n"))).where(F.col("__count") > _by_band(SUBCLASSES, F.col("band"))).select("key", "n", "band")
    kept = kept.join(enough, "key")
    df = kept.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return saved(kept.join(df, "shingle"), "candidates", paths)


# -- candidates ----------------------------------------------------------------------


def rare_pairs(shared: DataFrame) -> DataFrame:
    """``a, b``: pairs of classes that share enough rare shingles, counting
    all frequent ones of the class with fewer as shared."""
    frequent = shared.where(F.col("df") > RARE).groupBy("key").agg(F.count(F.lit(1)).alias("__f"))
    rare = shared.where(F.col("df") <= RARE).select("shingle", "key", "n")
    left, right = rare.toDF("shingle", "a", "na"), rare.toDF("shingle", "b", "nb")
    pairs = left.join(right, "shingle").where("a < b and 5 * na >= 4 * nb and 5 * nb >= 4 * na") \
        .groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("__common"))
    least = _by_band(SUBCLASSES, _band(F.greatest("na", "nb"))) + 1
    pairs = pairs.withColumn("__short", least - F.col("__common"))
    sure = pairs.where("__short <= 0").select("a", "b")
    open_ = pairs.where("__short > 0") \
        .join(frequent.select(F.col("key").alias("a"), F.col("__f").alias("__fa")), "a") \
        .join(frequent.select(F.col("key").alias("b"), F.col("__f").alias("__fb")), "b") \
        .where(F.least("__fa", "__fb") >= F.col("__short")).select("a", "b")
    return sure.unionByName(open_)


def combinations(shared: DataFrame) -> DataFrame:
    """``combination, key``: pairs of frequent shingles of one sub-class, for
    the two bands in which a class may be the smaller or the larger set."""
    lists = shared.where(F.col("df") > RARE).groupBy("key", "band").agg(F.collect_list("shingle").alias("shingles"))

    def combine(batches):
        for batch in batches:
            keys, out = [], []
            for key, band, own in zip(*(batch.column(c).to_pylist() for c in ("key", "band", "shingles")), strict=True):
                own = np.sort(np.array(own, np.int64).view(np.uint64))
                for level in (band, band + 1):
                    part = mix64(own) % np.uint64(SUBCLASSES[level])
                    for p in np.unique(part):
                        some = own[part == p]
                        i, j = np.triu_indices(len(some), 1)
                        if len(i):
                            out.append(mix64(mix64(some[i] + np.uint64(level)) + some[j]))
                            keys.append(np.full(len(i), key, np.int64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(keys))], ["combination", "key"])

    return lists.mapInArrow(combine, "combination bigint, key bigint")


def clusters(shared: DataFrame, paths: list[str]) -> DataFrame:
    """``node, component``: classes connected by shared combinations."""
    index = saved(combinations(shared), "combinations", paths)
    first = index.groupBy("combination").agg(F.min("key").alias("a"))
    return components(index.join(first, "combination").where("a <> key").select("a", F.col("key").alias("b")).distinct())


# -- verification --------------------------------------------------------------------


def numbered_classes(found: DataFrame, paths: list[str]) -> DataFrame:
    """``k1, k2, id, tag, rep`` of every class: its smallest ``doc_id``, the
    tag of a row with that id, and a number that no other class has."""
    classes = found.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.min_by("tag", "doc_id").alias("tag"))
    # Written, so that a number stays the same wherever it is read.
    return saved(classes.withColumn("rep", F.monotonically_increasing_id()), "classes", paths)


def whole_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """``key, rep, shingles`` (hashes as bytes) of the classes in ``reps``
    (key, k2, id, tag, rep)."""
    wanted = reps.select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), F.col("rep").alias("__rep"),
                         F.col("key").alias("__key"), F.col("k2").alias("__k2"))
    # Each class is one narrow row, so a partition of them is a small table in
    # memory, which the texts pass in a stream: no sort holds them.
    picked = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("__id"), F.xxhash64("text").alias("__tag"),
                         F.col("text").cast("string").alias("text")) \
        .join(wanted.hint("shuffle_hash"), ["__id", "__tag"]).select("__key", "__k2", "__rep", "text")

    def run(batches):
        seen = set()
        for batch in batches:
            keys, seconds, reps_ = (batch.column(c).to_pylist() for c in ("__key", "__k2", "__rep"))
            found = [s for _, _, data, offs in text_blocks(batch.column("text"), HASHED_BYTES) for s in shingle_sets(data, offs)]
            # Repeated rows of a class are read once in a task; those of other
            # tasks change no link.
            own = []
            for k, s in enumerate(found):
                if reps_[k] not in seen and set_key(s) == (keys[k], seconds[k]):
                    own.append(k)
                    seen.add(reps_[k])
            yield pa.RecordBatch.from_arrays([
                pa.array([keys[k] for k in own], pa.int64()), pa.array([reps_[k] for k in own], pa.int64()),
                pa.array([found[k].tobytes() for k in own], pa.binary())], ["key", "rep", "shingles"])

    return picked.mapInArrow(run, "key bigint, rep bigint, shingles binary")


def _linked(common, na, nb):
    return 100 * common >= PERCENT * (na + nb - common)


def verified_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links ``a, b`` (numbers of classes) among candidate pairs of keys."""
    left = sets.select(F.col("key").alias("a"), F.col("rep").alias("ra"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("rep").alias("rb"), F.col("shingles").alias("sb"))

    def run(batches):
        for batch in batches:
            a, b = [], []
            for ra, rb, x, y in zip(*(batch.column(c).to_pylist() for c in ("ra", "rb", "sa", "sb")), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if _linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                    a.append(ra)
                    b.append(rb)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("ra", "rb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def block_links(rows: pd.DataFrame) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between the rows marked ``open`` and
    all rows: ``rep, shingles, open``."""
    rows = rows.sort_values("rep").drop_duplicates("rep")
    reps, open_ = rows["rep"].to_numpy(np.int64), rows["open"].to_numpy(bool)
    sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    token = np.cumsum(np.concatenate([[0], flat[1:] != flat[:-1]])) if len(flat) else flat.astype(np.int64)
    several = np.bincount(token)[token] > 1
    token, owner = token[several], owner[several]
    left = np.flatnonzero(open_)
    common = np.zeros((len(left), len(sets)), np.float32)
    step = 4096
    cuts = np.searchsorted(token, np.arange(0, (token[-1] if len(token) else -1) + step + 1, step))
    for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if hi > lo:
            matrix = np.zeros((len(sets), step), np.float32)
            matrix[owner[lo:hi], token[lo:hi] - k * step] = 1
            used = matrix[:, matrix.any(0)]
            common += used[left] @ used.T
    link = _linked(common.astype(np.int64), sizes[left][:, None], sizes[None])
    link[np.arange(len(left)), left] = False
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    for i, j in np.argwhere(link).tolist():
        x, y = find(left[i]), find(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            a.append(int(reps[left[i]]))
            b.append(int(reps[j]))
    return a, b


def _forest(key, rows: pd.DataFrame) -> pd.DataFrame:
    a, b = block_links(rows)
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def verified_clusters(members: DataFrame, sets: DataFrame, paths: list[str]) -> DataFrame:
    """Links that connect the classes of each cluster; ``members``: node
    (key), component (cluster)."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("__g"))
    rows = members.join(sizes, "component").join(sets, members["node"] == sets["key"]).select(
        F.col("component").alias("cluster"), "key", "rep", "shingles",
        F.ceil(F.col("__g") / F.lit(BLOCK)).cast("long").alias("blocks"),
        F.pmod(F.xxhash64("key"), F.ceil(F.col("__g") / F.lit(BLOCK)).cast("long")).alias("block"))
    rows = saved(rows, "clusters", paths)
    # The class whose key names the cluster stands in every block of it.
    every = rows.where("key = cluster and blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    first = saved(rows.unionByName(every).withColumn("open", F.lit(True)).groupBy("cluster", "block").applyInPandas(_forest, "a bigint, b bigint"), "links")
    large = rows.where("blocks > 1")
    if not large.limit(1).count():
        return first
    reached = components(first).select(F.col("node").alias("rep"), F.col("component").alias("__c"))
    placed = large.join(reached, "rep", "left")
    head = placed.where("key = cluster").select("cluster", F.coalesce("__c", "rep").alias("__head")).dropDuplicates(["cluster"])
    placed = placed.join(head, "cluster").withColumn("open", F.coalesce("__c", "rep") != F.col("__head")).drop("__c", "__head")
    open_ = placed.where("open")
    counts = open_.groupBy("cluster").agg(F.count(F.lit(1)).alias("__open"))
    placed = saved(placed.join(counts, "cluster"), "placed", paths)
    # A rest of one block meets every block of its cluster.
    few = placed.where(F.col("__open") <= BLOCK)
    met = _meetings(few, paths)
    many = placed.where(F.col("__open") > BLOCK)
    if many.limit(1).count():
        # A larger rest is first split by sharper prefixes.
        parts = close_parts(many, paths)
        sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("__p"))
        closer = many.drop("blocks", "block", "__open").join(parts.join(sizes, "part"), "rep").where("__p > 1").select(
            F.col("part").alias("cluster"), "key", "rep", "shingles", "open",
            F.ceil(F.col("__p") / F.lit(BLOCK)).cast("long").alias("blocks"),
            F.pmod(F.xxhash64("key"), F.ceil(F.col("__p") / F.lit(BLOCK)).cast("long")).alias("block"))
        rest = closer.where("open").groupBy("cluster").agg(F.count(F.lit(1)).alias("__open"))
        met = met.unionByName(_meetings(closer.join(rest, "cluster"), paths))
    return first.unionByName(met.groupBy("cluster", "side", "block").applyInPandas(_rest, "a bigint, b bigint"))


def _meetings(placed: DataFrame, paths: list[str]) -> DataFrame:
    """Every block of the open rows of a cluster beside every block of it."""
    sides = F.ceil(F.col("__open") / F.lit(BLOCK)).cast("long")
    left = placed.where("open").withColumn("side", F.pmod(F.xxhash64("key"), sides)) \
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    right = placed.withColumn("open", F.lit(False)).withColumn("side", F.explode(F.sequence(F.lit(0).cast("long"), sides - 1)))
    columns = ["cluster", "side", "block", "rep", "shingles", "open"]
    return left.select(*columns).unionByName(right.select(*columns))


def _levels() -> np.ndarray:
    """First sizes of the fine levels."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * FINE)))
    return np.array(out)


FINE = 1.05
LEVELS = _levels()


def close_prefixes(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and roles of a set's prefixes for each pair of fine levels that it
    may link in; ``own`` has its shingles, rarest first.

    A link of sets of sizes n and m has ``common >= 4 / 9 (n + m)``, so each
    misses few of its shingles, and fewer the closer their sizes are: two
    linked sets share one of their first ``n - common + 1``.  Role 0 is the
    smaller level's, role 1 the larger's, 2 stands for both."""
    n = len(own)
    level = int(np.searchsorted(LEVELS, n, side="right")) - 1
    low = int(np.searchsorted(LEVELS, -(-n * PERCENT // 100), side="right")) - 1
    high = int(np.searchsorted(LEVELS, n * 100 // PERCENT, side="right")) - 1
    keys, roles = [], []
    for other in range(low, high + 1):
        least = max(int(LEVELS[other]), -(-n * PERCENT // 100))
        common = -(-PERCENT * (n + least) // (100 + PERCENT))
        size = n - min(common, n) + 1
        pair = np.uint64(min(level, other) << 20 | max(level, other))
        keys.append(mix64(own[:size] ^ mix64(np.full(1, pair, np.uint64))))
        roles.append(np.full(min(size, n), 2 if other == level else int(level > other)))
    return np.concatenate(keys), np.concatenate(roles)


def close_parts(rows: DataFrame, paths: list[str]) -> DataFrame:
    """``rep, part``: rows of large clusters that may be linked, by prefixes
    for the exact sizes and with the rarest shingles of these rows first."""

    def tokens(batches):
        for batch in batches:
            sets = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("rep")), [len(x) for x in sets])),
                                                  pa.array(np.concatenate(sets))], ["rep", "shingle"])

    spread_ = saved(rows.select("rep", "shingles").mapInArrow(tokens, "rep bigint, shingle bigint"), "tokens", paths)
    df = spread_.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    # a set is as long as its text
    ordered = spread_.join(df, "shingle").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("t")) \
        .select("rep", F.col("t.shingle").alias("own"))

    def emit(batches):
        for batch in batches:
            out = []
            for rep, own in zip(batch.column("rep").to_pylist(), batch.column("own"), strict=True):
                keys, roles = close_prefixes(np.asarray(own.values).view(np.uint64))
                out.append((np.full(len(keys), rep, np.int64), keys.view(np.int64), roles))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], ["rep", "near", "role"])

    index = saved(ordered.mapInArrow(emit, "rep bigint, near bigint, role bigint"), "near", paths)
    ends = index.groupBy("near").agg(F.min(F.when(F.col("role") != 1, F.col("rep"))).alias("__small"),
                                     F.min(F.when(F.col("role") != 0, F.col("rep"))).alias("__large"))
    # the smaller sets of a key join its first larger one, and the other way round
    joined_ = index.join(ends, "near")
    to = F.array(F.when(F.col("role") != 1, F.col("__large")), F.when(F.col("role") != 0, F.col("__small")))
    links = joined_.select(F.col("rep").alias("a"), F.explode(to).alias("b")).where("b is not null and a <> b").distinct()
    return components(links).select(F.col("node").alias("rep"), F.col("component").alias("part"))


def _rest(key, rows: pd.DataFrame) -> pd.DataFrame:
    return _forest(key, rows.sort_values("open", ascending=False).drop_duplicates("rep"))


# -- the join ------------------------------------------------------------------------


def joined(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, tag`` of every row.

    The narrow result is written; the tables on the way to it are deleted."""
    paths: list[str] = []
    found = saved(prefixes(docs, hot_shingles(docs)), "prefixes", paths)
    classes = numbered_classes(found, paths)
    shared = shared_shingles(found, paths)
    pairs = saved(rare_pairs(shared), "pairs", paths)
    members = clusters(shared, paths)
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))) \
        .unionByName(members.select(F.col("node").alias("key"))).distinct()
    reps = classes.withColumnRenamed("k1", "key").join(keys, "key", "left_semi")
    sets = saved(whole_sets(docs, reps), "sets", paths)
    links = verified_pairs(pairs, sets).unionByName(verified_clusters(members, sets, paths))
    reached = components(links).select(F.col("node").alias("rep"), F.col("component").alias("__c"))
    named = classes.select("rep", "id").join(reached, "rep").groupBy("__c").agg(F.min("id").alias("__component"))
    placed = classes.join(reached.join(named, "__c"), "rep", "left").select(
        F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.coalesce("__component", "id").alias("__component"))
    rows = found.join(placed, (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2")) & (F.col("n") > 0), "left")
    known = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    result = rows.select(known("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"),
                       F.coalesce(known("__component"), known("doc_id")).alias("component_id"), "tag")
    result = saved(result, "components")
    discard(docs.sparkSession, paths)
    return result


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: those whose ``doc_id`` names it; of equal
    rows of one ``doc_id`` the first.  Rows without an id stay unless they
    link with a row that has one."""
    on = ["__id", "__key"]
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("__id"), F.xxhash64("text").alias("__key")]
    stay = joined(docs).where("component_id is null or component_id = doc_id") \
        .select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("__id"), F.col("tag").alias("__key")).groupBy(*on).agg(F.count(F.lit(1)).alias("__rows"))
    rows = docs.select("*", *key)
    # The texts pass the keys in a stream; only those of repeated rows are sorted.
    kept = rows.join(stay.where("__rows = 1").hint("shuffle_hash"), on, "left_semi")
    repeated = stay.where("__rows > 1")
    if repeated.limit(1).count():
        kept = kept.unionByName(rows.join(repeated, on, "left_semi").dropDuplicates(on))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
