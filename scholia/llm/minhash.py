"""MinHash near-dedup on bottom-k sketches from one hash function.

1. Every document's set of word shingles is hashed once; the k smallest values are its sketch, and the whole set's
   128-bit digest collapses documents with equal sets into one class.
2. Inverted lists of retained values generate candidates. Two sets of the wanted similarity share at least
   ``overlap`` of their smallest values (up to a binomial tail, see ``required_overlap``), so each class enters only the lists of its
   rarest values, all but ``overlap`` - 1 of them: a passage that many documents share indexes few but near copies of the passage.
3. The estimate over the union's sketch filters. In short lists all pairs are estimated. In a long list every member is estimated against one of
   them, the anchor; those that fail (the rest) meet all members in blocks inside tasks, which return the spanning forest of what passes. So nothing is a
   candidate that the estimate doesn't pass, and a list of near copies costs its length.
4. Pairs that pass make candidate groups. A group of up to a block is compared all against all, exactly, on whole sets. In a larger one all members
   are compared with a few pivots; those linked to the pivots are one component already, and only the others meet all members, block by block. Tasks
   return forests of links, never pairs.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_side, stored, trimmed
from .graph import connected_components, unite

#: Classes in one block of a candidate group, and values of all its sets on average; a task holds two blocks at a time.
BLOCK, BLOCK_VALUES = 512, 1 << 20
#: Inverted lists up to this long make all pairs; longer ones make pairs with their anchor.
SHORT_LIST = 16
#: Sketches in one block of a long list's rest.
SKETCH_BLOCK = 1024
#: Pivots of a group of more than a block.
PIVOTS = 8


def required_overlap(k: int, similarity: float, miss: float = 1e-8) -> int:
    """Largest number of shared values that two bottom-k sketches of sets of this similarity fall short of with
    probability below ``miss``: the k smallest values of the union lie in both sets with that similarity each."""
    below = 0.0
    for shared in range(k + 1):
        below += math.comb(k, shared) * similarity**shared * (1 - similarity) ** (k - shared)
        if below > miss:
            return max(1, shared)
    return k


def shingle_hashes(text: str | bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles: A-Z lower-cased, split at \\x20 and \\x09-\\x0D.

    A text of fewer words is one shingle; no text or no words give an empty set.
    """
    if not text:
        return np.empty(0, np.uint64)
    tokens = (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    width = min(words, len(each))
    mixed = np.full(len(each) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ each[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


_SLICE = 512  # rows that are turned into Python objects at a time


def _sliced(batches):
    """(doc ids, texts as UTF-8 bytes) of slices of Arrow batches: texts are never all Python objects at once."""
    for batch in batches:
        for low in range(0, batch.num_rows, _SLICE):
            part = batch.slice(low, _SLICE)
            yield part.column("doc_id"), (x.as_py() for x in part.column("text").cast(pa.binary()))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


@trimmed
def _sketches(batches, words: int, k: int):
    for ids, texts in _sliced(batches):
        sizes, first, second, kept = [], [], [], []
        for text in texts:
            whole = shingle_hashes(text, words)
            spread = (whole ^ (whole >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            sizes.append(len(whole))
            first.append(int(whole.sum().astype(np.int64)))
            second.append(int(np.bitwise_xor.reduce(spread).astype(np.int64)))
            # with the top bit turned, signed values have the order of the hashes, which the union sketch is cut by
            kept.append((whole[:k] ^ np.uint64(1 << 63)).view(np.int64))
        columns = [ids, pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), _lists(kept)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest_a", "digest_b", "sketch"])


@trimmed
def _whole_sets(batches, words: int):
    for ids, texts in _sliced(batches):
        sets = [np.sort(shingle_hashes(text, words).view(np.int64)) for text in texts]
        yield pa.RecordBatch.from_arrays([ids, _lists(sets)], ["rep", "values"])


def _repeated(values: np.ndarray) -> np.ndarray:
    """Distinct entries that occur more than once."""
    values = np.sort(values)
    again = values[1:][values[1:] == values[:-1]]
    return again[np.concatenate([[True], again[1:] != again[:-1]])] if len(again) else again


def _shared(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections of left sets with right ones (or with each other), by a product of 0/1 matrices over the values that two sets can share."""
    if right is None:
        both = _repeated(np.concatenate(left))
    else:
        both = _repeated(np.concatenate([np.unique(np.concatenate(left)), np.unique(np.concatenate(right))]))
    out = np.zeros((len(left), len(left if right is None else right)), np.float32)
    for low in range(0, len(both), 4096):
        part = both[low : low + 4096]
        matrices = []
        for side in (left,) if right is None else (left, right):
            m = np.zeros((len(side), len(part)), np.float32)
            for i, values in enumerate(side):
                inside = values[np.searchsorted(values, part[0]) : np.searchsorted(values, part[-1], "right")]
                at = np.searchsorted(part, inside)
                m[i, at[part[np.minimum(at, len(part) - 1)] == inside]] = 1
            matrices.append(m)
        out += matrices[0] @ matrices[-1].T
    return out


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Spanning forest of links between positions a[i] and b[i] of ``ids``; positions of one id are one node."""
    names, at = np.unique(ids, return_inverse=True)
    labels = unite(np.arange(len(names)), at[a], at[b])
    moved = np.flatnonzero(labels != np.arange(len(names)))
    return pd.DataFrame({"u": names[moved], "v": names[labels[moved]], "main": False})


def _sides(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Positions of the left (side 0) and right (side 1) rows of a block pair, values and sizes of all; side 2 is both."""
    side = rows["side"].to_numpy()
    return np.flatnonzero(side != 1), np.flatnonzero(side != 0), list(rows["values"]), rows["n_shingles"].to_numpy(np.int64)


def _overlaps(first: np.ndarray, second: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    if not len(first) or not len(second):
        return np.zeros((len(first), len(second)), np.int64)
    same = len(first) == len(second) and (first == second).all()
    return _shared([sets[i] for i in first], None if same else [sets[i] for i in second]).astype(np.int64)


def _similar(shared: np.ndarray, n_first: np.ndarray, n_second: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (n_first[:, None] + n_second[None, :] - shared)


def _exact_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of one pair of blocks of whole sets (or of one block with itself). Two blocks of which one is empty have no links."""
    first, second, sets, n = _sides(rows)
    ids = rows["rep"].to_numpy(np.int64)
    if len(ids) == 2 and len(first) == len(second) == 2:
        inside = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        linked = np.arange(int(100 * inside >= percent * (n[0] + n[1] - inside)))
        return _forest(ids, linked, linked + 1)
    x, y = np.nonzero(_similar(_overlaps(first, second, sets), n[first], n[second], percent))
    return _forest(ids, first[x], second[y])


def _pivot_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of a group's pivots (side 0) with a chunk of its members. Rows with ``main`` name the members linked to the largest component of pivots."""
    rows = rows.sort_values(["side", "rep", "n_shingles"], kind="stable", ignore_index=True)
    first, second, sets, n = _sides(rows)
    ids = rows["rep"].to_numpy(np.int64)
    p, q = np.nonzero(_similar(_overlaps(first, first, sets), n[first], n[first], percent))
    labels = unite(np.arange(len(first)), p, q)
    main = labels == np.bincount(labels).argmax()  # the same in every chunk: pivots and their order are
    linked = _similar(_overlaps(first, second, sets), n[first], n[second], percent)
    x, y = np.nonzero(linked)
    held = ids[second[linked[main].any(axis=0)]]
    return pd.concat([_forest(ids, np.concatenate([first[p], first[x]]), np.concatenate([first[q], second[y]])), pd.DataFrame({"u": held, "v": held, "main": True})], ignore_index=True)


def _estimated(a: list[np.ndarray], b: list[np.ndarray], k: int, overlap: int) -> np.ndarray:
    """Whether pairs of full sketches pass: of the k smallest values of their union, ``overlap`` lie in both."""
    both = np.sort(np.concatenate([np.array(a), np.array(b)], axis=1), axis=1)
    again = both[:, 1:] == both[:, :-1]
    rank = np.arange(1, both.shape[1]) - np.cumsum(again, axis=1)  # distinct values before each entry's own
    return (again & (rank < k)).sum(axis=1) >= overlap


def _sketch_links(rows: pd.DataFrame, percent: int, k: int, overlap: int) -> pd.DataFrame:
    """Forest of the pairs of a long list's rest (side 0) and members (side 1) that pass the estimate."""
    first, second, sketches, n = _sides(rows)
    ids = rows["rep"].to_numpy(np.int64)
    names, at = np.unique(ids, return_inverse=True)
    shared = _overlaps(first, second, sketches)
    whole = n <= k
    exact = whole[first][:, None] & whole[second][None, :]  # both sketches are the sets themselves
    x, y = np.nonzero(np.where(exact, _similar(shared, n[first], n[second], percent), shared >= np.minimum(overlap, np.ceil(percent / 100 * np.minimum(n[first][:, None], n[second][None, :])))))
    sure = exact[x, y] | (np.minimum(n[first[x]], n[second[y]]) < k)
    x, y, sure = first[x], second[y], sure
    a, b = [x[sure]], [y[sure]]
    labels = unite(np.arange(len(names)), at[x[sure]], at[y[sure]])
    x, y = x[~sure], y[~sure]
    while True:  # what is connected already needs no estimate
        apart = labels[at[x]] != labels[at[y]]
        x, y = x[apart], y[apart]
        if not len(x):
            break
        u, v = x[:4096], y[:4096]
        passed = _estimated([sketches[i] for i in u], [sketches[i] for i in v], k, overlap)
        a.append(u[passed]), b.append(v[passed])
        labels = unite(labels, at[u[passed]], at[v[passed]])
        x, y = x[4096:], y[4096:]
    return _forest(ids, np.concatenate(a), np.concatenate(b))


@trimmed
def _passing(batches, percent: int, k: int, overlap: int):
    """Pairs whose sketches pass: full ones by the estimate; if both are whole sets they are compared as such."""
    for batch in batches:
        na, nb = batch["n_a"].to_numpy(np.int64), batch["n_b"].to_numpy(np.int64)
        passed = np.zeros(len(batch), bool)
        full = np.flatnonzero((na > k) & (nb > k))
        for low in range(0, len(full), 4096):
            at = full[low : low + 4096]
            passed[at] = _estimated([batch["sketch_a"].iloc[i] for i in at], [batch["sketch_b"].iloc[i] for i in at], k, overlap)
        for i in np.flatnonzero((na <= k) | (nb <= k)):
            shared = len(np.intersect1d(batch["sketch_a"].iloc[i], batch["sketch_b"].iloc[i], assume_unique=True))
            whole = na[i] <= k and nb[i] <= k
            passed[i] = 100 * shared >= percent * (na[i] + nb[i] - shared) if whole else shared >= min(overlap, math.ceil(percent / 100 * min(na[i], nb[i])))
        yield batch.loc[passed, ["a", "b"]]


@trimmed
def _compare_blocks(batches, decide):
    """Walk a task's rows, sorted by block pair, and compare each block pair once its rows are complete."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        keys = rows["pair"].to_numpy(np.int64)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        bounds = [0, *cuts.tolist()]
        for low, high in zip(bounds, bounds[1:]):
            yield decide(rows.iloc[low:high].reset_index(drop=True))
        held = rows.iloc[bounds[-1] :]
    if held is not None and len(held):
        yield decide(held.reset_index(drop=True))


def _compared(rows: DataFrame, decide) -> DataFrame:
    """(u, v, main) from rows (pair, side, rep, n_shingles, values), each pair of blocks in one place."""
    dealt = rows.select("pair", "side", "rep", "n_shingles", "values").repartition("pair").sortWithinPartitions("pair")
    return dealt.mapInPandas(partial(_compare_blocks, decide=decide), "u long, v long, main boolean")


def _dealt(chunks: str, salt: int = 0) -> F.Column:
    return F.pmod(F.xxhash64("rep", "n_shingles", F.lit(salt)), F.col(chunks)).cast("int")


def _crossed(rest: DataFrame, everyone: DataFrame, key: str) -> DataFrame:
    """Block pairs of the rest (side 0) with everyone of the same key; both have rest_chunks and chunks."""
    left = rest.withColumn("i", _dealt("rest_chunks", 1)).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("side", F.lit(0))
    right = everyone.withColumn("j", _dealt("chunks")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rest_chunks") - 1))).withColumn("side", F.lit(1))
    return left.unionByName(right).select(F.xxhash64(key, "i", "j").alias("pair"), "side", "rep", "n_shingles")


def _candidate_groups(classes: DataFrame, k: int, indexed: int, percent: int) -> DataFrame:
    """(rep, grp): classes that pass the estimate with one another. Classes that pass with nobody don't appear."""
    similarity, overlap = percent / 100, required_overlap(k, percent / 100)
    kept = f"least(n_shingles, {indexed})"
    prefix = f"cast({kept} - least({required_overlap(indexed, similarity)}, ceil({kept} * {similarity})) + 1 as int)"
    postings = classes.select("rep", "n_shingles", "digest_a", F.explode(F.slice("sketch", 1, indexed)).alias("value"))
    shared = postings.groupBy("value").count().where("count > 1")
    # only shared values can bring anybody together; values of one class alone are the rarest and come first in the order
    known = postings.join(shared, "value").groupBy("rep", "n_shingles", "digest_a").agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("by_rarity"))
    entries = cut(known.select("rep", "n_shingles", F.explode(F.expr(f"slice(by_rarity, 1, cast(greatest(0, {prefix} - ({kept} - size(by_rarity))) as int))")).alias("entry")).select("rep", "n_shingles", "entry.value"))
    lists = entries.join(entries.groupBy("value").agg(F.count("*").alias("count"), F.min("rep").alias("anchor")).where("count > 1"), "value")
    members = lists.where(F.col("count") <= SHORT_LIST).groupBy("value").agg(F.sort_array(F.collect_list(F.struct("n_shingles", "rep"))).alias("m"))
    # of a list sorted by set size, every member meets the later ones whose size allows the similarity
    pairs = members.select(F.expr("m"), F.posexplode("m").alias("at", "x")).select(F.col("x.rep").alias("a"), F.explode(F.expr(f"filter(slice(m, at + 2, {SHORT_LIST}), y -> x.n_shingles >= {similarity} * y.n_shingles)")).alias("y")).select("a", F.col("y.rep").alias("b"))
    long_lists = lists.where(F.col("count") > SHORT_LIST)
    anchored = long_lists.where("rep != anchor").select(F.col("rep").alias("a"), F.col("anchor").alias("b"))

    def side(name: str) -> DataFrame:
        return classes.select(F.col("rep").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))

    met = pairs.union(anchored).distinct().join(side("a"), "a").join(side("b"), "b")
    estimated = cut(met.mapInPandas(partial(_passing, percent=percent, k=k, overlap=overlap), "a long, b long"))

    # the rest of a long list: members that don't pass with its anchor
    rest = cut(long_lists.where("rep != anchor").join(estimated.select(F.col("a").alias("rep"), F.col("b").alias("anchor")), ["rep", "anchor"], "left_anti").select("value", "rep", "n_shingles"))
    found = estimated
    if not rest.isEmpty():
        sizes = rest.groupBy("value").agg(F.ceil(F.count("*") / SKETCH_BLOCK).cast("int").alias("rest_chunks"))
        everyone = long_lists.join(sizes, "value").withColumn("chunks", F.ceil(F.col("count") / SKETCH_BLOCK).cast("int"))
        crossed = _crossed(rest.join(everyone.select("value", "chunks", "rest_chunks").distinct(), "value"), everyone.select("value", "rep", "n_shingles", "chunks", "rest_chunks"), "value")
        rows = crossed.join(classes.select("rep", "n_shingles", F.col("sketch").alias("values")), ["rep", "n_shingles"])
        found = found.union(_compared(rows, partial(_sketch_links, percent=percent, k=k, overlap=overlap)).select("u", "v"))
    return connected_components(found, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("grp"))


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, k: int = 192, indexed: int = 64) -> DataFrame:
    """Near-duplicate classes of ``documents`` (doc_id, text) by Jaccard similarity >= percent/100 of word shingles.

    Returns one row per input row: doc_id, n_shingles (size of its set), component_id (smallest doc_id that links reach),
    kept (doc_id is its component's id).

    Null or empty texts have no shingles and link with nothing. Rows that repeat a doc_id are one node that has the
    links of all its texts. Rows with a null doc_id are returned with a null component and kept. Extra columns are ignored. Sets are compared
    whole, as 64-bit hashes of their shingles. ``k`` values of a set are its sketch, of which the ``indexed`` smallest are in inverted lists. A link can be missed
    only if two sketches overlap in fewer than ``required_overlap`` values, which a pair at the threshold does with probability below 1e-8.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sketched = documents.mapInArrow(partial(_sketches, words=words, k=k), "doc_id long, n_shingles long, digest_a long, digest_b long, sketch array<long>")
    per_doc = stored(sketched.withColumn("row", F.monotonically_increasing_id()))
    known = per_doc.where("doc_id is not null and n_shingles > 0")
    # equal sets are one class, which the row of smallest id stands for; only sets of several rows need a join
    digest = ["n_shingles", "digest_a", "digest_b"]
    several = cut(known.groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.min_by("row", "doc_id").alias("rep_row"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    joined = known.join(small_side(several, 64), digest, "left")
    classes = joined.where("rep is null or row = rep_row").select(F.col("doc_id").alias("rep"), "n_shingles", "digest_a", "sketch")
    same = joined.where("doc_id != rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    groups = cut(_candidate_groups(classes, k, indexed, percent))
    placed = cut(classes.select("rep", "n_shingles").join(small_side(groups, 64), "rep"))
    large = cut(placed.groupBy("grp").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("total")).where((F.col("members") > BLOCK) | (F.col("total") > BLOCK_VALUES)))
    # the texts of candidate classes alone are shingled again, whole
    wanted = documents.join(small_side(placed.select(F.col("rep").alias("doc_id")), 64), "doc_id", "left_semi")
    sets = wanted.mapInArrow(partial(_whole_sets, words=words), "rep long, values array<long>").withColumn("n_shingles", F.size("values").cast("long"))
    exactly = partial(_exact_links, percent=percent)

    def compared(meetings: DataFrame, decide) -> DataFrame:
        return _compared(meetings.join(sets, ["rep", "n_shingles"]), decide)

    small = placed.join(small_side(large, 64), "grp", "left_anti")
    links = compared(small.select(F.col("grp").alias("pair"), F.lit(2).alias("side"), "rep", "n_shingles"), exactly)
    if not large.isEmpty():
        chunks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("total") / BLOCK_VALUES)).cast("int")
        big = placed.join(small_side(large, 64), "grp").withColumn("chunks", chunks)
        order = Window.partitionBy("grp").orderBy(F.xxhash64("rep", F.lit("pivot")), "rep", "n_shingles")
        pivots = big.withColumn("at", F.row_number().over(order)).where(F.col("at") <= PIVOTS).where(F.col("at") <= F.greatest(F.lit(1.0), BLOCK_VALUES * F.col("members") / F.col("total")))
        offered = pivots.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(F.xxhash64("grp", "j").alias("pair"), F.lit(0).alias("side"), "rep", "n_shingles")
        chunked = big.withColumn("j", _dealt("chunks")).select(F.xxhash64("grp", "j").alias("pair"), F.lit(1).alias("side"), "rep", "n_shingles")
        stars = cut(compared(offered.union(chunked), partial(_pivot_links, percent=percent)))
        rest = cut(big.join(stars.where("main").select(F.col("u").alias("rep")).distinct(), "rep", "left_anti"))
        rest_sizes = rest.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_VALUES)).cast("int").alias("rest_chunks"))
        both = ["grp", "rep", "n_shingles", "chunks", "rest_chunks"]
        crossed = _crossed(rest.join(rest_sizes, "grp").select(*both), big.join(rest_sizes, "grp").select(*both), "grp")
        links = links.union(stars).union(compared(crossed, exactly))

    # equal sets link as well, and so do the several texts of one doc_id
    found = connected_components(links.select("u", "v").union(same), "u", "v").select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    return (
        per_doc.select("doc_id", "n_shingles").join(found, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
