"""Exact Jaccard join of documents on word shingles: the groups that its links make, and the
number of links of every document.

Sets that are equal become one class at once.  Sets are ordered by one order of all shingles, the
frequent ones last, and any two that link share a shingle among the first fifth of either
(``prefix_length``); the index lists hold these.  A list isn't joined with itself.  Instead

* every set is compared with one pivot, the set that comes first in most of its lists.  A linked
  set hangs below its pivot, so a large group of near copies becomes one tree by as many
  comparisons as it has sets.  Sets that agree in a band of min-hashes get further pivots, the
  first sets of their bands;
* lists in which all sets are in one group are skipped whole;
* for what is left, a set enters only the lists that can decide on a link. Partners are told apart by
  the ratio of sizes; it and the place of a shingle say how many of a set's lists a linked partner must
  share, so the longest of them but one may go, and with too few lists the set goes (``_meetings``);
* the sets of one tree in a list are one entry, two trees meet in the first list that they share, not in
  each, and a pair of trees that shares too few lists for its sizes can hold no link;
* the overlap of two roots then answers for the sets below them: a set differs from its root by a
  known number of shingles, which bounds its overlap with any set of the other tree from above and
  from below.  Only pairs that the bounds leave open are compared.

That gives the groups.  Links stay inside a group, so the links of each set are then counted by
comparing all pairs of different sets of a group (``link_counts``), but for sets whose sizes allow
no link.  Large groups are dealt out as pairs of blocks, and no pair becomes a row.

No step drops a list, a set or a pair for its size; frequency only decides the order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import back, in_small_batches, renamed, stored, text_of
from goldseam.llm.shingles import band_keys, digest, shingle_sets

#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: So many of the most frequent shingles stand last in the order; a bound of what is broadcast.
FREQUENT = 200_000
#: Permutations, bands of each and min-hashes of a band, by which sets find further pivots.
TURNS, BANDS, ROWS = 2, 6, 16
#: Sets that one task compares with a pivot, on average.
BLOCK = 4_096
#: Rows up to which a list of documents to look up is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 400_000
#: Lists of a tree up to which they are counted against another's; trees with more are compared at once.
LISTS = 10_000
#: Lists before its own that an entry names, by which trees that met there do not meet again.
BEFORE = 4
#: Sets, and shingles of them, of a block whose links one task counts, on average.
BLOCK_SETS, BLOCK_SHINGLES = 256, 200_000

_COUNTED = 2_000_000  # shingles that a task counts at a time
_OFTEN = 4  # of these, so many make a shingle worth reporting
_STEP = 512  # texts handled at a time
_BYTES = 4_000_000  # of sets, sent on at a time
_COLUMNS = 2_048  # shingles multiplied at a time


def least_overlap(a, b):
    """The smallest intersection with which sets of two sizes link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_length(n):
    """Shingles of a set's beginning that must hold one of any set it links with."""
    return n - -(-PERCENT * n // 100) + 1


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def frequent_shingles(docs: DataFrame, text: str, most: int = FREQUENT) -> np.ndarray:
    """The most frequent shingles, least frequent first.

    Tasks report what they meet repeatedly, which is enough for an order: any order is right.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def report() -> pa.RecordBatch:
            met = np.concatenate([*held, np.zeros(0, np.uint64)])
            held.clear()
            values, counts = np.unique(met, return_counts=True)
            often = counts >= _OFTEN
            return pa.RecordBatch.from_arrays(
                [_signed(values[often]), pa.array(counts[often])], names=["shingle", "n"]
            )

        for batch in batches:
            for hashes in shingle_sets(batch.column("text").to_pylist()):
                held.append(hashes)
                size += len(hashes)
                if size >= _COUNTED:
                    yield report()
                    size = 0
        yield report()

    counts = stored(
        docs.select(text_of(text).alias("text"))
        .mapInArrow(count, "shingle long, n long")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n"), F.floor(8 * F.log2(F.sum("n"))).alias("level")),
        "shingles",
    )
    levels = counts.groupBy("level").agg(F.count("*").alias("shingles")).orderBy(F.desc("level"))
    left, lowest = most, None
    for row in levels.collect():  # a few hundred levels at most
        left -= row["shingles"]
        if left < 0:
            break
        lowest = row["level"]
    if lowest is None:
        return np.zeros(0, np.uint64)
    top = counts.where(F.col("level") >= lowest).orderBy("n", "shingle").select("shingle").toArrow()
    return top.column("shingle").to_numpy().view(np.uint64)


def prefix(hashes: np.ndarray, ordered: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The beginning of a sorted set; ``ordered`` are the frequent shingles, sorted, with ranks."""
    wanted = prefix_length(len(hashes))
    if not len(ordered):
        return hashes[:wanted]
    places = np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)
    late = ordered[places] == hashes
    first = hashes[~late][:wanted]
    last = hashes[late][np.argsort(ranks[places[late]])]
    return np.concatenate([first, last[: wanted - len(first)]])


def described(
    docs: DataFrame, doc_id: str, text: str, frequent: np.ndarray, uid: str | None = None
) -> DataFrame:
    """One row per document: uid, doc_id, n, key (of the set; null if empty), prefix and bands."""
    ranks = np.argsort(frequent)
    ordered = frequent[ranks]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                sets = list(shingle_sets(part.column("text").to_pylist()))
                heads = [prefix(s, ordered, ranks) if len(s) else s for s in sets]
                flat = _signed(np.concatenate(heads))
                ends = np.cumsum([0, *map(len, heads)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("uid"),
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
                        pa.array(
                            [band_keys(s, TURNS, BANDS, ROWS).view(np.int64) for s in sets],
                            pa.list_(pa.int64()),
                        ),
                    ],
                    names=["uid", "doc_id", "n", "key", "prefix", "bands"],
                )

    rows = docs.select(
        (F.monotonically_increasing_id() if uid is None else F.col(uid)).alias("uid"),
        F.col(doc_id).alias("doc_id"),
        text_of(text).alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        describe,
        f"uid long, doc_id {kind}, n long, key binary, prefix array<long>, bands array<long>",
    )


def overlaps(docs: DataFrame, doc_id: str, text: str, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The exact overlap of pairs of classes (``a``, ``b``): a, b, overlap.

    The texts of the classes are read again.  The sets that meet a ``b`` are dealt out over tasks
    in blocks, each with a copy of b's set, and compared one by one as they stream by.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    roles = pairs.join(parts, "b").select(
        F.col("a").alias("uid"),
        F.struct(
            F.col("b").alias("key"),
            F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"),
            F.lit(1).alias("turn"),
        ).alias("role"),
    )
    roles = roles.unionByName(
        parts.select(
            F.col("b").alias("uid"),
            F.explode(
                F.transform(
                    F.expr("sequence(0, parts - 1)"),
                    lambda part: F.struct(F.col("b").alias("key"), part.alias("part"), F.lit(0).alias("turn")),
                )
            ).alias("role"),
        )
    )
    wanted = stored(
        roles.groupBy("uid")
        .agg(F.collect_list("role").alias("roles"))
        .join(classes.select("uid", "doc_id", "key"), "uid"),
        "wanted",
    )
    wanted = wanted.select("uid", F.col("doc_id").alias("wanted_id"), F.col("key").alias("wanted_key"), "roles")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).join(
        wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id"))
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                uids, keys = part.column("uid").to_pylist(), part.column("wanted_key").to_pylist()
                roles = part.column("roles").to_pylist()
                out = []
                for row, hashes in enumerate(shingle_sets(part.column("text").to_pylist())):
                    if len(hashes) and digest(hashes) == keys[row]:
                        out += [(r["key"], r["part"], r["turn"], uids[row], hashes.tobytes()) for r in roles[row]]
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                    names=["key", "part", "turn", "uid", "hashes"],
                )

    dealt = (
        rows.select("text", "uid", "wanted_key", "roles")
        .mapInArrow(sets, "key long, part int, turn int, uid long, hashes binary")
        .repartition("key", "part")
        .sortWithinPartitions("key", "part", "turn")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, pivot = None, None
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("key", "part", "turn", "uid")]
            found = []
            for row, (key, part, turn, uid) in enumerate(zip(*columns, strict=True)):
                hashes = np.frombuffer(batch.column("hashes")[row].as_buffer(), np.uint64)
                if turn == 0:
                    place, pivot = (key, part), hashes.copy()
                elif place == (key, part):
                    common = len(np.intersect1d(hashes, pivot, assume_unique=True))
                    found.append((uid, key, common))
            columns = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in columns], names=["a", "b", "overlap"]
            )

    # Repeated rows of a document give the same overlap again.
    return (
        dealt.mapInArrow(compare, "a long, b long, overlap long")
        .groupBy("a", "b")
        .agg(F.max("overlap").alias("overlap"))
    )


def trees(parents: DataFrame) -> DataFrame:
    """From sets with a linked pivot (uid, parent, more, less) to their roots (uid, root, more, less).

    ``more`` bounds the shingles that a set has and the other lacks, ``less`` the other way round.
    """
    known = stored(parents.select("uid", F.col("parent").alias("root"), "more", "less"), "trees")
    while True:
        above = known.select(
            F.col("uid").alias("root"),
            F.col("root").alias("higher"),
            F.col("more").alias("more_up"),
            F.col("less").alias("less_up"),
        )
        jumped = stored(
            known.join(above, "root", "left").select(
                "uid",
                F.coalesce("higher", "root").alias("root"),
                (F.col("more") + F.coalesce("more_up", F.lit(0))).alias("more"),
                (F.col("less") + F.coalesce("less_up", F.lit(0))).alias("less"),
                F.col("higher").isNotNull().alias("moved"),
            ),
            "trees",
        )
        known = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return known


def components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from every node of an edge list (``a``, ``b``): node, label."""
    both = stored(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        better = labels.join(near, "a").select("a", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("a").alias("next"), F.col("label").alias("far"))
        moved = stored(
            better.join(jump, "next").select("a", "label", F.least("next", "far").alias("next")), "labels"
        )
        labels = moved.select("a", F.col("next").alias("label"))
        if moved.where("label != next").isEmpty():
            return labels.select(F.col("a").alias("node"), "label")


def _band_pivots(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different groups: each set with the first that shares a band."""
    keys = classes.select("uid", F.posexplode("bands").alias("band", "key"))
    firsts = (
        keys.groupBy("band", "key")
        .agg(F.min("uid").alias("pivot"), F.count("*").alias("sets"))
        .where("sets > 1")
        .select("band", "key", "pivot")
    )
    pairs = keys.join(firsts, ["band", "key"]).where("uid != pivot")
    pairs = pairs.select(F.col("uid").alias("a"), F.col("pivot").alias("b")).distinct()
    for side in "ab":
        own = labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
        pairs = pairs.join(own, side, "left")
    apart = F.coalesce("label_a", "a") != F.coalesce("label_b", "b")
    return pairs.where(apart).select("a", "b")


def _links(overlap: Column, n_a: Column, n_b: Column) -> Column:
    return overlap * (100 + PERCENT) >= PERCENT * (n_a + n_b)


def _ceil_share(n: Column) -> Column:
    return F.ceil(n * PERCENT / 100)


def links(docs: DataFrame, doc_id: str, text: str, classes: DataFrame) -> DataFrame:
    """Edges (``a``, ``b``) between classes (uid, doc_id, n, key, prefix) that make the groups."""
    postings = classes.select("uid", "n", F.posexplode("prefix").alias("place", "shingle"))
    pivots = (
        postings.groupBy("shingle")
        .agg(F.min("uid").alias("pivot"), F.count("*").alias("sets"))
        .where("sets > 1")
        .select("shingle", "pivot")
    )
    lists = stored(postings.join(pivots, "shingle"), "lists")

    # One pivot per set, the one of most of its lists.
    chosen = (
        lists.where("uid != pivot")
        .groupBy("uid", "pivot")
        .agg(F.count("*").alias("shared"))
        .groupBy("uid")
        .agg(F.max(F.struct("shared", (-F.col("pivot")).alias("pivot"))).alias("best"))
        .select(F.col("uid").alias("a"), (-F.col("best.pivot")).alias("b"))
    )
    sizes = classes.select("uid", "n")
    compared = overlaps(docs, doc_id, text, stored(_possible(chosen, sizes), "pivots"), classes)
    star = stored(_sized(compared, sizes).where(_links(F.col("overlap"), F.col("n_a"), F.col("n_b"))), "star")
    tree = trees(
        star.select(
            F.col("a").alias("uid"),
            F.col("b").alias("parent"),
            (F.col("n_a") - F.col("overlap")).alias("more"),
            (F.col("n_b") - F.col("overlap")).alias("less"),
        )
    )

    # Further pivots, among sets that are likely to be very similar.
    edges = star.select("a", "b")
    found = stored(_possible(_band_pivots(classes, components(edges)), sizes), "pivots")
    compared = _sized(overlaps(docs, doc_id, text, found, classes), sizes)
    linked = compared.where(_links(F.col("overlap"), F.col("n_a"), F.col("n_b")))
    edges = stored(edges.unionByName(linked.select("a", "b")), "edges")

    # Lists that still join several groups.
    zero = F.lit(0).cast("long")
    labels = components(edges)
    placed = lists.join(tree, "uid", "left").join(labels, F.col("uid") == F.col("node"), "left")
    placed = placed.select(
        "shingle", "place", "uid", "n",
        F.coalesce("root", "uid").alias("root"),
        F.coalesce("more", zero).alias("more"),
        F.coalesce("less", zero).alias("less"),
        F.coalesce("label", "uid").alias("label"),
    )
    mixed = (
        placed.groupBy("shingle")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("sets"))
        .where("low != high")
        .select("shingle", "sets")
    )
    open_lists = stored(placed.join(mixed, "shingle"), "open")
    roots = stored(_tree_pairs(open_lists), "roots")
    if roots.isEmpty():
        return edges
    answers = stored(_sized(overlaps(docs, doc_id, text, roots, classes), sizes), "answers")
    linked = _links(F.col("overlap"), F.col("n_a"), F.col("n_b"))
    edges = edges.unionByName(answers.where(linked).select("a", "b"))
    answers = answers.where(~linked)  # linked roots need no further answer

    return edges.unionByName(_derived(docs, doc_id, text, classes, open_lists, answers))


def _range(n: Column) -> Column:
    """The range of a size; sets of two ranges that aren't the same or neighbours can't link."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / PERCENT)).cast("int")


def _size_at(range_: Column) -> Column:
    """About the smallest size of a range."""
    return F.exp(range_ * math.log(100 / PERCENT))


def _must_share(smaller: Column, larger: Column) -> Column:
    """A bound, from below, of what linked sets of two sizes share of the larger one's prefix and the first
    ``smaller - _ceil_share(larger) + 1`` shingles of the smaller one.

    These beginnings leave out equally many of the least overlap, all but k of it, in either set. The
    shared shingles in the beginning that ends first lie in the other one too, and they are k or more.
    """
    least = (smaller * 100 - larger * PERCENT) * PERCENT / (100 * (100 + PERCENT))
    return F.greatest(F.floor(least) + 1, F.lit(1))


def _meetings(open_lists: DataFrame) -> DataFrame:
    """Trees (root_a, root_b) of different groups that meet: every pair with a link, few pairs twice.

    A set looks for larger ones and for smaller ones, of its own range of sizes and of the next one
    (``step``).  For each it knows which of its lists count and how many of them a linked partner shares, k;
    among all but the k - 1 longest of either, two such sets share one.  Where a list follows within
    ``BEFORE`` lists on one that both trees enter, they have met, and don't meet in it.
    """
    sets = stored(
        open_lists.groupBy("uid", "n", "root", "label").agg(
            F.sort_array(F.collect_list(F.struct("sets", "shingle", "place"))).alias("held")
        ),
        "held",
    )
    n, range_, zero = F.col("n"), _range(F.col("n")), F.lit(0).cast("int")

    def entries(side: str) -> DataFrame:
        step = F.explode(F.array(zero, zero + 1)).alias("step")
        rows = sets.withColumn("range", range_).select("*", step)
        if side == "a":  # the smaller set
            partner = F.col("range") + F.col("step")
            low = F.greatest(n, F.floor(_size_at(partner)) - 1)
            high = F.least(F.floor(n * 100 / PERCENT), F.ceil(_size_at(partner + 1)) + 1)
            rows = rows.where(low <= high).select(
                "*",
                F.col("range").alias("key"),
                (n - _ceil_share(low) + 1).alias("places"),
                _must_share(n, high).alias("share"),
            )
            counted = F.filter("held", lambda entry: entry["place"] < F.col("places"))
        else:
            partner = F.col("range") - F.col("step")
            low = F.greatest(_ceil_share(n), F.floor(_size_at(partner)) - 1)
            rows = rows.where(low <= n).select("*", partner.alias("key"), _must_share(low, n).alias("share"))
            counted = F.col("held")
        rows = rows.withColumn("counted", F.transform(counted, lambda entry: entry["shingle"]))
        rows = rows.where(F.size("counted") >= F.col("share")).select(
            "root", "label", "key", "step",
            F.expr("slice(counted, 1, int(size(counted) - share + 1))").alias("entered"),
        )
        earlier = {
            f"before{k}": F.expr(f"slice(concat(array_repeat(CAST(null AS long), {k}), entered), 1, size(entered))")
            for k in range(1, BEFORE + 1)
        }
        rows = rows.withColumns(earlier).select(
            "root", "label", "key", "step", F.inline(F.arrays_zip("entered", *earlier))
        )
        return (
            rows.select("key", "step", "root", "label", F.col("entered").alias("shingle"), F.array(*earlier).alias("before"))
            .repartition("shingle", "key", "step")
            .groupBy("shingle", "key", "step", F.col("root").alias(f"root_{side}"), F.col("label").alias(f"label_{side}"))
            .agg(F.min("before").alias(f"before_{side}"))
        )

    return (
        entries("a")
        .join(entries("b"), ["shingle", "key", "step"])
        .where("label_a != label_b")
        .where(~F.coalesce(F.arrays_overlap("before_a", "before_b"), F.lit(False)))
        .select("root_a", "root_b")
    )


def _tree_pairs(open_lists: DataFrame) -> DataFrame:
    """Pairs of trees (a, b) that can hold a link, by the lists that still join several groups."""
    met = stored(
        _meetings(open_lists)
        .select(F.greatest("root_a", "root_b").alias("a"), F.least("root_a", "root_b").alias("b"))
        .distinct(),
        "met",
    )
    named = met.select(F.explode(F.array("a", "b")).alias("root")).distinct()
    rows = open_lists.select("root", "shingle", "n").join(named, "root", "left_semi")
    about = stored(
        rows.groupBy("root").agg(
            F.min("n").alias("small"), F.max("n").alias("large"), F.count("*").alias("entries")
        ),
        "about",
    )
    few = about.where(F.col("entries") <= LISTS).select("root")
    listed = rows.join(few, "root", "left_semi").groupBy("root").agg(F.collect_set("shingle").alias("lists"))
    about = stored(about.drop("entries").join(listed, "root", "left"), "about")
    pairs = met
    for side in "ab":
        pairs = pairs.join(about.toDF(side, f"small_{side}", f"large_{side}", f"lists_{side}"), side)
    # Beyond the prefixes a pair can share no more than the longer rest of the two.
    beyond = F.greatest(_ceil_share(F.col("large_a")), _ceil_share(F.col("large_b"))) - 1
    needed = F.ceil((F.col("small_a") + F.col("small_b")) * PERCENT / (100 + PERCENT))
    shared = F.size(F.array_intersect("lists_a", "lists_b"))
    uncounted = F.col("lists_a").isNull() | F.col("lists_b").isNull()
    return (
        pairs.where(F.col("large_a") * 100 >= F.col("small_b") * PERCENT)
        .where(F.col("large_b") * 100 >= F.col("small_a") * PERCENT)
        .where(uncounted | (shared + beyond >= needed))
        .select("a", "b")
    )


def _derived(
    docs: DataFrame, doc_id: str, text: str, classes: DataFrame, open_lists: DataFrame, answers: DataFrame
) -> DataFrame:
    """Links that the roots' answers (a, b, overlap) leave for the sets below them.

    Sets of a tree that have one size and differ from the root by as many shingles are one shape,
    and get one answer.  A shape is left out where not even the likeliest set of the other tree
    could link with it.  Two trees that some pair of shapes surely links need no further answer;
    only of the others the pairs that are left open become pairs of sets and are compared.
    """
    answers = answers.select(F.col("a").alias("root_a"), F.col("b").alias("root_b"), "overlap")
    shape = ("root", "n", "more", "less")
    sets = stored(open_lists.select("uid", *shape).distinct(), "below")
    shapes = stored(sets.groupBy(*shape).agg(F.min("uid").alias("one")), "shapes")
    best = shapes.groupBy("root").agg(F.max("more").alias("most"), F.min("n").alias("small"))

    def possible(own: str, other: str) -> DataFrame:
        mine = shapes.select(*(F.col(c).alias(f"{c}_{own}") for c in (*shape, "one")))
        far = best.withColumnRenamed("root", f"root_{other}")
        n, more = F.col(f"n_{own}"), F.col(f"more_{own}")
        return (
            answers.join(far, f"root_{other}")
            .join(mine, f"root_{own}")
            .where(_links(F.col("overlap") + more + F.col("most"), n, F.col("small")))
            .drop("most", "small")
        )

    most = F.col("overlap") + F.col("more_a") + F.col("more_b")
    least = F.col("overlap") - F.col("less_a") - F.col("less_b")
    pairs = (
        possible("a", "b")
        .join(possible("b", "a").drop("overlap"), ["root_a", "root_b"])
        .where(_links(most, F.col("n_a"), F.col("n_b")))
        .withColumn("sure", _links(least, F.col("n_a"), F.col("n_b")))
    )
    pairs = stored(pairs, "shape-pairs")
    sure = pairs.where("sure").groupBy("root_a", "root_b").agg(
        F.min(F.struct(F.col("one_a").alias("a"), F.col("one_b").alias("b"))).alias("pair")
    )
    unsure = pairs.where("NOT sure").join(sure.select("root_a", "root_b"), ["root_a", "root_b"], "left_anti")
    for side in "ab":
        names = {c: f"{c}_{side}" for c in shape}
        unsure = unsure.join(
            sets.select(F.col("uid").alias(side), *(F.col(c).alias(name) for c, name in names.items())),
            list(names.values()),
        )
    unsure = stored(unsure.select("a", "b"), "unsure")
    edges = sure.select("pair.a", "pair.b")
    if unsure.isEmpty():
        return edges
    sizes = classes.select("uid", "n")
    checked = _sized(overlaps(docs, doc_id, text, unsure, classes), sizes)
    linked = checked.where(_links(F.col("overlap"), F.col("n_a"), F.col("n_b")))
    return edges.unionByName(linked.select("a", "b"))


def _block_pairs(classes: DataFrame) -> DataFrame:
    """The classes of groups of several, each with the pairs of blocks (``roles``) it is compared in.

    A block holds sets of one group and of one range of sizes.  Ranges are so wide that sets of two
    ranges that aren't neighbours can't link.  Small groups are one block.
    """
    size = classes.groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    range_ = _range(F.col("n"))
    small = (F.col("sets") <= BLOCK_SETS) & (F.col("shingles") <= BLOCK_SHINGLES)
    placed = classes.join(size.where("sets > 1"), "group").select(
        "uid", "doc_id", "key", "n", "copies", "group", F.when(small, -1).otherwise(range_).alias("range")
    )
    parts = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    blocks = stored(placed.groupBy("group", "range").agg(parts.cast("int").alias("parts")), "blocks")
    for name, other in (("parts", 0), ("above", -1), ("below", 1)):
        near = blocks.select("group", (F.col("range") + other).alias("range"), F.col("parts").alias(name))
        placed = placed.join(near, ["group", "range"], "left")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))

    def roles(others: str, low: str, first: str, high: str, second: str, side: str) -> str:
        numbers = f"IF({others} > 0, sequence(0, {others} - 1), CAST(array() AS array<int>))"
        return (
            f"transform({numbers}, p -> named_struct('group', group, 'low', {low}, 'first', {first},"
            f" 'high', {high}, 'second', {second}, 'side', {side}))"
        )

    return placed.withColumn(
        "roles",
        F.concat(
            F.expr(roles("parts", "range", "least(part, p)", "range", "greatest(part, p)", "IF(p < part, 1, 0)")),
            F.expr(roles("above", "range", "part", "range + 1", "p", "0")),
            F.expr(roles("below", "range - 1", "p", "range", "part", "1")),
        ),
    ).select("uid", "doc_id", "key", "copies", "roles")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """The overlaps of all pairs of sets, as a matrix; its diagonal has no meaning."""
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held > 1  # a shingle of one set alone adds to no overlap
    number = np.cumsum(shared) - 1
    keep = shared[place]
    owners, place = owners[keep], number[place[keep]]
    order = np.argsort(place, kind="stable")
    owners, place = owners[order], place[order]
    found = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int(shared.sum()), _COLUMNS):
        first, end = np.searchsorted(place, (low, low + _COLUMNS))
        width = int(place[end - 1]) - low + 1
        holds = np.zeros((len(sets), width), np.float32)
        holds[owners[first:end], place[first:end] - low] = 1
        found += (holds @ holds.T).astype(np.int64)
    return found


def _linked(sides: list[int], sets: list[np.ndarray], copies: list[int], own: bool) -> np.ndarray:
    """Rows that each set of a pair of blocks links with; of one block (``own``) inside it."""
    sizes, side = np.array([len(s) for s in sets]), np.array(sides)
    found = _common(sets) * (100 + PERCENT) >= PERCENT * (sizes[:, None] + sizes[None, :])
    if own:
        np.fill_diagonal(found, False)
    else:
        found &= side[:, None] != side[None, :]
    return found @ np.array(copies, np.int64)


def link_counts(docs: DataFrame, doc_id: str, text: str, classes: DataFrame) -> DataFrame:
    """Rows of other classes that each class links with: uid, linked.

    ``classes`` has uid, doc_id, key, n, copies and the group, outside of which there is no link.
    """
    wanted = stored(_block_pairs(classes), "wanted")
    wanted = wanted.select(
        "uid", F.col("doc_id").alias("wanted_id"), F.col("key").alias("wanted_key"), "copies", "roles"
    )
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).join(
        wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id"))
    )
    unit = ("group", "low", "first", "high", "second")
    kinds = {
        "group": pa.int64(), **dict.fromkeys((*unit[1:], "side"), pa.int32()),
        "uid": pa.int64(), "copies": pa.int64(), "hashes": pa.binary(),
    }

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def send() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds)
            )

        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                named = [part.column(c).to_pylist() for c in ("uid", "wanted_key", "copies", "roles", "text")]
                for uid, key, copies, roles, hashes in zip(*named[:4], shingle_sets(named[4]), strict=True):
                    if not len(hashes) or digest(hashes) != key:
                        continue
                    data = hashes.tobytes()
                    for r in roles:
                        out.append((*(r[c] for c in (*unit, "side")), uid, copies, data))
                        size += len(data)
                        if size >= _BYTES:
                            yield send()
                            size = 0
        yield send()

    dealt = (
        rows.select("text", "uid", "wanted_key", "copies", "roles")
        .mapInArrow(
            sets,
            "group long, low int, first int, high int, second int, side int, uid long, copies long, hashes binary",
        )
        .repartition(*unit)
        .sortWithinPartitions(*unit, "side", "uid")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, ([], [], [], [])  # sides, uids, copies, sets

        def answer() -> tuple[list[int], list[int]]:
            sides, uids, copies, hashes = held
            if len(uids) < 2:
                return [], []
            _, low, first, high, second = place
            linked = _linked(sides, hashes, copies, (low, first) == (high, second))
            return uids, linked.tolist()

        for batch in batches:
            found = ([], [])
            named = [batch.column(c).to_pylist() for c in (*unit, "side", "uid", "copies")]
            for row, (*here, side, uid, copies) in enumerate(zip(*named, strict=True)):
                if here != place:
                    for column, more in zip(found, answer(), strict=True):
                        column.extend(more)
                    place, held = here, ([], [], [], [])
                if held[1] and held[1][-1] == uid:
                    continue  # a repeated row of the document
                hashes = np.frombuffer(batch.column("hashes")[row].as_buffer(), np.uint64).copy()
                for column, value in zip(held, (side, uid, copies, hashes), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["uid", "linked"])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in answer()], names=["uid", "linked"])

    return dealt.mapInArrow(count, "uid long, linked long").groupBy("uid").agg(F.sum("linked").alias("linked"))


def _sized(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(sizes.select(F.col("uid").alias(side), F.col("n").alias(f"n_{side}")), side)
    return pairs


def _possible(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs whose sizes allow a link."""
    sized = _sized(pairs, sizes)
    return sized.where(
        _links(F.least("n_a", "n_b"), F.col("n_a"), F.col("n_b"))
    ).select("a", "b")


def grouped_sets(
    docs: DataFrame, doc_id: str, text: str, frequent: int, uid: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Every row with the key of its set (uid, doc_id, n, key), and the classes of equal sets with
    their group (uid, doc_id, smallest, copies, n, key, group, component_id)."""
    in_small_batches(docs.sparkSession)
    heavy = frequent_shingles(docs, text, frequent)
    members = stored(described(docs, doc_id, text, heavy, uid), "sets")
    classes = stored(
        members.where("key IS NOT NULL")
        .groupBy("key")
        .agg(
            F.min(F.struct("uid", "doc_id")).alias("first"),
            F.min("doc_id").alias("smallest"),
            F.count("*").alias("copies"),
            F.any_value("n").alias("n"),
            F.any_value("prefix").alias("prefix"),
            F.any_value("bands").alias("bands"),
        )
        .select("first.*", "smallest", "copies", "n", "key", "prefix", "bands"),
        "classes",
    )
    edges = links(docs, doc_id, text, classes)
    labels = components(edges)
    grouped = classes.drop("prefix", "bands").join(labels, F.col("uid") == F.col("node"), "left")
    grouped = grouped.withColumn("group", F.coalesce("label", "uid")).drop("node", "label")
    smallest = grouped.groupBy("group").agg(F.min("smallest").alias("component_id"))
    return members.select("uid", "doc_id", "n", "key"), grouped.join(smallest, "group")


def jaccard_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    frequent: int = FREQUENT,
    uid: str | None = None,
) -> DataFrame:
    """One row per row: uid (any number, or the column named so), doc_id, n_shingles, component_id and group (any number).

    Words are ASCII-lower-cased and stand between ASCII white space.  A set holds the distinct
    shingles of five words; a shorter text is one shingle as a whole.  Null texts and texts without
    words are empty: they link with nothing, have n_shingles 0 and their own doc_id as component.
    ``component_id`` is the smallest doc_id of the group, null only if all are.  Repeated rows are
    in one group.  An empty table gives no rows.  Other columns are not read.
    """
    members, classes = grouped_sets(docs, doc_id, text, frequent, uid)
    named = classes.select("key", "group", "component_id")
    return members.join(named, "key", "left").select(
        "uid",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("group", F.col("uid")).alias("group"),
    )


def jaccard_links(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT
) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id, class_id and n_links.

    Sets, empty texts and ``component_id`` are those of ``jaccard_groups``.  ``class_id`` is the
    smallest doc_id of the rows with an equal set, null only if all are; ``n_links`` is the number
    of other rows that the row links with, rows with an equal set among them.  A row with an empty
    text has its own doc_id as class and no links.
    """
    members, classes = grouped_sets(docs, doc_id, text, frequent)
    classes = stored(classes, "grouped")
    counted = link_counts(docs, doc_id, text, classes)
    named = classes.join(counted, "uid", "left").select(
        "key",
        "component_id",
        F.col("smallest").alias("class_id"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    empty = F.col("key").isNull()
    return members.join(named, "key", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        *(F.when(empty, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("component_id", "class_id")),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near copies: of each group the row with the smallest doc_id stays.

    Null identifiers come last; of rows equal in it, one stays.  Empty texts link with nothing and
    stay.  All columns are kept, whatever their names.  The table is numbered by its partitions, so
    it has to be read from files, as a stored stage is.
    """
    plain, names = renamed(docs)
    plain = plain.withColumn("_row", F.monotonically_increasing_id())
    groups = stored(jaccard_groups(plain, names[doc_id], names[text], uid="_row"), "groups")
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "uid")
    kept = groups.groupBy("group").agg(F.min(rank).alias("kept"), F.count("*").alias("rows"))
    kept = kept.where("rows > 1").select("group", F.col("kept.uid").alias("keeper"))
    gone = stored(
        groups.join(kept, "group").where("uid != keeper").select(F.col("uid").alias("_row")), "gone"
    )
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return plain.join(gone, "_row", "left_anti").select(*back(names))
