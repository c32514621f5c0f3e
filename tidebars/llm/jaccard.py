"""N-gram Jaccard join: count-vector R-trees over groups of hashed shingles.

The set of a text is its distinct k-word shingles, as 64-bit hashes. Shingles are hashed into groups; the group
counts of a set are a point. For two sets the sum of the coordinate minima of their points bounds their overlap from
above, and with a node's coordinate maxima it bounds the overlap with anything below that node. Trees drop the pairs
whose bound can't reach the threshold; what is left is verified on the sets themselves.

Which points share a tree. One tree over a corpus doesn't exist on a cluster, so points are dealt to many small
trees, without losing a pair: with all shingles in one fixed order, two sets at the threshold share a shingle among
the first n - ceil(t n) + 1 of each (of the smaller, n - ceil(2 t n / (1 + t)) + 1 suffice). The order is by the document frequency of the shingle's frequency group (a table
of a fixed number of counters), then by hash, so what a passage of many documents brings comes last and rarely
deals anything. Texts of one set are one point throughout.

How large groups of near copies stay cheap. In each list the set with the commonest shingles, which in a group of copies
is the one changed least, stands for the list. Each set is first compared with the one that does so in most of its
lists; a tree over all sets with the same choice answers it, the survivors are verified, and the links make
components. Then the lists, those with one representative together, are searched in full, but only for pairs in
different components. Together every dealt pair is either verified or joined already, and no list is expanded into all its pairs.

Defined results: a text without words (null, empty) has no shingles and its own component; a row without doc_id takes no part
and has a null component; rows that repeat a doc_id give a row each; an empty table gives no rows; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.arrow_text import U64, mix, shingle_sets
from tidebars.llm.graph import components
from tidebars.llm.store import materialize, shuffle_partitions, small_batches

K, PERCENT = 5, 75
#: Counters of the document frequency table.
FREQUENCY_BITS = 16
#: Least number of groups of a count vector; more for larger sets, at most one shingle a group on average.
GROUPS = 64
LEAF, FANOUT = 16, 8
#: Members of a tree; a list with more is dealt in blocks, every two of which meet.
TREE = 1024
#: Shingles dealt to one partition, at most about.
PART_TOKENS = 500_000


def required(na: int, nb: int, percent: int) -> int:
    """Least overlap of sets of na and nb at the threshold."""
    return -(-percent * (na + nb) // (100 + percent))


def n_groups(n: int) -> int:
    return max(GROUPS, 1 << max(0, n - 1).bit_length())


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """Shingles in each of n_groups(len(shingles)) groups."""
    g = n_groups(len(shingles))
    return np.bincount((shingles >> U64(FREQUENCY_BITS)).astype(np.int64) & (g - 1), minlength=g).astype(np.uint16)


def fold(vector: np.ndarray, groups: int) -> np.ndarray:
    """The count vector over fewer groups."""
    return vector if vector.shape[-1] == groups else vector.reshape(*vector.shape[:-1], -1, groups).sum(axis=-2, dtype=np.int32)


def pack_vector(vector: np.ndarray) -> bytes:
    """One byte a group, or two where a count needs them."""
    return (vector.astype(np.uint8) if not len(vector) or vector.max() < 256 else vector).tobytes()


def unpack_vector(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == n_groups(n) else np.uint16)


class CountVectorTree:
    """Points (count vectors of one length) and set sizes, packed bottom-up into nodes of coordinate maxima."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # near points side by side: by size, then by the coordinate that is largest in a coarse view
        coarse = fold(points, min(16, points.shape[1])) if len(points) > LEAF else points[:, :1]
        self.order = np.lexsort((coarse.argmax(axis=1), sizes // max(1, int(sizes.max()) // 8)))
        self.points, self.sizes = points[self.order].astype(np.int32), sizes[self.order]
        #: Per level, lowest first: maxima, smallest size, first and last child.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        maxima, smallest, width = self.points, self.sizes, LEAF
        while len(maxima) > 1:
            first = np.arange(0, len(maxima), width)
            maxima, smallest = np.maximum.reduceat(maxima, first), np.minimum.reduceat(smallest, first)
            self.levels.append((maxima, smallest, first))
            width = FANOUT

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Positions (as given) of the points that may reach the threshold with this one."""
        point = point.astype(np.int32)
        nodes = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            maxima, smallest, first = self.levels[level]
            bound = np.minimum(maxima[nodes], point).sum(axis=1)
            least = np.maximum(smallest[nodes], -(-percent * size // 100))
            nodes = nodes[(100 + percent) * bound >= percent * (size + least)]
            if not len(nodes):
                return nodes
            end = np.append(first[1:], len(self.levels[level - 1][0]) if level else len(self.points))
            nodes = np.concatenate([np.arange(first[i], end[i]) for i in nodes])
        sizes = self.sizes[nodes]
        near = (100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size)) & ((100 + percent) * np.minimum(self.points[nodes], point).sum(axis=1) >= percent * (size + sizes))
        return self.order[nodes[near]]


def tree_pairs(points: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, sides: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of positions with different labels that survive the bound; a pair may come twice, once from either end.

    One end of such a pair is not of the commonest label, so only those points are looked up.
    sides: 0 for points of one block; with a block against another, 1 and 2, and pairs are across.
    Sizes fall into classes a factor 100 / percent apart, so a set's partners are in its class or one beside it.
    """
    classes = np.floor(np.log(np.maximum(sizes, 1)) / np.log(100 / percent) + 1e-9).astype(np.int64)
    names, count = np.unique(labels, return_counts=True)
    asks = labels != names[np.argmax(count)]
    for mine, theirs in ((1, 2), (2, 1)) if sides.any() else ((0, 0),):
        for c in np.unique(classes[sides == mine]):
            own = np.flatnonzero((classes == c) & (sides == mine))
            near = np.flatnonzero(asks & (np.abs(classes - c) <= 1) & (sides == theirs))
            if not len(near):
                continue
            groups = min(min(len(points[i]) for i in own), min(len(points[i]) for i in near))
            tree = CountVectorTree(np.stack([fold(points[i], groups) for i in own]), sizes[own])
            for q in near:
                for j in own[tree.search(fold(points[q], groups), int(sizes[q]), percent)]:
                    if labels[j] != labels[q]:
                        yield int(q), int(j)


def _set_id(shingles: np.ndarray) -> int:
    return int(mix(mix(shingles).sum(dtype=U64, keepdims=True) + U64(len(shingles)))[0].astype(np.int64))


def describe(docs: DataFrame, k: int = K) -> DataFrame:
    """Per row: doc_id, n (set size), set (id of the set); besides, rows of grp, cnt: the partition's frequency counters."""
    size = 1 << FREQUENCY_BITS

    def run(batches):
        counters = np.zeros(size, np.int64)
        null = lambda n: pa.nulls(n, pa.int64())
        names = ["doc_id", "n", "set", "grp", "cnt"]
        for batch in batches:
            n, own = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, s in shingle_sets(batch.column(1), k):
                n[i] = len(s)
                if len(s):
                    own[i] = _set_id(s)
                    np.add.at(counters, (s & U64(size - 1)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(own), null(batch.num_rows), null(batch.num_rows)], names=names)
        used = np.flatnonzero(counters)
        yield pa.RecordBatch.from_arrays([null(len(used)), null(len(used)), null(len(used)), pa.array(used), pa.array(counters[used])], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, set long, grp long, cnt long")


def frequency_ranks(described: DataFrame) -> np.ndarray:
    """Rank of each frequency group; a table of a fixed size."""
    rows = described.where("grp IS NOT NULL").groupBy("grp").agg(F.sum("cnt").alias("cnt")).toArrow()
    counts = np.zeros(1 << FREQUENCY_BITS, np.int64)
    counts[rows.column("grp").to_numpy()] = rows.column("cnt").to_numpy()
    ranks = np.empty(len(counts), np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint64)
    return ranks


def dealt_tokens(shingles: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the common order, as integers that sort so but for the lowest bit.

    The lowest bit tells whether a shingle is among the fewer that suffice where the set is the smaller of two.
    """
    order = (ranks[(shingles & U64((1 << FREQUENCY_BITS) - 1)).astype(np.int64)] << U64(64 - FREQUENCY_BITS)) | (shingles >> U64(FREQUENCY_BITS))
    n = len(order) - -(-percent * len(order) // 100) + 1
    core = len(order) - -(-2 * percent * len(order) // (100 + percent)) + 1
    first = np.partition(order, sorted({core - 1, n - 1}))[:n] & ~U64(1)
    first[:core] |= U64(1)
    return first


def deal(docs: DataFrame, ranks: np.ndarray, parts: int, k: int, percent: int) -> DataFrame:
    """part and the packed tokens, sets, sizes and scores that a run of rows deals to it; sets met again in the run come once.

    A set's score is the mean rank of its shingles: the higher, the more of it other documents have.
    """

    def run(batches):
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int, int]] = []
        tokens = 0

        def flush():
            all_tokens = np.concatenate([h[0] for h in held])
            own = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
            sets, sizes, scores = (np.array([h[i] for h in held], kind) for i, kind in ((1, np.int64), (2, np.uint32), (3, np.uint16)))
            part = (mix(all_tokens >> U64(1)) % U64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, all_tokens, own = part[order], all_tokens[order], own[order]
            at = np.flatnonzero(np.diff(part, prepend=-1))
            rows = []
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(part)], strict=True):
                first = np.flatnonzero(np.diff(own[a:b], prepend=-1))
                docs_here = own[a:b][first]
                counts = np.diff(np.append(first, b - a)).astype(np.uint32)
                rows.append((int(part[a]), all_tokens[a:b].tobytes(), sets[docs_here].tobytes(), sizes[docs_here].tobytes(), scores[docs_here].tobytes(), counts.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 5), strict=True)], names=["part", "tokens", "sets", "sizes", "scores", "counts"])

        for batch in batches:
            for _, s in shingle_sets(batch.column(0), k):
                if len(s) and (own := _set_id(s)) not in seen:
                    seen.add(own)
                    held.append((dealt_tokens(s, ranks, percent), own, len(s), int(ranks[(s & U64((1 << FREQUENCY_BITS) - 1)).astype(np.int64)].mean())))
                    tokens += len(held[-1][0])
                    if tokens >= PART_TOKENS:
                        yield flush()
                        held, tokens = [], 0
        if held:
            yield flush()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "part int, tokens binary, sets binary, sizes binary, scores binary, counts binary")


def lists(dealt: DataFrame, parts: int, percent: int) -> DataFrame:
    """Of each part: pairs (a, na, b, nb) of a list's best-scored set and another, with list null and how many lists have
    them as votes; and the members (b, nb) of lists of three or more, with the best-scored set as list."""

    def run(batches):
        got = [[], [], [], []]
        for batch in batches:
            for i in range(batch.num_rows):
                counts = np.frombuffer(batch.column(5)[i].as_py(), np.uint32)
                got[0].append(np.frombuffer(batch.column(1)[i].as_py(), np.uint64))
                got[1].append(np.repeat(np.frombuffer(batch.column(2)[i].as_py(), np.int64), counts))
                got[2].append(np.repeat(np.frombuffer(batch.column(3)[i].as_py(), np.uint32), counts))
                got[3].append(np.repeat(np.frombuffer(batch.column(4)[i].as_py(), np.uint16), counts))
        if not got[0]:
            return
        tokens, sets, sizes, scores = (np.concatenate(x) for x in got)
        order = np.lexsort((sets, sizes, tokens >> U64(1)))
        core = (tokens[order] & U64(1)) == 1
        tokens, sets, sizes, scores = tokens[order] >> U64(1), sets[order], sizes[order].astype(np.int64), scores[order].astype(np.int64)
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (sets[1:] != sets[:-1])
        tokens, sets, sizes, scores, core = tokens[fresh], sets[fresh], sizes[fresh], scores[fresh], core[fresh]
        at = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        end = np.append(at[1:], len(tokens))
        # sizes rise within a list; what comes before its first core member has no partner there
        at = np.minimum.reduceat(np.where(core, np.arange(len(tokens)), len(tokens)), at)
        at, length = at[at < end - 1], (end - at)[at < end - 1]
        if not len(at):
            return
        # lists of the same members count once
        signs = np.concatenate([[0], np.cumsum(mix(sets.astype(np.uint64) + core.astype(np.uint64)), dtype=np.uint64)]).astype(np.uint64)
        _, once = np.unique(signs[at + length] - signs[at], return_index=True)
        at, length = at[once], length[once]
        member = np.repeat(at - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        run_of = np.repeat(np.arange(len(at)), length)
        best = np.lexsort((sets[member], scores[member], run_of))[np.cumsum(length) - 1]
        hub = np.repeat(member[best], length)
        pair = (hub != member) & (100 * np.minimum(sizes[hub], sizes[member]) >= percent * np.maximum(sizes[hub], sizes[member]))
        a, b = hub[pair], member[pair]
        _, once, votes = np.unique(mix(sets[a].astype(np.uint64)) + sets[b].astype(np.uint64), return_index=True, return_counts=True)
        a, b = a[once], b[once]
        schema = ["list", "a", "na", "b", "nb", "votes"]
        for lo in range(0, len(a), 100_000):
            x, y = a[lo : lo + 100_000], b[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.array(sets[x]), pa.array(sizes[x]), pa.array(sets[y]), pa.array(sizes[y]), pa.array(votes[lo : lo + 100_000])], names=schema)
        # lists with one representative make one group: a set meets it once, whatever lists they share
        several = np.repeat(length > 2, length)
        name, own = sets[np.repeat(member[best], length)[several]], member[several]
        _, once = np.unique(mix(name.astype(np.uint64)) + sets[own].astype(np.uint64), return_index=True)
        name, own = name[once], own[once]
        for lo in range(0, len(own), 100_000):
            x = own[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(name[lo : lo + 100_000]), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.int64()), pa.array(sets[x]), pa.array(sizes[x]), pa.nulls(len(x), pa.int64())], names=schema)

    return dealt.repartitionById(parts, F.col("part")).mapInArrow(run, "list long, a long, na long, b long, nb long, votes long")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) at or above the threshold; texts: set, text.

    A block holds a set and up to about TREE / 4 of those to be compared with it; its tree answers the set, then the
    survivors' shingles are intersected.
    """
    spark = pairs.sparkSession
    pairs = pairs.select("a", "b").distinct()
    most = TREE // 4
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    pairs = pairs.join(degree, "a").withColumn("block", F.xxhash64("a", F.pmod(F.xxhash64("b"), "blocks")))
    rows = pairs.select("block", F.col("a").alias("hub"), F.col("b").alias("set")).union(pairs.select("block", F.col("a").alias("hub"), F.col("a").alias("set")).distinct())
    rows = materialize(rows, "blocks")
    cells = max(shuffle_partitions(spark), rows.count() // 500)

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block, hub, own = (table.column(c).to_numpy() for c in ("block", "hub", "set"))
        order = np.lexsort((own != hub, block))
        text = table.column("text").combine_chunks().take(pa.array(order))
        block, hub, own = block[order], hub[order], own[order]
        found: list[tuple[int, int]] = []
        group: list[tuple[int, np.ndarray]] = []

        def search(group: list[tuple[int, np.ndarray]], center: int) -> None:
            mine = next((s for i, s in group if i == center), None)
            others = {i: s for i, s in group if i != center}
            if mine is None or not others:
                return
            names, sets = list(others), list(others.values())
            sizes = np.array([len(s) for s in sets])
            vector = count_vector(mine)
            groups = min(len(vector), min(n_groups(int(n)) for n in sizes))
            tree = CountVectorTree(np.stack([fold(count_vector(s), groups) for s in sets]), sizes)
            for j in tree.search(fold(vector, groups), len(mine), percent).tolist():
                both = len(np.intersect1d(mine, sets[j], assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(sets[j]) - both):
                    found.append((center, names[j]))

        last = None
        for i, s in shingle_sets(text, k):
            if last is not None and block[i] != block[last]:
                search(group, int(hub[last]))
                group = []
            group.append((int(own[i]), s))
            last = i
        if last is not None:
            search(group, int(hub[last]))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    # both sides grow with the corpus: merged at any size, never broadcast
    given = rows.hint("merge").join(texts.select("set", "text"), "set").withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)))
    return given.select("cell", "block", "hub", "set", "text").groupBy("cell").applyInArrow(compare, "a long, b long")


def search_lists(members: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of sets in one list and different components that survive a tree; members: list, set, n, component, vector.

    A list of more than TREE members is dealt in blocks, and a tree of each block is asked by every later block.
    """
    count = members.groupBy("list").agg(F.ceil(F.count("*") / TREE).cast("int").alias("blocks"))
    rows = members.join(count, "list").withColumn("own", F.pmod(F.xxhash64("set", "list"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set", "n", "component", "vector")
    cells = shuffle_partitions(members.sparkSession) * 4

    def run(table: pa.Table) -> pa.Table:
        own, n, component, block_i, block_j, side = (table.column(c).to_numpy() for c in ("set", "n", "component", "i", "j", "own"))
        name = table.column("list").to_numpy()
        vectors = table.column("vector").to_pylist()
        order = np.lexsort((own, block_j, block_i, name))
        key = np.stack([name, block_i, block_j])[:, order]
        start = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))) if len(order) else np.zeros(0, int)
        found: set[tuple[int, int]] = set()
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(order)], strict=True):
            at = order[a:b]
            if b - a < 2 or len(np.unique(component[at])) < 2:
                continue
            sides = np.where(side[at] == block_i[at], 1, 2) if block_i[at[0]] != block_j[at[0]] else np.zeros(b - a, int)
            points = [unpack_vector(vectors[i], int(n[i])) for i in at]
            for x, y in tree_pairs(points, n[at], component[at], sides, percent):
                p, q = int(own[at[x]]), int(own[at[y]])
                if (q, p) not in found:
                    found.add((p, q))
        pairs = sorted(found)
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    rows = rows.withColumn("cell", F.pmod(F.xxhash64("list", "i", "j"), F.lit(cells)))
    return rows.groupBy("cell").applyInArrow(run, "a long, b long")


def _texts(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """set, n, text, vector of the wanted sets (set, doc_id), from their first documents."""

    def run(batches):
        for batch in batches:
            wants = batch.column(0).to_pylist()
            keep, sizes, vectors = [], [], []
            for i, s in shingle_sets(batch.column(1), k):
                # a doc_id that stands on several rows brings all their texts
                if len(s) and _set_id(s) == wants[i]:
                    keep.append(i)
                    sizes.append(len(s))
                    vectors.append(pack_vector(count_vector(s)))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(sizes, pa.int64()), batch.column(1).take(at), pa.array(vectors, pa.binary())], names=["set", "n", "text", "vector"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted.hint("merge"), "doc_id")
    return rows.select("set", "text").mapInArrow(run, "set long, n long, text string, vector binary")


def join(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    described = materialize(describe(docs, k), "sets")
    rows = described.where("grp IS NULL").select("doc_id", "n", "set")
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(shuffle_partitions(spark), int(total * (100 - percent) / 100 / PART_TOKENS) + 1)
    dealt = deal(docs.where("doc_id IS NOT NULL"), frequency_ranks(described), parts, k, percent)
    found = materialize(lists(dealt, parts, percent), "lists")
    pairs = materialize(found.where("list IS NULL").groupBy("a", "b").agg(F.sum("votes").alias("votes")), "pairs")
    members = found.where("list IS NOT NULL").select("list", F.col("b").alias("set"), F.col("nb").alias("n")).distinct()

    first = rows.where("doc_id IS NOT NULL AND n > 0").groupBy("set").agg(F.min("doc_id").alias("doc_id"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).union(members.select("set")).distinct().join(first, "set")
    texts = materialize(_texts(docs, wanted, k), "candidates")

    chosen = pairs.groupBy("b").agg(F.max_by("a", F.struct("votes", "a")).alias("a")).select("a", "b")
    links = materialize(verified(chosen, texts, k, percent), "links")
    near = materialize(components(links), "components").withColumnRenamed("node", "set")

    label = lambda side: near.select(F.col("set").alias(side), F.col("component").alias(f"{side}_component"))
    apart = pairs.join(chosen, ["a", "b"], "left_anti").join(label("a"), "a", "left").join(label("b"), "b", "left")
    apart = apart.where(F.coalesce("a_component", "a") != F.coalesce("b_component", "b")).select("a", "b")
    own = members.join(near, "set", "left").withColumn("component", F.coalesce("component", "set"))
    several = own.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("list")
    own = materialize(own.join(several, "list"), "members").hint("merge").join(texts.select("set", "vector"), "set")
    more = materialize(search_lists(own, percent).union(apart).distinct(), "pairs")
    links = materialize(links.union(verified(more, texts, k, percent)), "links")
    near = components(links).withColumnRenamed("node", "set")

    whole = first.join(near, "set", "left").withColumn("component", F.coalesce("component", "set"))
    least = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(whole.join(least, "component").select("set", "component_id"), "set", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"))
