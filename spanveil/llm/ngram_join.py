"""Similarity self-join of word n-gram sets by Jaccard, with a prefix tree.

1. Each document becomes the set of its n-word shingles (64-bit hashes); equal sets are one
   class. Classes, not documents, are joined, so copies never meet.
2. All shingles have one global order: shingles are counted over all documents in hashed
   cells, more of them for more input, and the order is by the cell's count (in steps of a
   quarter power of two), then hash; rare ones come first. Two sets that reach the threshold
   share at least l of their first |x| - ceil(t|x|) + l shingles. With l about half of
   what may differ, a class that doesn't share that many of its first shingles with any
   other class has no link and goes. This is repeated until nothing more goes.
3. The classes left are brought together by each of ROUTES shared shingles. A bucket's sets
   are stored in a trie in the local global order; each set walks the trie once,
   carrying the overlap with all paths at once, and leaves a subtree when the overlap so
   far and the remaining lengths can't reach the threshold. Sets already in the walker's
   component are skipped. Buckets above MOST_IN_BUCKET sets are joined in blocks,
   each pair of blocks a bucket of its own.
4. What that can miss is a pair that shares none of the routes. Where rarest first shingles
   of different components meet, pairs whose routes don't are listed while they are few
   (PAIRS for each set of the bucket at most), and compared by the same trie; with more,
   the whole bucket goes through the trie. So the join is exact, and no step writes more
   than a multiple of the rows it reads.

Hash collisions apart (64 bits), nothing is approximate and nothing is capped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, components, give_back, mix, shingle_sets, slices, table

ROUTES, MOST_IN_BUCKET, MOST_BROADCAST = 4, 20_000, 200_000
#: Bits of a cell's number: the least, to which one is added for each doubling of the input above CELL_BYTES, and the most.
CELL_BITS, CELL_BYTES = (18, 22), 4 << 30
#: Rows of small buckets that share a task; pairs that a bucket may list for each of its rows.
ROWS_IN_GROUP, PAIRS = 20_000, 4


def need(size: np.ndarray | int, num: int) -> np.ndarray | int:
    """Least overlap of a set of this size with any set that links with it: ceil(num / 100 * size)."""
    return -(-num * size // 100)


def pair_need(a: np.ndarray | int, b: np.ndarray | int, num: int) -> np.ndarray | int:
    """Least overlap with which sets of sizes a and b link: 100 * i >= num * (a + b - i)."""
    return -(-num * (a + b) // (100 + num))


def rank(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """tokens in the global order. counts: of each cell, in steps."""
    return tokens[np.lexsort((tokens, counts[(tokens >> np.uint64(65 - len(counts).bit_length())).astype(np.int64)]))]


class Trie:
    """Sets as paths of a compressed trie, built from their sorted order.

    An edge holds the shingles between two branchings; ``parent`` leads up. Sets end
    at edges; ``small`` and ``deep`` are the least size and the most shingles left below an edge.
    """

    def __init__(self, sets: list[np.ndarray]):
        """sets: arrays of local shingle numbers, rising in the order of the trie."""
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i4").tobytes())
        tokens, parent, depth_end, end_edge = [], [], [], np.full(len(sets), -1, dtype=np.int64)
        stack: list[tuple[int, int]] = []  # (edge, depth at its end)
        children: list[list[int]] = []
        last = None

        def edge(part: np.ndarray, up: int, deep: int) -> int:
            tokens.append(part)
            parent.append(up)
            depth_end.append(deep)
            children.append([])
            return len(parent) - 1

        for i in self.order:
            s = sets[i]
            common = 0
            if last is not None:
                n = min(len(s), len(last))
                differ = np.flatnonzero(s[:n] != last[:n])
                common = int(differ[0]) if len(differ) else n
            while stack and (stack[-2][1] if len(stack) > 1 else 0) >= common and stack[-1][1] > common:
                stack.pop()
            if stack and stack[-1][1] > common:  # branch inside an edge: split it
                e, deep = stack[-1]
                up = stack[-2][1] if len(stack) > 1 else 0
                part = tokens[e]
                lower = edge(part[common - up :], e, deep)
                children[lower] = children[e]
                for c in children[e]:
                    parent[c] = lower
                children[e] = [lower]
                end_edge[end_edge == e] = lower
                tokens[e], depth_end[e] = part[: common - up], common
                stack[-1] = (e, common)
            up = stack[-1][0] if stack else -1
            if len(s) > common or not stack:
                e = edge(s[common:], up, len(s))
                if up >= 0:
                    children[up].append(e)
                stack.append((e, len(s)))
            end_edge[i] = stack[-1][0]
            last = s
        self.n = len(parent)
        self.parent = np.array(parent, dtype=np.int64)
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.begin = np.concatenate(([0], np.cumsum(sizes)))
        self.tokens = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
        self.end_edge, self.depth_end = end_edge, np.array(depth_end, dtype=np.int64)
        todo = [e for e in range(self.n) if parent[e] < 0]
        self.levels = []
        while todo:
            self.levels.append(np.array(todo, dtype=np.int64))
            todo = [c for e in todo for c in children[e]]
        self.below = [np.array(c, dtype=np.int64) for c in children]

    def bounds(self, sizes: np.ndarray, live: np.ndarray) -> None:
        """Over the live sets below each edge: least and largest full size, and most shingles below the edge's end."""
        self.small = np.full(self.n, 1 << 60)
        self.deep = np.full(self.n, -1)
        np.minimum.at(self.small, self.end_edge[live], sizes[live])
        np.maximum.at(self.deep, self.end_edge[live], self.depth_end[self.end_edge[live]])
        for edges in reversed(self.levels):
            up = self.parent[edges]
            ok = up >= 0
            np.minimum.at(self.small, up[ok], self.small[edges[ok]])
            np.maximum.at(self.deep, up[ok], self.deep[edges[ok]])

    def overlaps(self, mark: np.ndarray, size: int, inside: int, num: int) -> np.ndarray:
        """For each edge the overlap of its path with the marked set, -1 where the walk didn't go.

        size, inside: the walker's full size and how many of its shingles can be met here.
        """
        out = np.full(self.n, -1, dtype=np.int64)
        edges = self.levels[0] if self.levels else np.empty(0, np.int64)
        before = np.zeros(len(edges), dtype=np.int64)
        while len(edges):
            go = self.deep[edges] >= 0
            edges, before = edges[go], before[go]
            if not len(edges):
                break
            lo, n = self.begin[edges], self.begin[edges + 1] - self.begin[edges]
            starts = np.concatenate(([0], np.cumsum(n)))
            hit = np.concatenate(([0], np.cumsum(mark[self.tokens[np.repeat(lo - starts[:-1], n) + np.arange(starts[-1])]])))
            now = before + hit[starts[1:]] - hit[starts[:-1]]
            out[edges] = now
            # What any set below can still reach, against what the smallest of them needs.
            reach = now + np.minimum(self.deep[edges] - self.depth_end[edges], inside - now)
            go = reach >= pair_need(size, self.small[edges], num)
            edges, now = edges[go], now[go]
            below = [self.below[e] for e in edges.tolist()]
            before = np.repeat(now, [len(b) for b in below])
            edges = np.concatenate(below) if below else np.empty(0, np.int64)
        return out


def link(sets: list[np.ndarray], comp: np.ndarray, num: int) -> list[tuple[int, int]]:
    """Pairs (i, j) that link sets of different components; enough of them to join all that can be joined.

    sets: sorted shingle hashes. comp: each set's component so far. A set that has walked is
    compared with all others; when only sets of one component have still to walk, all is known.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    every, count = np.unique(np.concatenate(sets), return_counts=True)
    shared = count > 1
    ordered = np.lexsort((every, -count))  # frequent first: alike sets share long paths
    number = np.empty(len(every), dtype=np.int64)
    number[ordered] = np.arange(len(every))
    local = []
    for s in sets:  # what no other set here has can't be part of an overlap
        at = np.searchsorted(every, s)
        local.append(np.sort(number[at[shared[at]]]))
    _, group = np.unique(comp, return_inverse=True)
    group = group.astype(np.int64)
    # A set that shares too little of itself links with nothing here.
    waiting = np.array([len(t) for t in local]) >= need(sizes, num)
    if waiting.sum() < 2:
        return []
    trie = Trie(local)
    trie.bounds(sizes, waiting)
    bound = int(waiting.sum())
    mark = np.zeros(len(every), dtype=np.int64)
    out = []
    while True:
        at = np.flatnonzero(waiting)
        if not len(at):
            return out
        known, n = np.unique(group[at], return_counts=True)
        if len(known) == 1:
            return out
        x = int(at[group[at] != known[n.argmax()]][0])
        waiting[x] = False
        live = waiting & (group != group[x])
        if waiting.sum() < bound // 2:
            trie.bounds(sizes, waiting)
            bound = int(waiting.sum())
        mark[local[x]] = 1
        overlap = trie.overlaps(mark, int(sizes[x]), len(local[x]), num)[trie.end_edge]
        mark[local[x]] = 0
        for y in np.flatnonzero(live & (overlap > 0) & (overlap >= pair_need(int(sizes[x]), sizes, num))).tolist():
            if group[y] != group[x]:
                out.append((x, y))
                group[group == group[y]] = group[x]


def _join(docs: DataFrame, scratch: Scratch, n: int, num: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, size, sig) of each row, and (sig, least, comp) of each class: its least key and its component."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))

    size = plain.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bits = min(CELL_BITS[1], CELL_BITS[0] + max(0, (size // CELL_BYTES).bit_length()))

    def cells(batches):
        total = np.zeros(1 << bits, dtype=np.int64)
        for b in slices(batches):
            cell, times = np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_sets(b.column(0).to_pylist(), n)]) >> np.uint64(64 - bits), return_counts=True)
            total[cell.astype(np.int64)] += times
        for part in range(32):
            cut = slice(part << bits - 5, part + 1 << bits - 5)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": [total[cut].tobytes()]})

    def add(frame: pa.Table) -> pa.Table:
        return pa.table({"part": frame.column("part").slice(0, 1), "n": [sum(np.frombuffer(x, dtype=np.int64) for x in frame.column("n").to_pylist()).tobytes()]})

    counts = np.zeros(1 << bits, dtype=np.uint8)  # a bounded size
    for r in plain.select("body").mapInArrow(cells, "part int, n binary").groupBy("part").applyInArrow(add, "part int, n binary").collect():
        counts[r.part << bits - 5 : r.part + 1 << bits - 5] = 4 * np.log2(np.frombuffer(r.n, dtype=np.int64) + 1)
    counts = spark.sparkContext.broadcast(counts)

    def signed(batches):
        for b in slices(batches):
            rows = []
            for s in shingle_sets(b.column(1).to_pylist(), n):
                size = len(s)
                first = 0 if not size else size - need(size, num) + slack(size, num)
                sig = _sign(s)
                rows.append((size, sig, rank(s, counts.value)[:first].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["key", "size", "sig", "first"])

    signs = scratch.save(plain.mapInArrow(signed, f"key {kind}, size long, sig long, first array<long>"), "signs")
    classes = scratch.save(signs.where("size > 0").groupBy("sig", "size").agg(F.min("key").alias("least"), F.first("first").alias("first")), "classes-first")
    # The lists of first shingles are the large part of these tables: each goes when no step needs its lists any more.
    signs = scratch.save(signs.drop("first"), "signed")
    scratch.drop("signs")
    # A class needs slack(least size that links) shared shingles among its first ones.
    size = F.col("size")
    least_size = F.ceil(size * num / 100)
    wanted = F.floor(least_size * (100 - num) / 200) + 1
    live, step, left = classes, 0, -1
    while True:
        each = live.select("sig", F.explode("first").alias("token"))
        twice = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
        have = each.join(twice, "token").groupBy("sig").agg(F.count("*").alias("have"))
        new = scratch.save(live.join(have, "sig").where(F.col("have") >= wanted).select("sig", "size", "least", "first"), f"live-{step}")
        now = new.count()
        if step:
            scratch.drop(f"live-{step - 1}")
        live, step = new, step + 1
        if now == left or not now or step >= 4:  # each round is exact; more only find less to drop
            break
        left = now
    classes = scratch.save(classes.select("sig", "least"), "classes")
    scratch.drop("classes-first")  # at least one round has made a table of its own
    each = live.select("sig", F.posexplode("first").alias("pos", "token"))
    twice = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = scratch.save(each.join(twice, "token"), "shared")
    live = scratch.save(live.select("sig", "size", "least"), "live")
    scratch.drop(f"live-{step - 1}")
    # Sets of the classes left, one for each class: rows of the class's least key, found by a join of narrow rows.
    near = live.select("sig", "size", "least")
    near = F.broadcast(near) if now <= MOST_BROADCAST else near
    bodies = plain.join(near, plain["key"].eqNullSafe(near["least"])).select("sig", "size", "body")

    def expanded(batches):
        for b in slices(batches):
            sig, size_, body = (c.to_pylist() for c in b.columns)
            got = [(g, s) for g, m, s in zip(sig, size_, shingle_sets(body, n), strict=True) if len(s) == m and _sign(s) == g]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1].tobytes() for g in got], pa.binary())], ["sig", "tokens"])

    sets = scratch.save(bodies.mapInArrow(expanded, "sig long, tokens binary").dropDuplicates(["sig"]), "sets")
    by_hash = Window.partitionBy("sig").orderBy(F.xxhash64("token"), "token")
    routes = scratch.save(shared.withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= ROUTES).select("sig", "token"), "routes")
    edges = _bucket_links(routes, sets, num)
    edges = scratch.save(edges, "edges-1")
    comps = scratch.save(components(edges, scratch, "stars-1"), "comps-1")
    # Pairs in different components whose first shingles meet and whose routes don't. Two that link share
    # ``wanted`` of their shared first shingles, so all but wanted - 1 of these, the rarest of the classes left, will do.
    by_df = Window.partitionBy("sig").orderBy("df", "token")
    ranked = shared.withColumn("rank", F.row_number().over(by_df)).withColumn("every", F.count("*").over(Window.partitionBy("sig")))
    of = live.select("sig", "size").join(comps, F.col("sig") == F.col("node"), "left").select("sig", "size", F.coalesce("component", "sig").alias("comp"))
    of = scratch.save(of.join(routes.groupBy("sig").agg(F.sort_array(F.collect_list("token")).alias("routes")), "sig", "left"), "of-live")
    heads = ranked.select("sig", "token", "pos", "rank", "every").join(of, "sig").where(F.col("rank") <= F.col("every") - wanted + 1)
    mixed = heads.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    # What has one component in all its buckets needs no look; others meet in blocks. Small buckets share a
    # group, dealt by hash, since a call for each would cost more than its comparisons.
    rest = _blocked(heads.join(mixed, "token"), "token")
    groups = max(64, shared.count() // ROWS_IN_GROUP)
    dealt = F.when(F.col("blocks") > 1, F.col("bucket")).otherwise(F.pmod(F.xxhash64(F.lit(9), "bucket"), F.lit(groups)))
    rest = rest.withColumn("group", dealt).select("group", "block", "bucket", "sig", "size", "pos", "comp", "routes")

    def missed(frame: pa.Table) -> pa.Table:
        bucket = frame.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        sig, size_, pos, comp = (frame.column(c).to_numpy()[order] for c in ("sig", "size", "pos", "comp"))
        lists = frame.column("routes").to_pylist()
        way = np.empty((len(sig), max(1, ROUTES)), dtype=np.int64)
        way[:] = -1 - np.arange(way.size).reshape(way.shape)  # no route: equal to nothing
        for i, k in enumerate(order.tolist()):
            r = lists[k] or ()
            way[i, : len(r)] = r
        cuts = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket))
        size_of = np.diff(cuts)

        def open_pairs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Which pairs of rows differ in component, can link, and share no route."""
            a, b = size_[i], size_[j]
            ok = (comp[i] != comp[j]) & (np.maximum(need(a, num), need(b, num)) <= np.minimum(a, b))
            ok &= np.minimum(a - pos[i], b - pos[j]) + np.minimum(pos[i], pos[j]) >= pair_need(a, b, num)
            at = np.flatnonzero(ok)
            same = (way[i[at]][:, :, None] == way[j[at]][:, None, :]).any(axis=(1, 2)) if len(at) else np.zeros(0, dtype=bool)
            return at[~same]

        two = cuts[:-1][size_of == 2]
        k = open_pairs(two, two + 1)
        a_out, b_out, token_out, sig_out = [sig[two[k]]], [sig[two[k] + 1]], [], []
        for g in np.flatnonzero(size_of > 2).tolist():
            rows_ = np.arange(cuts[g], cuts[g + 1])
            names, n = np.unique(comp[rows_], return_counts=True)
            waiting = np.ones(len(rows_), dtype=bool)
            left, found = PAIRS * len(rows_), []
            for i in np.flatnonzero(comp[rows_] != names[n.argmax()]).tolist():  # the largest component's own pairs need no look
                waiting[i] = False
                j = rows_[waiting]
                found.append((rows_[i], j[open_pairs(np.full(len(j), rows_[i]), j)]))
                left -= len(found[-1][1])
                if left < 0:
                    break
            if left < 0:  # too many to list: the bucket as a whole
                token_out.append(bucket[rows_])
                sig_out.append(sig[rows_])
            else:
                for i, j in found:
                    a_out.append(np.full(len(j), sig[i]))
                    b_out.append(sig[j])
        a, b = np.concatenate(a_out), np.concatenate(b_out)
        both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1) if len(a) else np.empty((2, 0), np.int64)
        token, whole = (np.concatenate([np.empty(0, np.int64), *x]) for x in (token_out, sig_out))
        # A pair is a bucket named after its first set.
        return pa.table({"token": pa.array(np.concatenate((both[0], both[0], token)), pa.int64()), "sig": pa.array(np.concatenate((both[0], both[1], whole)), pa.int64())})

    walkers = scratch.save(rest.groupBy("group", "block").applyInArrow(missed, "token long, sig long").distinct(), "walkers")
    more = scratch.save(_bucket_links(walkers.join(of.select("sig", "comp"), "sig"), sets, num), "edges-2")
    if more.limit(1).count():
        comps = scratch.save(components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), scratch, "stars-2"), "comps-2")
    least = classes.join(comps, F.col("sig") == F.col("node"), "left").select("sig", "least", F.coalesce("component", "sig").alias("comp"))
    of_class = scratch.save(least, "of-class")
    for name in ("classes", "shared", "sets", "routes", "of-live", "walkers", "edges-1", "edges-2"):
        scratch.drop(name)
    return signs, of_class


def ngram_components(docs: DataFrame, scratch: Scratch, n: int = 3, num: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: key, n_shingles, class_id, component_id.

    Sets link when 100 * intersection >= num * union. component_id is the least key
    reachable by links (null where all keys are null), class_id the least key of equal sets.
    Documents without words have an empty set and link with nothing, not even each other; a
    long text is one set, however large. A Jaccard of exactly num hundredths links. Rows with
    one key are documents of their own, repeated rows are copies; null keys take part. docs
    may be empty; its other columns are not read.
    """
    signs, of_class = _join(docs, scratch, n, num, key, text)
    names = of_class.groupBy("comp").agg(F.min("least").alias("component_id"))
    out = signs.join(of_class.join(names, "comp").drop("comp"), "sig", "left")
    own = F.when(F.col("size") == 0, F.col("key"))
    return out.select(F.col("key").alias(key), F.col("size").alias("n_shingles"), F.coalesce(own, F.col("least")).alias("class_id"), F.coalesce(own, F.col("component_id")).alias("component_id"))


def _sign(s: np.ndarray) -> int:
    """One number for a whole set; 0 for the empty one."""
    if not len(s):
        return 0
    spread = mix(s ^ np.uint64(0xA5A5))
    both = np.array([np.bitwise_xor.reduce(spread), spread.sum(dtype=np.uint64)], dtype=np.uint64)
    return int(mix(both[:1] * np.uint64(0x9E3779B97F4A7C15) + both[1:])[0].astype(np.int64)) or 1


def slack(size: int, num: int) -> int:
    """The l of a set: half of what may differ, and one."""
    return size * (100 - num) // 200 + 1


def _blocked(rows: DataFrame, name: str) -> DataFrame:
    """Rows with their bucket; one above MOST_IN_BUCKET rows becomes a bucket for each pair of its blocks."""
    sizes = rows.groupBy(F.col(name).alias("bucket")).agg(F.count("*").alias("n"))
    sizes = sizes.where("n > 1").select("bucket", F.ceil(F.col("n") / MOST_IN_BUCKET).cast("int").alias("blocks"))
    out = rows.join(sizes, F.col(name) == F.col("bucket")).withColumn("own", F.pmod(F.xxhash64(F.lit(5), "sig"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return out.withColumn("with", other).withColumn("block", F.least("own", "with") * F.col("blocks") + F.greatest("own", "with"))


def _bucket_links(routes: DataFrame, sets: DataFrame, num: int) -> DataFrame:
    """Edges (a, b) that join the sets of each bucket of routes(token, sig), which may hold their components so far (comp)."""
    routes = routes if "comp" in routes.columns else routes.withColumn("comp", F.col("sig"))
    rows = _blocked(routes, "token").select("bucket", "block", "sig", "comp").join(sets, "sig")

    def linked(frame: pa.Table) -> pa.Table:
        frame = frame.sort_by("sig")
        sig, comp = frame.column("sig").to_numpy(), frame.column("comp").to_numpy()
        found = link([np.frombuffer(t, dtype=np.uint64) for t in frame.column("tokens").to_pylist()], comp, num) if len(sig) > 1 else []
        if len(sig) > 1000:
            give_back()
        return pa.table({"a": pa.array(sig[[i for i, _ in found]], pa.int64()), "b": pa.array(sig[[j for _, j in found]], pa.int64())})

    return rows.groupBy("bucket", "block").applyInArrow(linked, "a long, b long")


def keep_one(docs: DataFrame, scratch: Scratch, n: int = 5, num: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that with the least key. Columns stay as they are.

    Rows without words stay. Null keys come after others. Of rows of a component with one
    key, one stays; rows with that key in other components are not touched.
    """
    _, of_class = _join(docs, scratch, n, num, key, text)
    first = of_class.groupBy("comp").agg(F.min(F.struct(F.col("least").isNull(), "least", "sig")).alias("f")).select(F.col("f.sig").alias("_sig"), F.col("f.least").alias("_key"))
    names = docs.columns
    at = names.index(text)

    def signed(batches):
        for b in slices(batches):
            sig = [_sign(s) for s in shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in b.column(at).to_pylist()], n)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sig, pa.int64())], [*names, "_sig"])

    with_sig = docs.mapInArrow(signed, StructType([*docs.schema.fields, StructField("_sig", LongType())]))
    held = with_sig.join(first, (with_sig["_sig"] == first["_sig"]) & with_sig[key].eqNullSafe(first["_key"]), "left_semi").dropDuplicates(["_sig"])
    return held.unionByName(with_sig.where("_sig = 0")).drop("_sig")


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard of 3-word shingles at 0.9."""
    out = ngram_components(table(spark, sf_dir, "documents"), Scratch(spark), 3, 90)
    return out.select("doc_id", "n_shingles", "component_id", "class_id")
