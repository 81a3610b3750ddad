"""Jaccard join of n-gram sets over prefix trees.

The join is exact and runs in three steps.

1. Each document becomes the set of its word n-grams, as 64-bit hashes in one
   global order: n-grams that are common in a sample of documents come last
   (any order gives the same result; this one keeps groups small). Equal sets
   form a class and go on as one.
2. Two sets that reach the threshold share an n-gram within their first
   ``n - ceil(t n) + 1`` ones. Classes meet by those n-grams; of each meeting
   only pairs that may still reach the threshold are linked, judged by their
   sizes and by histograms of their hashes, whose overlap is an upper bound of
   the sets' overlap. Linked classes form candidate groups. An n-gram known to
   be very common is dealt to pairs of blocks beforehand.
3. The sets of a candidate group meet once, in a prefix tree. A set probes the
   tree from its root: overlap counted on a shared path serves all sets below
   it, and a subtree is left as soon as the n-grams that remain on both sides
   cannot reach the threshold. Subtrees whose sets all are in the probe's
   component already are left, too, as only components are asked for. Large
   candidate groups are dealt to pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import small_batches, stage, text_hash, text_or_empty, utf8
from themeloom.operators.components import star_components

ORDER_SAMPLE = 20_000   # documents whose n-grams set the global order, at least
ORDER_SHARE = 16        # or one document in this many, if those are more
COMMON = 1 << 18        # n-grams that the order knows, at most
BLOCK = 4096            # classes that meet by one n-gram in one task, about
GROUP_SETS = 2048       # sets in a block of a candidate group, about
GROUP_GRAMS = 1 << 19   # n-grams in a block of a candidate group, about

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def gram_set(text: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``width``-word n-grams, A-Z folded.

    A text with fewer words is one n-gram; one without words has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=width)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    x = np.zeros(n, np.uint64)
    for i in range(width):  # an order-dependent combination, well mixed at each word
        x = (x ^ h[i:i + n]) * _MIX[i % len(_MIX)]
        x ^= x >> np.uint64(29)
    return np.unique(x)


class GramOrder:
    """The global order: by frequency in the sample (0 if not listed), then by hash."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, scale: float):
        by = np.argsort(grams)
        self.grams, self.counts, self.scale = grams[by], counts[by], scale

    def ranks(self, s: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.grams, s), len(self.grams) - 1)
        return np.where(self.grams[at] == s, self.counts[at], 0)

    def first(self, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``n`` of a sorted set in this order, and about how many blocks each is dealt to."""
        rank = self.ranks(s)
        by = np.argsort(rank, kind="stable")[:n]
        return s[by], np.maximum(1, np.ceil(rank[by] * self.scale / BLOCK)).astype(np.int64)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def reaches(overlap, a, b, percent: int):
    """Jaccard of sets of sizes ``a`` and ``b`` is ``percent`` / 100 or more; in whole numbers."""
    return overlap * (100 + percent) >= percent * (a + b)


def histogram(s: np.ndarray) -> bytes:
    """Counts of hashes by bucket, about eight a bucket, at most 1,024 buckets.

    Buckets follow low bits, so a histogram folds into one of half the length."""
    size = 16
    while size < 1024 and size * 8 < len(s):
        size *= 2
    counts = np.bincount((s >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return counts.astype("<u4").tobytes() if counts.max() > 255 else counts.astype(np.uint8).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    """A histogram as numbers. Read as bytes, one of 32-bit counts never sums to ``n``."""
    small = np.frombuffer(raw, np.uint8)
    return small.astype(np.int64) if int(small.sum()) == n else np.frombuffer(raw, "<u4").astype(np.int64)


class UnionFind:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Sum of the lesser counts, the longer histogram folded to the shorter's length."""
    if len(a) != len(b):
        short, long = (a, b) if len(a) < len(b) else (b, a)
        a, b = short, long.reshape(-1, len(short)).sum(0)
    return int(np.minimum(a, b).sum())


def possible_links(sizes: np.ndarray, hists: list[np.ndarray], percent: int, side: np.ndarray | None = None):
    """A spanning forest of the pairs that the bounds do not rule out.

    ``side``: only pairs of different sides count."""
    links = []
    if len(sizes) <= 8:
        uf, n = UnionFind(len(sizes)), sizes.tolist()
        for i in range(len(n)):
            for j in range(i):
                if (reaches(min(n[i], n[j]), n[i], n[j], percent) and (side is None or side[i] != side[j])
                        and uf.find(i) != uf.find(j) and reaches(overlap_bound(hists[i], hists[j]), n[i], n[j], percent)):
                    uf.join(i, j)
                    links.append((i, j))
        return links
    component = np.arange(len(sizes))
    lengths = np.array([len(h) for h in hists])
    for length in np.unique(lengths):
        # lengths are powers of two; those of sizes in reach of each other differ by less than 200 / percent
        own = np.flatnonzero(lengths == length)
        at = np.concatenate([own, np.flatnonzero((lengths > length) & (lengths * percent < 200 * length))])
        rows = np.stack([hists[i].reshape(-1, length).sum(0) for i in at])
        for k, i in enumerate(own):
            rest = np.arange(k + 1, len(at))
            rest = rest[component[at[rest]] != component[i]]
            if side is not None:
                rest = rest[side[at[rest]] != side[i]]
            n = sizes[at[rest]]
            fits = reaches(np.minimum(n, sizes[i]), n, sizes[i], percent)
            rest, n = rest[fits], n[fits]
            bound = np.minimum(rows[rest], rows[k]).sum(1)
            for j in at[rest[reaches(bound, n, sizes[i], percent)]]:
                if component[j] != component[i]:
                    component[component == component[j]] = component[i]
                    links.append((int(i), int(j)))
    return links


class Node:
    __slots__ = ("label", "below", "ends", "least", "most", "rest", "member", "alone")

    def __init__(self, label: np.ndarray, size: int, member: int):
        self.label, self.below, self.ends = label, {}, []
        self.least = self.most = size   # sizes of the sets below
        self.rest = len(label)          # most n-grams from here down
        self.member, self.alone = member, True  # all sets below are in this member's component


class SetTree:
    """Sets in global order, in a prefix tree with whole paths as labels."""

    def __init__(self, percent: int, uf: UnionFind):
        self.percent, self.uf, self.top = percent, uf, {}

    def add(self, s: np.ndarray, member: int) -> None:
        at, pos, size = self.top, 0, len(s)
        while True:
            first = int(s[pos])
            node = at.get(first)
            if node is None:
                at[first] = node = Node(s[pos:], size, member)
                node.ends.append(member)
                return
            label, left = node.label, s[pos:]
            m = min(len(label), len(left))
            differ = np.flatnonzero(label[:m] != left[:m])
            shared = int(differ[0]) if len(differ) else m
            if shared < len(label):  # split: the rest of the label moves down
                lower = Node(label[shared:], node.least, node.member)
                lower.below, lower.ends, lower.alone = node.below, node.ends, node.alone
                lower.most, lower.rest = node.most, node.rest - shared
                node.label, node.below, node.ends = label[:shared], {int(label[shared]): lower}, []
            node.least, node.most = min(node.least, size), max(node.most, size)
            node.rest = max(node.rest, len(left))
            node.alone = node.alone and self.uf.find(node.member) == self.uf.find(member)
            pos += shared
            if pos == size:
                node.ends.append(member)
                return
            at = node.below

    def probe(self, s: np.ndarray, member: int, holds: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
        """Links of ``s`` to sets of other components; ``holds`` marks its n-grams."""
        links, size, find = [], len(s), self.uf.find
        stack = [(n, 0) for n in self.top.values()]
        if size and int(s[0]) in self.top:  # the path of the set itself comes first
            stack.append((self.top[int(s[0])], 0))
        while stack:
            node, overlap = stack.pop()
            if node.alone and find(node.member) == find(member):
                continue
            likest = min(max(size, node.least), node.most)
            if not reaches(min(size, likest), size, likest, self.percent):
                continue
            ahead = size - int(np.searchsorted(s, node.label[0]))
            if not reaches(overlap + min(ahead, node.rest), size, node.least, self.percent):
                continue
            overlap += int(holds[node.label].sum())
            for other in node.ends:
                if reaches(overlap, size, int(sizes[other]), self.percent) and self.uf.join(member, other):
                    links.append((member, other))
            stack += [(n, overlap) for n in node.below.values()]
        return links


def tree_links(sets: list[np.ndarray], order: GramOrder, percent: int, side: np.ndarray | None = None):
    """Links between sets (indexes) that span each component of the join.

    ``side`` 0 fills the tree and 1 probes; without it all do both."""
    grams, flat = np.unique(np.concatenate(sets), return_inverse=True)
    place = np.empty(len(grams), np.int64)
    place[np.argsort(order.ranks(grams), kind="stable")] = np.arange(len(grams))
    ends = np.cumsum([len(s) for s in sets])
    ordered = [np.sort(x) for x in np.split(place[flat], ends[:-1])]
    sizes = np.array([len(s) for s in sets])
    uf = UnionFind(len(sets))
    tree, links, holds = SetTree(percent, uf), [], np.zeros(len(grams), bool)
    for i in range(len(sets)) if side is None else np.argsort(side, kind="stable"):
        i, s = int(i), ordered[int(i)]
        if side is None or side[i]:
            holds[s] = True
            links += tree.probe(s, i, holds, sizes)
            holds[s] = False
        if side is None or not side[i]:
            tree.add(s, i)
    return links


def _grams_of(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            sets = [gram_set(t, width) for t in utf8(b, "text")]
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            yield pa.record_batch([pa.array(flat.view(np.int64))], names=["gram"])
    return run


def gram_order(docs: DataFrame, width: int) -> GramOrder:
    """The order from a sample of documents by hash of their ids."""
    rows = docs.count()
    share = max(1 / ORDER_SHARE, ORDER_SAMPLE / max(1, rows))
    part = docs if share >= 1 else docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    common = (part.select("text").mapInArrow(_grams_of(width), "gram bigint").groupBy("gram").count()
              .filter("count >= 4").orderBy(F.desc("count"), "gram").limit(COMMON).toPandas())
    return GramOrder(common["gram"].to_numpy(np.int64).view(np.uint64), common["count"].to_numpy(np.int64),
                     1 / min(1.0, share))


SETS = "doc_id bigint, text_hash bigint, n bigint, digest binary, prefix binary, blocks binary, hist binary"


def _sets_of(width: int, percent: int, order: GramOrder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SETS.split(", ")]
        for b in small_batches(batches):
            rows = []
            for t in utf8(b, "text"):
                s = gram_set(t, width)
                if not len(s):
                    rows.append((0, None, None, None, None))
                    continue
                prefix, blocks = order.first(s, prefix_size(len(s), percent))
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), prefix.tobytes(),
                             blocks.astype("<i4").tobytes() if blocks.max() > 1 else None, histogram(s)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.record_batch([b.column(b.schema.get_field_index(c)) for c in names[:2]] + [pa.array(cols[0], pa.int64())]
                                  + [pa.array(c, pa.binary()) for c in cols[1:]], names=names)
    return run


POSTING = "gram bigint, low int, high int, block int, cls bigint"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per n-gram of a prefix; a very common one gives a row per pair of
    blocks that the class's own block stands in."""
    names = [x.split()[0] for x in POSTING.split(", ")]
    for b in small_batches(batches, 1 << 20):
        grams, low, high, block, cls = [], [], [], [], []
        for c, prefix, blocks in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("cls", "prefix", "blocks"))):
            g = np.frombuffer(prefix, np.int64)
            k = np.frombuffer(blocks, "<i4").astype(np.int64) if blocks else np.ones(len(g), np.int64)
            at = np.repeat(np.arange(len(g)), k)
            other = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
            own = (np.uint64(c) * _MIX[0] >> np.uint64(33)).astype(np.int64) % k[at]
            grams.append(g[at])
            low.append(np.minimum(own, other))
            high.append(np.maximum(own, other))
            block.append(own)
            cls.append(np.full(len(at), c, np.int64))
        if grams:
            yield pa.record_batch([pa.array(np.concatenate(x), t) for x, t in zip(
                (grams, low, high, block, cls), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=names)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut batches sorted by ``keys`` into tables that hold whole runs of equal keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        if held and any(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() != c[0] for k, c in zip(keys, cols)):
            yield pa.Table.from_batches(held)
            held = []
        if len(starts):
            last = int(starts[-1])
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = [b.slice(last)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for k in keys:
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


MEETING = ["gram", "low", "high"]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of n-grams that more than one class holds."""
    for t in _runs(batches, MEETING):
        at = _starts(t, MEETING)
        size = np.diff(at)
        keep = np.repeat(size > 1, size)
        yield from t.filter(pa.array(keep)).combine_chunks().to_batches()


def _candidates(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, MEETING):
            at = _starts(t, MEETING)
            cls, n, hist = t.column("cls").to_numpy(), t.column("n").to_numpy(), t.column("hist").to_pylist()
            low, high, block = (t.column(c).to_numpy() for c in ("low", "high", "block"))
            u, v = [], []
            for a, z in zip(at[:-1], at[1:]):
                if z - a < 2:
                    continue
                side = block[a:z] if low[a] != high[a] else None
                hists = [unpacked(hist[i], int(n[i])) for i in range(a, z)]
                for i, j in possible_links(n[a:z], hists, percent, side):
                    u.append(cls[a + i])
                    v.append(cls[a + j])
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
    return run


def _verified(width: int, percent: int, order: GramOrder):
    keys = ["component", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, keys):
            at = _starts(t, keys)
            cls, low, high, block = (t.column(c).to_numpy() for c in ("cls", "low", "high", "block"))
            texts = t.column("text")
            u, v = [], []
            for a, z in zip(at[:-1], at[1:]):
                if z - a < 2:
                    continue
                sets = [gram_set((x.as_py() or "").encode(), width) for x in texts[a:z]]
                side = None if low[a] == high[a] else (block[a:z] == high[a]).astype(np.int64)
                for i, j in tree_links(sets, order, percent, side):
                    u.append(cls[a + i])
                    v.append(cls[a + j])
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
    return run


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs``.

    Documents link when Jaccard of their n-gram sets is ``percent`` / 100 or
    more. ``component_id`` is the least doc_id that links reach. A null text
    has no words; a set without n-grams links with nothing, and its row keeps
    its own id. Rows that repeat an id are told apart by their sets. A row
    without an id takes part and has the component of the others, or null.
    """
    docs = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_hash", text_hash())
    order = gram_order(docs, width)
    sets = stage(docs.mapInArrow(_sets_of(width, percent, order), SETS), "gram-sets")
    classes = stage(sets.filter("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("least"),
        F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("least_hash"))
                    .withColumn("cls", F.monotonically_increasing_id()), "gram-classes")
    # one row per class: that of its least id (rows that repeat it are equal)
    holder = (F.col("s.digest") == F.col("c.digest")) & F.col("s.doc_id").eqNullSafe(F.col("c.least")) & (
        F.col("s.text_hash") == F.col("c.least_hash"))
    whole = (sets.alias("s").join(classes.alias("c").hint("shuffle_hash"), holder)
             .select("cls", "s.n", "prefix", "blocks", "hist"))
    shared = stage(whole.select("cls", "prefix", "blocks").mapInArrow(_postings, POSTING)
                   .repartition(*MEETING).sortWithinPartitions(*MEETING).mapInArrow(_shared, POSTING), "gram-shared")
    meeting = (shared.join(whole.select("cls", "n", "hist"), "cls").repartition(*MEETING).sortWithinPartitions(*MEETING))
    near = star_components(meeting.mapInArrow(_candidates(percent), "u bigint, v bigint"))
    near = stage(near.withColumnRenamed("node", "cls").join(classes, "cls"), "gram-near")
    links = star_components(_verified_links(docs, sets, near, width, percent, order))
    named = links.withColumnRenamed("node", "cls").join(classes, "cls", "right")
    named = stage(named.withColumn("component", F.coalesce("component", "cls")), "gram-named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_digest = stage(named.join(least, "component").select("digest", "component_id"), "gram-labels")
    return (sets.select("doc_id", "n", "digest").join(by_digest, "digest", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def _verified_links(docs: DataFrame, sets: DataFrame, near: DataFrame, width: int, percent: int, order: GramOrder) -> DataFrame:
    sizes = sets.select("digest", "n").filter("n > 0").distinct()
    near = near.join(sizes, "digest")
    blocks = stage(near.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / GROUP_SETS), F.ceil(F.sum("n") / GROUP_GRAMS)).alias("blocks")), "gram-blocks")
    dealt = (near.join(blocks, "component")
             .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
             .select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                     "block", "cls", "least", "digest"))
    holders = near.select("cls", "least", "least_hash", "digest")
    # by id and text: rows without an id do not all meet
    holder = F.col("d.doc_id").eqNullSafe(F.col("h.least")) & (F.col("d.text_hash") == F.col("h.least_hash"))
    texts = (docs.alias("d").join(holders.alias("h").hint("shuffle_hash"), holder)
             .select("h.cls", "digest", "d.text")
             .mapInArrow(_holding(width), "cls bigint, text string").dropDuplicates(["cls"]))
    keys = ["component", "low", "high"]
    return (dealt.select(*keys, "block", "cls").join(texts, "cls").repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(_verified(width, percent, order), "u bigint, v bigint"))


def _holding(width: int):
    """Rows whose text has the digest that is looked for (an id may stand in more rows)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            want = b.column(b.schema.get_field_index("digest")).to_pylist()
            keep = [xxhash.xxh3_128_digest(gram_set(t, width).tobytes()) == d for t, d in zip(utf8(b, "text"), want)]
            yield b.select(["cls", "text"]).filter(pa.array(keep, pa.bool_()))
    return run
