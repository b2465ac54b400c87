"""Near-duplicate texts: fingerprints in sharded BK-trees, then exact similarity of shingle sets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnstone.runtime import broadcast_if_small, join_few, materialize

#: Words of a shingle, least words of a text, least similarity of a pair.
SHINGLE, MIN_WORDS, SIMILARITY = 3, 50, 0.5
#: A text goes to one shard for each band of rows minima: a pair at similarity s shares no shard with
#: probability (1 - s ** ROWS) ** BANDS, 0.16 percent at 0.5 and less than 0.001 percent at 0.6.
BANDS, ROWS = 100, 4
#: Bits of a fingerprint (one of each of as many minima), and the radius of the search. Two texts of
#: similarity s differ in (1 - s) / 2 of the bits: at 0.5 in 48, with a standard deviation of 6.
BITS, RADIUS = 192, 70
#: Most fingerprints of one tree; a larger shard is cut into blocks that are searched pair by pair.
BLOCK = 4000
#: Classes of equal texts up to this size are written out in pairs; of a larger one each member, and
#: each text similar to it, is paired with one representative of another asset. Membership is in
#: groups(), the links between classes in the links themselves.
EXPANDED = 200

_WORDS = re.compile(r"[^\W_]+")
_KNOWN: dict[str, int] = {}


def shingles(text: str, size: int = SHINGLE) -> tuple[int, int, np.ndarray]:
    """(number of words, hash of the sequence of words, sorted different hashes of the shingles)."""
    import xxhash

    if len(_KNOWN) > 500_000:
        _KNOWN.clear()
    ids = []
    for w in _WORDS.findall(text.lower()):
        h = _KNOWN.get(w)
        if h is None:
            h = _KNOWN[w] = xxhash.xxh64_intdigest(w)
        ids.append(h)
    a = np.array(ids, np.uint64)
    whole = xxhash.xxh64_intdigest(a.tobytes()) - (1 << 63)
    if len(a) < size:
        return len(a), whole, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = a[: len(a) - size + 1].copy()
        for k in range(1, size):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + a[k : len(a) - size + 1 + k]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return len(a), whole, np.unique(h ^ (h >> np.uint64(31)))


_RNG = np.random.default_rng(20)
_MULTIPLY = (_RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32)
_MIX = _RNG.integers(0, 1 << 63, ROWS, np.uint64) | np.uint64(1)


def fingerprint(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(a key for each band, the bits) of a set of shingles."""
    low = hashes.astype(np.uint32)
    minima = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(minima, (low[at : at + 2048, None] * _MULTIPLY + _ADD).min(0), out=minima)
    with np.errstate(over="ignore"):
        keys = ((minima.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _MIX).sum(1)
    bits = np.packbits((minima[:BITS] >> np.uint32(9)) & np.uint32(1)).tobytes()
    return (keys >> np.uint64(32)).astype(np.uint32).view(np.int32), bits


_ITEM = "item_kind string, item_id string, asset_id string, class_id bigint, n_shingles int, bands array<int>, bits binary"


def fingerprints(items: DataFrame) -> DataFrame:
    """items (item_kind, item_id, asset_id, text) of at least MIN_WORDS words, with class_id (equal
    for equal sequences of words), bands and bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for kind, item, asset, text in zip(b.item_kind, b.item_id, b.asset_id, b.text):
                n, whole, hashes = shingles(text)
                if n >= MIN_WORDS:
                    rows.append((kind, item, asset, whole, len(hashes), *fingerprint(hashes)))
            yield pd.DataFrame(rows, columns=["item_kind", "item_id", "asset_id", "class_id", "n_shingles", "bands", "bits"])

    long_enough = items.where(F.col("item_id").isNotNull() & (F.length("text") >= 2 * MIN_WORDS - 1))
    return long_enough.select("item_kind", "item_id", "asset_id", "text").mapInPandas(run, _ITEM)


class BKTree:
    """Fingerprints in a tree: the child of a node under the key d has Hamming distance d to it."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int, item: tuple) -> None:
        if self.root is None:
            self.root = [value, [item], {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                node[1].append(item)
                return
            child = node[2].get(d)
            if child is None:
                node[2][d] = [value, [item], {}]
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[tuple]:
        """The items at most radius away: only edges whose key differs by at most radius from the
        distance to their node can lead to them."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            d = (node[0] ^ value).bit_count()
            if d <= radius:
                yield from node[1]
            stack.extend(child for key, child in node[2].items() if -radius <= key - d <= radius)


def _near(a: tuple, b: tuple) -> bool:
    """Whether two numbers of shingles allow the similarity."""
    return min(a[1], b[1]) >= SIMILARITY * max(a[1], b[1])


_SHARD = "shard bigint, place bigint, class_a bigint, class_b bigint, n_shingles int, bits binary"


def _search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard (shard, class_id, n_shingles, bits) to candidate pairs; the rows of a
    shard that is too large for one tree are given back with their place in it, class_b null."""
    shard, place, tree, kept = None, 0, BKTree(), []
    names = ["shard", "place", "class_a", "class_b", "n_shingles", "bits"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        if not batch.num_rows:
            continue
        out = []
        shards = batch.column(0).to_numpy()
        same = shards[1:] == shards[:-1]
        single = ~np.concatenate([[False], same]) & ~np.concatenate([same, [False]])
        single[[0, -1]] = False  # may go on in another batch
        keep = np.flatnonzero(~single)
        rows = batch.take(pa.array(keep)).to_pydict()
        for s, c, n, bits in zip(*rows.values()):
            if s != shard:
                shard, place, tree, kept = s, 0, BKTree(), []
            value, item = int.from_bytes(bits), (c, n)
            if place < BLOCK:
                for other in tree.within(value, RADIUS):
                    if _near(item, other):
                        out.append((s, 0, min(c, other[0]), max(c, other[0]), 0, None))
                tree.add(value, item)
                kept.append((s, place, c, None, n, bits))
            else:
                out.extend(kept)
                kept = []
                out.append((s, place, c, None, n, bits))
            place += 1
        columns = list(zip(*out)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=names)


def _search_blocks(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Candidates between two blocks of one large shard: one block as a tree, the other as queries."""
    tree, out = BKTree(), []
    inside = rows[rows.role == 0]
    for c, n, bits in zip(inside.class_a, inside.n_shingles, inside.bits):
        tree.add(int.from_bytes(bits), (c, n))
    asking = rows[rows.role == 1]
    for c, n, bits in zip(asking.class_a, asking.n_shingles, asking.bits):
        out += [(min(c, o[0]), max(c, o[0])) for o in tree.within(int.from_bytes(bits), RADIUS) if o[0] != c and _near((c, n), o)]
    return pd.DataFrame(out, columns=["class_a", "class_b"])


def candidates(classes: DataFrame) -> DataFrame:
    """(item_kind, class_a, class_b), different pairs whose fingerprints are within RADIUS of each other in some shard.

    classes: item_kind, class_id, n_shingles, bands, bits, one row a class. Shards are spread by
    hash; a shard is read in order, so it needs no more memory than one tree of BLOCK fingerprints."""
    kind = F.when(F.col("item_kind") == "chunk", 0).otherwise(1)
    rows = classes.select("class_id", "n_shingles", "bits", kind.alias("kind"), F.posexplode("bands").alias("band", "key"))
    shard = F.shiftleft((F.col("band") * 2 + F.col("kind")).cast("bigint"), 32) + F.col("key").cast("bigint") + (1 << 31)
    spread = rows.select(shard.alias("shard"), "class_id", "n_shingles", "bits").repartition("shard").sortWithinPartitions("shard")
    searched = materialize(spread.mapInArrow(_search_shards, _SHARD), "shards")
    kind_of = F.when(F.pmod(F.shiftright("shard", 32), F.lit(2)) == 0, "chunk").otherwise("revision").alias("item_kind")
    pairs = searched.where(F.col("class_b").isNotNull()).select(kind_of, "class_a", "class_b")
    large = searched.where(F.col("class_b").isNull())
    if not large.isEmpty():
        blocks = large.withColumn("block", F.floor(F.col("place") / BLOCK))
        last = blocks.groupBy("shard").agg(F.max("block").alias("last"))
        blocks = blocks.join(broadcast_if_small(last), "shard")
        member = blocks.select("*", F.col("block").alias("tree"), F.explode(F.sequence("block", "last")).alias("query"), F.lit(0).alias("role"))
        asking = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), "block")).alias("tree"), F.col("block").alias("query"), F.lit(1).alias("role"))
        found = member.unionByName(asking).groupBy("shard", "tree", "query").applyInPandas(lambda key, rows: _search_blocks(key, rows).assign(shard=key[0]), "class_a bigint, class_b bigint, shard bigint")
        pairs = pairs.unionByName(found.select(kind_of, "class_a", "class_b"))
    return pairs.distinct()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        sim = [jaccard(shingles(x)[2], shingles(y)[2]) for x, y in zip(b.text_a, b.text_b)]
        yield b[["item_kind", "class_a", "class_b"]].assign(similarity=sim)


def current_items(assets: DataFrame, revisions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_kind, item_id, asset_id, text): current revisions and their chunks. The row of an asset
    with the latest updated_at has its current revision; of equal times the largest id holds."""
    pointers = assets.where(F.col("asset_id").isNotNull()).groupBy("asset_id").agg(F.max(F.struct("updated_at", F.col("current_revision_id").alias("revision_id"))).alias("x")).select("asset_id", "x.revision_id").where(F.col("revision_id").isNotNull())
    pointers = materialize(pointers, "pointers")
    enough, key = 2 * MIN_WORDS - 1, ["asset_id", "revision_id"]
    revision = join_few(revisions.where(F.length("markdown") >= enough), pointers, key, "left_semi").select(F.lit("revision").alias("item_kind"), F.col("revision_id").alias("item_id"), "asset_id", F.col("markdown").alias("text"))
    chunk = join_few(chunks.where(F.length("text") >= enough), pointers, key, "left_semi").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "asset_id", "text")
    return revision.unionByName(chunk)


def near_duplicates(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, members): item_kind, class_a, class_b, similarity of classes of equal texts that are
    similar, and item_kind, class_id, item_id, asset_id of the classes' members.

    Texts under MIN_WORDS words and null texts belong to no class, repeated rows count once, empty
    tables give empty results. Every link is checked against the whole shingle sets of the texts."""
    prints = materialize(fingerprints(items), "fingerprints")
    members = prints.select("item_kind", "class_id", "item_id", "asset_id").distinct()
    classes = prints.groupBy("item_kind", "class_id").agg(F.min("item_id").alias("item_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    pairs = materialize(candidates(classes.drop("item_id")), "candidates")
    ends = pairs.select("item_kind", F.explode(F.array("class_a", "class_b")).alias("class_id")).distinct()
    representatives = prints.join(broadcast_if_small(ends), ["item_kind", "class_id"], "left_semi").groupBy("item_kind", "class_id").agg(F.min("item_id").alias("item_id"))
    texts = join_few(items, representatives, ["item_kind", "item_id"]).select("item_kind", "class_id", "text").dropDuplicates(["item_kind", "class_id"])
    texts = materialize(texts, "candidate-texts")
    a = texts.withColumnsRenamed({"class_id": "class_a", "text": "text_a"})
    b = texts.withColumnsRenamed({"class_id": "class_b", "text": "text_b"})
    checked = pairs.join(a, ["item_kind", "class_a"]).join(b, ["item_kind", "class_b"])
    links = checked.mapInPandas(_verify, "item_kind string, class_a bigint, class_b bigint, similarity double").where(F.col("similarity") >= SIMILARITY)
    return materialize(links, "links"), materialize(members, "members")


def _different(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def representatives(members: DataFrame) -> DataFrame:
    """(item_kind, class_id, n, first, asset_first, second, asset_second): of each class of more than
    EXPANDED members the least member, and the least of the other assets, null if there is none."""
    key = ["item_kind", "class_id"]
    large = members.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("item_id", F.col("asset_id"))).alias("x")).where(F.col("n") > EXPANDED)
    large = materialize(large.select(*key, "n", F.col("x.item_id").alias("first"), F.col("x.asset_id").alias("asset_first")), "large-classes")
    others = members.join(broadcast_if_small(large), key).where(_different("asset_id", "asset_first")).groupBy(*key).agg(F.min(F.struct("item_id", "asset_id")).alias("y"))
    return large.join(broadcast_if_small(others), key, "left").select(*key, "n", "first", "asset_first", F.col("y.item_id").alias("second"), F.col("y.asset_id").alias("asset_second"))


def pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(item_kind, id_a, id_b, similarity): the pairs of items of different assets.

    Classes of more than EXPANDED equal texts count with two representatives of different assets:
    each member, and each item of a linked class, is paired with the first, or if that is of its own
    asset with the second. So no item and no link between classes is lost that has different assets."""
    key = ["item_kind", "class_id"]
    large = materialize(representatives(members), "representatives")
    small = members.join(broadcast_if_small(large.select(*key)), key, "left_anti")
    null = F.lit(None).cast("string")
    shown = small.select(*key, F.col("item_id").alias("first"), F.col("asset_id").alias("asset_first"), null.alias("second"), null.alias("asset_second")).unionByName(large.drop("n"))
    sides = [shown.select("item_kind", F.col("class_id").alias(f"class_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("first", "asset_first", "second", "asset_second"))) for s in "ab"]
    met = links.join(sides[0], ["item_kind", "class_a"]).join(sides[1], ["item_kind", "class_b"])

    def pair(a: str, b: str) -> Column:
        return F.struct(F.col(a).alias("x"), F.col(b).alias("y"))

    chosen = (
        F.when(_different("asset_first_a", "asset_first_b"), pair("first_a", "first_b"))
        .when(F.col("second_b").isNotNull() & _different("asset_first_a", "asset_second_b"), pair("first_a", "second_b"))
        .when(F.col("second_a").isNotNull() & _different("asset_second_a", "asset_first_b"), pair("second_a", "first_b"))
    )
    between = met.select("item_kind", chosen.alias("p"), "similarity").where(F.col("p").isNotNull()).select("item_kind", "p.x", "p.y", "similarity")
    several = small.join(members.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1).drop("n"), key, "left_semi")
    left = several.select(*key, F.col("item_id").alias("x"), F.col("asset_id").alias("asset_x"))
    right = several.select(*key, F.col("item_id").alias("y"), F.col("asset_id").alias("asset_y"))
    equal = left.join(right, key).where((F.col("x") < F.col("y")) & _different("asset_x", "asset_y")).select("item_kind", "x", "y")
    other = F.when(_different("asset_id", "asset_first"), F.col("first")).otherwise(F.col("second"))
    of_large = members.join(broadcast_if_small(large), key).select("item_kind", F.col("item_id").alias("x"), other.alias("y")).where(F.col("y") != F.col("x"))
    both = between.unionByName(equal.unionByName(of_large).withColumn("similarity", F.lit(1.0)))
    return both.select("item_kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity").distinct()


def components(links: DataFrame) -> DataFrame:
    """(item_kind, class_id, group_id): the connected components of the links, each known by its
    least class. Large and small stars in turn: every node is tied to the least of its neighbours,
    in a number of rounds that grows with the logarithm of the longest chain. No node's neighbours
    are ever gathered; only minima are."""
    key = ["item_kind", "u"]
    edges = materialize(links.select("item_kind", F.greatest("class_a", "class_b").alias("u"), F.least("class_a", "class_b").alias("v")).where("u <> v").distinct(), "edges")

    def star(edges: DataFrame, both: bool) -> DataFrame:
        around = edges.unionByName(edges.select("item_kind", F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
        least = around.groupBy(*key).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        met = around.join(least, key)
        tied = met.where(F.col("v") > F.col("u")) if both else met
        out = tied.select("item_kind", F.col("v").alias("u"), F.col("m").alias("v"))
        if not both:
            out = out.unionByName(least.select("item_kind", "u", F.col("m").alias("v")))
        return out.where(F.col("u") != F.col("v")).distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("item_kind", "u", "v"))).first())

    before = state(edges)
    while True:
        edges = materialize(star(star(edges, True), False), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    nodes = links.select("item_kind", F.explode(F.array("class_a", "class_b")).alias("class_id")).distinct()
    joined = nodes.join(edges.select("item_kind", F.col("u").alias("class_id"), F.col("v").alias("group_id")), ["item_kind", "class_id"], "left")
    return joined.select("item_kind", "class_id", F.coalesce("group_id", "class_id").alias("group_id"))


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(item_kind, item_id, class_id, group_id, n_links): every item, its class of equal texts, its
    group and the number of classes that its own is linked to; an item alone is its own group."""
    degree = links.select("item_kind", F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("item_kind", "class_id").agg(F.count("*").alias("n_links"))
    of_class = components(links).join(degree, ["item_kind", "class_id"])
    met = members.join(of_class, ["item_kind", "class_id"], "left")
    return met.select("item_kind", "item_id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
