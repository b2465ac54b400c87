"""Near-duplicates against all pairs, trees against a scan, components against a search."""

import random

from tarnstone.llm import near_duplicates as nd

WORDS = [f"w{i}" for i in range(400)]


def jaccard(a, b):
    def grams(t):
        w = nd._WORDS.findall(t.lower())
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def corpus():
    random.seed(12)
    rows = []
    for i in range(60):
        words = random.choices(WORDS, k=random.randint(60, 120))
        rows.append(("chunk", f"i{i:03}", f"a{i}", " ".join(words)))
        if i % 2:
            edited = list(words)
            for _ in range(random.randint(0, 12)):
                edited[random.randrange(len(edited))] = random.choice(WORDS)
            rows.append(("chunk", f"j{i:03}", f"b{i}" if i % 4 == 1 else f"a{i}", ", ".join(edited).upper()))
    rows += [("revision", "r1", "x", rows[0][3]), ("chunk", "same", "z", rows[0][3]), ("chunk", "short", "z", "a b c"), ("chunk", "null", "z", None), rows[3]]
    return rows


def test_pairs_against_all_pairs(spark, monkeypatch):
    rows = corpus()
    frame = spark.createDataFrame(rows, "item_kind string, item_id string, asset_id string, text string")
    unique = {r[1]: r for r in rows if r[3] and len(r[3].split()) >= 50}
    want = {(a, b) for a in unique for b in unique if a < b and unique[a][0] == unique[b][0] and unique[a][2] != unique[b][2] and jaccard(unique[a][3], unique[b][3]) >= 0.5}
    links, members = nd.near_duplicates(frame)
    assert {(r.id_a, r.id_b) for r in nd.pairs(links, members).collect()} == want and len(want) > 10
    groups = {r.item_id: r for r in nd.groups(links, members).collect()}
    assert len(groups) == len(unique) and all(groups[a].group_id == groups[b].group_id for a, b in want)
    assert nd.near_duplicates(frame.limit(0))[0].count() == 0


def test_tree_against_scan():
    random.seed(13)
    values = [random.getrandbits(64) for _ in range(200)]
    values += [v ^ (1 << random.randrange(64)) for v in values[:50]] + values[:5]
    tree = nd.BKTree()
    for i, v in enumerate(values):
        tree.add(v, (i,))
    for v in values[:60]:
        for radius in (0, 3, 20):
            assert sorted(i for (i,) in tree.within(v, radius)) == [i for i, u in enumerate(values) if (u ^ v).bit_count() <= radius]


def test_large_shards_go_in_blocks(spark, monkeypatch):
    import pandas as pd

    random.seed(14)
    base = random.getrandbits(nd.BITS)
    rows = [(i, 100, (base ^ random.getrandbits(30)).to_bytes(nd.BITS // 8)) for i in range(50)]
    keys = [(k % 2**31) for k in range(nd.BANDS)]
    frame = spark.createDataFrame(pd.DataFrame([("chunk", c, n, keys, bits) for c, n, bits in rows], columns=["item_kind", "class_id", "n_shingles", "bands", "bits"]), "item_kind string, class_id bigint, n_shingles int, bands array<int>, bits binary")
    whole = {tuple(r) for r in nd.candidates(frame).collect()}
    monkeypatch.setattr(nd, "BLOCK", 7)
    import tarnstone.llm.near_duplicates as module

    assert module.BLOCK == 7
    search = nd._search_shards
    batches = list(search(iter(_batches(rows))))
    large = [r for b in batches for r in b.to_pylist() if r["class_b"] is None]
    assert len(large) == 50 and sorted(r["place"] for r in large) == list(range(50))
    assert whole == {("chunk", a, b) for a in range(50) for b in range(a + 1, 50)}
    pairs = set()
    for tree in range(8):
        for query in range(tree, 8):
            part = [(r["class_a"], r["n_shingles"], r["bits"], role) for r in large for role, block in ((0, tree), (1, query)) if r["place"] // 7 == block]
            out = nd._search_blocks(None, pd.DataFrame(part, columns=["class_a", "n_shingles", "bits", "role"]))
            pairs |= {tuple(x) for x in out.itertuples(index=False)}
    assert pairs == {(a, b) for _, a, b in whole}


def _batches(rows):
    import pyarrow as pa

    for at in range(0, len(rows), 13):
        part = rows[at : at + 13]
        yield pa.RecordBatch.from_arrays([pa.array([5] * len(part), pa.int64()), pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.binary())], names=["shard", "class_id", "n_shingles", "bits"])


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (20, 30), (30, 25), (25, 40)] + [(100, 100 + i) for i in range(1, 30)]
    frame = spark.createDataFrame([("chunk", a, b, 0.9) for a, b in links], "item_kind string, class_a bigint, class_b bigint, similarity double")
    got = {}
    for r in nd.components(frame).collect():
        got.setdefault(r.group_id, set()).add(r.class_id)
    assert got == {1: {1, 2, 3, 4, 5}, 10: {10, 11}, 20: {20, 25, 30, 40}, 100: set(range(100, 130))}
    assert nd.components(frame.limit(0)).count() == 0


def test_large_classes_keep_their_links(spark, monkeypatch):
    """Classes larger than EXPANDED whose least members, and partners, lie in one shared asset."""
    monkeypatch.setattr(nd, "EXPANDED", 2)
    members = [("c", 1, "a1", "hot"), ("c", 1, "a2", "hot"), ("c", 1, "a3", "p"), ("c", 1, "a4", "q")]
    members += [("c", 2, "b1", "hot"), ("c", 2, "b2", "r"), ("c", 2, "b3", "s")]
    members += [("c", 3, "c1", "hot"), ("c", 4, "d1", "hot"), ("c", 4, "d2", "hot"), ("c", 4, "d3", "hot"), ("c", 5, "e1", "t")]
    members = spark.createDataFrame(members, "item_kind string, class_id bigint, item_id string, asset_id string")
    links = spark.createDataFrame([("c", 1, 3, 0.9), ("c", 1, 2, 0.8), ("c", 4, 1, 0.7), ("c", 3, 4, 0.6), ("c", 4, 5, 0.5)], "item_kind string, class_a bigint, class_b bigint, similarity double")
    got = {(r.id_a, r.id_b): r.similarity for r in nd.pairs(links, members).collect()}
    equal = {("a1", "a3"): 1.0, ("a2", "a3"): 1.0, ("a1", "a4"): 1.0, ("b1", "b2"): 1.0, ("b1", "b3"): 1.0}
    assert got == equal | {("a3", "c1"): 0.9, ("a1", "b2"): 0.8, ("a3", "d1"): 0.7, ("d1", "e1"): 0.5}


def test_same_pairs_beyond_the_broadcast_bound(spark, monkeypatch):
    from tarnstone import runtime

    frame = spark.createDataFrame(corpus(), "item_kind string, item_id string, asset_id string, text string")
    small = {tuple(r) for r in nd.pairs(*nd.near_duplicates(frame)).collect()}
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in nd.pairs(*nd.near_duplicates(frame)).collect()} == small and len(small) > 10


def test_no_link_depends_on_the_size_of_a_class(spark):
    """201 equal texts, the least of them in the asset of a similar text: the text is paired with another of them."""
    random.seed(22)
    words = random.choices(WORDS, k=90)
    near = list(words)
    near[40] = "other"
    rows = [("chunk", "a000", "x", " ".join(words))] + [("chunk", f"b{i:03}", "y", " ".join(words)) for i in range(nd.EXPANDED)] + [("chunk", "c", "x", " ".join(near))]
    frame = spark.createDataFrame(rows, "item_kind string, item_id string, asset_id string, text string")
    links, members = nd.near_duplicates(frame)
    got = {(r.id_a, r.id_b) for r in nd.pairs(links, members).collect()}
    assert links.count() == 1 and ("b000", "c") in got and {("a000", f"b{i:03}") for i in range(nd.EXPANDED)} <= got


def test_edges_beyond_the_radius_are_not_followed():
    """Two groups of near copies in one shard: a search in one doesn't enter the other's branch."""
    random.seed(23)
    visits = []

    class Counted(int):
        def __xor__(self, other):
            visits.append(1)
            return int(self) ^ int(other)

    base = [random.getrandbits(nd.BITS) for _ in range(2)]
    tree = nd.BKTree()
    for i in range(400):
        value = base[i % 2]
        for b in random.sample(range(nd.BITS), 6):
            value ^= 1 << b
        tree.add(Counted(value), (i, 100))
    visits.clear()
    found = [i for i, _ in tree.within(base[0], 20)]
    assert sorted(found) == list(range(0, 400, 2)) and len(visits) < 260
