"""Encoding against the public libraries, and packing against the definition."""

import base64
import os
import random

import numpy as np
import pytest

from tarnstone.llm import encoding, packing

pytestmark = pytest.mark.skipif(not os.path.exists(encoding.TOKENIZER_DIR), reason="no vocabulary files")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(f"{encoding.TOKENIZER_DIR}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_exact_ids(reference):
    enc = encoding.encoder("byte_bpe_50k")
    random.seed(9)
    signs = ["a", "b", "the", "ing", " ", "  ", "\n", "\r\n", "\t", " ", "\x1c", "\x85", "1", "23", "²", "Ⅷ", "٣", "_", "é", "é", "中文", "😀", "​", "'s", "'", "ß", "==", "<|endoftext|>", "A"]
    for _ in range(4000):
        text = "".join(random.choices(signs, k=random.randint(0, 30)))
        assert enc.encode(text) == reference.encode_ordinary(text), repr(text)
    for text in ("0123456789" * 500, "a" * 3000, " " * 2000, "xyzzy" * 400, "é" * 999):
        assert enc.encode(text) == reference.encode_ordinary(text)


def test_rows(spark, reference):
    rows = [(1, "Hello there"), (2, None), (3, ""), (4, " \n "), (1, "Hello there"), (5, "x" * 100_000)]
    got = sorted((r.doc_id, list(r.ids)) for r in encoding.encode_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect())
    assert got == sorted((k, reference.encode_ordinary(t or "")) for k, t in rows)
    assert reference.decode(dict(got)[1]) == "Hello there"
    for name in ("byte_bpe_50k", "piece_bpe_32k"):
        counts = {r.doc_id: r.n_tokens for r in encoding.count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", name).collect()}
        assert counts[2] == counts[3] == 0 and counts[1] == 2


def test_buckets_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(10)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 40, rng.integers(1, 8)))
        counts = rng.integers(1, 30, len(lengths))

        def padding(bounds):
            return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))

        best = min(padding(b) for k in (1, 2, 3) for b in combinations(lengths.tolist(), min(k, len(lengths))) if max(b) == lengths.max())
        assert padding(packing.length_buckets(lengths, counts, 3)) == best


def test_containers(spark):
    random.seed(11)
    sizes = [(i, random.choice((0, 1, 3, 7, 8, 20, 45))) for i in range(400)] + [(i, 7) for i in range(1000, 1300)] + [(5000, None), (0, 0), (None, 3)]
    sizes[0] = (0, 0)
    frame = spark.createDataFrame(sizes, "item_id bigint, n_tokens bigint").repartition(6)
    got = packing.pack(frame, 20, 7).collect()  # a bucket for each length: then batches and rests are as good as best fit
    load, parts = {}, {}
    for r in got:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        parts.setdefault(r.item_id, []).append((r.part_no, r.from_token, r.n_tokens))
    want = {k: n or 0 for k, n in sizes if k is not None}
    assert parts.keys() == want.keys() and max(load.values()) <= 20 and set(load) == set(range(len(load)))
    for k, p in parts.items():
        p.sort()
        assert sum(n for _, _, n in p) == want[k] and [f for _, f, _ in p] == [20 * i for i in range(len(p))]
        assert len(p) == max(1, -(-want[k] // 20))
    rooms = []  # best fit, the longest first, item by item
    for n in sorted((m for v in want.values() for m in [20] * (v // 20) + [v % 20]), reverse=True):
        fit = min((i for i, r in enumerate(rooms) if r >= n), key=rooms.__getitem__, default=None)
        if n and fit is None:
            rooms.append(20 - n)
        elif n:
            rooms[fit] -= n
    assert len(load) <= len(rooms)
    assert packing.pack(frame.limit(0), 20).count() == 0


def test_buckets_decide():
    """The bounds make the batches: other bounds, other containers; better ones leave less room."""
    import pandas as pd

    rng = np.random.default_rng(21)
    lengths, counts = np.unique(np.clip(rng.lognormal(5.5, 1.2, 5000), 1, 1000).astype(np.int64), return_counts=True)
    items = pd.DataFrame({"item_id": np.arange(counts.sum()), "part_no": 0, "from_token": 0, "n_tokens": np.repeat(lengths, counts), "rank": np.concatenate([np.arange(c) for c in counts])})
    room, placed = {}, {}
    for buckets in (1, 4, 64):
        bounds = packing.length_buckets(lengths, counts, buckets)
        got = pd.concat(packing._assign(packing.plan_containers(lengths, counts, 1000, buckets))(iter([items])))
        load = got.groupby("container_id").n_tokens.sum()
        room[buckets], placed[buckets] = 1 - load.mean() / 1000, got.container_id.to_numpy()
        assert len(got) == len(items) and load.max() <= 1000 and sorted(load.index) == list(range(len(load)))
        # of its longest bucket a container holds a batch at the bucket's bound, or items in the rest of a longer one
        longest = got[got.bucket == got.groupby("container_id").bucket.transform("max")].groupby("container_id").agg(bucket=("bucket", "first"), n=("n_tokens", "size"))
        assert (longest.n <= 1000 // np.array(bounds)[longest.bucket]).all()
    assert room[64] < 0.01 and 2 * room[64] < room[4] < room[1] and room[1] > 0.4
    assert (placed[4] != placed[64]).any()


def test_ranks_over_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 50)
    frame = spark.createDataFrame([(i, 3 if i % 3 else 8) for i in range(600)], "item_id bigint, n_tokens bigint")
    load, seen = {}, set()
    for r in packing.pack(frame, 20).collect():
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        seen.add(r.item_id)
    assert len(seen) == 600 and max(load.values()) == 19 and len(load) == 150  # as without salts
