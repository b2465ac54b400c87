"""The best rows of each query, scored by blocks: a block of rows meets a block of queries as matrices.

A query's score is a sum over its words, and most words stand in several queries. So the words of a
block of queries are scored on a block of rows once each, and the queries add up what their words
have. No pair of a query and a row is ever a row of a table; a task hands on at most limit rows a
query. Every row still meets every query, so the work grows as rows times words of the queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnstone.operators import lexical, vectors
from tarnstone.runtime import broadcast_if_small, materialize

#: Rows and queries of a block; rows that are scored at a time; blocks of queries of which a task keeps the best rows.
ROW_BLOCK, QUERY_BLOCK, STEP, KEPT_BLOCKS = 1024, 2048, 128, 4


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows with each column as an array of the values of at most size rows."""
    columns = ", ".join(f"{name} array<{kind}>" for name, kind in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c) for c in part.columns], names=part.schema.names)

    return rows.mapInArrow(run, columns)


class Best:
    """The limit best (key, score) of each of n queries among the blocks that were added. Scores have
    six decimals; of equal ones the lesser key is the better."""

    def __init__(self, n: int, limit: int, floor: float) -> None:
        self.n, self.limit, self.held = n, limit, 0
        self.least, self.parts = np.full(n, floor), []

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """scores: a line for each query with the scores of keys, -inf where the row is none of its hits."""
        near = scores >= (self.least - 1e-6)[:, None]
        if len(keys) > self.limit and np.count_nonzero(near) > self.n * self.limit:
            self.least = np.maximum(self.least, np.round(np.partition(scores, -self.limit, axis=1)[:, -self.limit], 6))
            near = scores >= (self.least - 1e-6)[:, None]
        query, at = np.nonzero(near)
        score = np.round(scores[query, at], 6)
        kept = score >= self.least[query]
        self.parts.append((query[kept], keys[at[kept]], score[kept]))
        self.held += int(kept.sum())
        if self.held > 3 * self.n * self.limit:
            self.trim()
            if self.held > 2 * self.n * self.limit:  # many equal scores
                self.rows()

    def trim(self) -> None:
        """Drops what is worse than the limit-th best score of its query."""
        query, key, score = (np.concatenate(x) for x in zip(*self.parts))
        packed = np.sort((query << 44) - np.rint(score * 1e6).astype(np.int64))  # scores are below 2 ** 43 millionths
        ends = np.searchsorted(packed, (np.arange(self.n) << 44) + (1 << 43))
        starts = np.concatenate([[0], ends[:-1]])
        full = np.flatnonzero(ends - starts >= self.limit)
        self.least[full] = np.maximum(self.least[full], ((full << 44) - packed[starts[full] + self.limit - 1]) / 1e6)
        kept = score >= self.least[query]
        self.parts, self.held = [(query[kept], key[kept], score[kept])], int(kept.sum())

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, key, score) of what is best so far."""
        query, key, score = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((key, -score, query))
        query, key, score = query[order], key[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.limit - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])
        kept = place < self.limit
        self.parts, self.held = [(query[kept], key[kept], score[kept])], int(kept.sum())
        return self.parts[0]


def columns(lists: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of lists by length, longest first, and the first, second, ... entries of the lists in
    that order, as far as they go."""
    size = np.array([len(x) for x in lists], np.int64)
    order = np.argsort(-size, kind="stable")
    flat, starts = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([[0], np.cumsum(size)])[:-1]
    return order, [flat[starts[order[: np.count_nonzero(size > j)]] + j] for j in range(int(size.max(initial=0)))]


def sums(parts: np.ndarray, entries: list[np.ndarray], n: int) -> np.ndarray:
    """For each of n lists, as columns has them, the sum of the lines of parts that it names."""
    out, line = np.zeros((n, parts.shape[1])), np.empty((n, parts.shape[1]))
    for named in entries:
        np.take(parts, named, axis=0, out=line[: len(named)], mode="clip")
        out[: len(named)] += line[: len(named)]
    return out


def _best(rows: DataFrame, asked: DataFrame, scorer: Callable[[], tuple[Callable, Callable]], limit: int, floor: float) -> DataFrame:
    """(query, key, score, rank) from blocks of rows (keys, held) and of queries (names, wanted).

    scorer() gives two functions for a task: of wanted to (order, state), the order in which the
    queries have their lines, and of (state, held, keys) to (scores, keys) of some rows at a time."""
    of_key, of_query = (dict(x.dtypes)[c].removeprefix("array<").removesuffix(">") for x, c in ((rows, "keys"), (asked, "names")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepare, score = scorer()
        known: dict[int, tuple] = {}

        def ended(names: pa.Array, state, best: Best) -> pa.RecordBatch:
            best.trim()
            query, key, value = best.rows()
            return pa.RecordBatch.from_arrays([names.take(pa.array(query)), pa.array(key), pa.array(value)], names=["query", "key", "score"])

        for b in batches:
            for i in range(b.num_rows):
                number, keys, held, names, wanted = (b.column(c) for c in range(5))
                if (no := number[i].as_py()) not in known:
                    if len(known) >= KEPT_BLOCKS:
                        yield ended(*known.pop(next(iter(known))))
                    order, state = prepare(wanted[i].values)
                    known[no] = names[i].values.take(pa.array(order)), state, Best(len(order), limit, floor)
                _, state, best = known[no]
                for scores, near in score(state, held[i].values, keys[i].values.to_numpy(zero_copy_only=False)):
                    best.add(scores, near)
        for each in known.values():
            yield ended(*each)

    stated = materialize(asked.withColumn("number", F.monotonically_increasing_id()), "query-blocks")
    met = rows.crossJoin(broadcast_if_small(stated)).select("number", "keys", "held", "names", "wanted")
    return lexical.top(met.mapInArrow(run, f"query {of_query}, key {of_key}, score double"), "query", "key", limit)


def term_hits(values: DataFrame, key: str, terms: DataFrame, query: str, limit: int) -> DataFrame:
    """(query, key, score, rank) by sums of values (key, term_no, value, none below 0) over terms
    (query, term_no), a term as often as a query has it. A row with any term of a query is its hit."""
    held = values.groupBy(key).agg(F.collect_list(F.struct("term_no", "value")).alias("held"))  # at most the query set's terms in a row
    wanted = terms.groupBy(query).agg(F.collect_list("term_no").alias("wanted"))  # the terms of one query

    def scorer() -> tuple[Callable, Callable]:
        def prepare(wanted: pa.ListArray) -> tuple:
            lists = [x.values.to_numpy() for x in wanted]
            numbers, at = np.unique(np.concatenate(lists), return_inverse=True)
            order, entries = columns(np.split(at, np.cumsum([len(x) for x in lists])[:-1]))
            return order, (numbers, entries, len(lists))

        def score(state: tuple, held: pa.ListArray, keys: np.ndarray) -> Iterator[tuple]:
            numbers, entries, n = state
            for i in range(0, len(keys), STEP):
                near, some = keys[i : i + STEP], held.slice(i, STEP)
                row = np.repeat(np.arange(len(near)), some.value_lengths().to_numpy())
                term, value = (x.to_numpy() for x in some.flatten().flatten())
                at = np.minimum(np.searchsorted(numbers, term), len(numbers) - 1)
                asked = numbers[at] == term
                parts = np.bincount(at[asked] * len(near) + row[asked], np.maximum(value[asked], 1e-300), len(numbers) * len(near))  # above 0 where the row has the term
                scores = sums(parts.reshape(len(numbers), len(near)), entries, n)
                scores[scores == 0] = -np.inf
                yield scores, near

        return prepare, score

    rows = blocks(held.select(F.col(key).alias("keys"), "held"), ROW_BLOCK)
    asked = blocks(wanted.select(F.col(query).alias("names"), "wanted").coalesce(1), QUERY_BLOCK)
    return _best(rows, asked, scorer, limit, 0.0).select(F.col("query").alias(query), F.col("key").alias(key), "score", "rank")


def text_hits(rows: DataFrame, queries: DataFrame, limit: int, floor: float | None = vectors.FLOOR, digest: str = "sha") -> DataFrame:
    """(query, key, score, rank): for each of queries (key, text) the nearest of rows (key, text) by
    cosine of their n-gram vectors, from floor on or, where it is None, above 0. The vectors are made
    from the texts here: they are many times larger than the texts."""

    def scorer() -> tuple[Callable, Callable]:
        encoder, last = vectors.Encoder(digest), [None, None]

        def prepare(wanted: pa.StringArray) -> tuple:
            texts = wanted.to_pylist()
            number: dict[str, int] = {}
            lists = [np.array([number.setdefault(w, len(number)) for w in encoder.words(t)], np.int64) for t in texts]
            norm = np.concatenate([encoder.norms(texts[i : i + ROW_BLOCK]) for i in range(0, len(texts), STEP)])
            features = [encoder.of_word(w) for w in number]
            place, grams = columns([x[1:] for x in features])
            moved = np.empty(len(place), np.int64)
            moved[place] = np.arange(len(place))
            order, entries = columns([moved[x] for x in lists])
            own = np.array([features[i][0] for i in place], np.int64)
            return order, (own, grams, entries, np.where(norm > 0, norm, np.inf)[order][:, None])

        def vectored(texts: list[str | None], keys: np.ndarray) -> tuple:
            x = encoder.sums(texts, across=True)
            length = np.sqrt(np.einsum("ij,ij->j", x, x))
            if (some := length > 0).all():
                x /= length
                return x, keys
            return x[:, some] / length[some], keys[some]

        def score(state: tuple, held: pa.StringArray, keys: np.ndarray) -> Iterator[tuple]:
            own, grams, entries, norm = state
            if last[0] is None or not np.array_equal(last[0], keys):  # a block of rows meets the blocks of queries one after another
                last[:] = keys, [vectored(held.slice(i, STEP).to_pylist(), keys[i : i + STEP]) for i in range(0, len(keys), STEP)]
            for x, near in last[1]:
                of_word = sums(x, grams, len(own))
                of_word *= vectors.GRAM_WEIGHT
                of_word += x[own] * vectors.WORD_WEIGHT
                scores = sums(of_word, entries, len(norm))
                scores /= norm
                yield scores, near

        return prepare, score

    held = blocks(rows.select(F.col("key").alias("keys"), F.col("text").alias("held")), ROW_BLOCK)
    asked = blocks(queries.select(F.col("key").alias("names"), F.col("text").alias("wanted")).coalesce(1), QUERY_BLOCK)
    return _best(held, asked, scorer, limit, 1e-6 if floor is None else floor)
