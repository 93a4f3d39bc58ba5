"""Nearest neighbours by one-bit codes, and exact inner products by MaxScore.

Both searches deal the rows and the queries into hashed blocks of bounded size and let each block
of queries meet each block of rows in a task of its own, so neither the number of queries nor of
rows is limited by a machine. Copies of one vector are cut to the few with the smallest ids first.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import every, settled, shard_count, smallest_ids, top_k

#: Queries and rows that meet in one task, and how many of them are compared at once.
QUERY_BLOCK, ROW_BLOCK = 8_192, 4_096
QUERY_PART, ROW_PART = 512, 4_096
#: Rows of a wave over all rows before it.
GROWTH = 4
MAXSCORE_QUERIES, MAXSCORE_ROWS = 512, 2_048
#: Pairs whose non-essential terms are probed at once, and the floor of a query without `k` rows.
PROBES = 65_536
LOWEST = -(1 << 63)
SEED = 7
#: Width of the error interval in standard errors of the estimate; wider reranks more rows.
WIDTH = 3.5
#: Bits of a code; vectors of fewer dimensions are turned into so many, which narrows the interval.
CODE_BITS = 512
CENTRE_SAMPLE = 10_000


def usable(vector: Column, zero: bool) -> Column:
    """True for vectors without null or non-finite components; all-zero ones pass only with `zero`."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (sound if zero else sound & F.exists(vector, lambda x: x != 0)), F.lit(False))


def rotation(dim: int) -> np.ndarray:
    """Orthonormal rows that turn `dim` dimensions at random into the bits of a code, the same everywhere."""
    bits = max(CODE_BITS, -(-dim // 8) * 8)
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((bits, dim)))
    return (q * np.sign(np.diag(r))).T


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit residuals, residual norms, and code-to-vector inner products."""
    residual = vectors - centre
    norm = np.linalg.norm(residual, axis=1)
    unit = residual / np.where(norm > 0, norm, 1)[:, None] @ rotation(vectors.shape[1])
    packed = np.packbits(unit > 0, axis=1)
    return [row.tobytes() for row in packed], norm, np.abs(unit).sum(axis=1) / math.sqrt(unit.shape[1])


def distance_bounds(queries: np.ndarray, centre: np.ndarray, bits: np.ndarray, norm: np.ndarray, overlap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the squared distances, queries by rows: below, and above."""
    residual = queries - centre
    far = np.linalg.norm(residual, axis=1)
    turned = (residual / np.where(far > 0, far, 1)[:, None] @ rotation(queries.shape[1])).astype(np.float32)
    dim = turned.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    safe = np.where(overlap > 0, overlap, 1)
    cosine = (turned @ signs.T).astype(np.float64) / math.sqrt(dim) / safe
    error = WIDTH * np.sqrt(np.maximum(0, 1 - safe**2)) / safe / math.sqrt(max(dim - 1, 1)) + 1e-5
    base = norm[None, :] ** 2 + far[:, None] ** 2
    reach = 2 * norm[None, :] * far[:, None]
    slack = 1e-9 * (base + 1e-300)
    return base - reach * np.minimum(1, cosine + error) - slack, base - reach * np.maximum(-1, cosine - error) + slack


class Nearest:
    """The `k` nearest rows so far of each query, and the distance a further row must not pass."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, limits: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.limit, self.k = ids, vectors, limits.copy(), k
        self.best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]

    def meet(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norm: np.ndarray, overlap: np.ndarray, centre: np.ndarray) -> None:
        """Rerank the rows whose lower bound does not pass a query's limit; the limit falls as better rows are found."""
        for start in range(0, len(self.ids), QUERY_PART):
            part = slice(start, start + QUERY_PART)
            low, high = distance_bounds(self.vectors[part], centre, codes, norm, overlap)
            own = self.ids[part, None] == ids[None, :]
            low[own] = high[own] = np.inf
            limit = self.limit[part] ** 2 * (1 + 1e-9)
            if len(ids) > self.k:  # so many rows are at least as near as their upper bounds say
                limit = np.minimum(limit, np.partition(high, self.k - 1, axis=1)[:, self.k - 1])
            rows = (low <= limit[:, None]) & ~own
            for i in np.flatnonzero(rows.any(axis=1)):
                near = np.flatnonzero(rows[i])
                apart = vectors[near] - self.vectors[start + i]
                score = np.sqrt((apart * apart).sum(axis=1))
                held = score <= self.limit[start + i]
                all_ids = np.r_[self.best[start + i][0], ids[near[held]]]
                scores = np.r_[self.best[start + i][1], score[held]]
                first = np.lexsort((all_ids, scores))[:self.k]
                self.best[start + i] = all_ids[first], scores[first]
                if len(first) == self.k:
                    self.limit[start + i] = scores[first[-1]]

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": np.repeat(self.ids, [len(b[0]) for b in self.best]),
                             "vec_id": np.concatenate([np.zeros(0, np.int64), *(b[0] for b in self.best)]),
                             "score": np.concatenate([np.zeros(0), *(b[1] for b in self.best)])})


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """The `k` nearest rows of every query row: query_id, rank, vec_id, score (Euclidean distance).

    `vectors(vec_id, vector)`; `queries` selects the query rows; a query's own id is no candidate.
    Each row is indexed by one-bit codes and two numbers. The blocks of rows are met in waves, each
    GROWTH times the size of all before. A query enters a wave with the distance of its k-th row so
    far; tasks estimate distances from the codes and rerank, by the original vectors, the rows whose
    lower bound does not pass it. So a task gives out only rows that may stay, about as many per
    query and wave whatever the number of rows. Ties go to the smaller id. Null, zero and non-finite
    vectors and null ids take no part; vectors meet those of their own dimension; repeated rows count
    once; an empty table gives no rows. The centre is fitted on the CENTRE_SAMPLE rows with the
    smallest hashed ids of each dimension.
    """
    sound = settled(
        vectors.select("vec_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
        .filter(F.col("vec_id").isNotNull() & usable(F.col("vector"), zero=False)).distinct()
        .withColumn("dim", F.size("vector")))
    centres = _centres(sound)
    rows = smallest_ids(sound, "vector", k + 1)
    asked = sound.filter(queries)
    row_blocks = shard_count(sound.count(), ROW_BLOCK)
    query_blocks = shard_count(asked.count(), QUERY_BLOCK)

    def coded(batches):
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                codes, norm, overlap = encode(np.stack(part["vector"].to_numpy()), centres[dim])
                yield pd.DataFrame({"vec_id": part["vec_id"], "vector": part["vector"], "dim": part["dim"], "code": codes, "norm": norm, "overlap": overlap})

    def nearer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return Nearest(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), k).rows()
        found = Nearest(left["vec_id"].to_numpy(), np.stack(left["vector"].to_numpy()), left["limit"].to_numpy(), k)
        bits = np.frombuffer(b"".join(right["code"]), dtype=np.uint8).reshape(len(right), -1)
        ids, there = right["vec_id"].to_numpy(), np.stack(right["vector"].to_numpy())
        norm, overlap = right["norm"].to_numpy(), right["overlap"].to_numpy()
        for start in range(0, len(ids), ROW_PART):
            part = slice(start, start + ROW_PART)
            found.meet(ids[part], there[part], bits[part], norm[part], overlap[part], centres[int(left["dim"].iloc[0])])
        return found.rows()

    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(row_blocks)).cast("int")
    codes = settled(rows.mapInPandas(coded, "vec_id long, vector array<double>, dim int, code binary, norm double, overlap double").withColumn("rb", block))
    asked = settled(asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")))
    best, low, high = None, 0, 1
    while low < row_blocks:
        if best is None:
            left = asked.withColumn("limit", F.lit(float("inf")))
        else:
            # A query with fewer than k rows so far still takes any.
            limits = best.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("score")).alias("limit"))
            left = asked.join(limits.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
        top = min(high, row_blocks)
        left = left.withColumn("rb", F.explode(F.sequence(F.lit(low), F.lit(top - 1))))
        right = codes.filter(F.col("rb").between(low, top - 1)).withColumn("qb", every(query_blocks))
        found = (left.groupBy("dim", "qb", "rb").cogroup(right.groupBy("dim", "qb", "rb"))
                 .applyInPandas(nearer, "query_id long, vec_id long, score double"))
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = settled(top_k(found, "query_id", [F.col("score"), F.col("vec_id")], k))
        low, high = high, high * GROWTH
    return best.select("query_id", "rank", "vec_id", "score")


def _centres(sound: DataFrame) -> dict[int, np.ndarray]:
    dims = [row["dim"] for row in sound.select("dim").distinct().collect()]
    centres = {}
    for dim in dims:
        sample = (sound.filter(F.col("dim") == dim).select("vec_id", "vector", F.xxhash64("vec_id").alias("h"))
                  .orderBy("h", "vec_id").limit(CENTRE_SAMPLE))
        means = sample.select(F.posexplode("vector")).groupBy("pos").agg(F.avg("col").alias("mean")).collect()
        centre = np.zeros(dim)
        for row in means:
            centre[row["pos"]] = row["mean"]
        centres[dim] = centre
    return centres


class Postings:
    """Posting lists of a block of integer vectors: for every dimension the weights of its rows.

    Rows are held in windows by ascending id, so a later row never displaces an equal score.
    """

    WINDOW = 2_048

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], vectors[order]
        self.most, self.least = self.rows.max(axis=0), self.rows.min(axis=0)

    def search(self, own: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and scores of each query's `k` best rows above its floor, ties to the smaller id."""
        bound = np.maximum(np.maximum(queries * self.most, queries * self.least), 0)
        order = np.argsort(bound, axis=1, kind="stable")
        below = np.cumsum(np.take_along_axis(bound, order, axis=1), axis=1)
        place = np.argsort(order, axis=1, kind="stable")
        # Products of whole numbers are exact in doubles as long as no sum passes 2**53.
        sizes = np.abs(queries.astype(np.float64)) @ np.maximum(np.abs(self.most.astype(np.float64)), np.abs(self.least.astype(np.float64)))
        kind = np.float64 if not len(sizes) or sizes.max() < 2**52 else np.int64
        floors = floors.copy()
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for start in range(0, len(self.ids), self.WINDOW):
            ids, rows = self.ids[start:start + self.WINDOW], self.rows[start:start + self.WINDOW].astype(kind)
            # Terms whose bounds together cannot pass the floor are non-essential.
            split = (below <= floors[:, None]).sum(axis=1)
            essential = place >= split[:, None]
            rest = np.where(split > 0, np.take_along_axis(below, np.maximum(split - 1, 0)[:, None], axis=1)[:, 0], 0) if below.shape[1] else split
            total = np.where(essential, queries, 0).astype(kind) @ rows.T
            if kind is np.float64:
                total = total.astype(np.int64)
            alive = (total + rest[:, None] > floors[:, None]) & (own[:, None] != ids[None, :])
            if len(ids) > k + 1 and kind is np.float64:
                # At least k rows other than the query itself score no less than the essential terms say, less what the others may take away.
                least = np.where(essential, 0, np.minimum(np.minimum(queries * self.most, queries * self.least), 0)).sum(axis=1)
                known = np.where(own[:, None] != ids[None, :], total, total.min(axis=1, keepdims=True))
                kth = np.partition(known, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1] + least
                alive &= total + rest[:, None] >= kth[:, None]
            q, r = np.nonzero(alive)
            scores = total[q, r]
            # Non-essential terms are probed only for rows that can still compete.
            others = np.where(essential, 0, queries)
            open_ = np.flatnonzero(split[q] > 0)
            for part in range(0, len(open_), PROBES):
                at = open_[part:part + PROBES]
                scores[at] += np.einsum("pd,pd->p", others[q[at]], self.rows[start + r[at]])
            held = scores > floors[q]
            numbers, all_ids, all_scores = (np.r_[old, more] for old, more in zip(found, (q[held], ids[r[held]], scores[held])))
            turn = np.lexsort((all_ids, -all_scores, numbers))
            numbers = numbers[turn]
            first = np.searchsorted(numbers, np.arange(len(own)))
            rank = np.arange(len(turn)) - first[numbers]
            turn, numbers, rank = turn[rank < k], numbers[rank < k], rank[rank < k]
            found = numbers, all_ids[turn], all_scores[turn]
            last = rank == k - 1
            floors[numbers[last]] = np.maximum(floors[numbers[last]], found[2][last])
        return found


def inner_product_search(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """The `k` highest integer inner products of every query row: query_id, rank, vec_id, score long.

    `vectors(vec_id, vector array<long>)`. Terms are dimensions. Within a block of rows, the terms
    whose score bounds together stay below the k-th score so far are non-essential: the other
    terms' postings are traversed, and non-essential terms are probed only for rows that can still
    compete. The blocks of rows are met in waves, each GROWTH times the size of all before, and a query
    enters a wave with its k-th score so far. Ties go to the smaller id. Null vectors, vectors with
    nulls and null ids take no part; vectors meet those of their own dimension; repeated rows count
    once; an empty table gives no rows. Sums must fit 64 bits.
    """
    sound = settled(
        vectors.select("vec_id", "vector")
        .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull()))
        .distinct().withColumn("dim", F.size("vector")))
    asked = sound.filter(queries)
    row_blocks = shard_count(sound.count(), MAXSCORE_ROWS)
    query_blocks = shard_count(asked.count(), MAXSCORE_QUERIES)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({name: np.zeros(0, np.int64) for name in ("query_id", "vec_id", "score")})
        held = Postings(right["vec_id"].to_numpy(), np.stack(right["vector"].to_numpy()).astype(np.int64).reshape(len(right), -1))
        own = left["vec_id"].to_numpy()
        queries = np.stack(left["vector"].to_numpy()).astype(np.int64).reshape(len(left), -1)
        numbers, ids, scores = held.search(own, queries, left["floor"].to_numpy(), k)
        return pd.DataFrame({"query_id": own[numbers], "vec_id": ids, "score": scores})

    rows = settled(smallest_ids(sound, "vector", k + 1).withColumn("rb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(row_blocks)).cast("int")))
    asked = settled(asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")))
    found, low, high = None, 0, 1
    while low < row_blocks:
        if found is None:
            left = asked.withColumn("floor", F.lit(LOWEST))
        else:
            # A row of an equal score may have a smaller id, so the floor lies one below the k-th score.
            floors = found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score") - 1).alias("floor"))
            left = asked.join(floors.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(LOWEST)))
        top = min(high, row_blocks)
        left = left.withColumn("rb", F.explode(F.sequence(F.lit(low), F.lit(top - 1))))
        right = rows.filter(F.col("rb").between(low, top - 1)).withColumn("qb", every(query_blocks))
        more = (left.groupBy("dim", "qb", "rb").cogroup(right.groupBy("dim", "qb", "rb"))
                .applyInPandas(best, "query_id long, vec_id long, score long"))
        more = more if found is None else more.unionByName(found.drop("rank"))
        found = settled(top_k(more, "query_id", [F.desc("score"), F.col("vec_id")], k))
        low, high = high, high * GROWTH
    return found.select("query_id", "rank", "vec_id", "score")
