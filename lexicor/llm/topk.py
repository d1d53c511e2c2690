"""Exact top-k inner products by block-at-a-time pruning.

Vectors are kept as integers in blocks of consecutive ids. A block has a
forward index (its rows) and, for every term (component), the largest and
smallest value in it; with them a query bounds every score in the block. A
query visits blocks in the order of their bounds and stops as soon as the
next bound is below its k-th score.

Shards of blocks are dealt over the cluster; query chunks stream past them,
so a task holds one shard and one chunk. A first pass over one shard gives
every query a score that its k-th result cannot be below; the second pass
starts from there. Per shard and query at most k rows leave.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK_ROWS = 256
SHARD_ROWS = 8_192
CHUNK_ROWS = 512
SCALE = 256
_LOW = -(1 << 63)


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v`` with ``floor(256 * x)`` of every component as a long; rows
    with a null id, a null or empty vector, or a null or non-finite component
    take no part."""
    x = F.transform(vec_col, lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
            .where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & fine)
            .select("id", F.transform("x", lambda c: F.floor(c * SCALE)).alias("v")))


def _rows(col: pa.Array) -> np.ndarray:
    """Matrix of a list column; shorter vectors count as filled with zeros."""
    ends = col.offsets.to_numpy().astype(np.int64)
    flat = col.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _sharded(rows: DataFrame, n_shards: int) -> DataFrame:
    """``shard, id, v`` in id ranges, sorted within each."""
    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, shard), pa.int32()), *batch.columns],
                                             ["shard", "id", "v"])

    return (rows.repartitionByRange(n_shards, "id").sortWithinPartitions("id")
            .mapInArrow(run, "shard int, id long, v array<long>"))


def _pad(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def search_blocks(q_ids, q, floor, ids, vectors, k: int, block_rows: int = BLOCK_ROWS):
    """Best ``k`` rows of ``vectors`` for every query, as ``(query number,
    ids, scores)`` triples of flat arrays; ``floor``: per query a score below
    which nothing is wanted. Rows are sorted by id; a row of the query's own
    id does not count."""
    width = max(q.shape[1], vectors.shape[1])
    q, vectors = _pad(q, width), _pad(vectors, width)
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * width < 2.0 ** 52
    if exact:
        q, vectors = q.astype(np.float64), vectors.astype(np.float64)
    low = -np.inf if exact else _LOW
    cuts = range(0, len(ids), block_rows)
    top = np.stack([vectors[a:a + block_rows].max(0) for a in cuts])
    bottom = np.stack([vectors[a:a + block_rows].min(0) for a in cuts])
    # Floats: a bound may pass 64 bits where scores do not. The last term is
    # more than their rounding error.
    wide = [np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float), top.astype(float).T, bottom.astype(float).T]
    bound = wide[0] @ wide[2] + wide[1] @ wide[3]
    if not exact:
        bound += 1e-12 * (np.abs(wide[0] + wide[1]) @ np.maximum(np.abs(wide[2]), np.abs(wide[3])))
    order = np.argsort(-bound, axis=1, kind="stable")
    best = np.full((len(q), k), low, dtype=q.dtype)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max)
    floor = floor.astype(q.dtype)
    live = np.arange(len(q))
    for turn in range(len(top)):
        block = order[live, turn]
        limit = np.maximum(best[live, -1], floor[live])
        go = bound[live, block] >= limit
        live, block = live[go], block[go]
        if not len(live):
            break
        for b in np.unique(block):
            mine = live[block == b]
            a = int(b) * block_rows
            names = ids[a:a + block_rows]
            score = q[mine] @ vectors[a:a + block_rows].T
            score[q_ids[mine][:, None] == names[None, :]] = low
            first = np.argsort(-score if exact else np.negative(np.maximum(score, _LOW + 1)), axis=1, kind="stable")[:, :k]
            s = np.concatenate([best[mine], np.take_along_axis(score, first, 1)], 1)
            n = np.concatenate([best_id[mine], names[first]], 1)
            n = np.where(s == low, np.iinfo(np.int64).max, n)
            pick = np.lexsort((n, -s if exact else np.negative(np.maximum(s, _LOW + 1))), axis=1)[:, :k]
            best[mine], best_id[mine] = np.take_along_axis(s, pick, 1), np.take_along_axis(n, pick, 1)
    found = (best > low) & (best >= floor[:, None])
    at, _ = np.nonzero(found)
    return at, best_id[found], best[found].astype(np.int64)


def _visit(shards: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score``: of every shard the best rows of every
    query dealt to it. ``queries``: shard, id, v, floor."""
    both = (shards.select("shard", F.lit(0).alias("kind"), "id", "v", F.lit(0).cast("long").alias("floor"))
            .unionByName(queries.select("shard", F.lit(1).alias("kind"), "id", "v", "floor")))

    def run(batches):
        state = {"shard": None, "ids": [], "v": []}

        def answer(q_ids, q, floor):
            if not state["ids"] or not len(q_ids):
                return
            if len(state["ids"]) > 1:
                width = max(x.shape[1] for x in state["v"])
                state["ids"] = [np.concatenate(state["ids"])]
                state["v"] = [np.concatenate([_pad(x, width) for x in state["v"]])]
            for a in range(0, len(q_ids), CHUNK_ROWS):
                part = slice(a, a + CHUNK_ROWS)
                at, names, scores = search_blocks(q_ids[part], q[part], floor[part], state["ids"][0], state["v"][0], k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[part][at]), pa.array(names), pa.array(scores)],
                                                 ["query_id", "vec_id", "score"])

        for batch in batches:
            shard, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero(np.append(True, (np.diff(shard) != 0) | (np.diff(kind) != 0)))
            for a, b in zip(cut, np.append(cut[1:], len(shard))):
                if shard[a] != state["shard"]:
                    state = {"shard": shard[a], "ids": [], "v": []}
                ids, v = batch.column(2)[a:b].to_numpy(), _rows(batch.column(3)[a:b])
                if kind[a] == 0:
                    state["ids"].append(ids)
                    state["v"].append(v)
                else:
                    yield from answer(ids, v, batch.column(4)[a:b].to_numpy())

    return (both.repartition("shard").sortWithinPartitions("shard", "kind", "id")
            .mapInArrow(run, "query_id long, vec_id long, score long"))


def top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
          shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row of ``vectors`` that
    ``is_query`` holds for: its ``k`` best rows (all, if fewer) by integer
    inner product, equal scores by smaller id, rows of its own id left out.

    Invalid vectors (see ``quantised``) are neither queries nor results;
    vectors of different lengths count as filled with zeros; rows that share
    an id are each a candidate, and as queries one result list of all their
    scores. Scores must fit 64 bits. Other columns are not read."""
    flagged = vectors.where(is_query).select(F.col(id_col).cast("long").alias("id")).distinct()
    rows = cut_lineage(quantised(vectors, id_col, vec_col), "vectors")
    n = rows.count()
    shards = cut_lineage(_sharded(rows, max(1, -(-n // shard_rows))), "shards")
    n_shards = (shards.agg(F.max("shard")).first()[0] or 0) + 1
    queries = cut_lineage(rows.join(flagged, "id", "left_semi"), "queries")
    nothing = F.lit(_LOW).cast("long")
    pilot = _visit(shards.where("shard = 0"), queries.select(F.lit(0).alias("shard"), "id", "v", nothing.alias("floor")), k)
    floor = (pilot.dropDuplicates(["query_id", "vec_id"]).groupBy("query_id")
             .agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
             .where(F.size("s") >= k).select(F.col("query_id").alias("id"), F.element_at("s", k).alias("floor")))
    dealt = (queries.join(floor, "id", "left")
             .select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), "id", "v",
                     F.coalesce("floor", nothing).alias("floor")))
    found = _visit(shards, dealt, k)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
