"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are the distinct shingle sets, columns the
n-grams. Two sets of a and b n-grams with Jaccard similarity of at least t
differ in at most ``(a + b)(1 - t)/(1 + t)`` n-grams. The columns of a size
class are cut by hash into more blocks than that bound, so such a pair has
identical rows in some blocks, of which one is not empty (short sets with many
empty blocks are matched on their first n-grams too): all other pairs are
discarded before anything is multiplied, and n-grams that many documents share
do little harm, because a block row is matched whole. The product is then taken over the
surviving groups of rows, block of columns by block: overlap counts add up
and a pair goes as soon as what is left cannot bring it to its bound.

Equal sets are one row from the start. Rows meet in groups by the smallest
row of the blocks they share, and of a group only those go on whose parity bits
(one bit a slot of n-grams) do not rule out every link. A group never grows beyond
``max_rows``/``max_shingles``: larger ones are cut into chunks with that row in
each; then only chunks with rows of different components meet, parity bits
first. The product returns a spanning forest of the links, never
the pairs themselves.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from ..session import cut_lineage
from .arrowtext import WHITE_SEP, mix, shingle_hashes, text_buffer, word_hashes
from .graphs import components

#: Most rows and n-grams of one product (about 150 MB of task memory).
MAX_ROWS = 1024
MAX_SHINGLES = 2_000_000
#: Bytes of texts whose n-grams are worked out at once.
SPAN_BYTES = 1 << 22
#: Chunks whose parity bits are compared are so many times those of a product.
PARITY_CHUNK = 16


def size_classes(threshold: int, largest: int = 1 << 40) -> np.ndarray:
    """Lower ends of the size classes: partners are in the same or the next."""
    lo = [1]
    while lo[-1] < largest:
        lo.append(max(lo[-1] + 1, -(-lo[-1] * 100 // threshold)))
    return np.array(lo, dtype=np.int64)


@lru_cache(maxsize=4096)
def spare_blocks(size: int, differ: int) -> int:
    """Blocks beyond the bound. Linked sets agree in more blocks than these, so
    a set with at most as many empty ones agrees in one that is not empty. The
    first number that is two deviations above the empty blocks expected of
    ``size`` n-grams, or, for short sets, the one of a few that comes nearest."""
    best = (-math.inf, 0)
    for spare in range(differ // 2 + 2 if differ else 1):
        k = differ + 1 + spare
        empty = k * math.exp(-size / k)
        margin = (spare - empty) / math.sqrt(empty)
        if margin >= 2:
            return spare
        best = max(best, (margin, spare))
    return best[1]


def block_rows(s: np.ndarray, lo: np.ndarray, threshold: int) -> np.ndarray:
    """Keys of the block rows of one sorted set, for its own size class and,
    where a partner may be in the next one, for that too. Empty blocks have no
    key, as unrelated sets have them too: sets with more of them than spare
    ones add their first n-grams, of which two linked sets share one."""
    n, out = len(s), []
    own = int(np.searchsorted(lo, n, "right")) - 1
    for c in (own, own + 1):
        if c > own and 100 * n < threshold * int(lo[c]):
            continue
        differ = 2 * (int(lo[c + 1]) - 1) * (100 - threshold) // (100 + threshold)
        spare = spare_blocks(int(lo[c]), differ)
        k = differ + 1 + spare
        part = ((s >> np.uint64(33)).astype(np.int64) * k) >> 31
        ends = np.searchsorted(part, np.arange(k + 1))
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s ^ np.uint64(0xA0761D6478BD642F)))])
            seed = np.uint64(c * 0x1000003) + np.arange(k, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)
            keys = mix(total[ends[1:]] - total[ends[:-1]] + mix(seed))
            full = ends[1:] > ends[:-1]
            out.append(keys[full])
            if k - int(full.sum()) > spare:
                out.append(mix(s[:n - -(-threshold * n // 100) + 1] + np.uint64(c * 0x9E3779B1 + 1)))
    return np.concatenate(out).view(np.int64)


def parity(s: np.ndarray) -> bytes:
    """One bit a slot, whether the slot has an odd number of the set's n-grams;
    the power of two from the set's size on is the number of slots."""
    slots = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits(np.bincount((s & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1,
                       bitorder="little").tobytes()


def may_link(sizes: np.ndarray, parities: list, threshold: int, cells: int = 1 << 22,
             comp: np.ndarray | None = None) -> np.ndarray:
    """Whether each set may be linked with any other (of another ``comp``). Slots in which two
    parities differ are at most as many as n-grams in which the sets differ,
    and linked sets of a and b differ in at most (a + b)(1 - t)/(1 + t)."""
    out = np.zeros(len(sizes), bool)
    width = np.array([len(p) for p in parities])
    by_width = {}
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        by_width[int(w)] = at, np.array([np.frombuffer(parities[i], np.uint8) for i in at]).view(np.uint64)
    for w, (at, bits) in by_width.items():
        for v, (to, wide) in by_width.items():
            if v not in (w, 2 * w):
                continue
            if v > w:  # halves of a parity add up to that of half the slots
                half = wide.shape[1] // 2
                wide = wide[:, :half] ^ wide[:, half:]
            step = max(1, cells // max(1, wide.size))
            for a in range(0, len(at), step):
                mine = at[a:a + step]
                odd = np.bitwise_count(bits[a:a + step, None, :] ^ wide[None, :, :]).sum(2, dtype=np.int64)
                x, y = sizes[mine][:, None], sizes[to][None, :]
                ok = (100 + threshold) * odd <= (x + y) * (100 - threshold)
                ok &= (np.minimum(x, y) * 100 >= threshold * np.maximum(x, y)) & (mine[:, None] != to[None, :])
                if comp is not None:
                    ok &= comp[mine][:, None] != comp[to][None, :]
                out[mine] |= ok.any(1)
                out[to] |= ok.any(0)
    return out


def _sets(col: pa.Array, n_words: int, span: int = SPAN_BYTES):
    """The sorted distinct n-gram hashes of every text of an Arrow column,
    worked out for rows of about ``span`` bytes at a time."""
    data, ends = text_buffer(col)
    a = 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + span, "right")) - 1)
        words, first = word_hashes(data[ends[a]:ends[b]], ends[a:b + 1] - ends[a], WHITE_SEP)
        grams = shingle_hashes(words, n_words)
        for i in range(b - a):
            x, y = int(first[i]), int(first[i + 1])
            if y - x >= n_words:
                yield np.unique(grams[x:y - n_words + 1])
            elif y > x:
                yield shingle_hashes(words[x:y], y - x)
            else:
                yield grams[:0]
        a = b


def product_links(sets: list[np.ndarray], threshold: int, allowed: np.ndarray | None = None,
                  cells: int = 1 << 21) -> np.ndarray:
    """Matrix of the links among ``sets`` (upper triangle), by accumulating
    ``A_b A_b^T`` over blocks b of columns under the size-derived bounds."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    need = (-(-threshold * (size[:, None] + size[None, :]) // (100 + threshold))).astype(np.int32)
    alive = np.triu(np.minimum.outer(size, size) * 100 >= threshold * np.maximum.outer(size, size), 1)
    alive &= np.minimum.outer(size, size) > 0
    if allowed is not None:
        alive &= allowed
    if not alive.any():
        return alive
    row = np.repeat(np.arange(n), size)
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    keep = shared[col]
    row, col = row[keep], (np.cumsum(shared) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    n_cols, step = int(shared.sum()), max(64, cells // n)
    rest = np.bincount(row, minlength=n).astype(np.int32)
    overlap = np.zeros((n, n), np.int32)
    alive &= np.minimum.outer(rest, rest) >= need
    for a in range(0, n_cols, step):
        if not alive.any():
            break
        i, j = np.searchsorted(col, (a, a + step))
        block = np.zeros((n, min(step, n_cols - a)), np.float32)
        block[row[i:j], col[i:j] - a] = 1
        overlap += (block @ block.T).astype(np.int32)
        rest -= np.bincount(row[i:j], minlength=n).astype(np.int32)
        alive &= overlap + np.minimum.outer(rest, rest) >= need
    return alive


def forest(links: np.ndarray) -> np.ndarray:
    """For every row the smallest row of its component."""
    n = len(links)
    adjacent = links | links.T | np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        new = np.where(adjacent, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _product(threshold: int):
    """Group function: rows ``node, comp, grams`` to forest edges ``a, b``."""

    def edges(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        comp = table["comp"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["grams"].combine_chunks()] if table.num_rows else []
        a = np.zeros(0, np.int64)
        b = a
        if len(sets) > 1:
            links = product_links(sets, threshold, comp[:, None] != comp[None, :])
            label = forest(links)
            moved = label != np.arange(len(label))
            a, b = node[moved], node[label[moved]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return edges


def _candidates(threshold: int):
    """Group function: rows ``pivot, node, size, parity`` to those that may be linked."""

    def keep(table: pa.Table) -> pa.Table:
        ok = may_link(table["size"].to_numpy(), table["parity"].to_pylist(), threshold)
        return table.select(["pivot", "node"]).filter(pa.array(ok))

    return keep


def _apart(threshold: int):
    """Group function: rows ``unit, node, comp, load, size, parity`` to those
    that may be linked with one of another component."""

    def keep(table: pa.Table) -> pa.Table:
        ok = may_link(table["size"].to_numpy(), table["parity"].to_pylist(), threshold, 1 << 20, table["comp"].to_numpy())
        return table.select(["unit", "node", "comp", "load"]).filter(pa.array(ok))

    return keep


def sketches(docs: DataFrame, id_col: str, text_col: str, n_words: int) -> DataFrame:
    """``id, n_shingles, print, parity`` per row: size, fingerprint and parity
    bits of the set (null: empty)."""

    def run(batches):
        for batch in batches:
            n, prints, odd = [], [], []
            for s in _sets(batch.column(1), n_words):
                n.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                odd.append(parity(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(prints, pa.binary()),
                 pa.array(odd, pa.binary())], ["id", "n_shingles", "print", "parity"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, n_shingles long, print binary, parity binary")


def _shared_blocks(rows: DataFrame) -> DataFrame:
    """``key, node, pivot`` of the block rows that at least two nodes have;
    ``pivot`` is the smallest of them. One sorted pass per partition that
    keeps only the run at hand's first node."""
    def run(batches):
        last_key = last_node = pivot = None
        waiting = False
        for batch in batches:
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            repeat = np.zeros(len(key), bool)
            repeat[1:] = ~new[1:] & (node[1:] == node[:-1])
            if last_key is not None and key[0] == last_key:
                new[0], repeat[0] = False, node[0] == last_node
            key, node, new = key[~repeat], node[~repeat], new[~repeat]
            if not len(key):
                continue
            start = np.flatnonzero(new)
            head = np.zeros(len(key), np.int64)
            lead = len(key) if not len(start) else start[0]
            head[:lead] = pivot if lead else 0
            for_run = np.cumsum(new) - 1
            head[lead:] = node[start][for_run[lead:]] if len(start) else 0
            more = np.zeros(len(key), bool)  # the next row is of the same run
            more[:-1] = ~new[1:]
            k, v, p = key[~new | more], node[~new | more], head[~new | more]
            if waiting and lead:
                k, v, p = np.append(last_key, k), np.append(pivot, v), np.append(pivot, p)
            waiting = bool(new[-1]) if len(key) else waiting
            last_key, last_node, pivot = key[-1], node[-1], head[-1]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(v, pa.int64()),
                                              pa.array(p, pa.int64())], ["key", "node", "pivot"])

    return (rows.select("key", "node").repartition("key").sortWithinPartitions("key", "node")
            .mapInArrow(run, "key long, node long, pivot long"))


def _sets_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, n_words: int, schema: str, emit) -> DataFrame:
    """``emit(ids, sets)``, a record batch of ``schema``, over the rows whose id
    may be in ``nodes``. A bit filter of 16 bits a node, 64 MB at most, spares
    the other texts; where it is not exact, rows of further ids come too: copies
    of a node with a larger id, which never are the smallest row of a group."""
    bits = 1 << min(29, max(22, (16 * nodes.count()).bit_length()))
    place = F.pmod(F.xxhash64("node"), F.lit(bits)) + 1
    found = (nodes.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket"))
             .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")))
    have = np.zeros(bits // 8, np.uint8)
    width = 4096  # bytes of a bucket
    for r in found.toLocalIterator():
        have[(r["bucket"] - 1) * width:r["bucket"] * width] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    mask = docs.sparkSession.sparkContext.broadcast(have)

    def run(batches):
        wanted = mask.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.take(pa.array(np.flatnonzero((wanted[at >> 3] >> (at & 7)) & 1)))
            yield emit(batch.column(0), _sets(batch.column(1), n_words))

    ident = F.col(id_col).cast("long")
    return (docs.where(ident.isNotNull())
            .select(ident.alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(ident), F.lit(bits)).alias("p"))
            .mapInArrow(run, schema))


def _block_rows_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, n_words: int, threshold: int) -> DataFrame:
    """``key, node`` of the block rows of the sets of ``nodes``."""
    lo = size_classes(threshold)

    def emit(ids, sets):
        keys = [block_rows(s, lo, threshold) if len(s) else s.view(np.int64) for s in sets]
        node = np.repeat(ids.to_numpy(), [len(k) for k in keys])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *keys])),
                                           pa.array(node, pa.int64())], ["key", "node"])

    return _sets_of(docs, nodes, id_col, text_col, n_words, "key long, node long", emit)


def _grams_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, n_words: int) -> DataFrame:
    """``node, print, grams`` of ``nodes`` (the caller joins exactly)."""

    def emit(ids, sets):
        grams = [s.tobytes() for s in sets]
        prints = [hashlib.blake2b(g, digest_size=16).digest() if g else None for g in grams]
        return pa.RecordBatch.from_arrays([ids, pa.array(prints, pa.binary()), pa.array(grams, pa.binary())],
                                          ["node", "print", "grams"])

    return _sets_of(docs, nodes, id_col, text_col, n_words, "node long, print binary, grams binary", emit)


def _chunks(load) -> F.Column:
    """Number of chunks for rows with this sum of loads."""
    return F.greatest(F.lit(1), F.ceil(load)).cast("int")


def _star_links(star: DataFrame, size: DataFrame, grams: DataFrame, threshold: int) -> DataFrame:
    """Forest edges among the rows that share a pivot. Every two rows of one
    block have its pivot, so groups by pivot miss no pair; a group of several
    chunks has the pivot in each of them."""
    dealt = lookup(star.where("node <> pivot"), size, "pivot", "w").select(
        "pivot", "node", F.pmod(F.hash("node"), F.col("chunks")).alias("chunk"))
    pivots = size.select("pivot", F.col("pivot").alias("node"),
                         F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    return (dealt.unionByName(pivots).join(grams.select("node", "grams"), "node").withColumn("comp", F.col("node"))
            .groupBy("pivot", "chunk").applyInArrow(_product(threshold), "a long, b long"))


def _meetings(rows: DataFrame, chunk: int) -> DataFrame:
    """``rows`` (``unit, node, comp, load`` and more, a written table) as they
    meet, chunk ``i`` and ``j`` of their unit with loads of about ``chunk``: those
    outside the component that most of its rows are in meet all its rows."""
    per = rows.groupBy("unit", "comp").agg(F.count("*").alias("n"), F.sum("load").alias("load"))
    main = cut_lineage(
        per.groupBy("unit").agg(F.max(F.struct("n", "comp", "load")).alias("top"), F.sum("n").alias("w"),
                                F.sum("load").alias("load"))
        .where(F.col("w") > F.col("top.n"))
        .select("unit", F.col("top.comp").alias("main"), "w", _chunks((F.col("load") - F.col("top.load")) / chunk).alias("n_few"),
                _chunks(F.col("top.load") / chunk).alias("n_main")), "mains")
    held = lookup(rows, main, "unit", "w").where(F.col("main").isNotNull())
    few = F.col("comp") != F.col("main")
    place = F.when(few, F.pmod(F.hash("node"), F.col("n_few"))).otherwise(
        F.col("n_few") + F.pmod(F.hash("node"), F.col("n_main")))
    last = F.when(few, F.col("n_few") + F.col("n_main") - 1).otherwise(F.col("n_few") - 1)
    return (held.withColumn("place", place).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
            .select(*rows.columns, F.least("place", "other").alias("i"), F.greatest("place", "other").alias("j")))


def _units(met: DataFrame, blocks: DataFrame, large: DataFrame) -> DataFrame:
    """``unit, node, size, parity, load`` of the large groups' rows. A group's
    rows meet once under its pivot, unless block by block there are fewer pairs."""
    w = blocks.join(large, "pivot", "left_semi").groupBy("pivot", "key").agg(F.count("*").alias("n"))
    pairs = cut_lineage(w.groupBy("pivot").agg(F.sum(F.col("n") * F.col("n")).alias("pairs")).join(large, "pivot")
                        .select("pivot", (F.col("pairs") < F.col("w") * F.col("w")).alias("apart")), "groups")
    cols = ["node", "size", "parity", "load"]
    whole = met.join(pairs.where("not apart"), "pivot", "left_semi").select(F.col("pivot").alias("unit"), *cols)
    apart = pairs.where("apart")
    if apart.isEmpty():
        return whole
    known = met.join(apart, "pivot", "left_semi").select("pivot", *cols)
    own = blocks.join(apart, "pivot", "left_semi").select(F.col("key").alias("unit"), "pivot", "node")
    return whole.unionByName(own.join(known, ["pivot", "node"]).select("unit", *cols))


def _chunk_links(units: DataFrame, label: DataFrame, grams: DataFrame, threshold: int) -> DataFrame:
    """Forest edges among the chunks of large groups. ``units``: see above;
    ``label``: the components found so far. Rows of different components meet
    with their parity bits first, which are a small part of their n-grams, so
    those chunks are larger; only what may be linked there meets with its n-grams."""
    rows = cut_lineage(units.join(label, "node", "left")
                       .select("unit", "node", "size", "parity", "load", F.coalesce("component", "node").alias("comp")), "units")
    few = cut_lineage(_meetings(rows, PARITY_CHUNK).groupBy("unit", "i", "j")
                      .applyInArrow(_apart(threshold), "unit long, node long, comp long, load double").distinct(), "apart")
    return (_meetings(few, 1).join(grams.select("node", "grams"), "node").groupBy("unit", "i", "j")
            .applyInArrow(_product(threshold), "a long, b long"))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_words: int = 3,
                       threshold: int = 90, max_rows: int = MAX_ROWS, max_shingles: int = MAX_SHINGLES) -> DataFrame:
    """``id_col, n_shingles, component_id`` for every row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased; a text of
    fewer than ``n_words`` words is one n-gram, and one without words or a
    null has none and links with nothing. Two rows link when
    ``100 * |x & y| >= threshold * |x | y|``; ``component_id`` is the smallest
    id reachable. Rows of one id are one node of the graph. A row with a null
    id is returned with its set size and a null component. Other columns of
    ``docs`` are not read. The join is exact up to 64-bit hashes of n-grams."""
    sketch = cut_lineage(sketches(docs, id_col, text_col, n_words), "sketches")
    classes = cut_lineage(
        sketch.where(F.col("id").isNotNull() & F.col("print").isNotNull()).groupBy("print")
        .agg(F.min("id").alias("node"), F.count("*").alias("w"), F.first("n_shingles").alias("size"),
             F.first("parity").alias("parity")), "classes")
    blocks = cut_lineage(_shared_blocks(_block_rows_of(docs, classes.select("node"), id_col, text_col, n_words, threshold)), "blocks")
    load = F.greatest(F.lit(1 / max_rows), F.col("size") / max_shingles)
    met = cut_lineage(blocks.select("pivot", "node").distinct().join(
        classes.select("node", "size", "parity", load.alias("load")), "node"), "met")
    size = cut_lineage(met.groupBy("pivot").agg(F.count("*").alias("w"), _chunks(F.sum("load")).alias("chunks")), "sizes")
    large = size.where("chunks > 1").select("pivot", "w")
    # A group of one chunk holds all pairs of its rows, so those that can have no link there go.
    star = cut_lineage(
        met.join(large, "pivot", "left_anti").groupBy("pivot").applyInArrow(_candidates(threshold), "pivot long, node long")
        .unionByName(met.join(large, "pivot", "left_semi").select("pivot", "node").distinct()), "stars")
    members = classes.select("print", "node").join(star.select("node").distinct(), "node")
    texts = _grams_of(docs, star.select("node").distinct(), id_col, text_col, n_words)
    grams = cut_lineage(members.join(texts, ["node", "print"]).dropDuplicates(["node", "print"]), "grams")
    label = components(_star_links(star, size, grams, threshold))
    if not large.isEmpty():
        more = cut_lineage(_chunk_links(_units(met, blocks, large), label, grams, threshold), "links")
        if not more.isEmpty():
            label = components(more.unionByName(label.toDF("a", "b")))
    node = classes.join(label, "node", "left").select("print", F.coalesce("component", "node").alias("component"), "w")
    found = lookup(sketch.select("id", "n_shingles", "print"), cut_lineage(node, "nodes"), "print", "w")
    return found.select(F.col("id").alias(id_col), "n_shingles",
                        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
