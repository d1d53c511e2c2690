"""Micro-batched classify-and-store (S13) on Spark's keyed state.

A file source (``maxFilesPerTrigger`` bounds each micro-batch, the counterpart
of the original's 20,000-article flushes) is prepared exactly as in batch mode.
For every article key Spark's state holds the tags so far; a batch that brings a
new key or new tags appends one change row, the first with the first writer's
fields, to a plain Parquet sink. What was read, the state and the sink's files are committed
by Spark's checkpoint, so a restart or a replayed batch neither loses nor repeats
a change. A second source, or a new checkpoint, writes changes of its own next
to the others; reading the store reduces them to one row a key.

Counts (rejects by reason; by tag what was analysed, newly stored or tagged,
irrelevant, already tagged) are observed while the batch runs, without a scan
of their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import rejects as rj
from ..operators.store import KEY
from ..plans.ingest import STORE_FIELDS, prepare
from ..sources.providers import S2ORC_SCHEMA, s2orc_articles

#: Keys share a state by hash: calling the state function costs milliseconds,
#: so a call serves a few keys of a batch. Part of a checkpoint, as its state.
STATE_GROUPS = 4096
STATE = "known string"
CHANGES = "key_type string, key string, row string, tags array<string>, version int, is_new boolean, added array<string>"
#: Progress reports kept until a run ends: as many micro-batches have metrics.
PROGRESS = 10_000


def _changes(_group, frames, state):
    """State function: at most one change row for a key and batch. The state
    holds version and tags of the group's keys; fields are in first changes only."""
    known = {tuple(k): (version, tags) for *k, version, tags in json.loads(state.get[0])} if state.exists else {}
    first, added = {}, {}
    for pdf in frames:
        for kind, key, file, block, n, fields, new in zip(*(pdf[c] for c in (*KEY, "file", "block", "n", "row", "tags"))):
            k = kind, key
            if k not in added:
                added[k] = set()
            if k not in known and (k not in first or (file, block, n) < first[k][0]):
                first[k] = (file, block, n), fields
            added[k].update(new)
    rows = []
    for k, new in added.items():
        version, tags = known.get(k, (0, []))
        new = sorted(new - set(tags))
        if version == 0 or new:
            known[k] = version + 1, sorted([*tags, *new])
            rows.append((*k, first[k][1] if version == 0 else None, known[k][1], version + 1, version == 0, new))
    if rows:
        state.update((json.dumps([(*k, *v) for k, v in known.items()], ensure_ascii=False),))
        yield pd.DataFrame(rows, columns=[*KEY, "row", "tags", "version", "is_new", "added"])


@F.arrow_udf("long")
def _place(blocks: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The position of every row in its task."""
    n = 0
    for b in blocks:
        yield pa.array(range(n, n + len(b)), pa.int64())
        n += len(b)


def _positions(df: DataFrame) -> DataFrame:
    """``df`` with ``_seq``: file, block and the row's position in its task."""
    placed = df.withColumn("_file", F.input_file_name()).withColumn("_block", F.input_file_block_start())
    seq = F.struct(F.col("_file").alias("file"), F.col("_block").alias("block"), F.col("_n").alias("row"))
    return placed.withColumn("_n", _place.asNondeterministic()("_block")).withColumn("_seq", seq).drop("_file", "_block", "_n")


def _lightened(df: DataFrame) -> DataFrame:
    """Of the rows of a key in one Arrow batch the first and those with a
    further tag: a key with many rows brings few to its state."""
    def run(batches):
        for b in batches:
            seen: dict = {}
            keep = []
            for i, (kind, key, tags) in enumerate(zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in (*KEY, "tags")))):
                known = seen.get((kind, key))
                if known is None or not known.issuperset(tags):
                    keep.append(i)
                    seen[kind, key] = set(tags) | (known or set())
            yield b.take(pa.array(keep, pa.int64()))

    return df.mapInArrow(run, df.schema)


def _field_schema(fields: list[str], schema: T.StructType) -> T.StructType:
    return T.StructType([schema[f] for f in fields])


def latest_store(spark: SparkSession, root: str) -> DataFrame | None:
    """The store: of every key the fields of its first change (of several
    streams that of the first by name) and all its tags; None while empty."""
    base = root.rstrip("/")
    if not _exists(spark, f"{base}/fields"):
        return None
    schema = T.StructType.fromDDL(spark.read.text(f"{base}/fields").first()[0])
    changes = spark.read.schema(CHANGES + ", stream string").option("basePath", f"{base}/changes").parquet(f"{base}/changes/stream=*")
    one = changes.groupBy(*KEY).agg(F.min_by("row", F.struct("stream", "version")).alias("row"),
                                    F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"))
    return one.select(*KEY, F.from_json("row", schema).alias("f"), "tags").select(*KEY, "f.*", "tags")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stream_metrics(spark: SparkSession, root: str) -> DataFrame:
    """``stream, epoch, kind, name, total, relevant, irrelevant,
    already_tagged`` of every batch: kind ``reject`` (name: reason) or ``tag``."""
    return spark.read.parquet(f"{root.rstrip('/')}/metrics")


_REASONS = ("no_id", "no_abstract", "unprocessable")


def observed(rows: DataFrame, tags: list[str], general_tag: str | None) -> DataFrame:
    """``rows`` (all articles, with ``reject_reason``, ``tags`` and ``pred_<tag>``)
    with their counts observed as they pass (F4, A2, A3)."""
    good = F.col("reject_reason").isNull()
    counts = [F.count_if(F.col("reject_reason") == r).alias(f"reject:{r}") for r in _REASONS]
    counts += [F.count_if(good).alias(f"total:{t}") for t in [*tags, *([general_tag] if general_tag else [])]]
    counts += [F.count_if(good & (F.coalesce(F.col(f"pred_{t}"), F.lit(0)) != 1)).alias(f"irrelevant:{t}") for t in tags]
    return rows.observe("articles", *counts)


def _metric_rows(progress, stream: str):
    for p in progress:
        seen = p.observedMetrics
        if "articles" not in seen or "changes" not in seen:
            continue
        a, c = seen["articles"].asDict(), seen["changes"].asDict()
        for name, n in a.items():
            kind, _, what = name.partition(":")
            if kind == "reject" and n:
                yield stream, p.batchId, "reject", what, n, None, None, None
            if kind == "total":
                irrelevant = a.get(f"irrelevant:{what}", 0)
                yield stream, p.batchId, "tag", what, n, c[what], irrelevant, n - c[what] - irrelevant


def stream_s2orc(spark: SparkSession, source_dir: str, store_root: str, checkpoint: str, *, stream: str | None = None,
                 models=None, general_tag: str | None = None, max_files_per_trigger: int = 1,
                 recipe: str = "s2orc", glob: str = "*.jsonl", **normalise_kw):
    """Run the S2ORC ingest over every file now in ``source_dir`` and stop.
    ``stream`` names the changes of this source (default: by its checkpoint);
    ``normalise_kw`` (lemma table, spelling, flags) goes to the recipe."""
    name = stream or uuid.uuid5(uuid.NAMESPACE_URL, checkpoint.rstrip("/")).hex[:12]
    root = store_root.rstrip("/")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", str(PROGRESS))
    raw = (spark.readStream.schema(S2ORC_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
           .option("pathGlobFilter", glob).json(source_dir))
    tags = list(models or {})
    rows = prepare(_positions(s2orc_articles(raw)), "s2orc", models, general_tag, recipe,
                   watch=lambda df: observed(df, tags, general_tag), **normalise_kw)[0]
    fields = [f for f in STORE_FIELDS if f in rows.columns]
    schema = _field_schema(fields, rows.schema)
    if not _exists(spark, f"{root}/fields"):
        spark.range(1).select(F.lit(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)).alias("value")).coalesce(
            1).write.mode("overwrite").text(f"{root}/fields")
    group = F.pmod(F.xxhash64(*KEY), F.lit(STATE_GROUPS)).cast("int").alias("group")
    light = _lightened(rows.select(group, *KEY, F.col("_seq.file").alias("file"), F.col("_seq.block").alias("block"), F.col("_seq.row").alias("n"),
                                   F.to_json(F.struct(*fields)).alias("row"), "tags"))
    changes = light.groupBy("group").applyInPandasWithState(_changes, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)
    new = [F.count_if(F.col("is_new")).alias(general_tag)] if general_tag else []
    changes = changes.observe("changes", *(F.count_if(F.array_contains("added", t)).alias(t) for t in tags), *new, F.count(F.lit(1)).alias("rows"))
    q = (changes.writeStream.format("parquet").option("path", f"{root}/changes/stream={name}").outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    found = list(_metric_rows(q.recentProgress, name))
    if found:
        spark.createDataFrame(found, "stream string, epoch long, kind string, name string, total long, relevant long, irrelevant long, "
                                     "already_tagged long").coalesce(1).write.mode("append").parquet(f"{root}/metrics")
    return latest_store(spark, root)
