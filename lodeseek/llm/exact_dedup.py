"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries, one per partition of the scan, find the digests that may hold more than a share
``phi`` of all rows. Summed over partitions they stay lower bounds, so at most ``2 / phi`` digests can
reach half that share: this proves the size of the broadcast. Exact counts of those candidates (a
pre-aggregated group-by) give their winners, which are broadcast: heavy copies are settled map-side and
never meet in one task. All other digests, none above ``phi`` of the rows, take one ordinary shuffle.

Defined cases: a null text counts as the empty text; texts are equal when their SHA-256 is equal; the row
with the largest id stays, a null id being smallest; of rows that repeat both id and text exactly one
stays; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.plans.staging import stage

#: A digest above this share of the rows is surely settled map-side.
PHI = 1 / 2048


def text_digest(text: Column | str) -> Column:
    """SHA-256 of a text as 32 bytes; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """Summary of the first column: lower bounds of counts, each short by rows / (counters + 1) at most."""
    kept: dict[bytes, int] = {}
    for batch in batches:
        for entry in pc.value_counts(batch.column(0)):
            key = entry["values"].as_py()
            kept[key] = kept.get(key, 0) + entry["counts"].as_py()
        if len(kept) > counters:
            cut = sorted(kept.values(), reverse=True)[counters]
            kept = {key: n - cut for key, n in kept.items() if n > cut}
    yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["digest", "n"])


def heavy_candidates(digests: DataFrame, phi: float = PHI) -> DataFrame:
    """At most ``2 / phi`` digests, every one above a share ``phi`` of the rows among them."""
    counters = round(2 / phi)
    rows = digests.count()
    summaries = digests.select("digest").mapInArrow(lambda it: misra_gries(it, counters), "digest binary, n long")
    return summaries.groupBy("digest").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(2.0, rows * phi / 2)).select("digest")


def heavy_winners(digests: DataFrame, phi: float = PHI) -> DataFrame:
    """Exact group size and winner (id, row) of each candidate, staged; small enough to broadcast."""
    candidates = stage(heavy_candidates(digests, phi), "heavy-digests")
    found = (
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("winner"))
    )
    return stage(found, "heavy-winners")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phi: float = PHI) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest (32 bytes)."""
    digests = docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    digests = stage(digests, "digests")
    told = digests.join(F.broadcast(heavy_winners(digests, phi)), "digest", "left")
    group = Window.partitionBy("digest")
    light = told.filter(F.col("group_size").isNull()).select(
        "doc_id", "digest", "row", F.count("*").over(group).alias("group_size"), F.max(F.struct("doc_id", "row")).over(group).alias("winner")
    )
    heavy = told.filter(F.col("group_size").isNotNull()).select("doc_id", "digest", "row", "group_size", "winner")
    return heavy.unionByName(light).select(
        "doc_id", F.col("winner.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("winner.row")).alias("kept"), "digest"
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phi: float = PHI) -> DataFrame:
    """The rows that stay, with all their columns; the texts of heavy copies are never shuffled."""
    columns = docs.columns
    own = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_digest(F.col(f"`{text_col}`")).alias("digest"), own)
    digests = stage(rows.select("doc_id", "digest", F.monotonically_increasing_id().alias("row")), "digests")
    winners = heavy_winners(digests, phi).select("digest", F.col("winner.doc_id").alias("keep_id"), F.lit(True).alias("heavy"))
    told = rows.join(F.broadcast(winners), "digest", "left")
    last = Window.partitionBy("digest").orderBy(F.col("doc_id").desc_nulls_last())
    light = told.filter(F.col("heavy").isNull()).withColumn("rank", F.row_number().over(last)).filter("rank = 1").select("own")
    heavy = told.filter(F.col("heavy") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.first("own").alias("own")).select("own")
    return light.unionByName(heavy).select("own.*")
