"""Clusters of annotated mentions from their relations, and the sentences that annotators checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.sampling import placed

#: Where the numbers of mentions without a relation begin.
FIRST_EVENT = 100_000_000
FIRST_ENTITY = 200_000_000


def with_clusters(mentions: DataFrame, relations: DataFrame, targets: DataFrame) -> DataFrame:
    """mentions (doc, m_id, is_event, ...) with ``cluster_id`` and ``cluster_desc``.

    relations: doc, r_id, tag, source, target, one row for each source; of several with one source the
    greatest r_id counts. targets: doc, m_id, instance (three letters and a number), descriptor. Relations
    within a document number the cluster by r_id and 1 for events or 0 for entities, others by the target's
    instance. Mentions without a relation are clusters of their own, numbered in the order of doc and m_id."""
    one = relations.groupBy("doc", F.col("source").alias("m_id")).agg(F.max(F.struct("r_id", "tag", "target")).alias("r"))
    info = targets.select("doc", F.col("m_id").alias("__target"), "instance", "descriptor")
    joined = mentions.join(one, ["doc", "m_id"], "left").withColumn("__target", F.col("r.target")).join(info, ["doc", "__target"], "left")
    own = F.concat(F.col("r.r_id").cast("string"), F.when(F.col("is_event"), "1").otherwise("0"))
    number = F.when(F.startswith("r.tag", F.lit("INTRA")), own).otherwise(F.substring("instance", 4, 64)).cast("long")
    linked = joined.where("r IS NOT NULL").withColumns({"cluster_id": number, "cluster_desc": F.coalesce("descriptor", F.lit(""))})
    alone = mentions.join(one, ["doc", "m_id"], "left_anti")
    out = linked.select(*mentions.columns, "cluster_id", "cluster_desc")
    for is_event, first in ((True, FIRST_EVENT), (False, FIRST_ENTITY)):
        rows = placed(alone.where(F.col("is_event") == is_event), "doc", "m_id")
        out = out.unionByName(rows.select(*mentions.columns, (F.col("place") + first).alias("cluster_id"), F.lit("").alias("cluster_desc")))
    return out


def of_listed_sentences(rows: DataFrame, listed: DataFrame, key: str, idx: str) -> DataFrame:
    """The rows (tokens, mentions) of the sentences in a list of key and idx, repeated or not."""
    return rows.join(listed.select(key, idx), [key, idx], "left_semi")
