"""Votes carried to the same footage, and files forgotten by folder and name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import INHERIT_IOU, overlap_pairs


def spread_votes(votes: DataFrame, clips: DataFrame, by: Sequence[str], clip_id: str, start: str, end: str, vote_id: str, also: DataFrame | None = None, spread: str | None = None, least: float = INHERIT_IOU, width: float = 3600.0) -> DataFrame:
    """A row for every clip that each vote reaches: the vote's columns, ``clip_id`` the clip, ``inherited_from`` the clip voted on (null for itself).

    A vote goes to its clip, to the clips of the same ``by`` that overlap it by ``least`` of their union, unless its column ``spread`` is false, and to those of ``also`` (``vote_id``, ``clip_id``), each
    once. Votes on unknown clips, and unknown clips of ``also``, are left out.
    """
    rest = [c for c in votes.columns if c != clip_id]
    known = clips.select(clip_id).distinct()
    own = votes.join(known, clip_id, "left_semi")
    pairs = overlap_pairs(clips, by, start, end, clip_id, least, width=width).select("a", "b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    wide = own if spread is None else own.where(F.coalesce(spread, F.lit(True)))
    near = wide.join(both.withColumnRenamed("a", clip_id), clip_id).select(*rest, F.col("b").alias(clip_id), F.col(clip_id).alias("inherited_from"))
    me = own.select(*rest, clip_id, F.lit(None).cast(votes.schema[clip_id].dataType).alias("inherited_from"))
    if also is not None:
        more = also.select(vote_id, F.col(clip_id).alias("_also")).join(known.withColumnRenamed(clip_id, "_also"), "_also", "left_semi")
        shown = own.join(more, vote_id).where(F.col("_also") != F.col(clip_id)).select(*rest, F.col("_also").alias(clip_id), F.col(clip_id).alias("inherited_from"))
        near = near.unionByName(shown)
    return me.unionByName(near.dropDuplicates([vote_id, clip_id]))


def lies_under(path: Column, folder: Column, name_prefix: Column) -> Column:
    """Whether a file lies in a folder or below it, and its name begins so. A folder of the same beginning is another one."""
    inside = F.startswith(path, F.concat(F.rtrim(folder, F.lit("/")), F.lit("/")))
    return inside & F.startswith(F.substring_index(path, "/", -1), name_prefix)


def forget(files: DataFrame, orders: DataFrame, same: Sequence[str], path: str = "path") -> DataFrame:
    """``files`` without those that an order (``same``, ``folder``, ``name_prefix``) takes away: equal in ``same``, in its folder or below, with its beginning of the name.

    Folders are met by equality: a file has as many as its path is deep.
    """
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    asked = orders.select(*same, F.rtrim(F.col("folder"), F.lit("/")).alias("_folder"), F.col("name_prefix").alias("_prefix")).distinct()
    where = files.select(*same, path).distinct().withColumn("_folder", F.explode(above)).join(asked, [*same, "_folder"]).where(lies_under(F.col(path), F.col("_folder"), F.col("_prefix")))
    return files.join(where.select(*same, path).distinct(), [*same, path], "left_anti")
