"""Matching paths to templates such as `/a/{id}/b`, by hashed keys in place of patterns tried one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import template_pattern

#: Distinct masks that are sent to every task at most: some 10 MB.
MASKS = 100_000


def _masked(segments: Column, mask: Column) -> Column:
    """The segments that the mask (a text of 0 and 1) marks 0, in their places, and nothing in the others'."""
    return F.array_join(F.zip_with(segments, F.split(mask, ""), lambda s, m: F.when(m == "0", s).otherwise(F.lit(""))), "/")


def match_templates(paths: DataFrame, path: str, templates: DataFrame, template: str) -> DataFrame:
    """Rows of paths with each template that their path matches as a whole; `{name}` stands for one or more characters but `/`.

    A template's segments with a variable are its mask. A path is cut into segments once and probes, for each distinct mask
    of its length, one key: the mask and the segments beside it. Templates with equal keys are confirmed by their pattern.
    So the work is paths x distinct masks of a length, whatever the number of templates. Null paths and templates match nothing.
    """
    cut = F.split(F.col(template), "/")
    mask = F.array_join(F.transform(cut, lambda s: F.when(s.rlike(r"\{[^}]*\}"), "1").otherwise("0")), "")
    keyed = templates.where(F.col(template).isNotNull()).select(F.col(template).alias("_template"), mask.alias("_mask"), cut.alias("_cut")).distinct()
    keyed = keyed.select("_template", template_pattern(F.col("_template")).alias("_pattern"), "_mask", F.length("_mask").alias("_n"), _masked(F.col("_cut"), F.col("_mask")).alias("_key"))
    masks = keyed.select("_n", "_mask").distinct()
    masks = F.broadcast(masks) if masks.count() <= MASKS else masks
    segments = F.split(F.col(path), "/")
    probes = paths.where(F.col(path).isNotNull()).withColumn("_n", F.size(segments)).join(masks, "_n").withColumn("_key", _masked(segments, F.col("_mask")))
    found = probes.join(keyed, ["_n", "_mask", "_key"]).where(F.expr(f"`{path}` rlike _pattern"))
    return found.select(*paths.columns, F.col("_template").alias(template))
