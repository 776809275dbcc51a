"""Gold files paired with images, by tiers of ever looser keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import exprs as x
from quillframe.sources import filesink, tables


def image_stems(paths: DataFrame) -> DataFrame:
    """(path, name, stem) of the image files of paths(path)."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return paths.filter(x.route(F.col("path")) == "image").select("path", name.alias("name"), _stem(name).alias("stem"))


def _stem(name: Column) -> Column:
    """A file's name without its suffix; a leading point begins none."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def pair(gold: DataFrame, images: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """JN4, JN5: (stem, path, tier, ambiguous) of each row of gold(stem): the image with the same stem, else the least one with the stem and a trailing _digits, else the same stem by letters and digits alone, else an image with the stem of the file that the gold itself names (named(stem, image)), or that stem by letters and digits alone. path and tier are null without a match. Of several images with one key the least path counts, and so of several names of one gold file; ambiguous tells that tier 2 had several.

    The image side is aggregated by key before each join, so a key that many images share yields one row.
    """
    own = image_stems(images)
    least = lambda key, c: own.select(key.alias(c), "path").filter(F.col(c).isNotNull()).groupBy(c)
    exact = least(F.col("stem"), "stem").agg(F.min("path").alias("p1"))
    framed = least(x.frame_stem(F.col("stem")), "stem").agg(F.min("path").alias("p2"), F.count(F.lit(1)).alias("n2"))
    bare = least(x.bare_name(F.col("stem")), "bare").agg(F.min("path").alias("p3"))
    out = gold.select("stem").join(exact, "stem", "left").join(framed, "stem", "left").withColumn("bare", x.bare_name(F.col("stem"))).join(bare, "bare", "left")
    out = out.withColumn("p4", F.lit(None).cast("string"))
    if named is not None:
        told = named.select(F.col("stem").alias("gold"), _stem(F.col("image")).alias("stem")).withColumn("bare", x.bare_name(F.col("stem"))).distinct()
        told = told.join(exact, "stem", "left").join(bare, "bare", "left").select("gold", F.coalesce("p1", "p3").alias("p4"))
        out = out.drop("p4").join(told.filter("p4 is not null").groupBy(F.col("gold").alias("stem")).agg(F.min("p4").alias("p4")), "stem", "left")
    tier = F.when(F.col("p1").isNotNull(), 1).when(F.col("p2").isNotNull(), 2).when(F.col("p3").isNotNull(), 3).when(F.col("p4").isNotNull(), 4)
    return out.select("stem", F.coalesce("p1", "p2", "p3", "p4").alias("path"), tier.alias("tier"), F.coalesce(F.col("p1").isNull() & (F.col("n2") > 1), F.lit(False)).alias("ambiguous"))


def unmatched(pairs: DataFrame) -> DataFrame:
    """JN7: the gold stems without an image."""
    return pairs.filter("path is null").select("stem")


def held_out(pairs: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """JN6: the pairs whose key is among names(key)."""
    return pairs.join(names.select(key), key, "left_semi")


def first(pairs: DataFrame, n: int) -> DataFrame:
    """T-3: the first n matched pairs by stem."""
    return pairs.filter("path is not null").orderBy("stem").limit(n)


def mapping(pairs: DataFrame, suffix: str = ".expected.json") -> DataFrame:
    """K9: (stem, path, image, gold) of the matched pairs: what to copy, and the names below the output folder: the image under its own name, and the gold file of this stem and suffix. Written, this is the dry run."""
    return pairs.filter("path is not null").select("stem", "path", F.concat(F.lit("images/"), F.regexp_extract("path", r"([^/]*)$", 1)).alias("image"), F.concat(F.lit("jsons/"), "stem", F.lit(suffix)).alias("gold"))


def copy(pairs: DataFrame, gold: DataFrame, folder: str) -> dict[str, int]:
    """K9: copies the matched pairs to folder/jsons and folder/images, as one commit, and gives its counts. gold: (stem, path) of the gold files; their names are kept, as are the images'. An image that several gold files were paired with is copied once; of images with one name but other paths, the least path. Bytes go from file to file in tasks, never through rows."""
    name = lambda folder: F.concat(F.lit(folder), F.regexp_extract("copy_from", r"([^/]*)$", 1)).alias("name")
    matched = pairs.filter("path is not null")
    images = matched.select(F.col("path").alias("copy_from")).select(name("images/"), "copy_from")
    jsons = gold.join(matched.select("stem"), "stem", "left_semi").select(F.col("path").alias("copy_from")).select(name("jsons/"), "copy_from")
    return filesink.write_files(tables.once(images.union(jsons).groupBy("name").agg(F.min("copy_from").alias("copy_from"))), folder)


def counters(pairs: DataFrame) -> DataFrame:
    """K9: one row (matched, ambiguous, unmatched)."""
    return pairs.agg(F.count("path").alias("matched"), F.count(F.when(F.col("ambiguous"), 1)).alias("ambiguous"), F.count(F.when(F.col("path").isNull(), 1)).alias("unmatched"))
