"""A directory of recipe texts as a stream: of each batch the newest valid text wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.recipe import RecipeError, parse_recipe


def recipe_stream(spark: SparkSession, directory: str) -> DataFrame:
    """``(value, name, modified)`` of every text file that appears in ``directory``."""
    texts = spark.readStream.format("text").option("wholetext", True).load(directory)
    return texts.select("value", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("modified"))


class LatestRecipe:
    """The last good recipe and its generation; invalid or unchanged texts leave both as they are."""

    def __init__(self) -> None:
        self.generation, self.text, self.steps, self.error = 0, None, None, None

    def offer(self, text: str) -> bool:
        """Take ``text`` if it is new and valid; whether it was taken."""
        if text == self.text or not text.strip():
            return False
        try:
            steps = parse_recipe(text)
        except RecipeError as error:
            self.error = str(error)
            return False
        self.generation, self.text, self.steps, self.error = self.generation + 1, text, steps, None
        return True


def follow(stream: DataFrame, latest: LatestRecipe, changed: Callable[[LatestRecipe], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Offer the newest text of each batch and call ``changed`` when it is taken."""

    def batch(rows: DataFrame, _: int) -> None:
        newest = rows.agg(F.max_by("value", F.struct("modified", "name")).alias("value")).first()
        if newest and newest["value"] is not None and latest.offer(newest["value"]):
            changed(latest)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def newest_versions(results: DataFrame, registry: DataFrame) -> DataFrame:
    """``results(id, version, ...)`` whose version is the registry's: late results of replaced files are dropped."""
    return results.join(registry.select("id", "version"), ["id", "version"], "left_semi")
