"""Streams of clicked points against static map tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.areas import containing
from ..operators.nearest import nearest_building
from ..plans.tables import passing


def areas_of_clicks(clicks: DataFrame, vertices: DataFrame) -> DataFrame:
    """A stream (point_id, lat, lon) with the areas that contain each point: a stateless stream-static join."""
    return containing(clicks, vertices)


def buildings_of_clicks(clicks: DataFrame, buildings: DataFrame, write, checkpoint: str):
    """Starts a query that passes each micro-batch's nearest buildings to write(df, batch). The search grows its grid in
    rounds, so it runs on micro-batches; checkpoint is the stream's own folder. What a batch settles goes when it has been written."""

    def run(df, batch):
        with passing():
            write(nearest_building(df, buildings), batch)

    return clicks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
