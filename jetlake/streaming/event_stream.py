"""Event files that keep arriving, processed by the same operators.

Reading, final-state selection, clustering and jet selection work on one event
row at a time, so they apply unchanged to a file stream and need no state.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetlake.operators import clustering
from jetlake.sources.event_files import parse_hepmc3


def stream_hepmc3(spark, directory, final_only=True, files_per_trigger=None) -> DataFrame:
    """Event rows of the HepMC3 files that appear in a directory."""
    reader = spark.readStream.option("lineSep", "\nE ")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    text = reader.text(directory)
    return parse_hepmc3(text.select(F.col("_metadata.file_path").alias("file"), "value"), final_only)


def stream_jets(spark, directory, ptmin=5.0, **clustering_options) -> DataFrame:
    """Inclusive jets of every arriving event."""
    return clustering.inclusive_jets(stream_hepmc3(spark, directory), ptmin=ptmin, **clustering_options)
