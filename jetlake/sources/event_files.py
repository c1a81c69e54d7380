"""Readers of event data: HepMC3 ASCII files, jet dumps, particle tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetlake.operators import events as ev
from jetlake.operators.grouping import checked_broadcast, fixed
from jetlake.sources import tables

# The last part of a path.
_LAST = r"/[^/]*$"
END_MARK = "-END_EVENT_LISTING"
# Token positions (from 0) in a particle line.
TOKENS = {"barcode": (1, "int"), "vertex": (2, "int"), "pdgid": (3, "int"),
          "px": (4, "double"), "py": (5, "double"), "pz": (6, "double"), "e": (7, "double"),
          "status": (9, "int")}


def parse_hepmc3(records: DataFrame, final_only=True) -> DataFrame:
    """Event rows from text records (``file``, ``value``), one event per record.

    A record is what follows an event tag up to the next one.  The record ahead
    of the first event holds the file header and has no event number.
    """
    # The listing ends at this mark; what is left of its line is no particle line.
    body = F.substring_index("value", END_MARK, 1)
    number = F.regexp_extract("value", r"^(?:E )?\s*(\d+)\s", 1)
    lines = F.filter(F.split(body, "\n"), lambda line: line.startswith("P "))
    tokens = F.transform(lines, _tokens)
    if final_only:
        tokens = F.filter(tokens, lambda t: t[TOKENS["status"][0]] == F.lit(str(ev.FINAL_STATE)))

    def particle(t):
        return F.struct(*[t[i].cast(kind).alias(name) for name, (i, kind) in TOKENS.items()])

    return records.select("file", number.alias("number"), F.transform(tokens, particle).alias("particles")).where(
        "number <> ''").select("file", F.col("number").cast("bigint").alias("event"), "particles")


def _tokens(line):
    """Blank-separated tokens; only uneven blanks need the pattern."""
    uneven = line.contains("  ") | line.contains("\t")
    return F.when(uneven, F.split(F.trim(line), r"\s+")).otherwise(F.split(line, " "))


def read_hepmc3(spark, paths, max_events=None, skip_events=0, final_only=True) -> DataFrame:
    """One row per event: file, event, particles.

    The event tag is the record separator, so Spark splits plain files at event
    boundaries; compressed files (.gz and other Hadoop codecs) are read in
    place, one task each.
    """
    text = spark.read.option("lineSep", "\nE ").text(paths)
    events = parse_hepmc3(text.select(F.col("_metadata.file_path").alias("file"), "value"), final_only)
    if max_events is None and not skip_events:
        return events
    return ev.event_window(events, max_events, skip_events)


def parse_jet_dump(records: DataFrame) -> DataFrame:
    """Event rows of jets (rap, phi, pt) from text records cut at ``Jets in``."""
    lines = F.split("value", "\n")
    number = F.regexp_extract(lines[0], r"(\d+)", 1)
    event = F.when(number == "", F.raise_error(F.concat(F.lit("no event number in: "), lines[0]))
                   ).otherwise(number.cast("bigint"))
    shown = F.filter(lines, lambda line, i: (i > 0) & line.startswith(" ") & (F.trim(line) != ""))
    tokens = F.transform(shown, lambda line: F.split(F.trim(line), r"\s+"))
    jets = F.transform(tokens, lambda t: F.struct(*[
        t[i].cast("double").alias(c) for i, c in ((1, "rap"), (2, "phi"), (3, "pt"))]))
    # What comes before the first header starts with neither of these.
    is_event = F.col("value").startswith(" ") | F.col("value").startswith("Jets in")
    return records.where(is_event).select("file", event.alias("event"), jets.alias("jets"))


def read_jet_dump(spark, paths, keep_empty=True) -> DataFrame:
    """One row per event of a jet text dump; see ``selection.format_jet_dump``."""
    text = spark.read.option("lineSep", "\nJets in").text(paths)
    jets = parse_jet_dump(text.select(F.col("_metadata.file_path").alias("file"), "value"))
    return jets if keep_empty else jets.where(F.size("jets") > 0)


def read_particles(spark, path, keys=("event",), order="idx", max_events=None, fmt="parquet") -> DataFrame:
    """Event rows from a columnar particle table with px, py, pz, e."""
    particles = spark.read.format(fmt).load(path)
    if max_events is not None:
        files = [k for k in keys if k != "event"] or ["_all"]
        particles = particles.withColumn("_all", F.lit(0))
        wanted = ev.event_window(particles.select(*files, "event").distinct(), max_events, keys=files)
        particles = particles.join(wanted, [*files, "event"], "left_semi").drop("_all")
    return ev.assemble_events(particles, list(keys), order)


def read_manifest_events(spark, manifest, max_events=None, skip_events=0, final_only=True, buckets=None) -> DataFrame:
    """The events of all files of a manifest, each with its file's row: ``listed_file``, mean_particles, File_path.

    ``manifest`` is a CSV or a list of event files (``tables.read_manifest``).  With
    ``buckets`` the events are spread over so many tasks by the cost of clustering
    them.  A file that the manifest lists twice is read once; a listed directory is one
    file in parts (see ``sinks.write_named``).
    """
    # A name of its own, as ``file`` is the path that was read.
    listed = fixed(tables.read_manifest(spark, manifest).withColumnRenamed("File", "listed_file").dropDuplicates(["File_path"]))
    paths = [row.File_path for row in listed.select("File_path").collect()]  # the reader's list of files
    if not paths:
        raise ValueError("the manifest lists no files")
    events = read_hepmc3(spark, paths, final_only=final_only)
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.get(
        spark.sparkContext._jsc.hadoopConfiguration()).getWorkingDirectory().toUri().getPath()
    known = checked_broadcast(listed.withColumn("_path", _bare_path(F.col("File_path"), here)))
    homes = known.select(F.col("_path").alias("_home"), F.struct(*listed.columns).alias("_of"))
    joined = events.withColumn("_path", F.url_decode(F.replace(_bare_path(F.col("file"), here), F.lit("+"), F.lit("%2B"))))
    joined = joined.withColumn("_home", F.regexp_replace("_path", _LAST, "")).join(known, "_path", "left")
    joined = joined.join(homes, "_home", "left")
    part = F.col("File_path").isNull()
    lost = F.raise_error(F.concat(F.lit("file is not in the manifest: "), F.col("_path")))
    joined = joined.withColumn("file", F.when(part, F.regexp_replace("file", _LAST, "")).otherwise(F.col("file"))).withColumns({
        c: F.when(part, F.col(f"_of.`{c}`")).otherwise(F.col(f"`{c}`")) for c in listed.columns})
    joined = joined.withColumn("File_path", F.coalesce("File_path", lost.cast("string"))).drop("_path", "_home", "_of")
    if max_events is not None or skip_events:
        joined = ev.event_window(joined, max_events, skip_events)
    return ev.placed_by_cost(joined, buckets) if buckets else joined


def _bare_path(path, here):
    """A full path without scheme and authority."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    full = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit(f"{here}/"), bare))
    return F.regexp_replace(full, r"/(\.?/)+", "/")
