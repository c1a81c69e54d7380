"""End-to-end paths: event rows to jets, jet summaries and substructure."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetlake.operators import clustering, selection, substructure
from jetlake.operators.events import assemble_events
from jetlake.plans import views


def event_rows(spark, sf_dir, event="l_partkey") -> DataFrame:
    """Final-state event rows of the particle view, inputs in order."""
    rows = views.particle_rows(spark, sf_dir, event).where("status = 1")
    order = F.struct(*[c.strip() for c in views.INPUT_ORDER.split(",")])
    return assemble_events(rows.withColumn("idx", order), ["event"])


def jets(spark, sf_dir, algorithm="AntiKt", R=0.4, p=None, ptmin=5.0, event="l_partkey", **options) -> DataFrame:
    """Inclusive jets as rows."""
    events = event_rows(spark, sf_dir, event)
    return selection.jet_rows(clustering.inclusive_jets(events, algorithm, R, p, ptmin=ptmin, **options))


def exclusive(spark, sf_dir, algorithm, R, p=None, dcut=None, njets=None) -> DataFrame:
    """Exclusive jets as rows; with a jet number, an event of too few particles stays as one row without a jet."""
    sequence = clustering.cluster(event_rows(spark, sf_dir), algorithm, R, p)
    chosen = selection.select_jets(sequence, dcut=dcut, njets=njets, too_few="none")
    return selection.jet_rows(chosen, keep_empty=njets is not None)


def groomed(spark, sf_dir, method, R=1.0, **params) -> DataFrame:
    return substructure.measured(substructure.groom_events(event_rows(spark, sf_dir), method, R, **params))
