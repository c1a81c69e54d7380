"""Jet selection from cluster sequences, jet tables, dumps and documents.

Everything here is a native array expression on the event row: no shuffle, no
Python at run time.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetlake import schemas
from jetlake.constants import BEAM
from jetlake.functions import kinematics as kin

EMPTY = f"array<{schemas.MOMENTUM}>"


def _sequence(columns=("jets", "history")):
    return [F.col(c) for c in columns]


def _pt(momentum: Column) -> Column:
    return kin.pt(momentum["px"], momentum["py"])


def _jet_of(entry: Column) -> Column:
    """The momentum behind a history entry number."""
    jets, history = _sequence()
    return F.get(jets, F.get(history, entry)["jet"])


def beam_entries() -> Column:
    """History entries of the jets that met the beam, in clustering order."""
    met = F.filter("history", lambda h: (h["parent2"] == BEAM) & (h["parent1"] >= 0))
    return F.transform(met, lambda h: h["parent1"])


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once and used many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _exclusive(stop: Column) -> Column:
    """Jets that exist once all history entries before ``stop`` have happened."""
    history = F.col("history")

    def alive(stop):
        # Each later entry uses up one or two objects; those made before the stop are the answer.
        later = F.slice(history, stop + 1, F.greatest(F.size(history) - stop, F.lit(0)))
        used = F.flatten(F.transform(later, lambda h: F.array(h["parent1"], h["parent2"])))
        return F.transform(F.filter(used, lambda x: (x >= 0) & (x < stop)), _jet_of)

    return let(stop, alive)


def by_pt(jets: Column) -> Column:
    """Hardest first; equal pt keeps the given order."""
    keyed = F.transform(jets, lambda j, i: F.struct((-_pt(j)).alias("k"), i.alias("i"), j.alias("j")))
    return F.transform(F.sort_array(keyed), lambda x: x["j"])


def select_jets(clustered: DataFrame, ptmin=None, dcut=None, njets=None, too_few="error") -> DataFrame:
    """Replace ``jets`` by the selected jets, hardest first.

    Exactly one of: ``ptmin`` (inclusive), ``dcut`` or ``njets`` (exclusive).
    An event with fewer than ``njets`` particles fails, or with
    ``too_few="none"`` stays with an empty list.
    """
    if sum(x is not None for x in (ptmin, dcut, njets)) != 1:
        raise ValueError("exactly one of ptmin, dcut and njets must be given")
    if too_few not in ("error", "none"):
        raise ValueError("too_few must be 'error' or 'none'")
    history = F.col("history")
    if ptmin is not None:
        chosen = F.filter(F.transform(beam_entries(), _jet_of), lambda j: _pt(j) >= F.lit(float(ptmin)))
    elif dcut is not None:
        # max_dij never decreases, so the entries below the cut are a prefix.
        chosen = _exclusive(F.size(F.filter(history, lambda h: h["max_dij"] <= F.lit(float(dcut)))))
    else:
        if njets < 0:
            raise ValueError("njets must not be negative")
        inputs = (F.size(history) / 2).cast("int")
        chosen = F.when(
            inputs < njets,
            F.slice("jets", 1, 0) if too_few == "none" else F.raise_error(F.format_string(
                f"{njets} exclusive jets requested from an event with %d particles", inputs)),
        ).otherwise(_exclusive(F.greatest(2 * inputs - F.lit(int(njets)), inputs)))
    rest = [c for c in clustered.columns if c not in ("jets", "history", "membership", "particles")]
    return clustered.select(*rest, by_pt(chosen).alias("jets"))


def jet_rows(selected: DataFrame, keep_empty=False) -> DataFrame:
    """One row per jet: 0-based ``jet_rank`` by pt, rap, phi, pt and the momentum."""
    keys = [c for c in selected.columns if c != "jets"]
    explode = F.posexplode_outer if keep_empty else F.posexplode
    rows = selected.select(*keys, explode("jets").alias("jet_rank", "jet"))
    jet = F.col("jet")
    return rows.select(
        *keys, "jet_rank",
        kin.rapidity(*kin.of(jet)).alias("rap"),
        kin.phi(jet["px"], jet["py"]).alias("phi"),
        _pt(jet).alias("pt"),
        kin.mass(*kin.of(jet)).alias("mass"),
        jet["px"].alias("px"), jet["py"].alias("py"), jet["pz"].alias("pz"), jet["e"].alias("e"))


def jets_table(clustered: DataFrame) -> DataFrame:
    """All objects of the cluster sequence, numbered from 1 as in a sequence dump."""
    keys = [c for c in clustered.columns if c not in ("jets", "history", "membership", "particles")]
    return (clustered.select(*keys, F.posexplode("jets").alias("pos", "jet"))
            .select(*keys, (F.col("pos") + 1).alias("jet_id"), "jet.*"))


def history_table(clustered: DataFrame) -> DataFrame:
    """The clustering history; entry and parent numbers count from 1.

    Negative markers (-2 no parent, -1 beam, -1 no child) are kept as they are.
    """
    keys = [c for c in clustered.columns if c not in ("jets", "history", "membership", "particles")]
    rows = clustered.select(*keys, F.posexplode("history").alias("pos", "h"))

    def one_based(c):
        return F.when(c >= 0, c + 1).otherwise(c)

    h = F.col("h")
    return rows.select(
        *keys, (F.col("pos") + 1).alias("entry"),
        *[one_based(h[c]).alias(c) for c in ("parent1", "parent2", "child", "jet")],
        h["dij"].alias("dij"), h["max_dij"].alias("max_dij"))


def _measured(jets: Column) -> Column:
    return F.transform(jets, lambda j: F.struct(
        kin.rapidity(*kin.of(j)).alias("rap"),
        kin.phi(j["px"], j["py"]).alias("phi"),
        _pt(j).alias("pt")))


def jet_documents(selected: DataFrame, keep_empty=True) -> DataFrame:
    """One document per event: ``jetid`` and the nested ``jets`` (rap, phi, pt)."""
    keys = [c for c in selected.columns if c not in ("jets", "event")]
    docs = selected.select(*keys, F.col("event").alias("jetid"), _measured(F.col("jets")).alias("jets"))
    return docs if keep_empty else docs.where(F.size("jets") > 0)


def format_jet_dump(selected: DataFrame, number="event") -> DataFrame:
    """The text block of each event: a header line with its ``number`` column, then one line per jet."""
    keys = [c for c in selected.columns if c != "jets"]
    lines = F.transform(_measured(F.col("jets")), lambda j, i: F.format_string(
        "%5d %15.10f %15.10f %15.10f", i, j["rap"], j["phi"], j["pt"]))
    header = F.format_string("Jets in processed event %d", F.col(number))
    return selected.select(*keys, F.concat_ws("\n", F.array(header), lines).alias("value"))


def jets_per_file(selected: DataFrame, keys=("file",)) -> DataFrame:
    """Number of selected jets of each file."""
    return selected.groupBy(*keys).agg(F.sum(F.size("jets").cast("bigint")).alias("n_jets"))




def argmin(values: Column, prefix: Column | None = None) -> Column:
    """Smallest value of an array (or of its first ``prefix`` items) and its first 1-based index."""
    shown = values if prefix is None else F.slice(values, F.lit(1), prefix)
    return F.array_min(F.transform(
        shown, lambda x, i: F.struct(x.alias("value"), (i + 1).alias("index"))))
