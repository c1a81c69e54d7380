"""Jet substructure on cluster sequences.

Reclustering groomers turn each jet into an event row of its constituents and
use the ordinary clustering operator on it.  Declustering taggers follow the
primary branches of the history with array expressions inside the event row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetlake.functions import kinematics as kin
from jetlake.operators import clustering, selection
from jetlake.operators.selection import let

METHODS = ("filter", "trim", "mass_drop", "soft_drop")


def _beam_jets(ptmin) -> Column:
    """The jets that met the beam with pt >= ptmin: number, history entry, momentum."""
    numbered = F.transform(selection.beam_entries(), lambda x, i: F.struct(
        i.alias("jet_id"), x.alias("entry"), selection._jet_of(x).alias("jet")))
    return F.filter(numbered, lambda j: kin.pt(j["jet"]["px"], j["jet"]["py"]) >= F.lit(float(ptmin)))


def _tour_next() -> Column:
    """The tour through the merge trees: for each entry x, what follows entering (2x) and leaving (2x + 1) it.

    Entering a merge goes on to its first parent; leaving an object goes on to its
    sibling or leaves the merge.  The last step of a tree points to itself.
    """
    history = F.col("history")

    def after(h, x):
        inside = F.when(h["parent1"] < 0, 2 * x + 1).otherwise(2 * h["parent1"])
        user = F.get(history, h["child"])
        outside = F.when((h["child"] < 0) | (user["parent2"] < 0), 2 * x + 1).when(
            user["parent1"] == x, 2 * user["parent2"]).otherwise(2 * h["child"] + 1)
        return F.array(inside, outside)

    return F.flatten(F.transform(history, after))


def with_intervals(clustered: DataFrame) -> DataFrame:
    """Adds ``leaves``, the inputs in the order of a tour through the merge trees, and ``spans``.

    ``spans`` has for each history entry where its inputs begin in ``leaves`` and
    how many they are, so the constituents of any object are a slice.  The places
    come from the lengths of the tour that are left at entering and leaving an
    object, found by pointer doubling.
    """
    inputs = (F.size("history") / 2).cast("int")
    marks = F.transform("_next", lambda n, t: F.struct(
        n.alias("next"), F.when((t % 2 == 0) & (F.floor(t / 2) < F.size("membership")), 1).otherwise(0).alias("left")))
    rounds = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.size("_next").cast("double"))), F.lit(1)).cast("int"))

    def doubled(now, _):
        def jump(m, t):
            onward = F.get(now, m["next"])
            return F.struct(onward["next"].alias("next"), (m["left"] + F.when(m["next"] == t, 0).otherwise(onward["left"])).alias("left"))
        return F.transform(now, jump)

    rows = clustered.withColumn("_next", _tour_next())
    rows = rows.withColumn("_tour", F.when(inputs > 0, F.aggregate(rounds, marks, doubled)).otherwise(marks))

    def left_at(entry):
        return F.get("_tour", 2 * entry)["left"]

    order = F.sort_array(F.transform("membership", lambda owner, i: F.struct(
        owner.alias("owner"), (-left_at(i)).alias("back"), i.alias("i"))))
    rows = rows.withColumn("_order", order).withColumn("leaves", F.transform("_order", lambda o: o["i"]))
    # Where each beam jet begins: its leaves are together, the first has the whole tree left.
    starts = F.filter(F.transform("_order", lambda o, k: F.struct(
        o["owner"].alias("owner"), k.alias("k"), (-o["back"]).alias("all"))), lambda s: (s["k"] == 0) | (
            F.get("_order", s["k"] - 1)["owner"] != s["owner"]))
    rows = rows.withColumn("_starts", starts)

    def span(x):
        # The first input of an object has as much of the tour left as the object has on entering it.
        return F.struct(left_at(x).alias("left"), (left_at(x) - F.get("_tour", 2 * x + 1)["left"]).alias("count"))

    root = F.aggregate(rounds, F.transform("history", lambda h, x: F.when(
        (h["child"] < 0) | (F.get("history", h["child"])["parent2"] < 0), x).otherwise(h["child"])),
        lambda now, _: F.transform(now, lambda x: F.get(now, x)))
    rows = rows.withColumn("_root", F.when(inputs > 0, root).otherwise(F.array().cast("array<int>")))
    numbers = F.map_from_entries(F.transform(beam_numbered(), lambda b: F.struct(b["entry"], b["jet_id"])))
    rows = rows.withColumn("_number", numbers)

    def placed(h, x):
        start = F.get("_starts", F.element_at("_number", F.get("_root", x)))
        at = start["k"] + start["all"] - left_at(x)
        return F.when((h["parent1"] >= 0) & (h["parent2"] < 0), F.lit(None)).otherwise(
            F.struct(at.cast("int").alias("first"), span(x)["count"].cast("int").alias("count")))

    spans = F.transform("history", placed)
    return rows.withColumn("spans", spans).drop("_next", "_tour", "_order", "_starts", "_root", "_number")


def beam_numbered() -> Column:
    """The entries that met the beam, with their numbers in that order."""
    return F.transform(selection.beam_entries(), lambda x, i: F.struct(x.alias("entry"), i.alias("jet_id")))


def members(entry: Column) -> Column:
    """The inputs of an object of ``with_intervals``, ascending: a slice of the tour."""
    span = F.get("spans", entry)
    return F.array_sort(F.slice("leaves", span["first"] + 1, span["count"]))


def constituents(clustered: DataFrame, ptmin=2.0, particles="particles") -> DataFrame:
    """One row per inclusive jet with pt >= ptmin, with its constituents as ``particles``.

    Jets are numbered by ``jet_id`` in the order they met the beam.  The inputs
    are ordered by jet once, so the members of a jet are a slice; they are
    gathered before the jets become rows, so no row carries a whole event.
    """
    keys = [c for c in clustered.columns if c not in ("jets", "history", "membership", particles)]
    momenta = F.transform(F.col(particles), lambda p: F.struct(*[p[c].alias(c) for c in clustering.COMPONENTS]))
    ordered = F.sort_array(F.transform("membership", lambda owner, i: F.struct(owner.alias("owner"), i.alias("i"))))
    rows = clustered.select(*keys, "membership", _beam_jets(ptmin).alias("_found"), momenta.alias("_p"), ordered.alias("_by_jet"))
    # The first place of each jet in that order; every jet has members, so they come in the order of the jets.
    starts = F.transform(F.filter(F.transform("_by_jet", lambda m, k: F.struct(m["owner"].alias("owner"), k.alias("k"))), lambda s: (
        s["k"] == 0) | (F.get("_by_jet", s["k"] - 1)["owner"] != s["owner"])), lambda s: s["k"])
    rows = rows.withColumn("_starts", starts)

    def own(jet_id):
        first = F.get("_starts", jet_id)
        after = F.coalesce(F.get("_starts", jet_id + 1), F.size("_by_jet"))
        return F.transform(F.slice("_by_jet", first + 1, after - first), lambda m: F.get("_p", m["i"]))

    rows = rows.select(*keys, F.explode(F.transform("_found", lambda j: F.struct(
        j["jet_id"].alias("jet_id"), j["jet"].alias("jet"), own(j["jet_id"]).alias("particles")))).alias("j"))
    return rows.select(*keys, "j.*")


def _groomed(rows: DataFrame, momentum: Column) -> DataFrame:
    keys = [c for c in rows.columns if c not in ("particles", "jets", "history", "membership")]
    return rows.select(*keys, momentum.alias("groomed"))


def jet_filter(jets: DataFrame, R=0.3, n_hardest=3) -> DataFrame:
    """Filtering: recluster with CA at radius R, sum the hardest subjets."""
    subjets = clustering.inclusive_jets(jets, "CA", R, ptmin=0.0)
    return _groomed(subjets, kin.total(F.slice("jets", 1, n_hardest)))


def jet_trim(jets: DataFrame, R=0.3, fraction=0.3, algorithm="CA") -> DataFrame:
    """Trimming: recluster, sum the subjets with at least a fraction of the jet's pt."""
    subjets = clustering.inclusive_jets(jets, algorithm, R, ptmin=0.0)
    floor = kin.pt(F.col("jet.px"), F.col("jet.py")) * F.lit(float(fraction))
    kept = F.filter("jets", lambda j: kin.pt(j["px"], j["py"]) >= floor)
    return _groomed(subjets, kin.total(kept))


def _measure(clustered: DataFrame) -> DataFrame:
    """Add ``_m``: the kinematics of every object, looked up on each walk step."""
    return clustered.withColumn("_m", F.transform("jets", lambda j: F.struct(
        kin.pt(j["px"], j["py"]).alias("pt"), kin.rapidity(*kin.of(j)).alias("rap"),
        kin.phi(j["px"], j["py"]).alias("phi"), kin.mass2(*kin.of(j)).alias("m2"))))


def _look(entry: Column) -> Column:
    return F.get(F.col("_m"), F.get(F.col("history"), entry)["jet"])


def _distance2(a: Column, b: Column) -> Column:
    dphi = F.abs(a["phi"] - b["phi"])
    folded = F.least(dphi, F.lit(kin.TWO_PI) - dphi)
    dy = a["rap"] - b["rap"]
    return dy * dy + folded * folded


def _accepted(accept, size: str) -> Column:
    """For every history entry: the first accepted merge on its primary branch.

    A merge that is not accepted points to its parent with more ``size``, an
    accepted one or an input to itself.  Jumping along the pointers, twice as far
    in every round, brings all entries to the ends of their branches at once, in
    work that grows with the event and not with its jets.
    """
    def step(h, x):
        pair = F.struct(_look(h["parent1"]).alias("ja"), _look(h["parent2"]).alias("jb"), _look(x).alias("whole"))

        def decide(v):
            first = v["ja"][size] >= v["jb"][size]
            lead, other = F.when(first, v["ja"]).otherwise(v["jb"]), F.when(first, v["jb"]).otherwise(v["ja"])
            both = F.struct(lead.alias("lead"), other.alias("other"), v["whole"].alias("whole"), first.alias("first"))
            return let(both, lambda b: F.when(accept(b["whole"], b["lead"], b["other"]), x).otherwise(
                F.when(b["first"], h["parent1"]).otherwise(h["parent2"])))

        return F.when((h["parent1"] < 0) | (h["parent2"] < 0), x).otherwise(let(pair, decide))

    rounds = F.sequence(F.lit(0), F.greatest(F.log2(F.size("history").cast("double")), F.lit(0.0)).cast("int"))
    return F.aggregate(rounds, F.transform("history", step), lambda now, _: F.transform(now, lambda x: F.get(now, x)))


def _tagged(start: Column) -> Column:
    """The accepted object on the branch of an entry; NULL where the branch ends at an input."""
    return let(F.get("_ends", start), lambda end: F.when(
        F.get(F.col("history"), end)["parent2"] >= 0, selection._jet_of(end)))


def mass_drop(clustered: DataFrame, mu=0.67, y=0.09, ptmin=2.0) -> DataFrame:
    """Mass-drop tagging of the inclusive jets; ``groomed`` is NULL for untagged jets."""
    def accept(whole, lead, other):
        softer = F.least(lead["pt"], other["pt"])
        return ((lead["m2"] < whole["m2"] * F.lit(mu * mu))
                & (softer * softer * _distance2(lead, other) > whole["m2"] * F.lit(float(y))))

    keys = [c for c in clustered.columns if c not in ("jets", "history", "membership", "particles")]
    rows = _measure(clustered).withColumn("_ends", _accepted(accept, "m2")).withColumn("_found", _beam_jets(ptmin))
    tagged = F.transform("_found", lambda j: F.struct(
        j["jet_id"].alias("jet_id"), j["jet"].alias("jet"),
        _tagged(j["entry"]).alias("groomed")))
    return rows.select(*keys, F.explode(tagged).alias("t")).select(*keys, "t.*")


def soft_drop(jets: DataFrame, z_cut=0.1, beta=2.0, R0=1.0) -> DataFrame:
    """Soft drop: recluster with CA at radius R0 and drop soft wide-angle branches.

    The hardest jet of the reclustering is declustered; ``groomed`` is NULL when
    no branching passes.
    """
    def accept(_, lead, other):
        angle = F.pow(_distance2(lead, other) / F.lit(float(R0 * R0)), F.lit(beta / 2.0))
        share = F.try_divide(F.least(lead["pt"], other["pt"]), lead["pt"] + other["pt"])
        return share > F.lit(float(z_cut)) * angle

    keys = [c for c in jets.columns if c != "particles"]
    again = _measure(clustering.cluster(jets, "CA", R0))
    hardest = F.array_min(F.transform(selection.beam_entries(), lambda x, i: F.struct(
        (-_look(x)["pt"]).alias("k"), i.alias("i"), x.alias("entry"))))["entry"]
    seeded = again.withColumn("_ends", _accepted(accept, "pt")).withColumn("_start", hardest)
    return seeded.select(*keys, _tagged(F.col("_start")).alias("groomed"))


def groom(clustered: DataFrame, method: str, ptmin=2.0, **params) -> DataFrame:
    """Groom or tag every inclusive jet of clustered events (with their particles)."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if method == "mass_drop":
        return mass_drop(clustered, ptmin=ptmin, **params)
    return RECLUSTERING[method](constituents(clustered, ptmin), **params)


RECLUSTERING = {"filter": jet_filter, "trim": jet_trim, "soft_drop": soft_drop}


def groom_events(events: DataFrame, method: str, R=0.4, ptmin=2.0, **params) -> DataFrame:
    """Cluster events with CA and groom their jets in one go.

    Methods that recluster need only the constituents of the jets, so the
    sequence of the first clustering is not kept.
    """
    if method in RECLUSTERING:
        return RECLUSTERING[method](clustering.jets_with_constituents(events, "CA", R, ptmin=ptmin), **params)
    return groom(substructure_input(events, R), method, ptmin, **params)


def substructure_input(events: DataFrame, R=0.4) -> DataFrame:
    """The clustering that substructure starts from: Cambridge/Aachen."""
    return clustering.cluster(events, "CA", R)


def measured(groomed: DataFrame) -> DataFrame:
    """pt, rapidity, phi and mass of groomed jets; NULL where nothing was left."""
    g = F.col("groomed")
    keys = [c for c in groomed.columns if c not in ("groomed", "jet")]
    empty = (g["px"] == 0) & (g["py"] == 0) & (g["pz"] == 0) & (g["e"] == 0)

    def shown(value):
        return F.when(~empty, value)

    return groomed.select(
        *keys, shown(kin.pt(g["px"], g["py"])).alias("pt"), shown(kin.rapidity(*kin.of(g))).alias("rap"),
        shown(kin.phi(g["px"], g["py"])).alias("phi"), shown(kin.mass(*kin.of(g))).alias("mass"))
