"""Calibrators of probabilities, and sweeps of thresholds and of policies of two thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions.score import clamp, logit, sigmoid

# The grids, gates and anchors of the sweeps.
KNEE_GRID = tuple(round(0.7 + 0.005 * i, 3) for i in range(51))
KNEE_PRECISION, KNEE_ANCHOR = 0.90, 0.80
STEPS = 200  # policies' thresholds are multiples of 1 / STEPS
INITIAL_ACCEPT, INITIAL_ADJUDICATE = 0.85, 0.50
GATE_PRECISION, GATE_NIL_RECALL = 0.95, 0.80

BINS = 1_000  # of the probabilities from 0 to 1, in which segments are looked up


def identity(p: Column) -> Column:
    return clamp(p)


def platt(p: Column, slope: float = 1.0, intercept: float = 0.0) -> Column:
    return clamp(sigmoid(F.lit(intercept) + F.lit(slope) * logit(p)))


def calibrated_buckets(c6: Column, c12: Column, c18: Column) -> Column:
    """(p_0_6, p_6_12, p_12_18) of calibrated cumulative horizons, which are made monotone first."""
    m12 = F.greatest(c6, c12)
    m18 = F.greatest(m12, c18)
    return F.struct(F.round(c6, 6).alias("p_0_6"), F.round(m12 - c6, 6).alias("p_6_12"), F.round(m18 - m12, 6).alias("p_12_18"))


def fit_isotonic(rows: DataFrame, by: str, p: str = "p", outcome: str = "outcome", digits: int = 4) -> DataFrame:
    """(by, x, y): the points of the monotone step function of the least squared error, two a step: its first and last x.

    Probabilities are rounded to ``digits`` places, as the library's scores are, so a group has 10 ** digits + 1
    points at most, whatever its rows: they are summed up before the shuffle. A group's points are then pooled in one
    task, where neighbours that fall are joined until none does. Null probabilities and outcomes don't count.
    """
    points = rows.where(F.col(p).isNotNull() & F.col(outcome).isNotNull()).groupBy(F.col(by).alias("by"), F.round(clamp(F.col(p)), digits).alias("x")).agg(F.sum(F.col(outcome).cast("double")).alias("sum"), F.count(F.lit(1)).alias("n"))

    def pool(group):  # noqa: ANN001, ANN202
        import pandas as pd

        stack: list[list[float]] = []  # first x, last x, sum, count
        for x, total, n in group.sort_values("x")[["x", "sum", "n"]].itertuples(index=False):
            stack.append([x, x, total, n])
            while len(stack) > 1 and stack[-2][2] * stack[-1][3] >= stack[-1][2] * stack[-2][3]:
                _, last, s, k = stack.pop()
                stack[-1] = [stack[-1][0], last, stack[-1][2] + s, stack[-1][3] + k]
        xs = [(x, s / k) for first, last, s, k in stack for x in ((first,) if first == last else (first, last))]
        return pd.DataFrame({"by": group["by"].iloc[0], "x": [x for x, _ in xs], "y": [y for _, y in xs]})

    fitted = points.groupBy("by").applyInPandas(pool, f"by {points.schema['by'].dataType.simpleString()}, x double, y double")
    return fitted.select(F.col("by").alias(by), "x", "y")


def apply_isotonic(rows: DataFrame, points: DataFrame, by: str, p: str = "p", to: str = "calibrated") -> DataFrame:
    """``rows`` with the probability that their group's points give: linear between two points, flat outside of them.

    A group without points keeps its clamped probability; a null probability stays null. Each segment stands in the
    bins that it reaches, so a row finds its own by an equality of group and bin.
    """
    along = W.partitionBy(by).orderBy("x")
    low, high = F.coalesce(F.col("x"), F.lit(0.0)), F.col("x1")
    ends = points.withColumns({"x1": F.lead("x").over(along), "y1": F.lead("y").over(along), "first": F.row_number().over(along) == 1})
    before = ends.where("first").select(by, F.lit(-1.0).alias("x0"), F.col("x").alias("x1"), F.col("y").alias("y0"), F.col("y").alias("y1"))
    inside = ends.select(by, low.alias("x0"), F.coalesce(high, F.lit(2.0)).alias("x1"), F.col("y").alias("y0"), F.coalesce("y1", "y").alias("y1"))
    bin_of = lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * BINS)
    table = before.unionByName(inside).withColumn("bin", F.explode(F.sequence(bin_of(F.col("x0")), bin_of(F.col("x1")))))
    # A probability at a point belongs to the segment that ends there, where both give the same.
    side = table.select(F.col(by).alias("__by"), F.col("bin").alias("__bin"), *[F.col(c).alias(f"__{c}") for c in ("x0", "x1", "y0", "y1")])
    q = clamp(F.col(p))
    met = rows.join(side, rows[by].eqNullSafe(side["__by"]) & (bin_of(q) == F.col("__bin")) & (q > F.col("__x0")) & (q <= F.col("__x1")), "left")
    # At the end of a segment its own value counts: the line may miss it by the last bit.
    line = F.when(q == F.col("__x1"), F.col("__y1")).otherwise(F.col("__y0") + (q - F.col("__x0")) / (F.col("__x1") - F.col("__x0")) * (F.col("__y1") - F.col("__y0")))
    return met.withColumn(to, F.when(F.col("__x1").isNull(), q).otherwise(clamp(line))).drop("__by", "__bin", "__x0", "__x1", "__y0", "__y1")


def threshold_counts(pairs: DataFrame, by: str) -> DataFrame:
    """(by, threshold, tp, fp, fn, tn, precision, recall, f1, feasible) of the 51 thresholds from 0.700 to 0.950.

    ``pairs`` (by, similarity, same). A pair counts for all thresholds that it reaches: rows are counted by how many
    those are, in one pass, and thresholds are sums from above over at most 52 rows. Undefined rates are null.
    A threshold is feasible if it predicts something, with a precision of 0.90 or more.
    """
    grid = F.array(*[F.lit(t) for t in KNEE_GRID])
    reached = F.size(F.filter(grid, lambda t: F.col("similarity") >= t))
    rows = pairs.where("similarity is not null and same is not null").groupBy(by, reached.alias("reached")).agg(F.count_if("same").alias("pos"), F.count_if(~F.col("same")).alias("neg"))
    each = rows.select(by, "reached", "pos", "neg", F.explode(F.sequence(F.lit(1), F.lit(len(KNEE_GRID)))).alias("nth"))
    hit = F.col("reached") >= F.col("nth")
    sums = each.groupBy(by, "nth").agg(*[F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0)).alias(n) for n, c, v in (("tp", hit, "pos"), ("fp", hit, "neg"), ("fn", ~hit, "pos"), ("tn", ~hit, "neg"))])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rated = sums.withColumns({"threshold": F.element_at(grid, F.col("nth")), "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn)})
    return rated.withColumn("feasible", F.coalesce(F.col("precision") >= KNEE_PRECISION, F.lit(False))).drop("nth")


def precision_knee(counts: DataFrame, by: str) -> DataFrame:
    """The feasible row of :func:`threshold_counts` of the best recall, then F1, then nearness to 0.80, then the higher threshold."""
    key = F.struct("recall", "f1", (-F.abs(F.round((F.col("threshold") - KNEE_ANCHOR) * 1000))).alias("near"), "threshold", "precision")
    return counts.where("feasible").groupBy(by).agg(F.max(key).alias("k")).select(by, "k.threshold", "k.precision", "k.recall", "k.f1")


def policy_metrics(mentions: DataFrame) -> DataFrame:
    """Counts and rates of each split under all 20,100 policies: accept and adjudicate, the latter below the former.

    ``mentions`` (split, score, is_link, top_hit, candidate_hit, gated): the best candidate's score of four places, null
    without one; whether a link is expected; whether the best candidate, or any, is the expected one; whether a tie or
    an unsupported brand keeps it from being accepted. A score of accept or more is accepted, or adjudicated if gated;
    of adjudicate or more adjudicated; else nil. Undefined rates are null.

    Rows are counted once by the grid step that their score reaches; a policy is a difference of sums from above, so the cost is
    one pass and a join of 201 by 201 rows a split.
    """
    step = F.when(F.col("score").isNotNull(), F.least(F.floor(F.round(F.col("score") * 10_000) / (10_000 // STEPS)), F.lit(STEPS))).cast("int")
    link, free = F.col("is_link"), ~F.col("gated")
    tallies = {
        "n": F.lit(True), "nil": ~link, "hit": link & F.col("candidate_hit"), "free": free, "free_correct": free & link & F.col("top_hit"), "free_wrong": free & link & ~F.col("top_hit"), "gated_hit": ~free & link & F.col("candidate_hit"),
    }
    rows = mentions.groupBy("split", F.coalesce(step, F.lit(-1)).alias("step")).agg(*[F.count_if(c).alias(k) for k, c in tallies.items()], F.count_if(link).alias("links"), F.count_if(link & F.col("top_hit")).alias("tops"))
    # Sums of the rows from each grid step on: at most 202 by 201 rows a split.
    each = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(STEPS))))
    over = F.col("step") >= F.col("at")
    above = each.groupBy("split", "at").agg(*[F.sum(F.when(over, F.col(k)).otherwise(0)).alias(k) for k in tallies], F.sum("n").alias("total"), F.sum("links").alias("links"), F.sum("hit").alias("candidate_hits"), F.sum("tops").alias("top_hits"), F.sum("nil").alias("nils"))
    a, d = above.alias("a"), above.select("split", "at", "n", "hit", "nil").alias("d")
    both = a.join(d, (F.col("a.split") == F.col("d.split")) & (F.col("d.at") < F.col("a.at")))
    A, D = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"d.{n}"))  # noqa: E731, N806
    made = both.select(
        A("split").alias("split"), A("at").alias("accept"), D("at").alias("adjudicate"), A("total").alias("total"), A("links").alias("links"), A("nils").alias("nils"), A("candidate_hits").alias("candidate_hits"), A("top_hits").alias("top_hits"),
        A("free").alias("accepted_total"), A("free_correct").alias("accepted_correct"), A("free_wrong").alias("accepted_wrong"), (A("free") - A("free_correct") - A("free_wrong")).alias("accepted_nil"),
        (D("n") - A("free")).alias("adjudications"), (A("total") - D("n")).alias("nil_decisions"), (A("nils") - D("nil")).alias("nil_recalled"), (A("free_correct") + A("gated_hit") + D("hit") - A("hit")).alias("routed_hits"),
    )
    rate = lambda top, bottom: F.try_divide(F.col(top), F.col(bottom))
    return made.withColumns({
        "precision": rate("accepted_correct", "accepted_total"), "link_recall": rate("accepted_correct", "links"), "routed_recall": rate("routed_hits", "links"), "nil_recall": rate("nil_recalled", "nils"), "adjudication_rate": F.coalesce(rate("adjudications", "total"), F.lit(0.0)),
    })


def select_policy(metrics: DataFrame, train: str = "train", development: str = "development") -> DataFrame:
    """(status, accept, adjudicate, eligible, defined): one row.

    A policy is eligible if on ``train`` it accepts something with a precision of 0.95 or more and a nil recall of 0.80 or
    more. Of those the best on ``development`` is taken: by precision, link recall, routed recall, nil recall,
    fewer adjudications, nearness to 0.85 / 0.50, then higher thresholds. Without a defined precision there the initial thresholds are retained.
    """
    gate = metrics.where((F.col("split") == train) & (F.col("accepted_total") >= 1) & (F.col("precision") >= GATE_PRECISION) & (F.col("nil_recall") >= GATE_NIL_RECALL)).select("accept", "adjudicate")
    open_ = metrics.where(F.col("split") == development).join(gate, ["accept", "adjudicate"])
    far = F.abs(F.col("accept") - round(INITIAL_ACCEPT * STEPS)) + F.abs(F.col("adjudicate") - round(INITIAL_ADJUDICATE * STEPS))
    low = lambda c: F.coalesce(F.col(c), F.lit(float("-inf")))
    key = F.struct(*[low(c).alias(c) for c in ("precision", "link_recall", "routed_recall", "nil_recall")], (-F.col("adjudication_rate")).alias("calm"), (-far).alias("near"), "accept", "adjudicate")
    best = open_.agg(F.count(F.lit(1)).alias("eligible"), F.count("precision").alias("defined"), F.max(key).alias("k"))
    found = F.coalesce(F.col("k.precision") > float("-inf"), F.lit(False))
    pick = lambda c, initial: F.when(found, F.col(f"k.{c}") / STEPS).otherwise(initial)
    return best.select(F.when(found, "calibrated").otherwise("retained_insufficient_evidence").alias("status"), pick("accept", INITIAL_ACCEPT).alias("accept"), pick("adjudicate", INITIAL_ADJUDICATE).alias("adjudicate"), "eligible", "defined")
