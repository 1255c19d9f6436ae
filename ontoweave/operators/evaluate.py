"""Scores against gold labels, precision-coverage curves and the cut-offs fitted from them.

Sets are compared as distinct keys; undefined ratios are 0. Null keys never match anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_name
from .decide import ACCEPT, REJECT, REVIEW

CURVE_SLICES = 256


def entity_key(name: Column, kind: Column) -> Column:
    return F.concat_ws("|", canonical_name(name), F.upper(kind))


def relation_key(source: Column, target: Column, kind: Column) -> Column:
    return F.concat_ws("|", canonical_name(source), canonical_name(target), F.upper(kind))


def ratios(rows: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and support to tp, fp, fn."""
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return rows.withColumns({"precision": p, "recall": r, "f1": f, "support": F.col("tp") + F.col("fn")})


def counts(predicted: DataFrame, gold: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """tp, fp and fn of two sets of keys, per ``by``."""
    p = predicted.select(*keys).distinct().withColumn("in_pred", F.lit(1))
    g = gold.select(*keys).distinct().withColumn("in_gold", F.lit(1))
    both = p.join(g, keys, "full_outer")
    hit = F.col("in_pred").isNotNull() & F.col("in_gold").isNotNull()
    return both.groupBy(*by).agg(
        F.sum(hit.cast("long")).alias("tp"), F.sum((F.col("in_pred").isNotNull() & F.col("in_gold").isNull()).cast("long")).alias("fp"),
        F.sum((F.col("in_pred").isNull() & F.col("in_gold").isNotNull()).cast("long")).alias("fn"))


def prf(predicted: DataFrame, gold: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    return ratios(counts(predicted, gold, keys, by))


def micro_average(per: DataFrame, by: list[str] = []) -> DataFrame:
    """Counts summed over documents, then the ratios; per ``by`` and, as a rollup, in total (null)."""
    rows = per.rollup(*by) if by else per.groupBy()
    return ratios(rows.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def span_scores(pred_entities: DataFrame, gold_entities: DataFrame, pred_links: DataFrame, gold_links: DataFrame) -> DataFrame:
    """Exact spans per document: entities (start, end, type), links by both ends' spans and type; boundary_only, direction_swaps.

    boundary_only: predicted spans that are gold spans of another type only. direction_swaps: predicted links
    that are no gold link but are one the other way round. Both sides meet once, grouped by the span, or by the two
    spans of a link whichever way it points; all counts follow from what meets there.
    """
    by_type = lambda rows, mark: rows.select("doc_id", "start_char", "end_char", F.col("type"), F.lit(mark).alias("side"))
    spans = by_type(pred_entities, "p").unionByName(by_type(gold_entities, "g")).groupBy("doc_id", "start_char", "end_char").agg(*_sides(F.col("type")))
    tp, fp, fn = _met()
    ents = spans.select("doc_id", tp.alias("entity_tp"), fp.alias("entity_fp"), fn.alias("entity_fn"), F.when(F.size("g") > 0, fp).otherwise(0).alias("boundary_only"), *[F.lit(0).alias(c) for c in ("link_tp", "link_fp", "link_fn", "direction_swaps")])

    def links(rows: DataFrame, mark: str) -> DataFrame:
        a, b = F.struct(F.col("src_start").alias("s"), F.col("src_end").alias("e")), F.struct(F.col("tgt_start").alias("s"), F.col("tgt_end").alias("e"))
        return rows.select("doc_id", F.least(a, b).alias("one"), F.greatest(a, b).alias("two"), F.struct(F.col("type").alias("type"), (a > b).alias("turned")).alias("link"), F.lit(mark).alias("side"))

    pairs = links(pred_links, "p").unionByName(links(gold_links, "g")).groupBy("doc_id", "one", "two").agg(*_sides(F.col("link")))
    other = F.transform("g", lambda x: F.struct(x["type"].alias("type"), (~x["turned"] & (F.col("one") != F.col("two"))).alias("turned")))
    swaps = F.size(F.array_intersect(F.array_except("p", "g"), other))
    rels = pairs.select("doc_id", *[F.lit(0).alias(c) for c in ("entity_tp", "entity_fp", "entity_fn", "boundary_only")], tp.alias("link_tp"), fp.alias("link_fp"), fn.alias("link_fn"), swaps.alias("direction_swaps"))
    columns = ("entity_tp", "entity_fp", "entity_fn", "link_tp", "link_fp", "link_fn", "boundary_only", "direction_swaps")
    return ents.unionByName(rels).groupBy("doc_id").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in columns])


def _sides(what: Column) -> list[Column]:
    """The distinct values of each side, as p and g."""
    return [F.collect_set(F.when(F.col("side") == side, what)).alias(side) for side in ("p", "g")]


def _met() -> tuple[Column, Column, Column]:
    return F.size(F.array_intersect("p", "g")), F.size(F.array_except("p", "g")), F.size(F.array_except("g", "p"))


def has_spans(entities: Column) -> Column:
    """Whether a gold document's entities (array of structs with start and end) all have offsets."""
    return (F.size(entities) > 0) & F.forall(entities, lambda e: e["start"].isNotNull() & e["end"].isNotNull())


def curve(decisions: DataFrame, by: list[str], prob: str = "prob", right: str = "correct", tie: str = "ord") -> DataFrame:
    """Precision, error and coverage among the k most probable decisions, for every k; ties in ``tie`` order.

    A group may be a whole table: its rows are cut into slices of probability, each slice is ranked by itself
    and starts from the totals of the slices above it, which are few. Missing probabilities come last.
    """
    rows = decisions.withColumn("_slice", F.coalesce(F.floor(F.col(prob) * CURVE_SLICES).cast("int"), F.lit(-1)))
    slices = rows.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(right).cast("int")).alias("_ok"))
    above = Window.partitionBy(*by).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    slices = slices.select(*by, "_slice", before("_n").alias("_k0"), before("_ok").alias("_ok0"), F.sum("_n").over(Window.partitionBy(*by)).alias("_total"))
    order = Window.partitionBy(*by, "_slice").orderBy(F.desc(prob), tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("_k", F.count(F.lit(1)).over(order)).withColumn("_hit", F.sum(F.col(right).cast("int")).over(order)).join(slices, [*by, "_slice"])
    k, ok = F.col("_k0") + F.col("_k"), F.col("_ok0") + F.col("_hit")
    return ranked.select(*by, F.col(prob).alias("threshold"), k.alias("rank"), (k / F.col("_total")).alias("coverage"), (ok / k).alias("precision"), (1 - ok / k).alias("error"))


def fit_gate(points: DataFrame, by: list[str], most_error: float = 0.15) -> DataFrame:
    """(accept_prob, reject_prob) per group: the lowest threshold whose error so far is small enough, within .5 and .95.

    Without any such threshold the accepted cut-off is .70.
    """
    good = F.when(F.col("error") <= most_error, F.col("rank"))
    chosen = points.groupBy(*by).agg(F.max_by(F.col("threshold"), good).alias("t"), F.max(good).alias("found"))
    accept = F.coalesce(F.when(F.col("found").isNotNull(), F.greatest(F.lit(0.5), F.least(F.lit(0.95), F.col("t")))), F.lit(0.70))
    return chosen.select(*by, accept.alias("accept_prob"), F.least(F.lit(0.4), accept * 0.5).alias("reject_prob"))


def band_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """How many decisions are in each band, bands without any included."""
    return rows.groupBy(*by).pivot("band", [ACCEPT, REVIEW, REJECT]).agg(F.count(F.lit(1))).na.fill(0)


def latency_summary(rows: DataFrame, by: list[str], ms: str, n_questions: str) -> DataFrame:
    """Mean and median time of a call and the mean per question."""
    return rows.groupBy(*by).agg(F.avg(ms).alias("mean_ms"), F.median(ms).alias("median_ms"), F.coalesce(F.try_divide(F.sum(ms), F.sum(n_questions)), F.lit(0.0)).alias("ms_per_question"))


def uncovered_ids(specs: DataFrame, tests: DataFrame, pattern: str) -> DataFrame:
    """Ids that the specification texts name and the test texts do not."""
    ids = lambda rows: rows.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("id")).distinct()
    return ids(specs).join(ids(tests), "id", "left_anti")
