"""Scores, fusion and verdicts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argusline.functions.fixed import CUTOFF


def _clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def semantic_loss(distance: Column) -> Column:
    return F.least(F.lit(1.0), 2.5 * distance)


def local_score(ssim: Column, mean_diff: Column, pct: Column, edge: Column, hist: Column, focus: Column | None = None, massive: Column | None = None) -> Column:
    """Texture score; a focus hit adds 30 %, massive damage lifts it to 0.95."""
    drop = lambda x, level, weight: F.greatest(F.lit(0.0), (level - x) / level) * weight
    rise = lambda x, level, weight: F.least(F.lit(1.0), x / level) * weight
    s = _clip(drop(ssim, 0.85, 0.35) + rise(mean_diff, 0.25, 0.20) + rise(pct, 0.40, 0.20) + rise(edge, 0.25, 0.15) + drop(hist, 0.80, 0.10))
    if focus is not None:
        s = F.when(focus, F.least(F.lit(1.0), s * 1.30)).otherwise(s)
    if massive is not None:
        s = F.when(massive, F.greatest(s, F.lit(0.95))).otherwise(s)
    return s


def ctx_score(localized: Column, focus: Column) -> Column:
    """0.3 without context (null), 0.6 localised, 0.2 spread; 0.2 more in focus."""
    base = F.when(localized, 0.6).otherwise(0.2)
    return F.when(localized.isNull(), 0.3).otherwise(F.when(focus, F.least(F.lit(1.0), base + 0.2)).otherwise(base))


def physical_score(shift_defect: Column, shift_pct: Column, ink_defect: Column, semantic_defect: Column, loss: Column, local: Column, ctx: Column) -> tuple[Column, Column]:
    """(score, physical flag); absent engines are null."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    parts = [
        F.when(yes(shift_defect), F.greatest(F.lit(0.80), F.least(F.lit(1.0), shift_pct * 10))),
        F.when(yes(ink_defect), F.lit(0.85)),
        F.when(yes(semantic_defect), F.least(F.lit(1.0), F.greatest(F.lit(0.85), loss * 1.5))),
        local * 0.65 + ctx * 0.35,
    ]
    return F.coalesce(F.greatest(*parts, F.lit(0.0)), F.lit(0.0)), yes(shift_defect) | yes(ink_defect) | yes(semantic_defect)


def master_fusion(physical: Column, is_physical: Column, has_memory: Column, vote: Column, sim: Column) -> Column:
    """Final score from the physical score and the memory's vote."""
    mix = lambda p: physical * p + vote * (1 - p)
    return (
        F.when(~has_memory, physical)
        .when(is_physical & (vote < 0.30) & (sim > 0.80), physical * 0.40 + vote * 0.60)
        .when(is_physical, physical * 0.70 + vote * 0.30)
        .when(sim >= 0.90, physical * 0.20 + vote * 0.80)
        .when(sim >= 0.75, mix(0.50))
        .otherwise(physical * 0.70 + vote * 0.30)
    )


def judge_fusion(local: Column, ctx: Column, has_memory: Column, vote: Column, sim: Column) -> Column:
    """The older three-way weights."""
    return (
        F.when(~has_memory, local * 0.65 + ctx * 0.35)
        .when(sim >= 0.90, local * 0.10 + ctx * 0.10 + vote * 0.80)
        .when(sim >= 0.75, local * 0.30 + ctx * 0.20 + vote * 0.50)
        .otherwise(local * 0.50 + ctx * 0.20 + vote * 0.30)
    )


def confidence(score: Column, cutoff: float = CUTOFF) -> Column:
    """0.50 at the cutoff, rising to 0.99 at either end."""
    way = F.when(score > cutoff, (score - cutoff) / (1 - cutoff)).otherwise((cutoff - score) / cutoff)
    return _clip(0.50 + 0.49 * way, 0.50, 0.99)


def shift_score(gross: Column, macro: Column, micro: Column, tolerance: Column) -> Column:
    """struct<is_defect, score, reason> of the displacement cascade.

    The first that fires decides: gross change over 0.15, whole displacement
    over the tolerance, displacement in the focus over the tolerance.
    """
    hit = F.when(gross > 0.15, "structure").when(macro > tolerance, "displacement").when(micro > tolerance, "focus displacement")
    score = F.when(gross > 0.15, gross).when(macro > tolerance, macro).otherwise(F.coalesce(micro, macro))
    return F.struct(hit.isNotNull().alias("is_defect"), score.alias("score"), F.coalesce(hit, F.lit("")).alias("reason"))


def ink_score(error: Column, tolerance: Column, area: Column) -> Column:
    """struct<is_defect, score, reason>; the reason changes at 0.15."""
    bad = (error > tolerance) & (area > 10)
    reason = F.when(bad & (error > 0.15), "ink missing or reversed").when(bad, "ink differs").otherwise("")
    return F.struct(F.coalesce(bad, F.lit(False)).alias("is_defect"), error.alias("score"), reason.alias("reason"))


def displacement_kind(is_defect: Column, dx: Column, dy: Column, pct: Column) -> Column:
    return F.when(is_defect & (dx == 0) & (dy == 0) & (pct > 0.15), "structural").otherwise("displacement")


def severity_band(metric: Column, value: Column) -> Column:
    """good, warn or bad; similarity metrics count the other way round."""
    alike = metric.isin("ssim", "hist_corr")
    up = F.when(value > 0.6, "good").when(value > 0.4, "warn").otherwise("bad")
    down = F.when(value > 0.6, "bad").when(value > 0.3, "warn").otherwise("good")
    return F.when(alike, up).otherwise(down)


def radar_axes(ssim: Column, pct: Column, edge: Column, hist: Column, local: Column, ctx: Column) -> list[Column]:
    """Six anomaly axes and the severity of their sum."""
    axes = [_clip(1 - ssim), _clip(pct / 0.15), _clip(edge / 0.08), _clip(1 - hist), local, ctx]
    names = ["ax_ssim", "ax_pct", "ax_edge", "ax_hist", "ax_local", "ax_ctx"]
    total = axes[0]
    for a in axes[1:]:
        total = total + a
    return [a.alias(n) for a, n in zip(axes, names, strict=True)] + [F.when(total < 1.5, "low").otherwise("high").alias("severity")]


def reason_text(reasons: list[Column], has_memory: Column, vote: Column, sim: Column) -> Column:
    """Non-empty reasons, then what the memory says."""
    said = F.array_join(F.filter(F.array(*reasons), lambda r: F.coalesce(r, F.lit("")) != ""), " | ")
    said = F.when(said == "", "no significant anomaly").otherwise(said)
    memory = F.concat(F.lit(" || memory: "), F.floor(vote * 100).cast("string"), F.lit("% NG (sim "), F.floor(sim * 100).cast("string"), F.lit("%)"))
    return F.concat(said, F.when(has_memory, memory).otherwise(""))


def final_status(n_boxes: Column, is_defect: Column, has_image: Column) -> Column:
    return F.when(~has_image, "ignored").when((n_boxes == 0) & ~is_defect, "none detected").otherwise(F.when(is_defect, "real defect").otherwise("false alarm"))


def main_box(semantic: Column, shift: Column, ink: Column, texture: Column, legacy: bool = False, semantic_defect: Column | None = None) -> Column:
    """Box by priority.  ``legacy``: a semantic defect gives its (null) box."""
    rest = F.coalesce(shift, ink, texture)
    if legacy and semantic_defect is not None:
        return F.when(semantic_defect, semantic).otherwise(rest)
    return F.coalesce(semantic, rest)


def best_texture(scores: DataFrame) -> DataFrame:
    """Per inspection the highest-scored anomaly, and the first box with a score.

    ``scores`` has insp_id, ord, score, box.  Ties go to the smaller ord.
    """
    return scores.groupBy("insp_id").agg(
        F.max("score").alias("best_score"),
        F.max_by("ord", F.struct("score", -F.col("ord"))).alias("best_ord"),
        F.min_by("box", F.when(F.col("score") > 0, F.col("ord"))).alias("first_box"),
    )


def detail_merge(*metrics: Column) -> Column:
    """The last engine that states a metric wins: give them in running order."""
    return F.coalesce(*reversed(metrics))


def active_engines(route: Column, has_anomaly: Column) -> Column:
    """Engines of the route that ran: texture only where there were anomalies."""
    return F.filter(route, lambda e: (e != "ssim") | has_anomaly)
