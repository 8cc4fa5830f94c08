"""End-to-end inspection of image pairs: routes, engines, memory and verdict.

One Arrow pass measures each pair with the engines that its category routes it
to, sharing what several of them need; engines it is not routed to cost it
nothing.  What engines say of the measures, and the fusion with the memory's
vote, are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argusline.functions import kernels as K
from argusline.functions.fixed import DEFAULT_ROUTE, STRICT
from argusline.functions.masks import region_boxes
from argusline.functions.text import tolerance_rule
from argusline.operators import scoring as S
from argusline.operators.images import METRICS, arrays_of, ink_of, macro_regions, texture
from argusline.operators.knn import knn_vote
from argusline.operators.routing import route_engines

BOX = "struct<x:int,y:int,w:int,h:int>"
#: What the Arrow pass measures; fields of engines that a pair is not routed to are null.
MEASURES = (
    f"gross double, macro double, macro_dx double, macro_dy double, micro double, micro_dx double, micro_dy double, shift_box {BOX}, "
    f"ink_error double, ink_box {BOX}, distance double, "
    f"textures array<struct<box:{BOX},{','.join(m + ':double' for m in METRICS)},focus:boolean,localized:boolean>>, macro_box {BOX}"
)

Box = tuple[int, int, int, int]


def _cut(x: np.ndarray, box: Box) -> np.ndarray:
    bx, by, bw, bh = box
    return x[max(0, by) : max(0, by + bh), max(0, bx) : max(0, bx + bw)]


def _overlap(a: Box, b: Box) -> bool:
    return min(a[0] + a[2], b[0] + b[2]) > max(a[0], b[0]) and min(a[1] + a[3], b[1] + b[3]) > max(a[1], b[1])


def _size(dx: float, dy: float, box: Sequence[int]) -> float:
    return float(np.hypot(dx, dy) / max(box))


class Pair:
    """A golden and a suspect image, and what engines have asked of them so far."""

    def __init__(self, a: np.ndarray, b: np.ndarray, focus: list[Box]):
        self.a, self.b, self.focus = a, b, focus
        self.h, self.w = a.shape
        self.held: dict[tuple, tuple] = {}

    def both(self, of: Callable[[np.ndarray], np.ndarray], *key) -> tuple[np.ndarray, np.ndarray]:
        """``of`` both images, computed once for each key."""
        if key not in self.held:
            self.held[key] = of(self.a), of(self.b)
        return self.held[key]

    def displacement(self) -> dict:
        """Gross change, displacement of the whole and, by edges, around the smallest focus."""
        if min(self.h, self.w) < 10:
            return {}
        x, y = self.both(lambda i: K.blur(i, 5), "blur", 5)
        dx, dy = K.phase_shift(self.a, self.b)
        out = dict(gross=float((np.abs(x - y) > 45).mean()), macro_dx=dx, macro_dy=dy, macro=_size(dx, dy, (self.h, self.w)))
        if self.focus:
            ex, ey, ew, eh = least = min(self.focus, key=lambda f: f[2] * f[3])
            grow_x, grow_y = max(15, int(ew * 0.3)), max(15, int(eh * 0.3))
            near = [_cut(i, (ex - grow_x, ey - grow_y, ew + 2 * grow_x, eh + 2 * grow_y)) for i in (self.a, self.b)]
            if ew > 10 and eh > 10 and min(near[0].shape) >= 5:
                dx, dy = K.phase_shift(*(K.edges(i, 50, 150).astype(float) for i in near))
                out |= dict(micro_dx=dx, micro_dy=dy, micro=_size(dx, dy, (ew, eh)))
            out["shift_box"] = least
        return out

    def ink(self, tolerance: float) -> dict:
        """Ink of the first focus, or of the middle of the image."""
        cx, cy = int(self.w * 0.22), int(self.h * 0.18)
        box = (cx, cy, self.w - 2 * cx, self.h - 2 * cy)
        if self.focus:
            x, y, w, h = self.focus[0]
            box = (max(0, x), max(0, y), min(self.w, x + w) - max(0, x), min(self.h, y + h) - max(0, y))
        if box[2] <= 0 or box[3] <= 0:
            box = (0, 0, self.w, self.h)
        a, b = _cut(self.a, box), _cut(self.b, box)
        if min(a.shape) < 5:
            return {}
        error, bad, found = ink_of(a, b, K.phase_shift(*(K.edges(i, 50, 150).astype(float) for i in (a, b))), tolerance=tolerance)
        if found:
            found = (found["x"] + box[0], found["y"] + box[1], found["w"], found["h"])
        return dict(ink_error=error, ink_box=found)

    def distance(self) -> dict:
        """Cosine distance of structures, of the first focus that fits."""
        a, b = self.a, self.b
        for x, y, w, h in self.focus:
            if min(x, y) >= 0 and x + w <= self.w and y + h <= self.h:
                a, b = _cut(a, (x, y, w, h)), _cut(b, (x, y, w, h))
                break
        if a.size < 50:
            a, b = self.a, self.b
        u, v = K.structure(a), K.structure(b)
        n = np.sqrt((u @ u) * (v @ v))
        return dict(distance=float(1 - u @ v / n) if n > 0 else 0.0)

    def textures(self, anomalies: list[Box]) -> dict:
        """Texture and context of each anomaly, and the largest region of changed edges."""
        out = []
        for box in anomalies:
            at = next((f for f in self.focus if _overlap(f, box)), None)
            a, b = (_cut(i, at or box) for i in (self.a, self.b))
            if a.size < 10:
                a, b = (_cut(i, box) for i in (self.a, self.b))
            if min(a.shape) < 1:
                continue
            values = texture(*(K.blur(K.resample(i, 64, 64), 3) for i in (a, b)))
            x, y, w, h = box
            grow = max(w, h)
            near = [_cut(i, (x - grow, y - grow, w + 2 * grow, h + 2 * grow)) for i in (self.a, self.b)]
            alike = K.ssim_map(*(K.resample(i, 96, 96) for i in near), full=True)
            local = len(region_boxes(np.floor((1 - alike) * 255) > 100)) <= 3
            out.append((box, *values, at is not None, local))
        macro = max(macro_regions(self.a, self.b), key=lambda r: r[3] * r[4], default=None) if out else None
        return dict(textures=out, macro_box=macro[1:5] if macro else None)


def _boxes(found: list[dict] | None) -> list[Box]:
    return [tuple(b[c] for c in "xywh") for b in found or [] if b and all(b[c] is not None for c in "xywh")]


def measure(pairs: DataFrame) -> DataFrame:
    """``MEASURES`` of each pair (insp_id, h, w, gab, test, engines, ink_tolerance, anomalies, focus).

    A pair without two good images of its size has null measures, and so has an
    engine whose input is too small for it.
    """
    kind = pairs.schema["insp_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"insp_id {kind}, has_image boolean, {MEASURES}")
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]
    box = lambda b: dict(zip("xywh", b, strict=True)) if b else None
    plain = ("insp_id", "h", "w", "engines", "ink_tolerance", "anomalies", "focus")
    slim = pairs.select(*plain, *[F.col(c).cast("array<double>").alias(c) for c in ("gab", "test")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, h, w, engines, tolerance, anomalies, focus, a, b in zip(*(batch.column(c).to_pylist() for c in plain), arrays_of(batch.column("gab")), arrays_of(batch.column("test")), strict=True):
                a, b, row = K.grid(a, h, w), K.grid(b, h, w), {}
                if a is not None and b is not None:
                    pair = Pair(a, b, _boxes(focus))
                    row |= pair.displacement() if "shift" in engines else {}
                    row |= pair.ink(tolerance) if "silk" in engines else {}
                    row |= pair.distance() if "semantic" in engines else {}
                    row |= pair.textures(_boxes(anomalies)) if "ssim" in engines else {}
                for name in ("shift_box", "ink_box", "macro_box"):
                    row[name] = box(row.get(name))
                row["textures"] = [dict(zip(("box", *METRICS, "focus", "localized"), (box(t[0]), *t[1:]), strict=True)) for t in row.get("textures", [])]
                rows.append(row | dict(insp_id=i, has_image=a is not None and b is not None))
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in fields], [n for n, _ in fields])

    return slim.mapInArrow(run, schema)


def _told(is_defect: Column, score: Column, reason: Column, box: Column) -> Column:
    yes = F.coalesce(is_defect, F.lit(False))
    return F.struct(yes.alias("is_defect"), score.cast("double").alias("score"), F.when(yes, reason).otherwise("").alias("reason"), F.when(yes, box).alias("box"))


def _textures(c: Column) -> Column:
    """Each anomaly's box, local and context score, in order."""

    def of(t: Column) -> Column:
        local = S.local_score(*[t[m] for m in METRICS], t["focus"], F.col("macro_box").isNotNull())
        return F.struct(t["box"].alias("box"), local.alias("local"), S.ctx_score(t["localized"], t["focus"]).alias("ctx"))

    return F.transform(c, of)


def scores(measured: DataFrame) -> DataFrame:
    """Adds what each engine says: columns shift, silk, semantic and ssim (struct is_defect, score, reason, box).

    ``measured`` also has shift_tolerance and ink_tolerance.
    """
    c = F.col
    shift = S.shift_score(c("gross"), c("macro"), c("micro"), c("shift_tolerance"))
    out = measured.withColumns({
        "shift": F.when(c("gross").isNotNull(), _told(shift["is_defect"], shift["score"], shift["reason"], c("shift_box"))),
        "silk": F.when(c("ink_error").isNotNull(), _told(c("ink_box").isNotNull(), c("ink_error"), S.ink_score(c("ink_error"), c("ink_tolerance"), F.lit(11))["reason"], c("ink_box"))),
        "loss": F.when(c("distance").isNotNull(), S.semantic_loss(c("distance"))), "told": _textures(c("textures")),
    })
    # The first of the highest local scores; the box is the first with a score.
    best = F.array_max(F.transform("told", lambda t, i: F.struct(t["local"].alias("local"), (-i).alias("back"), t["ctx"].alias("ctx"))))
    first = F.element_at(F.filter("told", lambda t: t["local"] > 0), 1)
    out = out.withColumns({"semantic": F.when(c("loss").isNotNull(), _told(c("loss") > 0.45, c("loss"), F.lit("structure"), F.lit(None).cast(BOX))), "best": best, "first_box": F.when(F.exists("told", lambda t: t["local"] > 0), first["box"])})
    return out.withColumn("ssim", F.when(c("best.local") > 0, F.struct(F.lit(False).alias("is_defect"), c("best.local").alias("score"), F.lit("").alias("reason"), c("first_box").alias("box"))))


def inspect(pairs: DataFrame, info: DataFrame, memory: DataFrame, routes: DataFrame, k: int = 5, strict: Sequence[str] = STRICT, default: Sequence[str] = DEFAULT_ROUTE, own: bool = True) -> DataFrame:
    """A verdict of each inspection, with what its engines and the memory said.

    ``pairs``: insp_id (a number), h, w, gab, test, and, if there are any, ``anomalies`` and
    ``focus`` (arrays of boxes x, y, w, h).  ``info``: insp_id, part, category,
    value and emb, the suspect's embedding.  ``memory`` as for ``knn_vote``.
    An inspection without images is ignored; its vote is not looked at.
    """
    for name in ("anomalies", "focus"):
        if name not in pairs.columns:
            pairs = pairs.withColumn(name, F.lit(None).cast(f"array<{BOX}>"))
    info = info.select("insp_id", "part", "category", "value", "emb")
    routed = route_engines(info.drop("emb"), routes, default).withColumns({
        "shift_tolerance": tolerance_rule("shift", F.col("value"), F.col("category")), "ink_tolerance": tolerance_rule("silk", F.col("value")),
    })
    asked = pairs.join(routed.select("insp_id", "engines", "ink_tolerance"), "insp_id")
    said = scores(measure(asked).join(routed.select("insp_id", "engines", "shift_tolerance", "ink_tolerance"), "insp_id"))
    queries = info.join(routed.where(F.array_contains("engines", "knn")).select("insp_id"), "insp_id", "left_semi")
    votes = knn_vote(queries.select(F.col("insp_id").alias("query_id"), "part", "category", "emb"), memory, k, strict, own)
    rows = said.join(votes.withColumnRenamed("query_id", "insp_id"), "insp_id", "left")
    c = F.col
    with_memory = F.coalesce("has_memory", F.lit(False))
    p, physical = S.physical_score(c("shift.is_defect"), c("shift.score"), c("silk.is_defect"), c("semantic.is_defect"), c("loss"), c("best.local"), c("best.ctx"))
    rows = rows.withColumns({"has_memory": with_memory, "physical": p, "is_physical": physical})
    rows = rows.withColumn("final_score", S.master_fusion(c("physical"), c("is_physical"), c("has_memory"), F.coalesce("vote_defect", F.lit(0.5)), F.coalesce("best_similarity", F.lit(0.0))))
    rows = rows.withColumn("is_defect", c("has_image") & (c("final_score") > 0.45))
    names = ("semantic", "shift", "silk", "ssim")
    boxes = F.map_from_arrays(F.array(*[F.lit(n) for n in names], F.lit("macro")), F.array(*[c(f"{n}.box") for n in names], F.when(c("ssim").isNotNull(), c("macro_box"))))
    rows = rows.withColumn("all_boxes", F.map_filter(boxes, lambda _, b: b.isNotNull()))
    text = S.reason_text([c("shift.reason"), c("silk.reason"), c("semantic.reason")], c("has_memory"), F.coalesce("vote_defect", F.lit(0.5)), F.coalesce("best_similarity", F.lit(0.0)))
    return rows.select(
        "insp_id", "is_defect", "final_score", F.when(c("has_image"), S.confidence(c("final_score"))).otherwise(0.0).alias("confidence"),
        S.final_status(F.size(F.map_keys("all_boxes")), c("is_defect"), c("has_image")).alias("verdict"), text.alias("reason"),
        S.active_engines(c("engines"), F.size("textures") > 0).alias("active_engines"), S.main_box(*[c(f"{n}.box") for n in names]).alias("box"),
        "all_boxes", "shift", "silk", "semantic", "ssim", "best", "macro_dx", "macro_dy", "physical", "is_physical", "has_memory", "vote_defect", "best_similarity", "n_neighbors",
    )


def engine_scores(inspected: DataFrame) -> DataFrame:
    """One row for each inspection and engine that said something: insp_id, engine, is_defect, score, reason, box."""
    names = ("shift", "silk", "semantic", "ssim")
    all_said = F.array(*[F.struct(F.lit(n).alias("engine"), F.col(n).alias("s")) for n in names])
    rows = inspected.select("insp_id", F.explode(all_said).alias("e")).where("e.s IS NOT NULL")
    return rows.select("insp_id", "e.engine", "e.s.is_defect", "e.s.score", "e.s.reason", "e.s.box")
