"""Geometry expressions over boxes [x1, y1, x2, y2] and positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 1000


def planar_distance(x0: Column, y0: Column, x1: Column, y1: Column, digits: int = 4) -> Column:
    """Distance in the plane, rounded."""
    return F.round(F.sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1)), digits)


def _side(box: Column, k: int) -> Column:
    return F.get(box, k)


def area(box: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(_side(box, 2) - _side(box, 0), zero) * F.greatest(_side(box, 3) - _side(box, 1), zero)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union has no area."""
    zero = F.lit(0.0)
    wide = F.greatest(F.least(_side(a, 2), _side(b, 2)) - F.greatest(_side(a, 0), _side(b, 0)), zero)
    high = F.greatest(F.least(_side(a, 3), _side(b, 3)) - F.greatest(_side(a, 1), _side(b, 1)), zero)
    shared = wide * high
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(zero)


def to_grid(box: Column, width: Column, height: Column) -> Column:
    """Pixels to whole thousandths of the image, half to even."""
    return F.array(*[F.bround(F.lit(float(GRID)) * _side(box, k) / (width, height)[k % 2]).cast("int") for k in range(4)])


def letterbox(box: Column, width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """The box after fitting the image into a frame with its shape kept and equal bars on both sides."""
    scale = F.least(F.lit(float(to_width)) / width, F.lit(float(to_height)) / height)
    fitted = (width * scale).cast("int"), (height * scale).cast("int")
    pads = [F.floor((F.lit(to) - got) / 2) for to, got in zip((to_width, to_height), fitted, strict=True)]
    return F.array(*[_side(box, k) * scale + pads[k % 2] for k in range(4)])


def flipped(box: Column, width: Column) -> Column:
    """The box in the mirrored image."""
    return F.array(width - _side(box, 2), _side(box, 1), width - _side(box, 0), _side(box, 3))


def maybe_flipped(box: Column, width: Column, key: Column, seed: int = 42, share: float = 0.5) -> Column:
    """The box in the mirrored image for a share of the keys, chosen by a hash of seed and key, so that all boxes of an image agree and reruns repeat."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.when(drawn < F.lit(int(share * (1 << 32))), flipped(box, width)).otherwise(box)


def repaired(box: Column) -> Column:
    """Whole numbers within the grid, in order, at least one apart where the grid allows; other lengths stay as they are."""
    put = [F.greatest(F.lit(0), F.least(F.lit(GRID), F.bround(_side(box, k)).cast("int"))) for k in range(4)]
    out = []
    for low, high in ((0, 2), (1, 3)):
        first, second = F.least(put[low], put[high]), F.greatest(put[low], put[high])
        out.append((first, F.when(first == second, F.least(F.lit(GRID), second + 1)).otherwise(second)))
    fixed = F.array(out[0][0], out[1][0], out[0][1], out[1][1]).cast("array<double>")
    return F.when(F.size(box) == 4, fixed).otherwise(box)


def _rotated_back(q: Column, v: list[Column]) -> list[Column]:
    """A vector turned by the inverse of a unit quaternion [w, x, y, z]."""
    w, x, y, z = (F.get(q, k) for k in range(4))
    rows = (
        (1 - 2 * (y * y + z * z), 2 * (x * y + w * z), 2 * (x * z - w * y)),
        (2 * (x * y - w * z), 1 - 2 * (x * x + z * z), 2 * (y * z + w * x)),
        (2 * (x * z + w * y), 2 * (y * z - w * x), 1 - 2 * (x * x + y * y)),
    )
    return [a * v[0] + b * v[1] + c * v[2] for a, b, c in rows]


def projected_box(corners: Column, ego_at: Column, ego_turn: Column, sensor_at: Column, sensor_turn: Column, camera: Column, width: Column, height: Column) -> Column:
    """2-D box, on the grid, of a 3-D box seen by a camera; null if every corner is behind it.

    corners: array of [x, y, z] in world coordinates; camera: 3 x 3 intrinsics by rows.
    """

    def seen(corner: Column) -> Column:
        v = [F.get(corner, k) - F.get(ego_at, k) for k in range(3)]
        v = _rotated_back(ego_turn, v)
        v = [v[k] - F.get(sensor_at, k) for k in range(3)]
        v = _rotated_back(sensor_turn, v)
        return F.struct(v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))

    def pixel(p: Column) -> Column:
        row = [F.get(F.get(camera, r), 0) * p["x"] + F.get(F.get(camera, r), 1) * p["y"] + F.get(F.get(camera, r), 2) * p["z"] for r in range(3)]
        return F.struct((row[0] / row[2]).alias("u"), (row[1] / row[2]).alias("v"))

    points = F.transform(F.filter(F.transform(corners, seen), lambda p: p["z"] > 0), pixel)
    us, vs = F.transform(points, lambda p: p["u"]), F.transform(points, lambda p: p["v"])
    inside = lambda value, most: F.greatest(F.lit(0.0), F.least(most.cast("double"), value))
    box = F.array(inside(F.array_min(us), width), inside(F.array_min(vs), height), inside(F.array_max(us), width), inside(F.array_max(vs), height))
    return F.when(F.size(points) > 0, to_grid(box, width, height))
