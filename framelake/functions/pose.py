"""Column functions for poses: components, affine views, quaternions and six-number rotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = list[Column]


def components(vector: str | Column, ordinals: list[int]) -> Vec:
    """Components of an array column as doubles; null beyond its end."""
    return [F.get(vector, F.lit(i)).cast("double") for i in ordinals]


def dot(a: Vec, b: Vec) -> Column:
    """Inner product."""
    return reduce(lambda x, y: x + y, (p * q for p, q in zip(a, b, strict=True)))


def norm(a: Vec) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> Vec:
    """Cross product."""
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def minus(a: Vec, b: Vec) -> Vec:
    """Difference."""
    return [p - q for p, q in zip(a, b, strict=True)]


def scaled(a: Vec, by: Column) -> Vec:
    """Each component times ``by``."""
    return [p * by for p in a]


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """``x`` held between ``low`` and ``high``."""
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def affine(xyz: Vec, direction: list[int], offset: list[float]) -> Vec:
    """Sign first, then offset."""
    return [p * d + o for p, d, o in zip(xyz, direction, offset, strict=True)]


def unit(a: Vec, floor: float = 1e-12) -> Vec:
    """Direction of a vector; lengths under ``floor`` count as ``floor``."""
    return scaled(a, 1 / F.greatest(norm(a), F.lit(floor)))


def rotation(quaternion: Vec, least: float = 1e-6) -> Vec:
    """The quaternion made a unit; one that is shorter than ``least``, null or not finite has no direction and is an error."""
    size = norm(quaternion)
    sound = F.coalesce((size >= least) & (size < float("inf")) & ~F.isnan(size), F.lit(False))
    whole = F.when(sound, size).otherwise(F.raise_error(F.lit(f"a quaternion is not finite or shorter than {least}")).cast("double"))
    return [x / whole for x in quaternion]


def tool_offset(xyz: Vec, quaternion: Vec, offset: list[float]) -> Vec:
    """Position of a point fixed in the tool's frame; quaternion x, y, z, w is normalised, and must be finite and longer than 1e-8."""
    q = rotation(quaternion, 1e-8)
    v, w, o = q[:3], q[3], [F.lit(float(x)) for x in offset]
    c = scaled(cross(v, o), F.lit(2.0))
    return [p + a + w * b + d for p, a, b, d in zip(xyz, o, c, cross(v, c), strict=True)]


def quaternion_angle(a: Vec, b: Vec) -> Column:
    """Rotation between two unit quaternions in degrees; q and -q are one rotation."""
    return F.degrees(2 * F.acos(clamp(F.abs(dot(a, b)), 0.0, 1.0)))


def rotation_basis(six: Vec) -> list[Vec]:
    """Orthonormal basis of a six-number rotation: two columns made orthonormal, and their cross product."""
    first = unit(six[:3])
    second = unit(minus(six[3:], scaled(first, dot(first, six[3:]))))
    return [first, second, cross(first, second)]


def basis_angle(a: list[Vec], b: list[Vec]) -> Column:
    """Rotation between two bases in degrees, from the trace."""
    trace = reduce(lambda x, y: x + y, (dot(p, q) for p, q in zip(a, b, strict=True)))
    return F.degrees(F.acos(clamp((trace - 1) / 2)))


def segment_distance(p: Vec, a: Vec, b: Vec) -> Column:
    """Distance of a point to the segment from a to b."""
    along = minus(b, a)
    t = clamp(dot(minus(p, a), along) / F.greatest(dot(along, along), F.lit(1e-20)), 0.0, 1.0)
    return norm(minus(p, [x + d * t for x, d in zip(a, along, strict=True)]))


def samples(seconds: float, fps: float, odd: bool = False) -> int:
    """Frames in a time: rounded half to even, one at least, made odd if asked for."""
    n = max(1, round(seconds * fps))
    return n + (odd and n % 2 == 0)


def close(a: Column, b: Column, absolute: float = 1e-5, relative: float = 0.0) -> Column:
    """Whether two numbers agree within a tolerance."""
    return F.abs(a - b) <= absolute + relative * F.abs(b)


def frame_at(seconds: Column, fps: float, n: Column | int) -> Column:
    """The frame shown at a time, held within the episode."""
    return F.least(F.greatest(F.floor(seconds * fps + 1e-4), F.lit(0)), F.lit(n) - 1)


def time_of(frame: Column, fps: float) -> Column:
    """A time at which a frame is surely shown."""
    return (frame + 0.001) / fps


def clip_agrees(video_s: Column, n_frames: Column, fps: float) -> Column:
    """Whether a video lasts as long as its frames, within half a frame or 20 ms."""
    return F.abs(video_s - n_frames / fps) <= max(0.02, 0.5 / fps)
