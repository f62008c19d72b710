"""Vectors on the Poincare ball, and losses, as array expressions. Norms are kept under 1 - EDGE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = 1e-5


def doubles(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("array<double>")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often and in whatever inner function it is used."""
    return F.transform(F.array(value), use)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def scaled(a: Column, by: Column) -> Column:
    return let(by, lambda k: F.transform(a, lambda x: x * k))


def _by_norm(a: Column, factor: Callable[[Column], Column]) -> Column:
    return let(a, lambda v: scaled(v, let(norm(v), factor)))


def atanh(x: Column) -> Column:
    return F.atanh(F.least(x, F.lit(1 - EDGE)))


def clip(a: Column, most: float = 0.98, eps: float = 1e-8) -> Column:
    """VEC-01: a longer vector is shortened to `most`."""
    return _by_norm(a, lambda n: F.when(n > most, F.lit(most) / (n + eps)).otherwise(1.0))


def expmap0(a: Column) -> Column:
    """VEC-02: from the tangent space at the origin onto the ball."""
    return _by_norm(a, lambda n: F.when(n > 0, F.tanh(n) / n).otherwise(1.0))


def logmap0(a: Column) -> Column:
    return _by_norm(a, lambda n: F.when(n > 0, atanh(n) / n).otherwise(1.0))


def distance(a: Column, b: Column) -> Column:
    room = lambda v: F.greatest(F.lit(1.0) - dot(v, v), F.lit(EDGE))

    def apart(x: Column, y: Column) -> Column:
        gap = F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)
        return F.acosh(1 + 2 * gap / (room(x) * room(y)))

    return let(a, lambda x: let(b, lambda y: apart(x, y)))


def depth(a: Column) -> Column:
    """VEC-03: the distance from the origin."""
    return 2 * atanh(norm(a))


def softmax(logits: Column) -> Column:
    """VEC-05"""
    e = let(logits, lambda v: let(F.array_max(v), lambda most: F.transform(v, lambda x: F.exp(x - most))))
    return let(e, lambda v: let(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(v, lambda x: x / total)))


def argmax(values: Column) -> Column:
    """The first position, from 0, of the largest value."""
    return let(values, lambda v: F.array_position(v, F.array_max(v)) - 1)


def contrastive_loss(d: Column, same: Column, margin: float = 1.0) -> Column:
    """LOS-01: squared distance for equals, squared shortfall of the margin for others."""
    gap = F.greatest(F.lit(margin) - d, F.lit(0.0))
    return F.when(same, d * d).otherwise(gap * gap)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-8))


def hybrid_loss(distance_loss: Column, angle_loss: Column, share: float = 0.5) -> Column:
    return share * distance_loss + (1 - share) * angle_loss


def info_nce(similar: Column, others: Column, temperature: float = 0.1) -> Column:
    """-log of the similar pair's share among all pairs' exponentials."""
    every = F.transform(F.concat(F.array(similar), others), lambda x: x / temperature)
    total = let(every, lambda v: let(F.array_max(v), lambda most: F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - most))) + most))
    return total - similar / temperature


def distillation_loss(student: Column, teacher: Column, student_tangent: Column, teacher_tangent: Column, alpha: float = 0.7, temperature: float = 4.0) -> Column:
    """LOS-02: divergence of softened classes and mean squared gap in the tangent space."""
    soft = lambda x: softmax(scaled(x, F.lit(1 / temperature)))
    kl = F.aggregate(F.zip_with(soft(teacher), soft(student), lambda t, s: t * (F.log(t) - F.log(s))), F.lit(0.0), lambda a, x: a + x) * temperature**2
    gap = F.aggregate(F.zip_with(student_tangent, teacher_tangent, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x) / F.size(student_tangent)
    return alpha * kl + (1 - alpha) * gap


def hierarchical_loss(probabilities: Column, label: Column, penalties: Column, alpha: float = 0.3) -> Column:
    """LOS-03: cross entropy, and what the classes' probabilities cost; penalties: the label's row of the class distances."""
    own = F.element_at(probabilities, (label + 1).cast("int"))
    cost = F.aggregate(F.zip_with(probabilities, penalties, lambda p, h: p * (1 + h)), F.lit(0.0), lambda s, x: s + x)
    return (1 - alpha) * -F.log(F.greatest(own, F.lit(1e-12))) + alpha * cost
