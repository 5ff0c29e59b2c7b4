"""Vector arithmetic and losses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2_distance(a: Column, b: Column) -> Column:
    return norm(minus(a, b))


def translation_score(h: Column, r: Column, t: Column) -> Column:
    """Length of h + r - t."""
    return norm(F.zip_with(F.zip_with(h, r, lambda x, y: x.cast("double") + y.cast("double")), t, lambda x, y: x - y.cast("double")))


def anomaly_score(h: Column, r: Column, t: Column, views: list[tuple[Column, Column]], weight: float = 0.1) -> Column:
    """Translation score plus the weighted disagreement of each pair of views."""
    score = translation_score(h, r, t)
    for a, b in views:
        score = score + F.lit(weight) * l2_distance(a, b)
    return score


def softmax(x: Column, batch: WindowSpec) -> Column:
    e = F.exp(x - F.max(x).over(batch))
    return e / F.sum(e).over(batch)


def log_softmax(x: Column, batch: WindowSpec) -> Column:
    top = F.max(x).over(batch)
    return x - top - F.log(F.sum(F.exp(x - top)).over(batch))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def dropout(x: Column, rate: float, *key: Column | str) -> Column:
    """For training: 0 for a drawn share of rate, else x over the share that stays."""
    from tripleguard.functions.draws import draw

    return F.when(draw(*key) / 2**32 < rate, F.lit(0.0)).otherwise(x / (1 - rate))


def leaky_relu(x: Column, alpha: float = 0.2) -> Column:
    return F.when(x > 0, x).otherwise(x * alpha)


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.exp(x) - 1)


def gate(a: Column, mu: float = 0.001) -> Column:
    """What exceeds mu, else 0."""
    return F.greatest(a - mu, F.lit(0.0))


def margin_loss(pos: Column, neg: Column, gamma: float = 0.5) -> Column:
    """Mean of max(0, pos - neg + gamma)."""
    return F.avg(F.greatest(F.lit(0.0), pos - neg + gamma))


def initial_vector(size: int, *key: Column | str) -> Column:
    """Uniform in (-6/sqrt(size), 6/sqrt(size)), drawn from the key and the place."""
    from tripleguard.functions.draws import draw

    bound = 6 / size**0.5
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (draw(*key, i) / 2**32 * 2 - 1) * bound)
