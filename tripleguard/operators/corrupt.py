"""Negatives and labelled anomalies, drawn deterministically and kept clear of known facts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleguard.functions.draws import draw, draw_below
from tripleguard.operators import scan
from tripleguard.operators.scan import first_rows, large_groups, nth_free, nth_in_bits, nth_in_order, ordered, union
from tripleguard.session import materialised

#: For each slot that is replaced, the two that stay.
OTHERS = {"h": ("r", "t"), "r": ("h", "t"), "t": ("h", "r")}
SLOT_KEYS = ["a", "b", "slot"]  # the slot last, as rows are sorted by the first key fastest


def shuffled(rows: DataFrame, seed: str, key: str = "pos") -> DataFrame:
    """rows with ord: the place of each row in a drawn order."""
    return rows.withColumn("w", draw(seed, "shuffle", F.col(key))).orderBy("w", key)


def sample(rows: DataFrame, n: int, seed: str, key: str = "pos") -> DataFrame:
    """n rows without replacement; the key is a number that no two rows share."""
    return first_rows(rows, [(draw(seed, "sample", F.col(key)), False), (F.col(key), False)], n)


def _kept(slot: str) -> list[Column]:
    return [F.lit(slot).alias("slot"), *(F.col(c).alias(name) for c, name in zip(OTHERS[slot], "ab"))]


class Taken(NamedTuple):
    """What known facts hold for each two values that stay: of entities (None if no such slot is replaced), and of few relations as bits (else None)."""

    held: scan.Held | None
    bits: DataFrame | None


def taken_values(known: DataFrame, n_ent: int, n_rel: int, slots: tuple[str, ...] = ("h", "r", "t"), keep: bool = False) -> Taken:
    """The facts (h, r, t) in the form that single_slot() searches. keep: for several calls of it, so the facts are grouped and ordered once."""
    bits, rest = None, list(slots)
    if "r" in slots and n_rel <= scan.BITS:
        rest.remove("r")
        bits = scan.as_bits(known.select(F.col("h").alias("a"), F.col("t").alias("b"), F.col("r").alias("u")), ["a", "b"])
        bits = materialised(bits) if keep else bits
    if not rest:
        return Taken(None, bits)
    parts = {s: known.select(*_kept(s), F.col(s).alias("u")) for s in rest}
    taken = union(list(parts.values()))
    large = [part for s, part in parts.items() if (n_rel if s == "r" else n_ent) > scan.LONG] or [taken.where(F.lit(False))]  # others can't fill a large group
    return Taken(scan.held(taken, SLOT_KEYS, large_groups(union(large), SLOT_KEYS), keep), bits)


def single_slot(rows: DataFrame, known: DataFrame | Taken, n_ent: int, n_rel: int, seed: str, slots: tuple[str, ...] = ("h", "r", "t")) -> DataFrame:
    """pos, slot, h, r, t of each row with one slot replaced; h, r and t are null where no value is free.

    The values that known facts (h, r, t; or what taken_values() makes of them for these slots at least) hold for the two other slots are taken;
    of those that are free one is drawn by its rank, so every free value is as likely and no candidate is tried in vain.
    """
    names = F.array(*map(F.lit, slots))
    chosen = rows.select("pos", "h", "r", "t", F.get(names, draw_below(len(slots), seed, "slot", F.col("pos")).cast("int")).alias("slot"))
    stays = lambda i: F.coalesce(*(F.when(F.col("slot") == s, F.col(OTHERS[s][i])) for s in slots))
    chosen = materialised(chosen).withColumns({"a": stays(0), "b": stays(1)})
    taken = known if isinstance(known, Taken) else taken_values(known, n_ent, n_rel, slots)

    is_r, parts = F.col("slot") == "r", []

    def drawn(held: Column) -> Column:
        free = F.when(is_r, F.lit(n_rel)).otherwise(F.lit(n_ent)).cast("long") - held
        return F.when(free > 0, draw_below(free, seed, "free", F.col("pos")))

    if "r" in slots and taken.bits is not None:
        parts.append(nth_in_bits(chosen.where(is_r), taken.bits, ["a", "b"], n_rel, drawn))
        chosen = chosen.where(~is_r)
    if taken.held is not None:
        parts.append(nth_free(chosen, taken.held, SLOT_KEYS, drawn))
    value = lambda c: F.when(F.col("free").isNotNull(), F.when(F.col("slot") == c, F.col("free")).otherwise(F.col(c))).alias(c)
    return union(parts).select("pos", "slot", *map(value, "hrt"))


def fully_random(n: int, known: DataFrame, n_ent: int, n_rel: int, seed: str) -> DataFrame:
    """pos (0 to n-1), h, r, t: triples that are not known facts, each as likely; no rows if every triple is known.

    All triples are numbered by h, r and t, in 64 bits or else in decimals of 38 digits; the drawn rank among the free numbers gives the triple.
    """
    wide = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("decimal(38,0)")
    kind = "long" if n_ent * n_rel * n_ent < 1 << 62 else "decimal(38,0)"
    number = ((F.col("h").cast(kind) * F.lit(n_rel).cast(kind) + F.col("r").cast(kind)).cast(kind) * F.lit(n_ent).cast(kind) + F.col("t").cast(kind)).cast(kind)
    facts = ordered(known.select(F.lit(0).alias("all"), number.alias("u")), ["all"])
    free = n_ent * n_rel * n_ent - facts.count()
    rows = known.sparkSession.range(n if free > 0 else 0).select(F.col("id").alias("pos"), F.lit(0).alias("all"))
    digit = lambda i: wide(draw(seed, f"free{i}", F.col("pos")))
    drawn = (digit(0) * F.lit(str(2**64)).cast("decimal(20,0)") + digit(1) * wide(2**32) + digit(2)).cast("decimal(38,0)")
    asks = rows.withColumn("k", F.pmod(drawn, F.lit(str(max(free, 1))).cast("decimal(38,0)")).cast(kind))
    found = nth_in_order(asks, facts, ["all"])

    def split(x: Column, size: int) -> tuple[Column, Column]:
        rest = F.pmod(x, wide(size))
        return ((x - rest) / wide(size)).cast("decimal(38,0)"), rest.cast("long")

    pair, t = split(wide(F.col("free")), n_ent)
    h, r = split(pair, n_rel)
    return found.select("pos", h.cast("long").alias("h"), r.alias("r"), t.alias("t"))


def head_or_tail(rows: DataFrame, n_ent: int, seed: str) -> DataFrame:
    """Head or tail replaced by another entity; known facts are not avoided."""
    slot = draw_below(2, seed, "slot", F.col("pos"))
    other = lambda c: F.pmod(F.col(c) + 1 + draw_below(n_ent - 1, seed, "other", F.col("pos")), F.lit(n_ent))
    return rows.select("pos", F.when(slot == 0, other("h")).otherwise(F.col("h")).alias("h"), "r", F.when(slot == 1, other("t")).otherwise(F.col("t")).alias("t"))


def inject(triples: DataFrame, known: DataFrame, n_ent: int, n_rel: int, ratio: float, seed: str, taken: Taken | None = None) -> DataFrame:
    """pos, h, r, t, label: the triples (0) and, at positions behind them, anomalies (1).

    Half of the floor(ratio * n) anomalies replace one slot of a sampled triple, half are random. A triple whose
    slot has no free value is missing, so count label = 1 for what was realised. taken: taken_values() of known, if the caller has it.
    """
    n = triples.count()
    half = int(ratio * n + 1e-9) // 2
    top = triples.agg(F.max("pos")).first()[0]
    first = 0 if top is None else top + 1
    one = single_slot(sample(triples, half, seed), taken or known, n_ent, n_rel, seed).where("h is not null").select((F.col("pos") + first).alias("pos"), "h", "r", "t")
    full = fully_random(half, known, n_ent, n_rel, seed).select((F.col("pos") + 2 * first).alias("pos"), "h", "r", "t")
    return triples.select("pos", "h", "r", "t", F.lit(0).alias("label")).unionByName(one.unionByName(full).withColumn("label", F.lit(1)))


def baseline_batches(rows: DataFrame, negative: DataFrame, size: int, seed: str, epoch: int | str = "epoch") -> DataFrame:
    """batch_id, pos, h, r, t, y (1, or -1 for a negative) and label (null unless rows have it): batches of rows and their negatives (pos, h, r, t), without neighbourhoods."""
    label = F.col("label") if "label" in rows.columns else F.lit(None).cast("int")
    placed = batches(rows.select("pos", "h", "r", "t", label.alias("label")), size, seed, epoch)
    other = placed.select("pos", "label", "batch_id").join(negative.select("pos", "h", "r", "t"), "pos")
    one = lambda part, y: part.select("batch_id", "pos", "h", "r", "t", F.lit(y).alias("y"), "label")
    return one(placed, 1).unionByName(one(other, -1))


def replaced(given: DataFrame, fallback: DataFrame) -> DataFrame:
    """pos, h, r, t: the negative h2, r2, t2 of given, or that of fallback (pos, h, r, t) where one of the three is null."""
    missing = F.col("h2").isNull() | F.col("r2").isNull() | F.col("t2").isNull()
    return given.join(fallback.select("pos", "h", "r", "t"), "pos", "left").select("pos", *(F.when(missing, F.col(c)).otherwise(F.col(f"{c}2")).alias(c) for c in "hrt"))


def changed(pairs: DataFrame) -> DataFrame:
    """pairs (h, r, t, h2, r2, t2) with moved: the slots that differ, or NONE."""
    parts = [F.when(~F.col(c).eqNullSafe(F.col(f"{c}2")), F.lit(name)) for c, name in (("h", "head"), ("r", "relation"), ("t", "tail"))]
    moved = F.concat_ws(",", *parts)
    return pairs.withColumn("moved", F.when(moved == "", F.lit("NONE")).otherwise(moved))


def iterations(n: int, size: int) -> int:
    """How many batches of the size n rows make."""
    return -(-n // size)


def batches(rows: DataFrame, size: int, seed: str, epoch: int | str = "epoch") -> DataFrame:
    """rows with batch_id: an order drawn for the epoch, cut into batches of the size, the rest last."""
    from tripleguard.operators.vocabulary import dense_ids

    return dense_ids(rows.withColumn("_w", draw(seed, epoch, F.col("pos"))), ["_w", "pos"]).withColumn("batch_id", F.floor(F.col("id") / size)).drop("_w", "id")
