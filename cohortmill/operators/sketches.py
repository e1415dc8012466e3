"""Counts of set operations over many audiences, by theta sketches: one row for each audience, no join of ids.

A sketch holds at most 2 ** lg_nom hashes of an audience's ids, so up to that many ids counts are exact; beyond it an estimate's
relative error is about 1 / sqrt(2 ** lg_nom) of the union's size (1.6 % for the default 12). Dealt into parts by a hash, an
audience has a sketch for each part, and counts add up over the parts: with enough of them (parts_for) each part's sketches
hold all its ids, and counts are exact at every size. Sketches are for plans of many audiences, made once and combined at will.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_NOM = 12


def parts_for(ids: int, lg_nom: int = LG_NOM) -> int:
    """Parts in which the sketches of audiences that have `ids` ids together hold all of them: a quarter of their room on average."""
    return max(1, -(-ids // 2 ** (lg_nom - 2)))


def sketched(audiences: Mapping[str, DataFrame], lg_nom: int = LG_NOM, parts: int = 1) -> DataFrame:
    """audience, part, ids: a theta sketch of the customer_ids of each audience in each part, an empty one where it has none."""
    one = []
    for name, df in audiences.items():
        rows = df.select(F.pmod(F.xxhash64("customer_id"), F.lit(parts)).alias("part"), "customer_id")
        rows = rows.unionByName(df.sparkSession.range(parts).select(F.col("id").alias("part"), F.lit(None).cast(df.schema["customer_id"].dataType).alias("customer_id")))
        one.append(rows.groupBy("part").agg(F.theta_sketch_agg("customer_id", F.lit(lg_nom)).alias("ids")).select(F.lit(name).alias("audience"), "part", "ids"))
    return reduce(lambda a, b: a.unionByName(b), one)


def _combined(kind: str, sketches: Sequence[Column], lg_nom: int) -> Column:
    """As set_operation combines ids: exclude and exclude_overlap are the first without the others."""
    if kind == "union":
        return reduce(lambda a, b: F.theta_union(a, b, F.lit(lg_nom)), sketches)
    if kind == "overlap":
        return reduce(F.theta_intersection, sketches)
    if kind in ("exclude", "exclude_overlap"):
        return reduce(F.theta_difference, sketches)
    raise ValueError(f"unknown set operation {kind!r}")


def set_count(sketches: DataFrame, kind: str, names: Sequence[str], lg_nom: int = LG_NOM, exact: bool = False) -> DataFrame:
    """kind, n: the estimated size of the set operation over the named audiences, in their order. exact: fail where a part
    holds more ids than a sketch has room for, instead of estimating."""
    known = sketches.where(F.col("audience").isin(*names)).groupBy("part").agg(*(F.max(F.when(F.col("audience") == n, F.col("ids"))).alias(f"s{i}") for i, n in enumerate(names)))
    held = [F.col(f"s{i}") for i in range(len(names))]
    n = F.theta_sketch_estimate(_combined(kind, held, lg_nom))
    if exact:
        whole = F.theta_sketch_estimate(_combined("union", held, lg_nom)) <= 2**lg_nom
        n = F.when(whole, n).otherwise(F.raise_error(F.lit("a part has more ids than its sketch holds: take more parts")).cast("long"))
    return known.select(n.alias("n")).agg(F.lit(kind).alias("kind"), F.sum("n").alias("n"))
