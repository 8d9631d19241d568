"""Array expressions for ordered lists of practice names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evenkeel.functions.hashing import hash32, uniform


def name_array(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")


def draw_index(u: Column, size: Column) -> Column:
    """0-based position in a list of ``size`` elements for a uniform ``u``."""
    return F.floor(u * size).cast("int")


def random_subset(names: list[str], seed: str, *keys: str) -> Column:
    """Random ordered subset; its size is uniform on 1..len(names)."""
    size = draw_index(uniform(f"{seed}:size", *keys), F.lit(len(names))) + 1
    keyed = F.transform(
        name_array(names),
        lambda n: F.struct(hash32(f"{seed}:order", *keys, n).alias("h"), n.alias("name")),
    )
    shuffled = F.sort_array(keyed)["name"]
    return F.slice(shuffled, F.lit(1), size)


def crossover(a: Column, b: Column, apply: Column, u_a: Column, u_b: Column) -> Column:
    """Head of ``a`` joined to the tail of ``b`` at random cuts; ``a`` itself unless ``apply``.

    A cut lies in 1..len-1, or is 1 for a single-element list.
    """

    def cut(arr: Column, u: Column) -> Column:
        span = F.greatest(F.size(arr) - 1, F.lit(1))
        return draw_index(u, span) + 1

    joined = F.concat(
        F.slice(a, F.lit(1), cut(a, u_a)),
        F.slice(b, cut(b, u_b) + 1, F.greatest(F.size(b), F.lit(1))),
    )
    usable = apply & (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(usable, joined).otherwise(a)


def mutate(child: Column, apply: Column, u_pos: Column, u_new: Column, names: list[str]) -> Column:
    """Replace one random position by a name the list does not contain yet."""
    free = F.array_except(name_array(names), child)
    pos = draw_index(u_pos, F.size(child))
    new = F.get(free, draw_index(u_new, F.size(free)))
    usable = apply & (F.size(child) > 0) & (F.size(free) > 0)
    return F.when(
        usable, F.transform(child, lambda x, i: F.when(i == pos, new).otherwise(x))
    ).otherwise(child)
