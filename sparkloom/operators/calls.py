"""Resolution of calls to overloaded methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Primitive types with their wrappers, and what a pair of parameter and argument types scores.
BOXED = {"boolean": "Boolean", "byte": "Byte", "char": "Character", "double": "Double", "float": "Float", "int": "Integer", "long": "Long", "short": "Short"}
EXACT, BOXING, ANY_OBJECT, MISMATCH, NULL_TO_PRIMITIVE = 8, 6, 1, -4, -50


def short_name(c: Column) -> Column:
    """A type's name without packages and type arguments."""
    return F.substring_index(F.regexp_replace(F.trim(c), "<.*>", ""), ".", -1)


def compatibility(param: Column, arg: Column) -> Column:
    """How well an argument's type suits a parameter's; an unknown argument (null or '') tells nothing."""
    p, a = short_name(param), short_name(arg)
    primitive = p.isin(*BOXED)
    boxing = reduce(lambda x, y: x | y, [((p == k) & (a == v)) | ((p == v) & (a == k)) for k, v in BOXED.items()])
    known = F.when(a == "null", F.when(primitive, NULL_TO_PRIMITIVE).otherwise(ANY_OBJECT)).when(p == a, EXACT).when(boxing, BOXING).when(p == "Object", ANY_OBJECT).otherwise(MISMATCH)
    return F.when(F.coalesce(a, F.lit("")) == "", 0).otherwise(known)


def best_overload(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """(call, pos): the method each call goes to, if any.

    calls(call, owner, name, args) with the arguments' types; methods(owner, name, pos, params, varargs).
    Methods with as many parameters and no variable tail come first, best score first; else the widest
    variable one that the arguments reach. Without args (null), one without parameters, else any.
    The lower pos wins ties. One equi join and a partial aggregation: no window, no sort.
    """
    pairs = calls.join(methods, ["owner", "name"])
    n, width = F.size("args"), F.size("params")
    fixed = ~F.col("varargs") & (width == n)
    reaches = F.col("varargs") & (width > 0) & (n >= width - 1)
    blind = F.col("args").isNull()
    both = F.slice(F.arrays_zip("params", "args"), F.lit(1), F.greatest(F.least(n, width), F.lit(0)))
    score = F.aggregate(F.transform(both, lambda x: compatibility(x["params"], x["args"])), F.lit(0), lambda s, x: s + x)
    rank = F.when(blind, F.struct((width == 0).cast("int").alias("fixed"), F.lit(0).alias("by"))).when(fixed, F.struct(F.lit(1).alias("fixed"), score.alias("by"))).otherwise(F.struct(F.lit(0).alias("fixed"), width.alias("by")))
    fit = pairs.where(blind | fixed | reaches).select("call", "pos", rank.alias("_rank"))
    return fit.groupBy("call").agg(F.max_by("pos", F.struct("_rank", (-F.col("pos")).alias("_first"))).alias("pos"))
