"""Replacing, removing and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnback import scratch
from turnback.functions.scalars import hashed_long, hashed_uniform, let

from .arrays import numbered
from .base import Elementwise, Op


class Replace(Elementwise):
    """``with_`` where ``mask`` is true; the replaced value is the residual."""

    name = "replace"
    ins = ("a", "mask", "with_")

    @property
    def outs(self):
        return ("target", "replaced", *(i for i in ("mask", "with_") if i in self.free))

    def fwd(self, a, mask, with_):
        return {"target": F.when(mask, with_).otherwise(a), "replaced": F.when(mask, a), "mask": mask, "with_": with_}

    def inv(self, target, replaced, mask, with_):
        return {"a": F.when(mask, replaced).otherwise(target), "mask": mask, "with_": with_}


def replace_listed(df: DataFrame, column: str, mask: Column, values: DataFrame, order: list[str], target: str = "target") -> DataFrame:
    """One listed value for each masked row in order: ``values`` has (pos from 0, value). Masked rows beyond the list keep
    their value. Only masked rows are numbered."""
    hit = numbered(df.filter(mask), order, "__pos")
    v = values.select(F.col("pos").alias("__pos"), F.col("value").alias("__value"))
    done = hit.join(v, "__pos", "left").withColumn(target, F.coalesce("__value", column)).withColumn("replaced", F.col(column)).drop("__pos", "__value")
    rest = df.filter(~F.coalesce(mask, F.lit(False))).withColumn(target, F.col(column)).withColumn("replaced", F.lit(None).cast(df.schema[column].dataType))
    return done.unionByName(rest)


def remove(df: DataFrame, mask: Column) -> tuple[DataFrame, DataFrame]:
    """(rows where the mask is true, the others); :func:`restore` puts them together again."""
    m = F.coalesce(mask, F.lit(False))
    return df.filter(m), df.filter(~m)


def restore(kept: DataFrame, removed: DataFrame) -> DataFrame:
    return kept.unionByName(removed)


class RandomReplace(Op):
    """In an array cell, each element is replaced with probability ``prob`` unless protected; at most ``max_replace``
    of them, those at the highest positions. The choice is a hash of the row's key, the position and the seed, so it is
    the same on every run and partitioning. Residuals: ``positions`` replaced (falling) and their values."""

    name = "random_replace"
    ins = ("a", "key")

    @property
    def outs(self):
        return ("target", "positions", "replaced", "key")

    def forward(self, cols):
        x = self.args(cols)
        a, p = x["a"], self.params
        keep = list(p.get("do_not_replace", []))

        def chosen(i: Column) -> Column:
            drawn = hashed_uniform(x["key"], i, F.lit(p.get("seed", 0))) < p["prob"]
            return ~F.coalesce(F.get(a, i).isin(keep), F.lit(True)) & drawn if keep else drawn

        # from the highest position down; once there are enough, no more are drawn
        places = F.when(a.isNotNull(), F.when(F.size(a) > 0, F.sequence(F.size(a) - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>")))
        none = F.array().cast("array<int>")
        positions = F.aggregate(places, none, lambda got, i: F.when((F.size(got) < p["max_replace"]) & chosen(i), F.concat(got, F.array(i))).otherwise(got))
        done = let(positions, lambda at: F.struct(at.alias("at"), F.transform(a, lambda v, i: F.when(F.array_contains(at, i), F.lit(p["with_"])).otherwise(v)).alias("target"), F.transform(at, lambda i: F.get(a, i)).alias("was")))
        return {"target": done["target"], "positions": done["at"], "replaced": done["was"], "key": x["key"]}

    def inverse(self, cols):
        at, was = cols["positions"], cols["replaced"]
        back = F.transform(cols["target"], lambda v, i: F.when(F.array_contains(at, i), F.get(was, (F.array_position(at, i) - 1).cast("int"))).otherwise(v))
        return {"a": back, "key": cols["key"]}


class RandomChoice(Op):
    """``size`` draws from ``choices`` with probabilities ``p`` (equal ones without it), by hash of the row's key."""

    name = "random_choice"
    ins = ("key",)
    outs = ("target", "key")

    def forward(self, cols):
        key, choices = self.args(cols)["key"], list(self.params["choices"])
        p = list(self.params.get("p") or [1 / len(choices)] * len(choices))
        if len(p) != len(choices) or abs(sum(p) - 1) > 1e-9:
            raise ValueError("p needs a probability for each choice, with sum 1")
        bounds = [sum(p[: i + 1]) for i in range(len(p) - 1)]

        def draw(i: Column) -> Column:
            u = hashed_uniform(key, i, F.lit(self.params.get("seed", 0)))
            out = F.lit(choices[-1])
            for b, v in reversed(list(zip(bounds, choices))):
                out = F.when(u < b, F.lit(v)).otherwise(out)
            return out

        return {"target": F.transform(F.sequence(F.lit(0), F.lit(self.params.get("size", 1) - 1)), draw), "key": key}

    def inverse(self, cols):
        return {"key": cols["key"]}


def segment_pairs(df: DataFrame, key: str, tokens: str, ends: str, num_tries: int = 10, prob: float = 0.5, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Next-segment examples: key, target, segment_ids, is_random_next, removed; and the columns of ``keep``.

    A row's tokens (padded with '') are cut at a sentence end drawn at random among those marked in ``ends``:
    [CLS] A [SEP] B [SEP], three columns wider. With probability ``prob`` B gives way to the longest B that fits among
    ``num_tries`` random rows; the B replaced goes to ``removed``, right-aligned and padded with [NA].
    Random rows are drawn by hashed row number, so the lookup is an equi-join on bounded tries, never a cross join. Tries
    meet sizes alone; the one that wins then fetches its segment.
    """
    u = lambda *p: hashed_uniform(F.col(key), *p, F.lit(seed))
    width = F.size(tokens) + 3
    marks = F.filter(F.sequence(F.lit(0), F.size(ends) - 1), lambda i: F.get(F.col(ends), i).cast("boolean"))
    x = df.select(key, *keep, tokens, ends).withColumn("__m", marks)
    x = x.withColumn("__cut", F.get("__m", F.floor(u(F.lit("cut")) * F.size("__m")).cast("int"))).withColumn("__last", F.element_at("__m", -1))
    x = x.withColumn("__a", F.slice(tokens, 1, F.col("__cut") + 1)).withColumn("__b", F.slice(F.col(tokens), F.col("__cut") + 2, F.col("__last") - F.col("__cut")))
    x = x.withColumn("__tail", F.slice(F.col(tokens), F.col("__last") + 2, F.size(tokens))).withColumn("__width", width)
    # written once: filters inferred from the joins would else be pushed down into the lambdas above, for each element anew
    x = scratch.table(x.select(key, *keep, "__a", "__b", "__tail", "__width"), "segments")
    # rows in buckets by hash of key: a try picks a bucket, and the bucket's first row by hash answers
    buckets = F.greatest(F.lit(1), x.agg(F.count("*")).scalar())
    rows = x.withColumn("__bucket", F.pmod(hashed_long(F.col(key), F.lit(seed)), buckets))
    pool = rows.groupBy("__bucket").agg(F.min_by("__b", hashed_long(F.col(key), F.lit(seed + 1))).alias("__chunk"))
    tries = x.withColumn("__go", u(F.lit("go")) < prob).filter("__go").select(key, F.size("__a").alias("__na"), "__width", F.explode(F.sequence(F.lit(1), F.lit(num_tries))).alias("__t"))
    tries = tries.withColumn("__bucket", F.pmod(hashed_long(F.col(key), F.col("__t"), F.lit(seed + 2)), buckets))
    best = tries.join(pool.select("__bucket", F.size("__chunk").alias("__n")), "__bucket").filter(F.col("__n") + 1 < F.col("__width") - F.col("__na") - 2)
    best = best.groupBy(key).agg(F.max(F.struct("__n", -F.col("__t"), "__bucket"))["__bucket"].alias("__bucket"))
    best = best.join(pool, "__bucket").select(key, "__chunk")
    x = x.join(best, key, "left")
    sep = F.array(F.lit("[SEP]"))
    head = F.concat(F.array(F.lit("[CLS]")), "__a", sep)
    own = F.concat(F.col("__b"), sep, F.col("__tail"))
    tail = F.coalesce(F.concat(F.col("__chunk"), sep), own)
    pad = lambda c: F.concat(c, F.array_repeat(F.lit(""), F.col("__width") - F.size(c)))
    ids = F.concat(F.array_repeat(F.lit(0), F.size(head)), F.array_repeat(F.lit(1), F.col("__width") - F.size(head)))
    na = lambda c: F.concat(F.array_repeat(F.lit("[NA]"), F.col("__width") - F.size(c)), c)
    removed = F.when(F.col("__chunk").isNotNull(), na(own)).otherwise(F.array_repeat(F.lit("[NA]"), F.col("__width")))
    return x.select(key, *keep, pad(F.concat(head, tail)).alias("target"), ids.alias("segment_ids"), F.col("__chunk").isNotNull().alias("is_random_next"), removed.alias("removed"))


def unsegmented() -> Column:
    """The tokens that :func:`segment_pairs` was given, from the columns that it returns."""
    head = F.array_position("target", "[SEP]")
    own = F.when(F.col("is_random_next"), F.filter("removed", lambda t: t != "[NA]")).otherwise(F.slice(F.col("target"), head + 1, F.size("target")))
    a = F.slice(F.col("target"), 2, head - 2)
    end = F.array_position(own, "[SEP]")
    return F.concat(a, F.slice(own, F.lit(1), end - 1), F.slice(own, end + 1, F.size(own)))


def unsegment_pairs(df: DataFrame, key: str) -> DataFrame:
    """key and the tokens that :func:`segment_pairs` was given."""
    return df.select(key, unsegmented().alias("tokens"))
