"""Finite-context models as tables: training by counting, and scoring by joins with escapes and full exclusions.

A model is two tables: ``sym`` (model, k, ctx, sym, n, weight) and ``ctx`` (model, k, ctx, occurrences, types, mass, below). A symbol
that occurred n times in a context weighs 2n - 1 (method D) or n (method C). A context is usable if it occurred at least twice; order 0
always is. From the longest usable context, a listed symbol costs the logarithm of its share of the mass that isn't excluded plus one
for each listed symbol; else the escape is paid, unless nothing else was left, and all listed symbols are excluded further down. Those
are followers of the shorter context too, so ``below`` (their mass there) is all that is needed, known once for each model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symstream.session import cut

from .counts import context_counts, gram_context, gram_counts, gram_length, gram_symbol, grams

#: Symbols that can occur, for order -1.
ALPHABET = 65536
#: Costs of grams are broadcast if they are counted to take no more bytes than this; else grams and costs meet in a shuffled join.
BROADCAST_BYTES = 64 << 20
#: Models whose names are written into a plan; more are joined.
LISTED = 256


class Model:
    """The tables of one or more models that share order, method and alphabet."""

    def __init__(self, sym: DataFrame, ctx: DataFrame, order: int, method: str = "D", alphabet: int = ALPHABET, sep: str = "") -> None:
        """sep: what stands between the symbols of a context where they are words; else each sign is a symbol."""
        self.sym, self.ctx, self.order, self.method, self.alphabet, self.sep = sym, ctx, order, method, alphabet, sep

    def write(self, path: str, title: str = "", kind: str = "static") -> None:
        """The tables and a registry row. kind: static, or dynamic for a model that is to learn further when it is read."""
        if kind not in ("static", "dynamic"):
            raise ValueError("a model is static or dynamic")
        self.sym.write.mode("overwrite").parquet(f"{path}/sym")
        self.ctx.write.mode("overwrite").parquet(f"{path}/ctx")
        meta = self.sym.sparkSession.createDataFrame([(title, kind, self.order, self.method, self.alphabet)], "title string, kind string, max_order int, method string, alphabet int")
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/registry")

    @classmethod
    def read(cls, spark, path: str) -> Model:  # noqa: ANN001
        meta = spark.read.parquet(f"{path}/registry").first()
        return cls(spark.read.parquet(f"{path}/sym"), spark.read.parquet(f"{path}/ctx"), meta.max_order, meta.method, meta.alphabet)

    def where(self, condition: Column) -> Model:
        """Those of the models that a condition on the column model holds for."""
        return Model(self.sym.where(condition), self.ctx.where(condition), self.order, self.method, self.alphabet, self.sep)

    def names(self) -> list[tuple[str, int]]:
        """(model, symbols that it has seen), by name: a row for each model."""
        return sorted((r.model, r.types) for r in self.ctx.where("k = 0").select("model", "types").collect())

    def statistics(self) -> DataFrame:
        """Contexts, usable ones, counters and symbols read, by model and order."""
        by = self.ctx.groupBy("model", "k").agg(
            F.count(F.lit(1)).alias("contexts"), F.count_if((F.col("occurrences") >= 2) | (F.col("k") == 0)).alias("usable"), F.sum("types").alias("counters"), F.sum("occurrences").alias("symbols")
        )
        return by


def weight(method: str, n: Column) -> Column:
    if method not in ("C", "D"):
        raise ValueError("escape method is C or D")
    return n if method == "C" else 2 * n - 1


def train(df: DataFrame, model_col: str, text_col: str, order: int, method: str = "D", alphabet: int = ALPHABET) -> Model:
    """Models of the texts by model_col. Texts are units: no context crosses from one to the next. Null texts and models are left out."""
    rows = df.select(F.col(model_col).cast("string").alias("model"), F.col(text_col).alias("t")).where("model IS NOT NULL AND t IS NOT NULL")
    return tables(context_counts(gram_counts(rows, ["model"], "t", order), ["model"], order), order, method, alphabet)


def retitled(spark, path: str, title: str | None = None, kind: str | None = None) -> None:  # noqa: ANN001
    """Changes title or kind of a written model; its tables stay as they are."""
    r = spark.read.parquet(f"{path}/registry").first()
    row = (r.title if title is None else title, r.kind if kind is None else kind, r.max_order, r.method, r.alphabet)
    if row[1] not in ("static", "dynamic"):
        raise ValueError("a model is static or dynamic")
    spark.createDataFrame([row], "title string, kind string, max_order int, method string, alphabet int").coalesce(1).write.mode("overwrite").parquet(f"{path}/registry")


def tables(counted: DataFrame, order: int, method: str = "D", alphabet: int = ALPHABET, sep: str = "") -> Model:
    """A model from (model, k, ctx, sym, n). The counts are kept, since they are read several times; texts are read once."""
    sym = cut(counted).withColumn("weight", weight(method, F.col("n")))
    ctx = sym.groupBy("model", "k", "ctx").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("types"), F.sum("weight").alias("mass"))
    shorter = sym.select("model", (F.col("k") + 1).alias("k"), F.col("ctx").alias("tail"), "sym", F.col("weight").alias("lower"))
    parts = F.split("ctx", sep) if sep else None
    tail = F.array_join(F.slice(parts, F.lit(2), F.size(parts)), sep) if sep else F.expr("substring(ctx, 2)")
    longer = sym.where("k > 0").select("model", "k", "ctx", tail.alias("tail"), "sym")
    below = longer.join(shorter, ["model", "k", "tail", "sym"]).groupBy("model", "k", "ctx").agg(F.sum("lower").alias("below"))
    return Model(sym, ctx.join(below, ["model", "k", "ctx"], "left").fillna(0, ["below"]), order, method, alphabet, sep)


def gram_bits(rows: DataFrame, model: Model, exclusions: bool = True) -> DataFrame:
    """(model, gram, bits) for each distinct gram under each model; a symbol that no context knows is one of the rest of the alphabet."""
    rest = F.greatest(F.lit(model.alphabet) - (F.col("types0") if exclusions else F.lit(0)) + 1, F.lit(1)).cast("double")
    return escaped_bits(rows, model, exclusions).select("model", "gram", F.when(F.col("found"), F.col("bits")).otherwise(F.col("bits") + F.log(2.0, rest)).alias("bits"))


def escaped_bits(rows: DataFrame, model: Model, exclusions: bool = True) -> DataFrame:
    """(model, gram, bits, found, types0, level, alone) for each distinct gram under each model. level is the length of the context that knows the
    symbol, or -1, and alone what the symbol costs if that is known. The cost of a symbol depends on its gram alone, so it is found once.

    rows has a column gram: the symbol, and before it the symbols of its context.
    """
    distinct = rows.select("gram").distinct()
    names = model.names()
    if len(names) <= LISTED:
        listed = F.array(*(F.struct(F.lit(name).alias("model"), F.lit(types).cast("bigint").alias("types0")) for name, types in names)) if names else F.array().cast("array<struct<model:string,types0:bigint>>")
        each = distinct.select("gram", F.inline(listed))
    else:  # every gram has a cost under every model
        each = distinct.join(model.ctx.where("k = 0").select("model", F.col("types").alias("types0")))
    levels = each.select("model", "gram", "types0", F.explode(F.sequence(F.lit(0), F.least(gram_length("gram", model.sep) - 1, F.lit(model.order)))).alias("k"))
    levels = levels.select("model", "gram", "types0", "k", gram_context("gram", "k", model.sep).alias("ctx"), gram_symbol("gram", model.sep).alias("sym"))
    joined = levels.join(model.ctx, ["model", "k", "ctx"], "left").join(model.sym.select("model", "k", "ctx", "sym", "weight"), ["model", "k", "ctx", "sym"], "left")
    level = F.struct(-F.col("k"), "occurrences", "types", "mass", "below", "weight")
    grouped = joined.groupBy("model", "gram", "types0").agg(F.array_sort(F.collect_list(level)).alias("levels"))  # order + 1 entries
    log2 = lambda c: F.log(2.0, c)
    start = F.struct(F.lit(0.0).alias("bits"), F.lit(False).alias("found"), F.lit(0).cast("bigint").alias("excluded"), F.lit(-1).alias("level"), F.lit(0.0).alias("alone"))

    def step(state: Column, x: Column) -> Column:
        usable = x["occurrences"].isNotNull() & ((x["occurrences"] >= 2) | (x["col1"] == 0))
        left = x["mass"] - (state["excluded"] if exclusions else F.lit(0))
        total = (left + x["types"]).cast("double")
        hit = usable & x["weight"].isNotNull()
        bits = F.when(hit, state["bits"] - log2(x["weight"] / total)).when(left > 0, state["bits"] - log2(x["types"] / total)).otherwise(state["bits"])
        after = F.struct(bits.alias("bits"), hit.alias("found"), x["below"].cast("bigint").alias("excluded"), F.when(hit, -x["col1"]).otherwise(-1).alias("level"), F.when(hit, -log2(x["weight"] / left.cast("double"))).otherwise(0.0).alias("alone"))
        passed = F.struct(state["bits"].alias("bits"), F.lit(False).alias("found"), F.lit(0).cast("bigint").alias("excluded"), F.lit(-1).alias("level"), F.lit(0.0).alias("alone"))
        return F.when(state["found"], state).when(usable, after).otherwise(passed)

    end = F.aggregate("levels", start, step)
    return grouped.withColumn("end", end).select("model", "gram", F.col("end.bits").alias("bits"), F.col("end.found").alias("found"), "types0", F.col("end.level").alias("level"), F.col("end.alone").alias("alone"))


def costs(rows: DataFrame, model: Model, exclusions: bool = True) -> tuple[DataFrame, bool]:
    """((gram, costs), whether they may be broadcast): of each distinct gram its (model, bits) in the order of the models' names."""
    kept = cut(gram_bits(rows, model, exclusions).groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("model", "bits"))).alias("costs")))  # an entry for each model
    n, most = kept.agg(F.count(F.lit(1)), F.max(F.size("costs"))).first()
    return kept, n * (64 + 48 * (most or 0)) <= BROADCAST_BYTES


def gram_codelengths(rows: DataFrame, keys: list[str], model: Model, exclusions: bool = True) -> DataFrame:
    """(keys, model, bits, symbols) from a row (keys, gram) for each symbol: the cost of each text under each model.

    If the costs of the distinct grams may be broadcast, each task adds up its texts' symbols, and only sums are shuffled. Else the
    symbols are counted by text and gram first; a gram that very many texts hold is split by the adaptive skew join.
    """
    kept, small = costs(rows, model, exclusions)
    if small:
        names = [name for name, _ in model.names()]
        summed = rows.join(F.broadcast(kept), "gram").groupBy(*keys).agg(F.count(F.lit(1)).alias("symbols"), *(F.sum(F.col("costs")[i]["bits"]).alias(f"__b{i}") for i in range(len(names))))
        each = F.array(*(F.struct(F.lit(name).alias("model"), F.col(f"__b{i}").alias("bits")) for i, name in enumerate(names))) if names else F.array().cast("array<struct<model:string,bits:double>>")
        return summed.select(*keys, "symbols", F.inline(each)).select(*keys, "model", "bits", "symbols")
    counted = rows.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(kept, "gram").select(*keys, "n", F.inline("costs"))
    return joined.groupBy(*keys, "model").agg(F.sum(F.col("n") * F.col("bits")).alias("bits"), F.sum("n").alias("symbols"))


def own_codelengths(model: Model) -> DataFrame:
    """(model, max_order, bits, symbols): the texts that each model was trained on under it, for every order up to its own.

    A symbol of these texts is known wherever its context is usable, so no escape is ever paid: it is found in the longest usable context. At
    a length below the highest that leaves of a counter what no usable context that is longer by one has found.
    """
    usable = (F.col("occurrences") >= 2) | (F.col("k") == 0)
    totals = model.sym.groupBy("model", "k", "ctx").agg(F.sum("n").alias("occurrences"), (F.sum("weight") + F.count(F.lit(1))).alias("total")).where(usable)
    known = cut(model.sym.join(totals, ["model", "k", "ctx"]).select("model", "k", "ctx", "sym", "n", (-F.log(2.0, F.col("weight") / F.col("total"))).alias("cost")))
    shorter = known.where(F.col("k") < model.order).select("model", F.col("k").alias("at"), F.col("ctx").alias("tail"), "sym", "cost")
    longer = known.where("k > 0").select("model", (F.col("k") - 1).alias("at"), F.expr("substring(ctx, 2)").alias("tail"), "sym", "n")
    found = longer.join(shorter, ["model", "at", "tail", "sym"]).groupBy("model", F.col("at").alias("k")).agg(F.sum(F.col("n") * F.col("cost")).alias("gone"))
    by = known.groupBy("model", "k").agg(F.sum(F.col("n") * F.col("cost")).alias("full"), F.sum("n").alias("n"))
    by = cut(by.join(found, ["model", "k"], "left").fillna(0.0, ["gone"]))  # a row for each model and length
    out = None
    for order in range(model.order + 1):
        bits = F.sum("full") - F.sum(F.when(F.col("k") < order, F.col("gone")).otherwise(0.0))
        one = by.where(F.col("k") <= order).groupBy("model").agg(bits.alias("bits"), F.sum(F.when(F.col("k") == 0, F.col("n")).otherwise(0)).alias("symbols"))
        one = one.select("model", F.lit(order).alias("max_order"), "bits", "symbols")
        out = one if out is None else out.unionByName(one)
    return out


def codelengths(df: DataFrame, id_col: str, text_col: str, model: Model, exclusions: bool = True) -> DataFrame:
    """(id, model, bits, symbols): the codelength of each text under each model. Null and empty texts give no row."""
    rows = grams(df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t")).where("t IS NOT NULL"), ["doc"], "t", model.order)
    return gram_codelengths(rows, ["doc"], model, exclusions).withColumnRenamed("doc", id_col)


def track(df: DataFrame, id_col: str, text_col: str, model: Model, exclusions: bool = True) -> DataFrame:
    """(id, model, pos, sym, bits): the cost of each symbol of each text under each model."""
    rows = grams(df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t")).where("t IS NOT NULL"), ["doc"], "t", model.order, pos=True)
    kept, small = costs(rows, model, exclusions)
    joined = rows.join(F.broadcast(kept) if small else kept, "gram")
    return joined.select(F.col("doc").alias(id_col), "pos", F.right("gram", F.lit(1)).alias("sym"), F.inline("costs")).select(id_col, "model", "pos", "sym", "bits")


def best_models(scored: DataFrame, id_col: str) -> DataFrame:
    """(id, best, best_bits, second, second_bits) by codelength, then by name; a text under one model has no second."""
    ranked = scored.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("bits", "model"))).alias("r"))  # a row for each model
    at = lambda i, f: F.try_element_at("r", F.lit(i))[f]
    return ranked.select(id_col, at(1, "model").alias("best"), at(1, "bits").alias("best_bits"), at(2, "model").alias("second"), at(2, "bits").alias("second_bits"))


def winners(tracked: DataFrame, id_col: str) -> DataFrame:
    """(model, wins, share): of how many symbols each model is the cheapest; ties go to the first name."""
    best = tracked.groupBy(id_col, "pos").agg(F.min(F.struct("bits", "model"))["model"].alias("model"))
    counted = best.groupBy("model").agg(F.count(F.lit(1)).alias("wins"))
    return counted.withColumn("share", F.col("wins") / F.sum("wins").over(Window.partitionBy()))  # a row for each model


def running_entropy(tracked: DataFrame, id_col: str, every: int) -> DataFrame:
    """Bits and bits a symbol so far, at every so-manieth position of each text."""
    so_far = F.sum("bits").over(Window.partitionBy(id_col, "model").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return tracked.withColumn("bits_so_far", so_far).where((F.col("pos") + 1) % every == 0).select(id_col, "model", "pos", "bits_so_far", (F.col("bits_so_far") / (F.col("pos") + 1)).alias("entropy"))


def word_divergence(tracked: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """(id, word_no, bits_a, bits_b, divergence): both models' bits of each word with the space behind it."""
    two = tracked.where(F.col("model").isin(a, b)).groupBy(id_col, "pos", "sym").agg(F.sum(F.when(F.col("model") == a, F.col("bits"))).alias("a"), F.sum(F.when(F.col("model") == b, F.col("bits"))).alias("b"))
    before = F.count_if(F.col("sym") == " ").over(Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    words = two.withColumn("word_no", F.coalesce(before, F.lit(0)))
    return words.groupBy(id_col, "word_no").agg(F.sum("a").alias("bits_a"), F.sum("b").alias("bits_b"), (F.sum("a") - F.sum("b")).alias("divergence"))


def information(tracked: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """(id, entropy_a, entropy_b, radius, absolute, signed): bits a symbol of two models, their mean, and their mean differences."""
    two = tracked.where(F.col("model").isin(a, b)).groupBy(id_col, "pos").agg(F.sum(F.when(F.col("model") == a, F.col("bits"))).alias("a"), F.sum(F.when(F.col("model") == b, F.col("bits"))).alias("b"))
    return two.groupBy(id_col).agg(
        F.avg("a").alias("entropy_a"), F.avg("b").alias("entropy_b"), F.avg((F.col("a") + F.col("b")) / 2).alias("radius"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("absolute"), F.avg(F.col("a") - F.col("b")).alias("signed")
    )


def divergences(df: DataFrame, id_col: str, own_col: str, text_col: str, model: Model) -> DataFrame:
    """(id, model, absolute, signed, radius): for each text and each model but its own (by name) the mean absolute and signed difference of
    the symbols' bits to those under its own, and the mean of both models' bits. Texts whose own model isn't there give no row.
    """
    rows = grams(df.where(F.col(text_col).isNotNull() & F.col(own_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(own_col).cast("string").alias("own"), F.col(text_col).alias("t")), ["doc", "own"], "t", model.order)
    kept, small = costs(rows, model)
    own = F.filter("costs", lambda c: c["model"] == F.col("own"))[0]["bits"]
    joined = rows.join(F.broadcast(kept) if small else kept, "gram").withColumn("b", own).where("b IS NOT NULL")
    each = joined.select("doc", "own", "b", F.inline("costs")).where("model <> own")
    out = each.groupBy(F.col("doc").alias(id_col), "model")
    return out.agg(F.avg(F.abs(F.col("bits") - F.col("b"))).alias("absolute"), F.avg(F.col("bits") - F.col("b")).alias("signed"), F.avg((F.col("bits") + F.col("b")) / 2).alias("radius"))
