"""Scoring of predictions against gold: set metrics, averages, B-cubed, votes, reference checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreline.functions import scalars as S


def set_counts(pred: DataFrame, gold: DataFrame, key: list[str], item: list[str]) -> DataFrame:
    """tp, fp and fn of the distinct items of each key."""
    p = pred.select(*key, *item).distinct().withColumn("_p", F.lit(1))
    g = gold.select(*key, *item).distinct().withColumn("_g", F.lit(1))
    both = p.join(g, [*key, *item], "full")
    return both.groupBy(*key).agg(F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.select("*", *S.rates_zero(F.col("tp"), F.col("fp"), F.col("fn")))


def micro_average(counts: DataFrame, *by: str) -> DataFrame:
    """Rates of the summed counts."""
    return with_rates(counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def micro_covered(counts: DataFrame, *by: str) -> DataFrame:
    """Summed counts of layers with coverage exhaustive, partial or none, and their rates; only exhaustive ones count for precision."""
    full = F.col("coverage") == "exhaustive"
    summed = counts.groupBy(*by).agg(
        F.sum("tp").alias("tp"), F.sum(F.when(full, F.col("tp")).otherwise(0)).alias("p_tp"), F.sum(F.when(full, F.col("fp")).otherwise(0)).alias("fp"), F.sum("fn").alias("fn"),
        F.count_if(full).alias("exhaustive"), F.count_if(F.col("coverage") == "partial").alias("partial"),
    )
    label = F.when((F.col("exhaustive") > 0) & (F.col("partial") > 0), "mixed").when(F.col("exhaustive") > 0, "exhaustive").when(F.col("partial") > 0, "partial").otherwise("none")
    measured = F.when(F.col("exhaustive") > 0, "exhaustive").otherwise("partial")
    return summed.withColumn("coverage", label).select("*", *S.rates_covered(F.col("tp"), F.col("p_tp"), F.col("fp"), F.col("fn"), measured))


def b_cubed(pred: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """p_num, p_den, r_num, r_den of clusterings (key, item, cluster): sums over pairs of clusters of common items squared over
    size. Pairs are counted by their common items, so clusters that share none never meet."""
    p, g = pred.select(*key, "item", F.col("cluster").alias("p")), gold.select(*key, "item", F.col("cluster").alias("g"))
    common = p.join(g, [*key, "item"]).groupBy(*key, "p", "g").agg(F.count("*").alias("n"))
    sizes = lambda df, c: df.groupBy(*key, c).agg(F.count("*").alias(f"{c}_size"))
    both = common.join(sizes(p, "p"), [*key, "p"]).join(sizes(g, "g"), [*key, "g"])
    nums = both.groupBy(*key).agg(F.sum(F.col("n") * F.col("n") / F.col("p_size")).alias("p_num"), F.sum(F.col("n") * F.col("n") / F.col("g_size")).alias("r_num"))
    dens = p.groupBy(*key).agg(F.count("*").alias("p_den")).join(g.groupBy(*key).agg(F.count("*").alias("r_den")), key, "full")
    return dens.join(nums, key, "left").select(*key, F.coalesce("p_num", F.lit(0.0)).alias("p_num"), F.coalesce("p_den", F.lit(0)).alias("p_den"), F.coalesce("r_num", F.lit(0.0)).alias("r_num"), F.coalesce("r_den", F.lit(0)).alias("r_den"))


def majority(votes: DataFrame, key: list[str], choice: str) -> DataFrame:
    """The most frequent choice of each key, null on a tie."""
    counted = votes.where(F.col(choice).isNotNull()).groupBy(*key, choice).agg(F.count("*").alias("n"))
    top = counted.withColumn("_top", F.max("n").over(W.partitionBy(*key))).where("n = _top")
    return top.groupBy(*key).agg(F.when(F.count("*") == 1, F.max(choice)).alias(choice), F.max("n").alias("n"))


def majority_or_least(votes: DataFrame, key: list[str], choice: str) -> DataFrame:
    """The most frequent choice of each key, of equals the least."""
    counted = votes.groupBy(*key, choice).agg(F.count("*").alias("n"))
    best = counted.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("n"), choice)))
    return best.where("_r = 1").select(*key, choice)


def most_common(rows: DataFrame, key: list[str], name: str, place: str) -> DataFrame:
    """The most frequent name of each key; of equals the shorter, then the one seen first."""
    counted = rows.groupBy(*key, name).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    return counted.groupBy(*key).agg(F.max_by(name, F.struct("n", -F.length(name), -F.col("first"))).alias(name))


def accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """correct (boolean) rows: correct, total and their ratio, null of none."""
    return rows.groupBy(*by).agg(F.count_if("correct").alias("correct"), F.count("*").alias("total")).withColumn("accuracy", F.col("correct") / F.nullif(F.col("total"), F.lit(0)))


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def dangling(rows: DataFrame, ref: str, targets: DataFrame, target: str) -> DataFrame:
    """Rows whose reference names nothing; null references are no reference."""
    return rows.where(F.col(ref).isNotNull()).join(targets.select(F.col(target).alias(ref)), ref, "left_anti")


def unique_match(names: DataFrame, known: DataFrame, name: str, ident: str) -> DataFrame:
    """names with the id of the only known entity of that folded name, and how it was found: name, ambiguous or unresolved."""
    folded = known.select(S.fold_spaces(F.col(name)).alias("_f"), ident).distinct().groupBy("_f").agg(F.count("*").alias("_n"), F.min(ident).alias(ident))
    out = names.withColumn("_f", S.fold_spaces(F.col(name))).join(folded, "_f", "left")
    return out.select(*names.columns, F.when(F.col("_n") == 1, F.col(ident)).alias(ident), F.when(F.col("_n") == 1, "name").when(F.col("_n") > 1, "ambiguous_name").otherwise("unresolved").alias("source"))


def claim_classes(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Predicted relations (id, source, predicate, target) by why they are right or wrong: tp, lenient_only, wrong_predicate,
    wrong_endpoint, unresolved or false_positive. Four equality joins on distinct keys; a null end is unresolved."""
    def keyed(df: DataFrame) -> DataFrame:
        c = S.canonical_relation(F.col("source"), F.col("predicate"), F.col("target"))
        return df.withColumn("_c", c).withColumns({"s": F.col("_c.source"), "p": F.col("_c.predicate"), "t": F.col("_c.target")}).drop("_c").withColumn("lp", S.lenient_predicate(F.col("p")))

    p, g = keyed(pred), keyed(gold)
    mark = lambda cols, name: g.select(*cols).distinct().withColumn(name, F.lit(True))
    pair = S.pair_key(F.col("s"), F.col("t"))
    p, g = p.withColumn("pair", pair), g.withColumn("pair", pair)
    out = p.join(mark(["s", "p", "t"], "strict"), ["s", "p", "t"], "left").join(mark(["s", "lp", "t"], "lenient"), ["s", "lp", "t"], "left").join(mark(["pair"], "paired"), "pair", "left")
    ends = g.select("lp", F.explode(F.array("s", "t")).alias("end")).distinct()
    shared = p.select("id", "lp", F.explode(F.array("s", "t")).alias("end")).join(ends, ["lp", "end"], "left_semi").select("id").distinct().withColumn("shared", F.lit(True))
    out = out.join(shared, "id", "left")
    kind = (
        F.when(F.col("source").isNull() | F.col("target").isNull(), "unresolved").when(F.col("strict"), "tp").when(F.col("lenient"), "lenient_only")
        .when(F.col("paired"), "wrong_predicate").when(F.col("shared"), "wrong_endpoint").otherwise("false_positive")
    )
    return out.select("id", kind.alias("class"))
