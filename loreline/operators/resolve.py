"""Which stored entity a name of a new chapter means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreline.functions import scalars as S


def _folded(name: Column) -> Column:
    return F.lower(F.trim(name))


def known_names(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """entity_id, entity_type, name of every canonical name and alias; entities: id, canonical_name, entity_type."""
    base = entities.select(F.col("id").alias("entity_id"), "entity_type", F.col("canonical_name").alias("name"), F.lit(0).alias("order"))
    more = aliases.select("entity_id", F.col("alias").alias("name")).join(entities.select(F.col("id").alias("entity_id"), "entity_type"), "entity_id")
    return base.unionByName(more.select("entity_id", "entity_type", "name", F.lit(1).alias("order")))


def _support(title: Column, evidence: Column) -> Column:
    """Genders that the forms speak for, from titles (arrays) and evidence values; 'unknown' evidence takes all support away."""
    return F.when(F.exists(evidence, lambda g: g == "unknown"), F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(F.concat(title, evidence), lambda g: g.isin("m", "f"))))


def resolve(incoming: DataFrame, entities: DataFrame, aliases: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """mention_id, entity_id and how it was found, for incoming (mention_id, names array<string>, entity_type).

    In this order: owned: a role with an owner ('X's wife') by its exact name or the spouse it implies; exact: a proper name
    that equals a canonical name, else an alias; implied: the one stored role whose spouse the name is; part: the one entity of the
    type that shares a short or full form, unless titles or gender speak against it. Role words never match. Ambiguous
    names match nothing. evidence: name, gender ('m', 'f' or 'unknown') seen in this chapter; it can veto a match by
    title and surname but never choose one. Word overlap is found by an equality join on words, never by all pairs.
    """
    kinds = dict(incoming.dtypes)
    if evidence is None:
        evidence = incoming.sparkSession.createDataFrame([], "name string, gender string")
    clues = evidence.select(_folded(F.col("name")).alias("f"), F.coalesce("gender", F.lit("unknown")).alias("clue")).groupBy("f").agg(F.collect_set("clue").alias("clues"))
    names = incoming.select("mention_id", "entity_type", F.posexplode("names").alias("place", "name"))
    known = known_names(entities, aliases)
    by_name = known.select(_folded(F.col("name")).alias("f"), F.col("order"), "entity_id").groupBy("f").agg(F.min_by("entity_id", F.struct("order", "entity_id")).alias("entity_id"))

    def first(rows: DataFrame, how: str) -> DataFrame:
        return rows.groupBy("mention_id").agg(F.min_by("entity_id", "rank").alias("entity_id")).withColumn("how", F.lit(how))

    owned = names.where(F.col("name").contains("'s ") & F.substring("name", 1, 1).rlike(r"^\p{Lu}"))
    direct = owned.withColumn("f", _folded(F.col("name"))).join(by_name, "f").select("mention_id", "entity_id", (F.col("place") * 2).alias("rank"))
    spouse = owned.withColumn("f", _folded(S.spouse_name(F.col("name")))).join(by_name, "f").select("mention_id", "entity_id", (F.col("place") * 2 + 1).alias("rank"))
    found_owned = first(direct.unionByName(spouse), "owned")

    proper = names.where(S.is_proper_name(F.col("name")))
    exact = first(proper.withColumn("f", _folded(F.col("name"))).join(by_name, "f").select("mention_id", "entity_id", F.col("place").alias("rank")), "exact")

    def only(rows: DataFrame, how: str) -> DataFrame:
        return rows.select("mention_id", "entity_id").distinct().groupBy("mention_id").agg(F.count("*").alias("n"), F.min("entity_id").alias("entity_id")).where("n = 1").select("mention_id", "entity_id", F.lit(how).alias("how"))

    typed = F.col("entity_type").isNull() | (F.col("entity_type") == F.col("k_type"))
    spouses = known.select("entity_id", F.col("entity_type").alias("k_type"), S.spouse_name(F.col("name")).alias("name")).where("name IS NOT NULL")
    implied = only(proper.join(spouses, "name").where(typed), "implied")

    own = proper.withColumns({"words": S.name_words(F.col("name")), "gender": S.title_gender(F.col("name"))})
    theirs = known.where(S.is_proper_name(F.col("name"))).select("entity_id", F.col("entity_type").alias("k_type"), F.col("name").alias("k_name"), S.name_words(F.col("name")).alias("k_words"))
    a, b = own.withColumn("word", F.explode("words")), theirs.withColumn("word", F.explode("k_words"))
    met = a.join(b, "word").groupBy("mention_id", "entity_type", "name", "words", "gender", "entity_id", "k_type", "k_name", "k_words").agg(F.count("*").alias("n"))
    within = met.where(typed & ((F.col("n") == F.size("words")) | (F.col("n") == F.size("k_words"))))
    genders = own.where("gender IS NOT NULL").groupBy("mention_id").agg(F.collect_set("gender").alias("genders"))
    titles = entities.select(F.col("id").alias("entity_id"), S.title_gender(F.col("canonical_name")).alias("k_gender"))
    fits = within.join(genders, "mention_id", "left").join(titles, "entity_id").where(F.col("genders").isNull() | F.col("k_gender").isNull() | F.array_contains("genders", F.col("k_gender")))
    single = only(fits, "part")

    def forms(rows: DataFrame, key: str) -> DataFrame:
        rows = rows.withColumn("f", _folded(F.col("name"))).join(clues, "f", "left")
        title = S.title_gender(F.col("name"))
        surname = S.is_proper_name(F.col("name")) & title.isNotNull() & (F.size(S.name_words(F.col("name"))) == 1)
        out = rows.groupBy(key).agg(
            F.max(surname).alias("titled"), F.collect_set(F.when(~F.col("name").contains("'s "), title)).alias("t"), F.flatten(F.collect_list(F.coalesce("clues", F.array().cast("array<string>")))).alias("c")
        )
        return out.select(key, "titled", _support(F.col("t"), F.col("c")).alias("support"))

    mine = forms(proper, "mention_id")
    yours = forms(known, "entity_id").withColumnsRenamed({"titled": "k_titled", "support": "k_support"})
    types = entities.select(F.col("id").alias("entity_id"), F.col("entity_type").alias("k_type"))
    judged = single.join(mine, "mention_id").join(yours, "entity_id").join(types, "entity_id").join(incoming.select("mention_id", "entity_type"), "mention_id")
    same = (F.size("support") == 1) & (F.array_sort("support") == F.array_sort("k_support"))
    good = (F.col("k_type") != "character") | ~(F.col("titled") | F.col("k_titled")) | F.when(F.col("titled"), same).otherwise(F.col("entity_type").isNull())
    part = judged.where(good).select("mention_id", "entity_id", "how")

    ranked = None
    for tier, rows in enumerate((found_owned, exact, implied, part)):
        rows = rows.select("mention_id", "entity_id", "how", F.lit(tier).alias("tier"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    best = ranked.groupBy("mention_id").agg(F.min_by(F.struct("entity_id", "how"), "tier").alias("b"))
    assert kinds["names"] == "array<string>"
    return incoming.select("mention_id").join(best, "mention_id", "left").select("mention_id", "b.entity_id", F.coalesce("b.how", F.lit("new")).alias("how"))


def renames(resolved: DataFrame, incoming: DataFrame, entities: DataFrame) -> DataFrame:
    """entity_id, canonical_name and the old name as alias, of role-named entities that a proper name has now reached."""
    name = F.filter("names", S.is_proper_name)[0]
    rows = incoming.select("mention_id", name.alias("name")).where("name IS NOT NULL").join(resolved, "mention_id").where("entity_id IS NOT NULL")
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy("entity_id").orderBy("mention_id"))).where("_r = 1")
    old = entities.where(~S.is_proper_name(F.col("canonical_name"))).select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("alias"))
    return first.join(old, "entity_id").select("entity_id", F.col("name").alias("canonical_name"), "alias")
