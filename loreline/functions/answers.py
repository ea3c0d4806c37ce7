"""Checks and shapes of extracted answers: facts, relations, lines that describe an entity, settings. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreline.functions import scalars as S
from loreline.functions import vocabulary as V


def _quoted(text: Column) -> Column:
    """text as a pattern that matches itself."""
    return F.concat(F.lit(r"\Q"), text, F.lit(r"\E"))


def keep_property(name: Column) -> Column:
    """Where synonyms of properties would be mapped; they pass as they are."""
    return name


def keep_predicate(name: Column) -> Column:
    """The same for predicates."""
    return name


def whole_number(value: Column) -> Column:
    """value as an offset where it is a whole number, else null."""
    return F.when(value.cast("string").rlike(r"^-?\d+$"), value.cast("string").cast("long"))


def plausible(prop: Column, value: Column) -> Column:
    """Whether a value can be one of its property: a capitalised rank as title, a number in an age, a capitalised word in an
    origin or a birth place (which may also begin with a determiner); other properties take any value."""
    named = value.rlike(r"(?:^|\s)\p{Lu}")
    rank = value.rlike(r"^\p{Lu}") & F.lower(F.regexp_replace(value, r"\.+$", "")).isin(*V.TITLE_RANKS)
    determined = F.lit(False)
    for d in V.DETERMINERS:
        determined = determined | F.lower(value).startswith(d)
    number = value.rlike(r"(?i)\d|\b(?:" + "|".join(V.NUMBER_WORDS) + ")")
    return F.when(prop == "title", rank).when(prop == "age", number).when(prop == "origin", named).when(prop == "birth_place", named | determined).otherwise(True)


def with_determiner(prop: Column, text: Column, start: Column) -> Column:
    """Where the value of a place property starts if a determiner right in front of it belongs to it."""
    out = start
    for d in reversed(V.DETERMINERS):
        out = F.when(F.lower(F.substring(text, start + 1 - len(d), F.lit(len(d)))).eqNullSafe(F.lit(d)) & (start >= len(d)), start - len(d)).otherwise(out)
    return F.when(prop.isin(*V.PLACE_PROPERTIES), out).otherwise(start)


def named(name: Column, evidence: Column) -> Column:
    """Whether evidence holds the name as whole words, in any case; a pronoun of the first person stands for all of them."""
    own = F.lower(F.trim(name)).isin(*V.FIRST_PERSON)
    whole = F.regexp_like(evidence, F.concat(F.lit(r"(?iU)(?<!\w)"), _quoted(F.trim(name)), F.lit(r"(?!\w)")))
    return F.when(own, evidence.rlike(r"(?iU)(?<!\w)(?:" + "|".join(V.FIRST_PERSON) + r")(?!\w)")).otherwise(whole)


def states_relation(evidence: Column, text: Column, predicate: Column, subject: Column, target: Column) -> Column:
    """Whether evidence is a quote from text that names both ends and has a word that tells of the predicate."""
    cue = F.lit(False)
    for k, words in V.RELATION_CUES.items():
        cue = F.when(predicate == k, evidence.rlike(r"(?iU)(?<!\w)(?:" + "|".join(words) + ")")).otherwise(cue)
    quote = ~S.is_blank(evidence) & F.contains(F.lower(text), F.lower(F.trim(evidence)))
    return F.coalesce(quote & cue & named(subject, evidence) & named(target, evidence), F.lit(False))


def fact_value(prop: Column, value: Column) -> Column:
    """The value to keep: of a colour from its first to its last word for one, else null; null for other values with
    digits, unless the property is free in form."""
    word = r"(?iU)(?<!\w)(?:" + "|".join(V.COLOURS) + r")(?!\w)"
    colour = F.nullif(F.regexp_extract(value, f"{word}(?:.*{word.replace('(?iU)', '')})?", 0), F.lit(""))
    return F.when(prop.isin("hair_color", "eye_color"), colour).when(prop.isin(*V.FREE_PROPERTIES) | ~value.rlike(r"\d"), value)


def relation_options(a: Column, b: Column, a_type: Column, b_type: Column) -> Column:
    """The phrases an answer may choose from: array of phrase, predicate and a_first. With a location only ownership of it."""
    options = []
    for phrase, predicate, a_first in V.RELATION_OPTIONS:
        made = F.concat(*[a if x == "a" else b if x == "b" else F.lit(x) for x in phrase.replace("{", "|").replace("}", "|").split("|") if x])
        owned = b_type if a_first else a_type
        located = (a_type == "location") | (b_type == "location")
        fits = ~located | ((owned == "location") if predicate == "OWNS" else F.lit(False))
        options.append(F.when(fits, F.struct(made.alias("phrase"), F.lit(predicate).alias("predicate"), F.lit(a_first).alias("a_first"))))
    return F.array_compact(F.array(*options))


def chosen_relation(answer: Column, options: Column) -> Column:
    """The first option whose phrase the answer is, in any case; else null."""
    return F.get(F.filter(options, lambda o: F.lower(o["phrase"]) == F.lower(F.trim(answer))), F.lit(0))


def described(name: Column, kind: Column, aliases: Column, facts: Column) -> Column:
    """One line on an entity: name (type), aliases, and facts (array of property and value)."""
    told = F.array_join(F.transform(facts, lambda f: F.concat(F.replace(f["property"], F.lit("_"), F.lit(" ")), F.lit(": "), f["value"])), "; ")
    also = F.when(F.size(aliases) > 0, F.concat(F.lit("also called "), F.array_join(aliases, ", ")))
    return F.concat_ws(" \u2014 ", F.concat(name, F.lit(" ("), kind, F.lit(")")), also, F.when(F.size(facts) > 0, told))


def title_fact(text: Column, start: Column, mention: Column) -> Column:
    """property and value that a title tells: the first word of a longer name, or the capitalised word right before it."""
    first = F.regexp_replace(F.regexp_extract(mention, r"^\S+", 0), r"\.+$", "")
    begin = F.greatest(start - 20, F.lit(0))
    before = F.regexp_extract(F.substring(text, begin + 1, start - begin), r"\b([A-Z][a-z]+)\.?\s+$", 1)
    titles = [*V.TITLE_OCCUPATIONS, *V.TITLE_RANKS]
    word = F.lower(F.when(F.lower(first).isin(*titles) & (first != mention), first).otherwise(before))
    value = F.element_at(S._map(V.TITLE_OCCUPATIONS | V.TITLE_RANKS), word)
    return F.when(word.isin(*titles), F.struct(F.when(word.isin(*V.TITLE_OCCUPATIONS), "occupation").otherwise("title").alias("property"), value.alias("value")))


def profile(stored_name: Column, stored: Column) -> Column:
    """display_name (at most 120 characters) and preferences: the defaults under what is stored (a map)."""
    known = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*V.DEFAULT_PREFERENCES))
    rest = F.map_filter(S._map(V.DEFAULT_PREFERENCES), lambda k, v: ~F.map_contains_key(known, k))
    return F.struct(F.substring(F.trim(F.coalesce(stored_name, F.lit(""))), 1, 120).alias("display_name"), F.map_concat(rest, known).alias("preferences"))


def reply_length_error(wanted: Column) -> Column:
    return F.when(wanted.isNotNull() & ~wanted.isin(*V.REPLY_LENGTHS), "must be short, medium or long")


def layer_scope(layers: Column, name: str, text: Column) -> Column:
    """coverage (none where the layer is missing) and region (null: everything; its end is the text's where it has none) of a
    layer in a map of coverage, start and end."""
    layer = F.try_element_at(layers, F.lit(name))
    region = F.when(layer["start"].isNotNull(), F.struct(layer["start"].alias("start"), F.coalesce(layer["end"], F.length(text)).alias("end")))
    return F.struct(F.coalesce(layer["coverage"], F.lit("none")).alias("coverage"), region.alias("region"))


def request_key(*parts: Column) -> Column:
    """Address of a request by its content: SHA-256 of its parts as JSON."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)
