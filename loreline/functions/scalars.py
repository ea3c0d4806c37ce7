"""Scalar functions as Column expressions. Null in gives null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreline.functions import vocabulary as V

Col = Column


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


# ---- folding of names


def normalize_property(name: Col) -> Col:
    """Lower case, runs of anything but a-z and 0-9 become one underscore, none at the ends; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "[^a-z0-9]+", "_"), F.lit("_"))


def normalize_predicate(name: Col) -> Col:
    return F.trim(F.regexp_replace(F.upper(F.trim(F.coalesce(name, F.lit("")))), "[^A-Z0-9]+", "_"), F.lit("_"))


def property_kind(name: Col) -> Col:
    p = normalize_property(name)
    return F.when(p.isin(*V.IMMUTABLE_PROPERTIES), "immutable").when(p.isin(*V.MUTABLE_PROPERTIES), "mutable").otherwise("unknown")


def values_equal(a: Col, b: Col) -> Col:
    """Same text but for case and outer white space; two nulls are equal, a null and a value are not."""
    return F.lower(F.trim(a)).eqNullSafe(F.lower(F.trim(b)))


def is_blank(value: Col) -> Col:
    return value.isNull() | (F.trim(value) == "")


def fold_spaces(text: Col) -> Col:
    """Case folded (by lower), white space runs to one space."""
    return F.lower(F.regexp_replace(F.trim(text), r"(?U)\s+", " "))


def slug(name: Col) -> Col:
    return normalize_property(name)


# ---- ages and states


def parse_age(value: Col) -> Col:
    """Whole number 0 to 150 from digits or English words up to ninety-nine, with or without 'years old'; else null."""
    text = F.lower(F.trim(value))
    digits = F.regexp_extract(text, r"^(\d{1,3})\s*(?:years?(?:\s*old)?)?$", 1)
    words = F.regexp_extract(text, r"^([a-z]+)(?:[\s-]+([a-z]+))?\s*(?:years?(?:\s*old)?)?$", 0)
    core = F.regexp_replace(words, r"\s*\byears?(?:\s*old)?$", "")
    first, second = F.regexp_extract(core, r"^([a-z]+)", 1), F.regexp_extract(core, r"^[a-z]+[\s-]+([a-z]+)$", 1)
    units = _map({w: i for i, w in enumerate(V.UNITS)})
    tens = _map({w: 10 * i for i, w in enumerate(V.TENS, 2)})
    unit = F.element_at(units, second)
    spoken = F.when(second == "", F.coalesce(F.element_at(units, first), F.element_at(tens, first))).when(unit.between(1, 9), F.element_at(tens, first) + unit)
    age = F.when(digits != "", digits.try_cast("int")).when(words != "", spoken)
    return F.when(age.between(0, 150), age)


def age_of_number(value: Col) -> Col:
    """The number itself if whole and 0 to 150, else null."""
    return F.when((value == F.floor(value)) & value.between(0, 150), F.floor(value).cast("int"))


def life_state(value: Col) -> Col:
    v = F.lower(F.trim(value))
    return F.when(v.isin(*V.DEAD_VALUES), "DEAD").when(v.isin(*V.ALIVE_VALUES), "ALIVE")


# ---- names


def without_titles(name: Col) -> Col:
    """Leading titles dropped, with or without a period; a name that is all title keeps its last word."""
    titles = "|".join(V.TITLES)
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"\s+", " "), rf"^(?i:(?:{titles})\.* )+(?=\S)", "")


def name_words(name: Col) -> Col:
    return F.array_sort(F.array_distinct(F.split(F.lower(without_titles(name)), " ")))


def is_proper_name(name: Col) -> Col:
    """Every word capitalised or a connector, none in the genitive."""
    words = F.split(without_titles(name), " ")
    capital = lambda w: F.substring(w, 1, 1).rlike(r"^\p{Lu}")
    return (F.trim(name) != "") & F.forall(words, lambda w: (capital(w) | F.lower(w).isin(*V.NAME_CONNECTORS)) & ~w.rlike("['’]s$"))


def title_gender(name: Col) -> Col:
    first = F.lower(F.regexp_replace(F.element_at(F.split(F.trim(name), r"\s+"), 1), r"\.+$", ""))
    return F.element_at(_map(V.GENDERED_TITLES), first)


def spouse_name(name: Col) -> Col:
    """The name that a spouse role implies: Mr. X's wife or lady is Mrs. X, Mrs. X's husband Mr. X."""
    owner, role = F.substring_index(name, "'s ", 1), F.lower(F.trim(F.regexp_extract(name, r"(?s)'s (.*)$", 1)))
    words = F.split(F.trim(owner), r"\s+")
    title = F.lower(F.regexp_replace(words[0], r"\.+$", ""))
    other = F.when((title == "mr") & role.isin("wife", "lady"), "Mrs.").when((title == "mrs") & (role == "husband"), "Mr.")
    fits = name.contains("'s ") & (F.size(words) > 1) & other.isNotNull()
    return F.when(fits, F.concat(other, F.lit(" "), F.element_at(words, -1)))


def name_key(name: Col) -> Col:
    """For comparison: without article and titles, lower case."""
    return F.lower(without_titles(F.regexp_replace(F.trim(name), r"^(?i:the|a|an) ", "")))


def search_names(canonical: Col, aliases: Col) -> Col:
    """All ways to write an entity, with and without titles, longest first, then by text."""
    every = F.array_union(F.array(canonical), F.coalesce(aliases, F.array().cast("array<string>")))
    both = F.array_distinct(F.array_union(every, F.transform(every, without_titles)))
    keyed = F.array_sort(F.transform(both, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n"))))
    return F.transform(keyed, lambda s: s["n"])


def contains_either_way(a: Col, b: Col) -> Col:
    return F.contains(a, b) | F.contains(b, a)


def mention_kind(surface: Col) -> Col:
    return F.when(F.lower(surface).isin(*V.PRONOUNS), "pronominal").when(F.substring(surface, 1, 1).rlike(r"^\p{Lu}"), "proper").otherwise("nominal")


def bare_role(name: Col) -> Col:
    """A single lower-case word, or one after an article or possessive."""
    return name.rlike(r"^(?:(?:the|a|an|my|his|her|their|our|your) )?[a-z]+$")


def plural_role(name: Col) -> Col:
    return bare_role(name) & name.rlike(r"(?<!s)s$")


def without_determiner(name: Col) -> Col:
    """A noun without the determiner in front of it."""
    return F.regexp_replace(F.trim(name), rf"^(?i:{'|'.join(V.ROLE_DETERMINERS)})\s+(?=\S)", "")


def names_several(name: Col) -> Col:
    """Whether the last word is a plural: irregular, or in s but not ss, us or is."""
    last = F.lower(F.element_at(F.split(F.trim(name), r"\s+"), -1))
    return last.isin(*V.IRREGULAR_PLURALS) | last.rlike("(?<![sui])s$")


def group_gender(role_m: Col, role_f: Col, pronoun_m: Col, pronoun_f: Col) -> Col:
    """Role words decide from one on, pronouns from two on; the winner needs twice the other."""
    def won(m: Col, f: Col, least: int) -> Col:
        return F.when((m >= least) & (m >= 2 * f), "m").when((f >= least) & (f >= 2 * m), "f")

    return F.when(role_m + role_f > 0, won(role_m, role_f, 1)).otherwise(won(pronoun_m, pronoun_f, 2))


# ---- relations and facts as keys


def is_symmetric(predicate: Col) -> Col:
    return predicate.isin(*V.SYMMETRIC_PREDICATES)


def is_negative(predicate: Col) -> Col:
    return predicate.isin(*V.NEGATIVE_PREDICATES)


def canonical_relation(subject: Col, predicate: Col, obj: Col) -> Col:
    """Struct of source, predicate, target: CHILD_OF turned to PARENT_OF, ends of symmetric predicates in order."""
    turned = predicate == "CHILD_OF"
    swap = turned | (is_symmetric(predicate) & (obj < subject))
    return F.struct(F.when(swap, obj).otherwise(subject).alias("source"), F.when(turned, "PARENT_OF").otherwise(predicate).alias("predicate"), F.when(swap, subject).otherwise(obj).alias("target"))


def lenient_predicate(predicate: Col) -> Col:
    return F.when(predicate.isin("FATHER_OF", "MOTHER_OF"), "PARENT_OF").otherwise(predicate)


def parent_predicate(predicate: Col, gender: Col) -> Col:
    return F.when((predicate == "PARENT_OF") & (gender == "m"), "FATHER_OF").when((predicate == "PARENT_OF") & (gender == "f"), "MOTHER_OF").otherwise(predicate)


def fact_keys(prop: Col, value: Col, state: Col, age: Col) -> Col:
    """All keys under which a fact counts as the same: its folded value, its life state, its age in years."""
    keys = F.array(F.concat_ws("|", prop, F.coalesce(state, fold_spaces(value))), F.when(age.isNotNull(), F.concat_ws("|", prop, F.concat(F.lit("age:"), age))))
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))


def pair_key(a: Col, b: Col) -> Col:
    return F.concat_ws("|", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def answer_value(answer: Col) -> Col:
    """The answer with white space collapsed and punctuation off its ends, null for words that say there is none."""
    a = F.regexp_replace(F.regexp_replace(answer, r"(?U)\s+", " "), "^[ .,;:]+|[ .,;:]+$", "")
    return F.when(~F.lower(a).isin(*V.NONE_WORDS), a)


def stored_explanation(rule: Col, text: Col) -> Col:
    return F.concat(F.lit("["), rule, F.lit("] "), text)


def rule_of_explanation(text: Col) -> Col:
    return F.nullif(F.regexp_extract(text, r"^\[([A-Z_]+)\] ", 1), F.lit(""))


def severity(confidence: Col) -> Col:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.6, "medium").otherwise("low")


# ---- spans


def span_problem(text: Col, start: Col, end: Col, surface: Col) -> Col:
    """outside, differs or cuts a word; null for a sound span (half-open code-point offsets)."""
    inner = F.substring(text, start + 1, end - start)
    word = lambda c: c.rlike(r"^[\p{L}\p{N}]$")
    left = word(F.substring(text, start, F.lit(1))) & word(F.substring(inner, 1, 1)) & (start > 0)
    right = word(F.substring(text, end + 1, F.lit(1))) & word(F.substring(inner, -1, 1))
    return F.when((start < 0) | (end > F.length(text)) | (start >= end), "outside").when(inner != surface, "differs").when(left | right, "cuts a word")


def trimmed_span(text: Col, start: Col, end: Col) -> Col:
    """Struct of start and end without outer white space; an all-blank span collapses to its end."""
    inner = F.substring(text, start + 1, end - start)
    lead = F.length(inner) - F.length(F.ltrim(inner))
    tail = F.length(inner) - F.length(F.rtrim(inner))
    return F.struct(F.least(start + lead, end).alias("start"), F.greatest(end - tail, F.least(start + lead, end)).alias("end"))


def in_region(start: Col, end: Col, region_start: Col, region_end: Col) -> Col:
    """A null region holds everything."""
    return region_start.isNull() | ((start >= region_start) & (end <= region_end))


def line_number(text: Col, offset: Col) -> Col:
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def word_count(text: Col) -> Col:
    """Words between white space; blank or null is 0."""
    return F.when(is_blank(text), 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")))


def fold_edition(text: Col) -> Col:
    """Typographic quotes of an edition to plain ones."""
    return F.translate(text, *V.EDITION_QUOTES)


def content_hash(text: Col) -> Col:
    return F.sha2(text, 256)


def find_whole_word(text: Col, needle: Col) -> Col:
    """Offset of the first whole-word occurrence, any case; null if there is none."""
    quoted = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), needle, F.lit(r"\E(?!\w)"))
    at = F.regexp_instr(text, quoted)
    return F.when(at > 0, at - 1)


# ---- ratios


def rates_zero(tp: Col, fp: Col, fn: Col) -> list[Col]:
    """precision, recall and f1 with 0 where a denominator is 0."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def rates_covered(tp: Col, p_tp: Col, fp: Col, fn: Col, coverage: Col) -> list[Col]:
    """precision only under exhaustive coverage with predictions, recall only with gold, f1 where both can be measured."""
    p = F.when((coverage == "exhaustive") & (p_tp + fp > 0), p_tp / (p_tp + fp))
    r = F.when((coverage != "none") & (tp + fn > 0), tp / (tp + fn))
    f = F.when((coverage == "exhaustive") & (tp + fp + fn > 0), 2 * F.coalesce(p, F.lit(0.0)) * F.coalesce(r, F.lit(0.0)) / F.nullif(F.coalesce(p, F.lit(0.0)) + F.coalesce(r, F.lit(0.0)), F.lit(0.0)))
    return [p.alias("precision"), r.alias("recall"), F.when((coverage == "exhaustive") & (tp + fp + fn > 0), F.coalesce(f, F.lit(0.0))).alias("f1")]
