"""Windows of closed questions, answers copied from them, and raw answers, on a text that is written down."""

from loreline.operators import closed

TEXT = ["Anna met  the Old Cook.", "She had (grey) eyes.", "Ben, a miller, left.", "Anna wept.", "Nobody spoke."]


def tables(spark):
    starts = [sum(len(t) + 1 for t in TEXT[:n]) for n in range(len(TEXT))]
    sentences = spark.createDataFrame([("d", n, s, s + len(t), t) for n, (s, t) in enumerate(zip(starts, TEXT, strict=True))], "doc string, sentence int, start int, end int, text string")
    chunks = spark.createDataFrame([("d", 0, 0, starts[3]), ("d", 1, starts[3], starts[4] + len(TEXT[4]))], "doc string, chunk int, start int, end int")
    # the last mention of anna stands between two sentences and counts in the later one
    rows = [("anna", "Anna", "character", "proper", 0), ("anna", "She", "character", "pronominal", starts[1]), ("anna", "Anna", "character", "proper", starts[3]), ("anna", "Ann", "location", "proper", starts[4] - 1)]
    rows += [("cook", "the  Old Cook", "character", "nominal", 10), ("ben", "Ben", "character", "proper", starts[2]), ("mill", "mill", "location", "nominal", starts[2] + 7), ("he", "he", "character", "pronominal", starts[2])]
    mentions = spark.createDataFrame([("d", *r) for r in rows], "doc string, entity string, text string, type string, kind string, start int")
    return starts, mentions, sentences, chunks


def test_windows_and_answers(spark):
    starts, mentions, sentences, chunks = tables(spark)
    assert {(r.entity, r.name, r.type) for r in closed.names(mentions).collect()} == {("anna", "Anna", "character"), ("cook", "the Old Cook", "character"), ("ben", "Ben", "character"), ("mill", "mill", "location")}
    windows = closed.fact_windows(mentions, sentences, chunks)
    assert {(r.chunk, r.entity): r.context for r in windows.collect()} == {(0, "anna"): "\n".join(TEXT[:2]), (0, "cook"): TEXT[0], (0, "ben"): TEXT[2], (1, "anna"): "\n".join(TEXT[3:])}
    asked = [(0, "anna", "(GREY) eyes."), (0, "anna", " Not  stated; "), (0, "anna", "the old cook"), (0, "anna", "miller"), (0, "cook", "grey"), (0, "ben", "a miller"), (1, "cook", "Anna"), (1, "anna", None)]
    answers = spark.createDataFrame([("d", c, e, str(n), v) for n, (c, e, v) in enumerate(asked)], "doc string, chunk int, entity string, property string, value string")
    got = {int(r.property): (r.result, r.value, r.start, r.sentence) for r in closed.checked_values(answers, windows).collect()}
    assert got == {
        0: ("kept", "(grey) eyes", starts[1] + 8, 1), 1: ("none", None, None, None), 2: ("kept", "the Old Cook", 10, 0), 3: ("invalid", "miller", None, None),
        4: ("invalid", "grey", None, None), 5: ("kept", "a miller", starts[2] + 5, 2), 6: ("invalid", "Anna", None, None), 7: ("none", None, None, None),
    }


def test_pairs(spark):
    """a and b share 0 and 5, so 0 and 1, 4 and 5 give no pair of sentences; b is in 2 and a in 3. c is next to a in many."""
    places = spark.createDataFrame([("d", e, n) for e, ns in {"a": (0, 1, 3, 5, 20, 22, 24, 26, 28), "b": (0, 2, 4, 5), "c": (21, 23, 25, 27)}.items() for n in ns], "doc string, entity string, sentence int")
    rows = lambda most: sorted((r.a, r.b, r.low, r.high) for r in closed.pair_windows(places, most).collect())
    assert [r[2:] for r in rows(None) if r[:2] == ("a", "b")] == [(0, 0), (1, 2), (2, 3), (3, 4), (5, 5)]
    assert len([r for r in rows(None) if r[1] == "c"]) == 8 and [r[2] for r in rows(6) if r[1] == "c"] == [20, 21, 22, 23, 24, 25]


def test_attribution(spark):
    starts, mentions, _, chunks = tables(spark)
    known = spark.createDataFrame([("d", "anna", "Anna"), ("d", "anna", "Miss A"), ("d", "cook", "Cook"), ("d", "ben", "Ben")], "doc string, entity string, name string")
    facts = spark.createDataFrame([("d", n, e, "trait", v, starts[s]) for n, (e, v, s) in enumerate([("anna", "grey  eyes", 1), ("ben", "miller", 2), ("cook", "old", 0), ("anna", "sad", 3)])], "doc string, id int, entity string, property string, value string, at int")
    raw = spark.createDataFrame([("d", 0, n, p, v) for n, p, v in [("anna", "trait", "Grey eyes, tall"), ("Anna", "trait", "MILLER"), ("the old cook", "age", "old"), ("Anna", "trait", "sad"), ("Anna", "trait", ""), (None, "trait", None)]], "doc string, chunk int, name string, property string, value string")
    assert {r.id: r.raw for r in closed.fact_attribution(facts, raw, known, mentions, chunks).collect()} == {0: "raw_value_right_entity", 1: "raw_value_wrong_entity", 2: "raw_none", 3: "raw_none"}
    relations = spark.createDataFrame([("d", n, a, p, b, starts[0]) for n, (a, p, b) in enumerate([("anna", "FATHER_OF", "cook"), ("ben", "KNOWS", "anna"), ("ben", "KNOWS", "cook")])], "doc string, id int, subject string, predicate string, object string, at int")
    said = spark.createDataFrame([("d", 0, s, p, o) for s, p, o in [("The Old Cook", "knows", "Anna"), ("Cook", "child_of", "anna"), ("ben", "enemy_of", "Anna"), (None, "knows", "Ben")]], "doc string, chunk int, subject string, relation string, object string")
    assert {r.id: r.raw for r in closed.relation_attribution(relations, said, known, mentions, chunks).collect()} == {0: "raw_match", 1: "raw_other_relation", 2: "raw_none"}
