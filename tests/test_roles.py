"""Role nouns on parses that are written down, and against one walk over each document."""

import random

from loreline.operators import roles

TOKENS = "doc_id string, token_id int, word string, tag string, pos string, rel string, head int, start int, end int"
MENTIONS = "doc_id string, mention_id string, start int, end int"
CLUSTERS = "doc_id string, cluster_id string, mention_id string"


def parse(doc, text):
    """'word/tag/pos/rel/head' a token, heads by number; words stand one space apart."""
    rows, at = [], 0
    for n, t in enumerate(text.split()):
        word, tag, pos, rel, head = t.split("/")
        rows.append((doc, n, word, tag, pos, rel, int(head), at, at + len(word)))
        at += len(word) + 1
    return rows


def found_in(spark, tokens, mentions, clusters=()):
    t = spark.createDataFrame(tokens, TOKENS)
    m, c = spark.createDataFrame(list(mentions), MENTIONS), spark.createDataFrame(list(clusters), CLUSTERS)
    return roles.role_pairs(t, m, c).persist(), c


def test_holders(spark):
    tokens = parse("said", "Tom/NNP/PROPN/nsubj/1 is/V/AUX/ROOT/1 her/P/PRON/poss/3 brother/NN/NOUN/attr/1")
    tokens += parse("nobody", "It/P/PRON/nsubj/1 was/V/AUX/ROOT/1 my/P/PRON/poss/3 boss/NN/NOUN/attr/1")
    tokens += parse("below", "Mara/NNP/PROPN/poss/1 brother/NN/NOUN/nsubj/3 Tobias/NNP/PROPN/appos/1 left/V/VERB/ROOT/3")
    tokens += parse("above", "Tobias/NNP/PROPN/nsubj/3 Mara/NNP/PROPN/poss/2 brother/NN/NOUN/appos/0 left/V/VERB/ROOT/3")
    tokens += parse("own", "my/P/PRON/poss/1 Friends/NNS/NOUN/nsubj/2 left/V/VERB/ROOT/2")
    tokens += parse("none", "the/D/DET/poss/1 mother/NN/NOUN/ROOT/1 boss/NN/NOUN/ROOT/2")
    mentions = [("said", "M1", 0, 3), ("said", "M2", 7, 10), ("nobody", "M1", 0, 2), ("nobody", "M4", 7, 9), ("below", "M1", 0, 4), ("below", "M2", 13, 19), ("above", "M1", 0, 6), ("above", "M2", 7, 11), ("own", "M1", 0, 2), ("own", "M2", 3, 10), ("own", "M3", 0, 10)]
    found, _ = found_in(spark, tokens, mentions)
    got = {r.doc_id: (r.subject, r.predicate, r.object, r.mention_id, r.start, r.end) for r in found.collect()}
    assert got == {
        "said": ("M2", "SIBLING_OF", "M1", None, None, None), "nobody": ("M4", "WORKS_FOR", "M5", "M5", 10, 14), "below": ("M1", "SIBLING_OF", "M2", None, None, None),
        "above": ("M2", "SIBLING_OF", "M1", None, None, None), "own": ("M1", "FRIEND_OF", "M2", None, None, None),
    }


def test_new_mentions_and_their_clusters(spark):
    """Dan's mother's boss: the possessor of the second noun is the mention that the first one brings in."""
    text = "Dan/NNP/PROPN/poss/1 mother/NN/NOUN/poss/2 boss/NN/NOUN/nsubj/3 left/V/VERB/ROOT/3 his/P/PRON/poss/5 mother/NN/NOUN/dobj/3"
    tokens = parse("d", text)
    found, clusters = found_in(spark, tokens, [("d", "M1", 0, 3), ("d", "M7", 21, 24)], [("d", "C3", "M1"), ("d", "C3", "M7")])
    assert sorted((r.place, r.subject, r.predicate, r.object, r.start, r.end, r.owner) for r in found.collect()) == [(1, "M8", "PARENT_OF", "M1", 0, 10, "C3"), (2, "M8", "WORKS_FOR", "M9", 11, 15, "M8"), (5, "M10", "PARENT_OF", "M7", 25, 31, "C3")]
    texts = spark.createDataFrame([("d", " ".join(t.split("/")[0] for t in text.split()))], "doc_id string, text string")
    assert sorted((r.mention_id, r.text) for r in roles.role_mentions(found, texts).collect()) == [("M10", "mother"), ("M8", "Dan mother"), ("M9", "boss")]
    assert sorted((r.cluster_id, r.mention_id) for r in roles.role_clusters(found, clusters).collect()) == [("C4", "M10"), ("C4", "M8")]


def by_one_walk(tokens, mentions):
    """The same by one walk in order over a document, with all mentions so far before it."""
    table = {w: (p, f) for p, f, ws in roles.ROLES for w in ws.split()}
    ms, out = [(int(i[1:]), a, b) for _, i, a, b in mentions], []

    def smallest(t, but=None):
        inside = [(b - a, n >= 1000, a if n < 1000 else n, n) for n, a, b in ms if a <= t[7] and t[8] <= b and not (but is not None and a <= but[7] < b)]
        return min(inside)[-1] if inside else None

    for t in tokens:
        kid = lambda over, rel: next((k for k in tokens if k[6] == over and k[5] == rel), None)  # noqa: B023, E731
        poss = kid(t[1], "poss") if t[2] in table else None
        owner = smallest(poss) if poss else None
        if owner is None:
            continue
        subject = kid(t[6], "nsubj") if t[5] == "attr" else None
        appos = kid(t[1], "appos") or (tokens[t[6]] if t[5] == "appos" else None)
        holder = (smallest(subject) if subject else None) or (smallest(appos) if appos else None) or smallest(t, poss)
        if holder is None:
            holder = 1000 + sum(n >= 1000 for n, _, _ in ms)
            ms.append((holder, poss[7] if poss[4] == "PROPN" else t[7], t[8]))
        pred, first = table[t[2]]
        out.append((t[0], t[1], pred, *((owner, holder) if first else (holder, owner))))
    return out


def test_random_parses(spark):
    rng = random.Random(5)
    tokens, mentions, want = [], [], []
    for d in range(120):
        n = rng.randint(5, 30)
        doc = [(f"d{d}", i, rng.choice(["mother", "boss", "brother", "Ann", "sat"]), "NN", rng.choice(["PROPN", "NOUN"]), rng.choice(["poss", "poss", "nsubj", "appos", "attr", "dobj"]), min(n - 1, max(0, i + rng.choice([-2, -1, 1, 1, 2]))), 5 * i, 5 * i + 4) for i in range(n)]
        spans = sorted({(5 * a, 5 * min(n, a + rng.randint(1, 3)) - 1) for a in rng.sample(range(n), n // 3)})
        own = [(f"d{d}", f"M{999 - len(spans) + k + 1}", a, b) for k, (a, b) in enumerate(spans)]
        tokens, mentions, want = tokens + doc, mentions + own, want + by_one_walk(doc, own)
    found, _ = found_in(spark, tokens, mentions)
    got = [(r.doc_id, r.place, r.predicate, int(r.subject[1:]), int(r.object[1:])) for r in found.collect()]
    assert len(want) > 200 and any(max(r[3:]) > 1000 for r in want) and sorted(got) == sorted(want)


def test_empty(spark):
    found, clusters = found_in(spark, [], [])
    assert found.count() == 0 and roles.role_clusters(found, clusters).count() == 0
