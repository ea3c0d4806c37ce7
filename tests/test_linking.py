"""Clusters linked in rounds against one walk over each document."""

import random
from collections import Counter

from loreline.operators import linking

SPANS = "doc_id int, cluster int, place int, start int, end int, kind string, text string"


def align(pred, gold):
    """Largest overlap first; ties by gold start, predicted start and ids."""
    pairs = sorted((max(a, c) - min(b, d), c, a, i, j) for i, (a, b) in pred.items() for j, (c, d) in gold.items() if min(b, d) > max(a, c))
    used, out = set(), {}
    for _, _, _, i, j in pairs:
        if i not in out and j not in used:
            used.add(j)
            out[i] = j
    return out


def walk(clusters, mentions):
    """clusters: lists of (start, end, kind, text); mentions: id to (start, end, type)."""
    to = align({(i, p): s[:2] for i, c in enumerate(clusters) for p, s in enumerate(c)}, {m: x[:2] for m, x in mentions.items()})
    taken, new, members = [], [], []
    for i, spans in enumerate(clusters):
        own = [to[i, p] for p in range(len(spans)) if (i, p) in to]
        types = Counter(mentions[m][2] for m in own)
        fresh = []
        for p, s in enumerate(spans):
            if (i, p) in to or s[:2] in taken or s in fresh:
                continue
            clear = types and not any(a < s[1] and s[0] < b for a, b, *_ in [*mentions.values(), *[(*t,) for t in taken]])
            if s[2] == "pronominal" or (s[2] == "proper" and clear):
                fresh.append(s)
        kind = types.most_common(1)[0][0] if types else "character" if any(s[3].lower() in linking.PERSONAL for s in fresh) else None
        if kind is None or len(own) + len(fresh) < 2:
            continue
        for s in fresh:
            taken.append(s[:2])
            new.append((f"M{len(mentions) + len(new) + 1}", s[0], s[1], kind, s[2], s[3]))
            own.append(new[-1][0])
        members.append((f"C{len(members) + 1}", own))
    return new, members


def test_links_like_a_walk(spark):
    rng = random.Random(12)
    rows, known, want = [], [], {}
    for d in range(40):
        mentions, at = {}, 0
        for n in range(rng.randrange(7)):
            at += rng.randrange(1, 6)
            mentions[f"M{n + 1}"] = (at, at + rng.randrange(1, 4), rng.choice(["character", "location"]))
            at = mentions[f"M{n + 1}"][1]
        clusters = []
        for _ in range(rng.randrange(6)):
            spans, text = [], {}
            for _ in range(rng.randrange(1, 5)):
                a = rng.randrange(30)
                b = a + rng.randrange(1, 4)
                kind = ["pronominal", "proper", "nominal"][(a * 7 + b) % 3]
                text[a, b] = (a, b, kind, "She" if (a + b) % 2 else "it")
                if text[a, b] not in spans:
                    spans.append(text[a, b])
            clusters.append(spans)
        rows += [(d, i, p, *s) for i, c in enumerate(clusters) for p, s in enumerate(c)]
        known += [(d, m, *x) for m, x in mentions.items()]
        want[d] = walk(clusters, mentions)
    new, members = linking.link(spark.createDataFrame(rows, SPANS).repartition(3), spark.createDataFrame(known, "doc_id int, mention_id string, start int, end int, type string"))
    got_new, got = {}, {}
    for r in new.collect():
        got_new.setdefault(r.doc_id, []).append((r.mention_id, r.start, r.end, r.type, r.kind, r.text))
    for r in sorted(members.collect(), key=lambda r: (r.doc_id, int(r.cluster_id[1:]), r.place)):
        got.setdefault(r.doc_id, {}).setdefault(r.cluster_id, []).append(r.mention_id)
    for d, (n, m) in want.items():
        assert sorted(got_new.get(d, [])) == sorted(n), d
        assert list(got.get(d, {}).items()) == m, d


def test_no_clusters(spark):
    new, members = linking.link(spark.createDataFrame([], SPANS), spark.createDataFrame([(1, "M1", 0, 3, "character")], "doc_id int, mention_id string, start int, end int, type string"))
    assert new.count() == members.count() == 0
