"""The audit of filters against walking every order document by document."""

import random
import re
from itertools import permutations

from phialo.llm import filter_audit

ORDER = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    failing = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        failing.append((s or "", i, {k for k, v in f.items() if v}))
    out = []
    for part in {p for p, _, _ in failing}:
        own = [(i, f) for p, i, f in failing if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                shapley[x] += len(gone)
                redundant = sum(x in f for _, f in own) - len(gone)
                rows.append((part, "".join(order), k + 1, len(left), len(gone), redundant, sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x))
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


def got(spark, docs, labels, extra=False):
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, source string, failed int, quality int")
    df = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return sorted(tuple(r) for r in df.select(ORDER).collect())


def test_random_documents(spark):
    pick = random.Random(5)
    texts = [None, "", " \t", "A" * 10 + " b", "one two #", "same words " * 150, *(" ".join(pick.choice(["word", "Other", "x%d" % k]) for k in range(pick.choice([50, 260]))) for _ in range(20))]
    docs = [(i if i % 13 else None, pick.choice(texts), pick.choice([None, "", "a", "b"])) for i in range(150)]
    docs += docs[:4]
    labels = [(i, pick.choice([0, 1, None]), pick.choice([0, 1])) for i in range(0, 200, 2)] + [(2, 1, 0), (2, 1, 1), (None, 1, 1)]
    assert got(spark, docs, labels) == plain(docs, labels)


def test_empty_tables(spark):
    assert got(spark, [], []) == []
    docs = [(1, "a", "s"), (2, "a", "s")]
    assert got(spark, docs, []) == plain(docs, [])


def test_path_counts_of_the_lattice():
    reach, leave = filter_audit.path_counts(5)
    assert all(reach[s] * leave[s] > 0 for s in range(32)) and reach[31] == leave[0] == 120
    assert sum(reach[s] * leave[s | 1] for s in range(32) if not s & 1) == 120
