"""Discovery of personal data against a brute-force graph, and its bounds."""

import collections
import tracemalloc

from factsheet.llm import pii
from factsheet.llm.common import stored
from tests.llm.test_text_operators import given  # noqa: F401


def brute_added(texts, trust=pii.TRUST, support=pii.SUPPORT):
    """{text number: added spans} by dictionaries over the same places."""
    places = [(d, *p) for d, t in enumerate(texts) for p in pii.instances(t or "", pii.base_spans(t or ""))]
    known = {}
    for _, _, _, k, i, _ in places:
        if k >= 0:
            known[i] = min(k, known[i]) if known.get(i, -1) >= 0 else k
        elif k == pii.NEVER:
            known.setdefault(i, k)
    edges = collections.defaultdict(set)
    edge_kind = {}
    for _, _, _, k, i, patterns in places:
        for p in patterns:
            edges[p].add(i)
            edge_kind[p, i] = max(k, edge_kind.get((p, i), k))

    def trusted():
        out = {}
        for p, members in edges.items():
            kinds = collections.Counter(known[i] for i in members if i in known)
            most = max((kinds[k] for k in range(len(pii.ALL_KINDS))), default=0)
            if most >= support and most >= trust * sum(kinds.values()):
                out[p] = next(k for k in range(len(pii.ALL_KINDS)) if kinds[k] == most)
        return out

    votes = {}
    while True:
        of = trusted()
        new = collections.defaultdict(collections.Counter)
        for (p, i), k in edge_kind.items():
            if k == pii.UNKNOWN and p in of and i not in known:
                new[i][of[p]] += 1
        if not new:
            break
        for i, n in new.items():
            votes[i] = min((-c, k) for k, c in n.items())
            known[i] = votes[i][1]
    for i in {i for (p, i), k in edge_kind.items() if k == pii.SECRET and of.get(p) == pii.SECRET}:
        votes[i] = (-sum(k == pii.SECRET and j == i and of.get(p) == pii.SECRET for (p, j), k in edge_kind.items()), pii.SECRET)
    in_graph = {i for _, i in edge_kind}
    votes.update({i: (-pii.CERTAIN, k) for i, k in known.items() if 0 <= k < pii.SECRET and i not in votes and i in in_graph})
    found = collections.defaultdict(list)
    for d, s, e, k, i, _ in places:
        if k in (pii.UNKNOWN, pii.SECRET) and i in votes:
            found[d].append((votes[i][0], s - e, s, e, votes[i][1]))
    out = {}
    for d, spans in found.items():
        kept = []
        for _, _, s, e, k in sorted(spans):
            if all(e <= a or b <= s for a, _, b in kept):
                kept.append((s, k, e))
        out[d] = sorted(kept)
    return out


def spark_added(spark, texts):
    docs = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "pii")
    rows = pii.find_personal_data(docs).collect()
    assert len(rows) == len(texts)
    return {r.doc_id: sorted((s.start, s.kind, s.end) for s in r.added) for r in rows if r.added}


def test_discovery_of_given_texts_equals_brute_force(spark):
    texts = [r.text for r in given(spark).collect()]
    texts += [f'password = "{k:x}{"ab12" * 9}" and more' for k in range(3)] + ['password = "hunter2hunter" and more']
    texts += [f"ring +1 ({200 + k}) 555-0{100 + k} tonight" for k in range(4)] + ["ring +1 (300) 555-0199 10.20.30.40 tonight"]
    want = brute_added(texts)
    assert want
    assert spark_added(spark, texts) == want


def test_shape_reveals_what_the_patterns_drop(spark):
    """A phone number that runs on into an address is dropped by the fixed pattern, and found by class and shape."""
    texts = [f"{w} +1 ({200 + k}) 555-0{100 + k} {w}{w}" for k, w in enumerate(["some", "other", "words", "stand"])]
    texts += ["here +1 (301) 555-0199 10.20.30.40 there", "and +1 (200) 555-0100 10.20.30.40 there"]
    assert not [x for t in texts[4:] for x in pii.base_spans(t) if x[1] == 3]
    assert spark_added(spark, texts) == brute_added(texts) == {4: [(5, 3, 22)], 5: [(4, 3, 21)]}


def test_failing_matches_count_against_a_shape(spark):
    good = ["4845168114407329", "4417744280351547", "4929348385146306", "4111111111111111"]
    assert all(map(pii.luhn, good))
    words = "one other words stand here and there".split()
    texts = [f"{w} {c} {w}w" for w, c in zip(words, good)] + [f"{w} {c[:-1]}{9 - int(c[-1])} w{w}" for w, c in zip(words[4:], good)]
    texts += ["again 12 5500000000000004 now"]  # a longer run, which the fixed pattern drops
    assert not pii.base_spans(texts[-1])
    assert spark_added(spark, texts) == brute_added(texts) == {}
    assert spark_added(spark, texts[:4] + texts[-1:]) == {4: [(9, 2, 25)]}
    assert pii.refuted("4417744280351548") and pii.refuted("999.1.1.1") and not pii.refuted("1.2.3.4")


def test_secrets_need_a_trusted_label(spark):
    keys = [f"{k:x}" + "0a1b2c3d" * 5 for k in range(1, 5)]
    texts = [f'w{k} token = "{x}" and' for k, x in enumerate(keys)] + ['so token = "short9key" but', f"a lone {'9f' * 20} stands"]
    got = spark_added(spark, texts)
    assert set(got) == {0, 1, 2, 3, 4} and {k for spans in got.values() for _, k, _ in spans} == {pii.SECRET}
    assert [texts[4][s:e] for s, _, e in got[4]] == ["short9key"]


def test_long_instances_have_no_cap(spark):
    long = "x9" * 50 + "[at]mail"
    texts = [f"Please write to user{k}@mail.example for help" for k in range(3)] + [f"Please write to {long} for help"]
    assert spark_added(spark, texts) == {3: [(16, 0, 16 + len(long))]}


def test_memory_of_a_text_full_of_groups():
    text = "12 34 56 7 " * 20_000
    tracemalloc.start()
    n = sum(1 for _ in pii.instances(text, pii.base_spans(text)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 200_000 and peak < 40 * len(text)


def test_empty_null_and_repeated_texts(spark):
    assert spark_added(spark, [None, "", "   ", "plain words only"]) == {}
    docs = stored(spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd"), (None, None)], "doc_id long, text string"), "pii")
    rows = pii.find_personal_data(docs).collect()
    assert sorted((r.doc_id or 0, len(r.base), len(r.added)) for r in rows) == [(0, 0, 0), (1, 1, 0), (1, 1, 0)]
