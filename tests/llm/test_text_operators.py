"""Dealt operators on text against brute force, on given rows and on odd ones."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from factsheet.llm import exact_dedup, langid, mixing, packing, pii, queries, simhash, tokens, toxicity
from factsheet.llm.common import stored

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("_row", T.StringType()), T.StructField("size", T.StringType())])
LONG = "alpha beta <b> gamma's 1,234 " * 40_000
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Equal text  here now"), (5, "Equal text\there now"), (5, "Equal text here now"),
       (None, "no id"), (None, "no id"), (8, LONG), (9, "no id"), (10, "x"), (11, "Ünïcödé ΣΑΣ 中文字 ² ½ don't <|endoftext|> a_b"),
       (12, "mail a@b.co or x@y, ip 1.2.3.4 and 300.1.1.1 card 4111 1111 1111 1111 phone +1 (555) 010-9999"), (10, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, "en" if k % 2 else None, [None, "a", "b"][k % 3], "mine", "too") for k, (d, t) in enumerate(ODD)]
    return stored(spark.createDataFrame(rows, DOCS).coalesce(2), "odd")


@pytest.fixture(scope="module")
def none(spark):
    return stored(spark.createDataFrame([], DOCS), "none")


@pytest.fixture(scope="module")
def library():
    return tokens.load_tokenizer(queries.tokenizer_path())


def given(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def components(n, links):
    p = list(range(n))
    for i, j in links:
        while p[i] != i:
            i = p[i]
        while p[j] != j:
            j = p[j]
        p[max(i, j)] = min(i, j)
    out = []
    for i in range(n):
        while p[i] != i:
            i = p[i]
        out.append(i)
    return out


# -- op 7, op 4

def test_token_counts(spark, odd, none, library):
    for docs in (given(spark), odd):
        want = collections.Counter((r.doc_id, len((r.text or "").encode()), len(ids_of(library, r.text))) for r in docs.collect())
        got = tokens.count_tokens(docs, queries.tokenizer_path()).collect()
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert tokens.count_tokens(none, queries.tokenizer_path()).count() == 0


def test_whole_tokens_are_proven(library):
    found = tokens.whole_tokens(queries.tokenizer_path())
    assert len(found) > 10_000
    for word in list(found)[::501]:
        assert ids_of(library, word) == [found[word]]


@pytest.mark.parametrize("which", ["given", "odd", "none"])
def test_packing(spark, odd, none, library, which):
    docs = {"given": given(spark), "odd": odd, "none": none}[which]
    rows = packing.pack_documents(docs, queries.tokenizer_path(), window=512).collect()
    want = collections.Counter((r.doc_id, tuple(ids_of(library, r.text)) + (2,)) for r in docs.collect())
    stream = collections.defaultdict(dict)
    for r in rows:
        assert r.offset not in stream[r.sequence_id] and r.length > 0
        stream[r.sequence_id][r.offset] = r
    flat = []
    for k, s in enumerate(sorted(stream)):
        assert k == s
        at = 0
        for offset in sorted(stream[s]):
            assert offset == at
            at += stream[s][offset].length
            flat.append(stream[s][offset])
        assert at == 512 or s == max(stream) and at < 513
    got, k = collections.Counter(), 0
    while k < len(flat):  # pieces of a document follow each other
        first, ids = flat[k], []
        assert first.start == 0
        while len(ids) < first.doc_tokens:
            assert flat[k].start == len(ids) and flat[k].doc_id == first.doc_id
            ids += np.frombuffer(flat[k].ids, "<u4").tolist()
            k += 1
        got[first.doc_id, tuple(ids)] += 1
    assert got == want


# -- op 5

def brute_exact(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    out = collections.Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        kept = ids.index(keep)
        for k, i in enumerate(ids):
            out[i, keep, len(ids), k == kept, digest] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"id_bits": 3, "least": 8, "most": 24}])
def test_exact_duplicates(spark, odd, none, options):
    for docs in (given(spark), odd):
        got = collections.Counter(tuple(r) for r in exact_dedup.exact_duplicates(docs, **options).drop("_row").collect())
        assert got == brute_exact(docs.collect())
    left = exact_dedup.drop_exact_duplicates(odd, **options)
    assert left.columns == odd.columns and left.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ODD})
    assert exact_dedup.exact_duplicates(none, **options).count() == 0


# -- op 2

def brute_mix(rows, most=3):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]
    words = collections.Counter()
    for r, n in zip(rows, size):
        words[r.source] += n
    weights = mixing.cycled_weights(words)
    target, left, open_ = {}, float(sum(words.values())), set(words)
    while True:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * left / total > most * words[s]}
        if not over:
            break
        for s in over:
            target[s] = float(most * words[s])
        left -= sum(target[s] for s in over)
        open_ -= over
    target |= {s: weights[s] * left / total for s in open_}
    return size, words, target


@pytest.mark.parametrize("hot_id", [None, 7])
def test_mixing_splits_an_id_that_many_rows_hold(spark, monkeypatch, hot_id):
    rows = [(hot_id if i % 4 else i, "one two three"[: 3 + i % 11], "a") for i in range(4000)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, source string"), "hot-id")
    tables = {}

    def seen(df, name):
        tables[name] = stored(df, name)
        return tables[name]

    monkeypatch.setattr(mixing, "stored", seen)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = mixing.mix_sources(docs).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r.taken for r in got) == sum(r.size for r in got) and len(got) == 4000
    assert max(r["count"] for r in tables["mix-line"].groupBy("source", "part").count().collect()) < 1000


def test_mixing(spark, odd, none):
    for docs in (given(spark), odd):
        rows = docs.collect()
        size, words, target = brute_mix(rows)
        got = {r._row: r for r in mixing.mix_sources(docs).collect()}
        again = {r._row: r for r in mixing.mix_sources(docs).collect()}
        assert got == again and len(got) == len(rows)
        taken, most = collections.Counter(), collections.Counter()
        by = collections.defaultdict(list)
        for r, n in zip(rows, size):
            by[r.doc_id, n].append(r.source)
        for r in got.values():
            assert 0 <= r.taken <= 3 * r["size"]
        assert sum(r.taken for r in got.values()) == sum(size)
        source = {(r.doc_id, n): r.source for r, n in zip(rows, size)}
        for r in got.values():
            if len(by[r.doc_id, r["size"]]) == 1:
                s = source[r.doc_id, r["size"]]
                assert r.source_size == words[s] and r.target == pytest.approx(target[s])
        if docs is not odd:
            for r in got.values():
                s = source[r.doc_id, r["size"]]
                taken[s] += r.taken
                most[s] = max(most[s], r["size"])
            assert all(abs(taken[s] - target[s]) <= most[s] + 1 for s in words)
    assert mixing.mix_sources(none).count() == 0
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns


# -- op 9

def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd, none):
    for docs in (given(spark), odd):
        rows = docs.collect()
        fp = np.array([brute_print(r.text) for r in rows], dtype=np.uint64)
        i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))
        group = components(len(rows), zip(i, j))
        least = {}
        for g, r in zip(group, rows):
            if r.doc_id is not None:
                least[g] = min(least.get(g, r.doc_id), r.doc_id)
        want = collections.Counter((r.doc_id, f"{f:016x}", least.get(g)) for r, f, g in zip(rows, fp.tolist(), group))
        got = simhash.simhash_groups(docs).collect()
        assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
        assert sum(r.kept for r in got) == len(set(group))
        left = simhash.drop_near_duplicates(docs)
        assert left.columns == docs.columns and left.count() == len(set(group))
    assert simhash.simhash_groups(none).count() == 0


def test_simhash_links_find_every_pair_in_crowds(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    crowd = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for c in centre for _ in range(700)]
    fp = np.unique(np.array(crowd + rng.integers(0, 1 << 63, 500, dtype=np.uint64).tolist(), dtype=np.uint64))
    prints = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "bits long")
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))
    want = components(len(fp), zip(i, j))
    at = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    links = [(at[r.a], at[r.b]) for r in simhash.simhash_links(prints).collect()]
    assert components(len(fp), links) == want
    rank = {r.bits: r.g for r in prints.select("bits", simhash.gray_rank(prints.bits).alias("g")).collect()}
    for x in list(rank)[:50]:  # the Gray code of the rank is the fingerprint
        g = rank[x] & (1 << 64) - 1
        assert g ^ g >> 1 == x & (1 << 64) - 1


def test_tree_search_of_two_pages():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    flip = lambda n: np.unique(base[rng.integers(0, 20, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ np.uint64(7))
    x, y = flip(600), flip(35)
    got = set(zip(*map(np.ndarray.tolist, simhash.tree_links(x, y, 3))))
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= 3))))


# -- op 8

def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(sum(divmod(x * (1 + k % 2), 10)) for k, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("a1@.-+() 5x0%_"), 60)) for _ in range(3000)] + [t for _, t in ODD if t]
    texts += [r.text for r in given(spark).collect()]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t)


def test_contexts_reveal_unseen_identifiers(spark, odd, none):
    known = [f"Please write to user{k}@mail.example for help" for k in range(6)]
    unseen = ["Please write to user77[at]mail for help", "some words and user77[at]mail again", "other code abc12345 stands alone"]
    docs = stored(spark.createDataFrame(list(enumerate(known + unseen)), "doc_id long, text string"), "pii")
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert [len(got[k].base) for k in range(6)] == [1] * 6
    found = lambda k: [(unseen[k - 6][s.start:s.end], s.kind) for s in got[k].added]
    assert found(6) == [("user77[at]mail", 0)] and found(7) == [("user77[at]mail", 0)] and found(8) == []
    rows = pii.find_personal_data(odd).collect()
    assert collections.Counter((r.doc_id, tuple((s.start, s.kind, s.end) for s in r.base)) for r in rows) == collections.Counter(
        (d, tuple(brute_spans(t or ""))) for d, t in ODD)
    assert pii.find_personal_data(none).count() == 0


def added(spark, texts):
    docs = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "pii")
    return {r.doc_id: [(texts[r.doc_id][s.start:s.end], pii.KINDS[s.kind]) for s in r.added]
            for r in pii.find_personal_data(docs).collect() if r.added}


def test_unknown_identifiers_do_not_count_against_their_context(spark):
    texts = [f"Please write to user{k}@mail.example for help" for k in range(3)] + ["Please write to user77[at]mail for help"]
    texts += [f"We can be reached at 10.0.0.{k} today" for k in range(6)] + [f"We can be reached at host{k}.lan.0 today" for k in range(2)]
    assert added(spark, texts) == {3: [("user77[at]mail", "email")], 10: [("host0.lan.0", "ip")], 11: [("host1.lan.0", "ip")]}
    # known ones of another kind, and dates, do
    texts = [f"it came from user{k}@mail.example again" for k in range(3)] + ["it came from 10.0.0.1 again", "it came from xyz12345 again"]
    assert added(spark, texts) == {}
    texts = [f"it was sent user{k}@mail.example again" for k in range(3)] + ["it was sent 2020-01-02 again", "it was sent xyz12345 again"]
    assert added(spark, texts) == {}


def test_identifiers_of_several_words_and_without_digits(spark):
    seeds = [f"Please write to user{k}@mail.example for help" for k in range(3)]
    assert added(spark, [*seeds, "Please write to john at example dot com for help", "Please write to john[at]example for help",
                         "We met at noon dot dot and so on", "Please write to John for help"]) == {
        3: [("john at example dot com", "email")], 4: [("john[at]example", "email")]}
    seeds = [f"You may call me on +1 (555) 123-456{k} or later" for k in range(3)]
    assert added(spark, [*seeds, "You may call me on 555 123 4567 or later", "The number 555 123 4567, they say",
                         "You may call me on (555) 123 4568 or later", "There were 12 of 30 rows"]) == {
        3: [("555 123 4567", "phone")], 4: [("555 123 4567", "phone")], 5: [("(555) 123 4568", "phone")]}
    seeds = [f"we have paid with {x} by the day" for x in ("4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009")]
    assert added(spark, [*seeds, "we have paid with 4111 1111 1111 1112 by the day"]) == {3: [("4111 1111 1111 1112", "card")]}


def test_contexts_at_the_ends_of_a_text(spark):
    assert added(spark, [f"Phone: +49 30 12345{k}" for k in range(3)] + ["Phone: 030-123456", "Fax 030-123457"]) == {
        3: [("030-123456", "phone")]}
    assert added(spark, [f"user{k}@mail.example wrote" for k in range(3)] + ["user7[at]mail wrote this"]) == {3: [("user7[at]mail", "email")]}
    assert added(spark, [f"{x} Phone: +49 30 12345{k} {x}" for k, x in enumerate("abc")] + ["far off Phone: 030-123456 there"]) == {
        3: [("030-123456", "phone")]}


def test_contexts_are_followed_to_the_end(spark):
    texts = [f"round zero says user{k}@mail.example here" for k in range(3)]
    for n in range(6):  # each round's three instances make the next one's context known
        texts += [f"round {'abcdefg'[n - 1] if n else 'zero'} says name{n}x{k}55 here" for k in range(3)] if n == 0 else []
        texts += [f"round {'abcdefg'[n]} tells name{n}x{k}55 there{n}" for k in range(3)]
        texts += [f"round {'abcdefg'[n]} tells name{n + 1}x{k}55 there{n}" for k in range(3)]
    found = added(spark, texts)
    assert {x for v in found.values() for x, _ in v} == {f"name{n}x{k}55" for n in range(7) for k in range(3)}


# -- op 1, op 3

def test_languages_held_out(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, learn_from=queries.remainder("doc_id", 4) != 2)
    got = {r.doc_id: r for r in langid.label_languages(docs, model).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.97
    en, fr = (next(r.text for r in held if r.lang == x and len(r.text) > 800)[:700] for x in ("en", "fr"))
    mixed = stored(spark.createDataFrame([(1, f"{en} {fr}")], "doc_id long, text string"), "mixed")
    spans = langid.label_languages(mixed, model).first().spans
    assert [s.lang for s in spans] == ["en", "fr"] and abs(spans[0].end - len(en)) < 40
    rows = langid.label_languages(odd, model).collect()
    assert len(rows) == len(ODD)
    assert all(r.lang_pred == "und" and r.score == 0 and r.spans == [] for r in rows if r.doc_id in (1, 2, 3))
    assert langid.label_languages(none, model).count() == 0
    nothing = langid.train(none)
    assert {r.lang_pred for r in langid.label_languages(odd, nothing).collect()} == {"und"}


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    sizes = np.array([5, 0, 1, 6, 3])
    scores = rng.normal(0, 3, (sizes.sum(), 3))
    path = langid.viterbi(scores, sizes, 2.5)
    at = 0
    for n in sizes:
        own = scores[at:at + n]
        value = lambda p: sum(own[k, c] for k, c in enumerate(p)) - 2.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731,B023
        if n:
            best = max(value(p) for p in np.ndindex(*[3] * n))
            assert value(path[at:at + n].tolist()) == pytest.approx(best)
        at += n


def test_toxicity_learns_pairs(spark, odd, none):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(1500):  # insult with group: toxic; either alone: not
        insult, group = rng.random(2) < 0.5
        words = [f"w{x}q" for x in rng.integers(0, 30, 6)] + ["rotters"] * bool(insult) + ["martians"] * bool(group)
        rows.append((k, " ".join(rng.permutation(words)), int(insult and group)))
    docs = stored(spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string"), "tox-docs")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels, learn_from=queries.remainder("doc_id", 5) != 0)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, machine).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(got[a].predicted == c for a, _, c in held) / len(held) > 0.97
    assert toxicity.drop_toxic(docs, machine).count() == sum(not r.predicted for r in got.values())
    out = toxicity.score_toxicity(odd, machine).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.drop_toxic(odd, machine).columns == odd.columns
    assert toxicity.score_toxicity(none, machine).count() == 0
    assert toxicity.score_toxicity(odd, toxicity.train(odd, labels.limit(0))).where("score = 0.0001").count() == len(ODD)


def test_toxicity_learns_pairs_without_marginal_effect(spark):
    rng = np.random.default_rng(1)
    names = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(2500)]
    rows = []
    for k in range(4000):  # exactly one of the two words: toxic
        a, b = rng.random(2) < 0.5
        words = [names[x] for x in rng.integers(0, len(names), 8)] + ["rotters"] * bool(a) + ["martians"] * bool(b)
        rows.append((k, " ".join(rng.permutation(words)), int(a != b)))
    docs = stored(spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string"), "tox-pairs")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels, learn_from=queries.remainder("doc_id", 5) != 0)
    assert len(machine.weight) > 5000
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, machine).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(got[a] == c for a, _, c in held) / len(held) > 0.97


def test_viterbi_of_many_languages():
    scores = np.full((6, 400), -50.0)
    want = [399, 399, 255, 255, 300, 300]
    scores[np.arange(6), want] = 0.0
    assert langid.viterbi(scores, np.array([6]), 12.0).tolist() == want


def test_spans_without_spaces(spark):
    ru, en, zh, th = "привет как твои дела сегодня", "hello how are you today", "今天天气很好我们去公园散步", "วันนี้อากาศดีมากเราไปเดินเล่น"
    docs = stored(spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(zip((ru, en, zh, th), ("ru", "en", "zh", "th")))],
                                        "doc_id long, text string, lang string"), "scripts")
    model = langid.train(docs)
    mixed = zh + th + "hellohowareyoutoday" + "приветкактвоидела"
    r = langid.label_languages(stored(spark.createDataFrame([(1, f"{en} {mixed}")], "doc_id long, text string"), "unspaced"), model).first()
    assert [s.lang for s in r.spans] == ["en", "zh", "th", "en", "ru"]
    assert "".join(f"{en} {mixed}"[s.start:s.end] for s in r.spans[1:]) == mixed and r.score < 0.6
    assert [len(x) for x in langid.Pieces().of(zh)] == [4, 4, 4, 1]
