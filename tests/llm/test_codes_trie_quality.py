"""Vector codes, the conversation trie and quality rules against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from factsheet.llm import langid, quality, queries, trie, vectorcodes
from factsheet.llm.common import join_by_key, stored

SF = "/root/testdata/sf0.001"


# --- vector codes ---------------------------------------------------------------------------------------------------


def brute_codes(rows, rounds=6):
    """Plain rounds over (id, vector), every distance computed every time, in Python integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    x = [[math.floor(4096 * c) for c in v] for _, v in rows]
    d = len(x[0]) // 8
    parts = [[v[p * d:(p + 1) * d] for v in x] for p in range(8)]
    books = [[list(v) for v in part[:16]] for part in parts]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    pick = lambda p: [min(range(len(books[p])), key=lambda e: (far(v, books[p][e]), e)) for v in parts[p]]
    for _ in range(rounds):
        for p in range(8):
            chosen = pick(p)
            for e in range(len(books[p])):
                own = [v for v, c in zip(parts[p], chosen) if c == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    last = [pick(p) for p in range(8)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {r[0]: ("".join(f"{last[p][k]:02x}" for p in range(8)), sum(far(parts[p][k], books[p][last[p][k]]) for p in range(8)), sha)
            for k, r in enumerate(rows)}


def test_vector_codes_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(300, 16)) * rng.choice([0.1, 1, 30], size=(300, 1))).astype(np.float32)
    x[50:90] = x[50]  # a group of copies, ties among entries
    good = [(k, v.tolist(), k % 3 if k % 7 else None) for k, v in enumerate(x)]
    odd = [(900, None, 1), (901, [1.0, None] * 8, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, 1)]
    data = stored(spark.createDataFrame([(*r, "clash") for r in good + odd], "vec_id long, embedding array<float>, label int, entry string"), "v")
    monkeypatch.setattr(vectorcodes, "BLOCK_ROWS", 64)
    got = {r.vec_id: r for r in vectorcodes.vector_codes(data).collect()}
    want = brute_codes([(k, v) for k, v, _ in good])
    assert {k: (r.code, r.error, r.codebooks_sha256) for k, r in got.items()} == want
    totals = collections.Counter()
    for k, _, lab in good:
        totals[lab] += want[k][1]
    assert all(got[k].label_error == totals[lab] for k, _, lab in good)


def test_vector_codes_odd_tables(spark):
    rows = [(1, [0.5] * 8), (1, [0.5] * 8), (None, [1.0] * 8), (2, []), (3, [1e30, -1e30, 1.0]), (4, [0.25] * 8)]
    data = spark.createDataFrame([(*r, None) for r in rows], "vec_id long, embedding array<double>, label int")
    got = vectorcodes.vector_codes(data).collect()
    assert len(got) == len(rows) and all(r.error == 0 and len(r.code) == 16 for r in got)
    assert len({r.codebooks_sha256 for r in got}) == 3  # a codebook for each length
    assert vectorcodes.vector_codes(data.limit(0)).count() == 0


def test_bounds_spare_rescans_and_never_err():
    rng = np.random.default_rng(3)
    x = rng.integers(-4000, 4000, (2000, 16))
    block = vectorcodes.Block(x)
    history = [x[:16].reshape(16, 8, 2).swapaxes(0, 1).astype(np.int64)]
    block.assign(history)
    first = block.rescans
    for _ in range(6):
        total, n = block.sums(16)
        history.append(np.where(n[:, :, None] > 0, total // np.maximum(n, 1)[:, :, None], history[-1]))
        block.rescans = 0
        block.assign(history)
        for p in range(8):
            assert (block.state["entry"][:, p] == vectorcodes.distances(block.part(p), history[-1][p]).argmin(axis=1)).all()
    assert block.rescans < first / 3
    wide = np.array([[1 << 26, -(1 << 26)]], dtype=np.int64)
    assert vectorcodes.distances(wide, -wide).tolist() == [[2 * (1 << 27) ** 2]]


# --- conversation trie ----------------------------------------------------------------------------------------------


def brute_trie(rows):
    own = collections.defaultdict(list)
    name = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, name(name(role or "") + name(text or "")), role or "", text or ""))
    for c in own:
        own[c] = [x[3:] for x in sorted(own[c])]
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = collections.defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = set()
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(r[:-1] == q for r in below if r) for q in below)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(p))))
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), leaves,
                 sum((len(nodes[q]) - 1) * words(q) for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def told(df):
    return {tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()}


def test_trie_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in [*range(-25, 60), 100, 101, 104]:
        for t in range(int(rng.integers(1, 7))):
            rows.append((c, None if t == 0 and c % 5 == 0 else t, "user" if t % 2 else None, [None, "", "a b", "a  b\nc", "d"][rng.integers(0, 5)]))
    rows += [(100, t, "user", f"turn {t}") for t in range(70)]  # deeper than any other
    rows += [(30, 2, "user", "tie"), (30, 2, "user", "tie"), (30, 2, "bot", "tie")] + [(None, 1, "user", "no id")] * 3
    data = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, name string")
    got = trie.conversation_trie(data)
    assert told(got) == brute_trie(rows)
    assert trie.conversation_trie(data.limit(0)).count() == 0
    assert told(trie.conversation_trie(data.where("conv_id = 7"))) == brute_trie([r for r in rows if r[0] == 7])


def test_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 7)
    ends = [(b"a" * 16, k) for k in range(-40, 60)] + [(b"b" * 16, 5), (b"c" * 16, 6), (b"c" * 16, 600)] + [(b"d" * 16, k) for k in range(14)]
    df = spark.createDataFrame(ends, "name binary, conv long")
    want = collections.defaultdict(list)
    for n, c in ends:
        want[n].append(c)
    want = {n: hashlib.sha256(",".join(map(str, sorted(c))).encode()).hexdigest() for n, c in want.items()}
    for n in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert {bytes(r.name): r.sha for r in trie._end_digests(df).collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_hot_conversation_spreads_over_ranges(spark):
    rows = spark.range(6000).selectExpr("if(id < 4000, 20, id) AS conv_id", "id AS turn", "'u' AS role", "concat('t', id % 50) AS text")
    placed = stored(trie.placed_turns(rows.repartition(8)), "p")
    hot = placed.where("conv = 20").select("pos").toPandas()["pos"]
    assert sorted(hot) == list(range(4000))


def test_join_by_key_hot_and_null(spark):
    rows = stored(spark.range(3000).selectExpr("id", "CASE WHEN id < 1000 THEN 'hot' WHEN id < 2000 THEN NULL ELSE cast(id AS string) END AS k"), "r")
    facts = stored(rows.groupBy("k").count().selectExpr("k", "count AS n", "coalesce(k, 'none') AS fact"), "f")
    got = join_by_key(rows, facts, "k", "n")
    assert got.columns == ["id", "k", "fact"]
    assert {(r.id, r.fact) for r in got.collect()} == {(k, "hot" if k < 1000 else "none" if k < 2000 else str(k)) for k in range(3000)}


# --- quality --------------------------------------------------------------------------------------------------------


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def brute_bits(texts, langs):
    """Log2 perplexity a unit by the textbook formulas, over dictionaries."""
    def units(t):
        raw = "".join(w + " " for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")).encode("utf-16-le")
        return [32] * 3 + [raw[k] + 256 * raw[k + 1] for k in range(0, len(raw), 2)] if raw else []
    grams = []
    for t in texts:
        u = units(t)
        grams.append([tuple(u[k - 3:k + 1]) for k in range(3, len(u))])
    counts = {4: collections.Counter((lang, g) for own, lang in zip(grams, langs) for g in set(own))}
    for k in (3, 2, 1):
        counts[k] = collections.Counter((lang, g[1:]) for lang, g in counts[k + 1])
    cuts = {}
    for k in counts:
        n = {i: sum(c == i for c in counts[k].values()) for i in range(1, 5)}
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        cuts[k] = [0.0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i / 2, 0.1), i - 0.1) for i in (1, 2, 3)]
    context = {k: collections.defaultdict(list) for k in counts}
    for k in counts:
        for (lang, g), c in counts[k].items():
            context[k][lang, g[:-1]].append(c)

    def p(lang, g):
        k = len(g)
        if k == 0:
            return 1 / (len(context[1][lang, ()]) + 1)
        of = context[k][lang, g[:-1]]
        c = counts[k][lang, g] - (k == 4)
        freed = sum(cuts[k][min(x, 3)] for x in of)
        return (max(c - cuts[k][min(c, 3)], 0) + freed * p(lang, g[1:])) / sum(of)
    return [sum(-math.log2(p(lang, g)) for g in own) / len(own) if own else None for own, lang in zip(grams, langs)]


TEXTS = ["", None, " \n\t ", "one", "a b c d e f a b c d e g", "x\ny\nx\n\n \nx y\nx y", "# * $ | <p> &amp; 100%", "naïve 𝒳𝒴 \U0001F600 文字 文字",
         "the cat sat on the mat and the dog sat on the log while the bird sang", "the cat sat on the mat and the dog sat on the log while the bird sang",
         "one two three four five six seven eight nine ten eleven", "a a a a a a a a a a a a", "zq xj kv wq zx qj vk xw jz qk xv jq wz", "tab\x0bvert\x0cfeed\rreturn nbsp\xa0stays \x85here"]


@pytest.mark.parametrize("heavy", [1 << 20, 40, 1])
def test_quality_equals_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(quality, "HEAVY", heavy)
    langs = ["en", None, "de", None, *["en"] * 5, "de", "en", "en", "en", "de"]
    docs = stored(spark.createDataFrame([(k, t, g, "clash") for k, (t, g) in enumerate(zip(TEXTS, langs))], "doc_id long, text string, lang string, bits string"), "d")
    got = {r.doc_id: r for r in quality.judge_documents(docs).collect()}
    assert len(got) == len(TEXTS)
    bits = brute_bits(TEXTS, langs)
    for k, t in enumerate(TEXTS):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(t), t
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert (r.bits is None) if bits[k] is None else r.bits == pytest.approx(bits[k], abs=1e-4)
        assert r.kept == (not r.base_failed and r.low <= r.bits <= r.high)
    assert quality.judge_documents(docs.limit(0)).count() == 0


def test_other_corpus_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(quality, "CHUNK", 64)
    monkeypatch.setattr(quality, "_FORTH", quality._powers(quality._STEP, 64))
    monkeypatch.setattr(quality, "_BACKWARD", quality._powers(quality._BACK, 64))
    long = " ".join(f"word{k % 17}{'abc'[k % 3]}" for k in range(400))
    assert {k: int(v[0]) for k, v in quality.Texts([long]).base().items()} == dict(zip(
        ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), brute_base(long)))
    schema = "doc_id long, text string, lang string"
    corpus = stored(spark.createDataFrame([(1, "the cat sat on the mat " * 3, "en"), (2, "a dog sat on a log", "en")], schema), "c")
    docs = stored(spark.createDataFrame([(1, "the cat sat on a log of the mat and on it", "en"), (2, "ΩΨ жщ ΩΨ жщ Ω щ ж Ψ q z", "en"),
                                         (3, "unknown language here", "xx")], schema), "d")
    got = {r.doc_id: r.bits for r in quality.judge_documents(docs, corpus=corpus).collect()}
    assert got[1] < got[2] and got[3] >= 0


def test_bands_reject_what_does_not_read_like_the_rest(spark):
    import random
    rng = random.Random(5)
    stock = "der die das und ist ein haus baum weg stadt land fluss berg garten kind frau mann tag nacht jahr".split()
    rows = [(k, " ".join(rng.choices(stock, k=80)), "de") for k in range(300)]
    rows += [(900, " ".join("".join(rng.choices("qxzjvkw0987#", k=7)) for _ in range(60)), "de")]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "d")
    out = {r.doc_id: r.kept for r in quality.judge_documents(docs).collect()}
    assert [k for k, v in out.items() if not v] == [900]


def test_given_tables(spark):
    got = queries.op13_quality_rules(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(texts[r.doc_id]) for r in got.collect())


def test_language_of_a_repeated_id_is_no_flood(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    one = docs.where("lang = 'fr'").orderBy("doc_id").limit(1)
    flood = stored(docs.unionByName(one.crossJoin(spark.range(20000)).select("doc_id", "text", "lang")), "flood")
    assert langid.train(flood).langs == langid.train(docs).langs == ["de", "en", "es", "fr"]
