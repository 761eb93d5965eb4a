"""Embeddings, web pages and the pipeline against brute force."""

import collections
import re

import numpy as np
import pytest

import corpus_pipeline
from factsheet.llm import common, embeddings, html_text, mixing, pages, queries, simhash, toxicity
from factsheet.llm.common import stored
from factsheet.llm.components import components
from factsheet.llm.tokens import load_tokenizer

SF = "/root/testdata/sf0.001"


def crowd(dim=16):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, dim))
    x = np.concatenate([c + rng.normal(scale=0.12, size=(n, dim)) for c, n in zip(centres, [700, 300, 40, 20, *[8] * 8])])
    return x.astype(np.float32), rng.integers(0, 2, len(x))


def brute(ids, vectors, labels, threshold=0.93):
    u = vectors.astype(np.float64)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    near = (u @ u.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    return near


def test_embedding_groups(spark):
    x, labels = crowd()
    rows = [(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, labels))]
    extra = len(rows)
    odd = [(None, 0), ([], 0), ([0.0] * 16, 0), ([1.0, None] * 8, 0), ([float("nan")] * 16, 0), ([float("inf")] * 16, 0),
           (rows[0][1], None), ([1.0, 2.0], 0), ([2.0, 4.0], 0), (rows[0][1], rows[0][2]), (rows[0][1], rows[0][2])]
    all_rows = rows + [(extra + k, v, c) for k, (v, c) in enumerate(odd)]
    data = stored(spark.createDataFrame([(*r, "clash") for r in all_rows], "vec_id long, embedding array<float>, label int, class string"), "v")
    got = {r.vec_id: r for r in embeddings.embedding_groups(data).collect()}
    assert len(got) == len(all_rows)
    full = np.concatenate([x, x[:1], x[:1]])
    ids = [*range(extra), extra + 9, extra + 10]
    near = brute(ids, full, np.concatenate([labels, labels[:1], labels[:1]]))
    want = near.sum(axis=1)
    found = np.array([got[i].n_links for i in ids])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum()
    for k in (0, 1, 2, 3, 4, 5, 6):
        r = got[extra + k]
        assert (r.n_links, r.component_id, r.kept) == (0, extra + k, True)
    assert got[extra + 7].n_links == got[extra + 8].n_links == 1 and got[extra + 8].component_id == extra + 7
    assert got[extra + 9].component_id == got[0].component_id
    assert embeddings.embedding_groups(data.limit(0)).count() == 0


def test_signs_meet_as_often_as_stated():
    rng = np.random.default_rng(9)
    a = embeddings.unit(rng.normal(size=(2000, 64)))
    b = embeddings.unit(rng.normal(size=(2000, 64)))
    b = embeddings.unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    c = 0.93 * a + np.sqrt(1 - 0.93 ** 2) * b
    met = (embeddings.signatures(a) == embeddings.signatures(c)).any(axis=1).mean()
    assert met > 0.95


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_groups_over_pages_and_partitions_meet(spark, partitions):
    rng = np.random.default_rng(6)
    rows = [("hot", int(k)) for k in rng.permutation(900)] + [(f"k{k % 50}", 1000 + k) for k in range(300)]
    keyed = spark.createDataFrame(rows, "key string, rank long").selectExpr("key", "rank", "rank AS bits")

    def count(rows, group):
        g = np.unique(group)
        ids = rows["bits"].to_numpy()
        pairs = [(ids[group == x][i], ids[group == x][j]) for x in g for i, j in zip(*np.triu_indices((group == x).sum(), 1))]
        a = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return np.full(len(a), pages.LINK, np.int32), a[:, 0], a[:, 1]

    def across(x, y):
        a, b = np.meshgrid(x["bits"].to_numpy(), y["bits"].to_numpy(), indexing="ij")
        return np.full(a.size, pages.LINK, np.int32), a.ravel(), b.ravel()

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = pages.compare_groups(keyed, count, across, lambda p: (0, 0), most_difference=0, page_rows=64, held_rows=100)
        got = collections.Counter(tuple(sorted((r.a, r.b))) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert max(got.values()) == 1
    assert len(got) == 900 * 899 // 2 + 50 * 15


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 300)] + [(7, 7)] + [(300, 301), (301, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 5 for k in [5, *range(200, 300)]}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav>
<header><h1>Site</h1></header><div class="wrap"><article><h1>A &amp; B</h1><p>First <b>bold</b>
 line<br>goes on with <a href=x>a link</a>.<p>Second &eacute; paragraph, which is longer than the first one.
<ul><li>one<li>two</ul><script>var x = "</p>";</script><form><input value=q><button>Send</button></form>
<div class="cookie-notice">We use cookies, a lot of them, every day.</div></article>
<section id="comments"><p>I don't agree with any of this, and I will say so at length, again and again.</p></section>
<aside><p>Side story that goes on for a while.</p></aside></div><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    assert html_text.main_text(PAGE) == ("A & B First bold line goes on with a link. Second é paragraph, which is longer "
                                         "than the first one. one two")
    assert html_text.main_text("no <markup> at all &lt;") == "no at all <"
    assert html_text.main_text("<body><nav>only a menu</nav></body>") == ""
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", PAGE), (1, "u", PAGE), (4, "u", "<b>" * 20_000 + "x")]
    df = stored(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string"), "pages-odd")
    got = html_text.extract_main_text(df).collect()
    assert collections.Counter((r.page_id, r.text) for r in got) == collections.Counter((p, html_text.main_text(h)) for p, _, h in rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_main_text_leaves_out_links_without_telling_names():
    long = [f"Paragraph {k} of the article says a good deal about the matter, in plain words and at some length." for k in range(6)]
    paragraphs = "".join(f"<p>{x}</p>" for x in [*long[:3], "Short.", *long[3:]])
    text = " ".join([*long[:3], "Short.", *long[3:]])
    links = "<ul>" + "".join(f"<li><a href=/{k}>Some other page {k}</a></li>" for k in range(5)) + "</ul>"
    teasers = "".join(f"<div><h3><a href=/{k}>Other story {k}</a></h3><p>In short.</p></div>" for k in range(3))
    for inner in (f"<div>{paragraphs}</div>{links}{teasers}", f"{paragraphs}{links}", f"{links}<div>{paragraphs}</div>",
                  f"<div>{paragraphs}{teasers}</div>"):
        for tag in ("main", "article", "div"):
            assert html_text.main_text(f"<body><{tag}>{inner}</{tag}></body>") == text
    assert html_text.main_text(f"<body><article><h1>Title</h1><div>{paragraphs}</div>{links}</article></body>") == f"Title {text}"
    cited = paragraphs.replace("plain words", "<a href=/w>plain words</a>")
    assert html_text.main_text(f"<body><main>{cited}</main></body>") == text


def test_main_text_names_never_drop_the_article():
    long = [f"Paragraph {k} of the article says a good deal about the matter, in plain words and at some length." for k in range(4)]
    text, paragraphs = " ".join(long), "".join(f"<p>{x}</p>" for x in long)
    side = '<div id="sidebar"><p>Side story that goes on for a while.</p></div><div class="share-buttons"><p>Tell your friends</p></div>'
    replies = '<div id="comments">' + "".join(f"<p>I don't agree at all, number {k}, and I say so at length, again and again.</p>" for k in range(12))
    for wrapper in ('div class="content with-sidebar"', 'div id="content" class="no-sidebar"', 'div class="post share-enabled"',
                    'div class="promo"', "form method=post", 'div class="related newsletter"', 'div class="comments-open"'):
        tag = wrapper.split()[0]
        assert html_text.main_text(f"<body><{wrapper}><div>{paragraphs}</div>{side}</{tag}</body>") == text
        assert html_text.main_text(f"<body><{wrapper}>{paragraphs}</{tag}>{side}{replies}<p class=share>x</p></div></body>") == text
    assert html_text.main_text(f"<body><div>{paragraphs}</div><form><p>Your name</p></form>{side}{replies}</div></body>") == text
    ad = '<div class="ad">A very long advertisement, which holds more text than the article does.</div>'
    assert html_text.main_text(f"<body>{ad}<article><p>Short.</p></article></body>") == "Short."
    assert html_text.main_text(f"<body>{ad}<div><h1>Title</h1><p>Short.</p></div></body>") == "Title Short."
    assert html_text.main_text("<body><div class=comment>" * 20_000 + "x").endswith("x")


def test_main_text_of_given_pages(spark):
    import html

    def article(h):
        inner = re.search(r"<article>(.*?)(</article>|$)", h, re.S)[1]
        return re.sub(r"\s+", " ", html.unescape(re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", re.sub(r"</?b>", "", inner)))).strip()

    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r.text for r in queries.op10_main_text(spark, SF).collect()}
    assert got == {r.page_id: article(r.html) for r in rows}


def test_pipeline(spark):
    """Each stage against a plain version of it over the rows that the stage before left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["toxicity"]
    machine = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"),
                             learn_from=queries.remainder("doc_id", 5) != 0)
    buckets = toxicity.Buckets(machine.wanted)
    scores = machine.score([buckets.of(r.text) for r in before])
    assert sorted(after) == sorted(r for r, s in zip(before, scores) if s < 0.5)
    before, after = seen["exact_dedup"]
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(first.values())
    before, after = seen["simhash_dedup"]
    fp = np.array([simhash.fingerprint(r.text) for r in before], dtype=np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    least = np.arange(len(before))
    while True:
        new = np.array([least[row].min() for row in near])
        if (new == least).all():
            break
        least = new
    want = {g: min(before[k].doc_id for k in np.flatnonzero(least == g)) for g in set(least.tolist())}
    assert sorted(r.doc_id for r in after) == sorted(want.values())
    before, after = seen["source_mix"]
    times = collections.Counter(r.doc_id for r in after)
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in before}
    words = collections.Counter()
    for r in before:
        words[r.source] += size[r.doc_id]
    target = {t.source: t.target for t in mixing.share_targets(words, mixing.cycled_weights(words))}
    taken = collections.Counter()
    for r in before:
        taken[r.source] += times[r.doc_id] * size[r.doc_id]
    longest = {s: max(size[r.doc_id] for r in before if r.source == s) for s in words}
    assert max(times.values()) <= 3 and all(abs(taken[s] - target[s]) <= longest[s] + 1 for s in words)
    before, pieces = seen["packing"]
    ids = lambda t: load_tokenizer(queries.tokenizer_path()).encode(t or "", add_special_tokens=False).ids
    assert sum(r.length for r in pieces) == sum(len(ids(r.text)) + 1 for r in before)
    whole = lambda rows: collections.Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert whole(pieces) == collections.Counter((r.doc_id, len(ids(r.text)) + 1) for r in before)
    assert whole(corpus_pipeline.run(spark, SF).collect()) == whole(pieces)


def test_row_numbers_stay_when_cores_come_or_go(spark, tmp_path):
    """Rows keep their numbers although Spark sees other cores at the second scan."""
    cores, least = "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.minPartitionNum"
    before = {k: spark.conf.get(k, None) for k in (cores, least)}
    path = str(tmp_path / "t")
    spark.range(0, 400_000, 1, 3).selectExpr("id", "md5(cast(id AS string)) AS pad").write.option(
        "parquet.block.size", 1 << 20).parquet(path)
    try:
        spark.conf.unset(least)
        spark.conf.set(cores, "2")
        docs = spark.read.parquet(path)
        splits = docs.rdd.getNumPartitions()
        first = common.stored(common.with_row(docs, "n"), "numbers")
        spark.conf.set(cores, "16")
        assert common.with_row(docs, "n").join(first, ["id", "n"]).count() == 400_000
        spark.conf.unset(least)
        assert spark.read.parquet(path).rdd.getNumPartitions() > splits  # unfixed, the splits do change
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
