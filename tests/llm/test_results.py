"""Results against brute force, exact round trips, libraries and held-out labels."""

import base64
import hashlib
import itertools
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ordinata.llm import bpe, html_text, lm_scoring, media, minmax_dedup, packing, quality_model, queries, shingles, token_counts, url_filter, workspace

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@needs_tables
@pytest.mark.parametrize("name", [n for n in queries.ORACLES if n != "pipeline"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    ours = queries.QUERIES[name](spark, SF)
    theirs = con.execute(f"SELECT {', '.join(ours.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    plain = lambda rows: sorted(str([v if v is None or isinstance(v, str) else None if v != v else round(float(v), 5) if isinstance(v, float) else int(v) for v in row]) for row in rows)
    assert plain(ours.collect()) == plain(theirs)


def test_longer_context_tells_texts_apart(spark):
    """Pairs that are common, in triples that never occur: only the longer context backs off."""
    rows = [*enumerate(["a b c"] * 3 + ["x b d"] * 3), (9, "a b d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    off = [{r["doc_id"]: r["n_backoffs"] for r in lm_scoring.score(docs, order=n).collect()}[9] for n in (1, 2, 3, 4)]
    assert off == [0, 0, 1, 1]
    got = {r["doc_id"]: r["mean_log_score"] for r in lm_scoring.score(docs).collect()}
    assert got[9] == pytest.approx(np.mean(np.log([4 / 21, 4 / 4, 0.4 * 4 / 7])), abs=1e-6)
    assert got[0] == pytest.approx(np.mean(np.log([4 / 21, 4 / 4, 3 / 4])), abs=1e-6)


@needs_tables
def test_packing_covers_every_token_once(spark, docs):
    exact = Tokenizer.from_file(queries.TOKENIZER)
    ids = {k: np.array(exact.encode(t, add_special_tokens=False).ids + [1], "<u4") for k, t in docs.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op1_retrieval_packing(spark, SF).collect():
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for group, size in [(p, len(ids[k])) for k, p in pieces.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(group):
            assert start == at and length > 0
            at += length
        assert at == size if size is not None else at <= 2048 and at & (at - 1) == 0
    assert pieces.keys() == ids.keys()


def test_neighbours_agree_with_plain_bm25():
    """Scores and order of every query over all its distinct terms, before and after documents are dropped."""
    rng = np.random.default_rng(3)
    docs = [rng.zipf(1.4, rng.integers(1, 120)).clip(0, 400).astype(np.uint16) for _ in range(150)]
    df = Counter(t for d in docs for t in set(d.tolist()))
    idf = np.array([np.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) for t in range(401)], np.float32)
    mean, unused = float(np.mean([len(d) for d in docs])), np.ones(len(docs), bool)

    def plain(query, k):
        tf, own = Counter(docs[k].tolist()), len(docs[k])
        return sum(float(idf[t]) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * own / mean)) for t in set(query.tolist()) if t in tf)

    index = packing.Bm25Shard(docs, idf, mean)
    for step in range(3):
        for query in docs[:40]:
            got = list(index.neighbours(query, unused))
            want = {k: plain(query, k) for k in range(len(docs)) if unused[k]}
            assert sorted(got) == [k for k, v in want.items() if v > 0]
            assert all(want[a] >= want[b] - 1e-4 for a, b in itertools.pairwise(got))
        unused[rng.integers(0, len(docs), 40)] = False
        index.forget(unused)


def test_packing_takes_the_best_neighbour():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 50, 20) for _ in range(5)]
    texts[3] = texts[0].copy()
    order = [k for k, *_ in packing.pack_shard([t.astype(np.uint16) for t in texts], np.ones(50, np.float32), 20.0, window=40)]
    assert order[:2] == [0, 3]


def test_fast_tokens_agree_on_latin():
    own = packing.tokens(queries.TOKENIZER, queries.RANKS, queries.PATTERN)
    for c in map(chr, range(256)):
        for text in (f"a{c}b", f" {c} ", f"{c}{c}1", f"'{c}", f"x{c}{c}", f"\n{c}\n"):
            assert own.ids(text).tolist() == own.exact.encode(text, add_special_tokens=False).ids
    assert own.ids(" " * 3_000_000)[:3].tolist() == own.exact.encode(" " * 3_000_000, add_special_tokens=False).ids[:3]


@needs_tables
def test_encoding_agrees_with_the_library(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(queries.RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.codec(queries.RANKS, queries.PATTERN)
    rng = random.Random(3)
    texts = [*docs.values(), "a" * 9000, "".join(rng.choice("abA 1é\n") for _ in range(20_000)), "ab" * 5000, "<|endoftext|>"]
    for text in texts:
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text) and own.decode(ids) == text.encode()


@needs_tables
def test_round_trip_digests(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(queries.RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op10_bitmap_bpe(spark, SF).collect():
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    for r in queries.op10_bitmap_bpe(spark, SF).collect():
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
    encoded = bpe.encode(spark.read.parquet(f"{SF}/documents.parquet"), queries.RANKS, queries.PATTERN)
    assert all(bytes(r["data"]) == docs[r["doc_id"]].encode() for r in bpe.decode(encoded, queries.RANKS, queries.PATTERN).collect())


def test_trie_counts_agree_with_dynamic_programming():
    trie = token_counts.SegmentTrie(token_counts.zipf_scores(bpe.load_ranks(queries.RANKS)))

    def brute(piece):
        best = [(0.0, 0)]
        for end in range(1, len(piece) + 1):
            found = (-1e99, 0)
            for start in range(end):
                if piece[start:end] in trie.scores and best[start][0] + trie.scores[piece[start:end]] > found[0]:
                    found = (best[start][0] + trie.scores[piece[start:end]], best[start][1] + 1)
            best.append(found)
        return best[-1][1]

    words = regex.findall(queries.PATTERN, "The quick, brown foxes' unbelievably internationalised café 12345!! " * 2 + "z" * 200)
    assert trie.count_words(Counter(words)) == sum(brute(w.encode()) for w in words)
    assert len(trie.best) < 1 + sum(len(w.encode()) for w in set(words))


@needs_tables
def test_token_counts_of_the_query(spark, docs):
    """Every row against a plain dynamic programme over each pre-token."""
    scores = token_counts.zipf_scores(bpe.load_ranks(queries.RANKS))
    longest, known = max(map(len, scores)), {}

    def plain(word):
        if word not in known:
            piece, best = word.encode(), [(0.0, 0)]
            for end in range(1, len(piece) + 1):
                found = [(best[s][0] + scores[piece[s:end]], -s, best[s][1] + 1) for s in range(max(0, end - longest), end) if piece[s:end] in scores]
                top = max(found)
                best.append((top[0], top[2]))
            known[word] = best[-1][1]
        return known[word]

    for r in queries.op3_trie_token_counts(spark, SF).collect():
        words = regex.findall(queries.PATTERN, docs[r["doc_id"]])
        assert (r["n_pretokens"], r["n_tokens"]) == (len(words), sum(map(plain, words)))


def test_long_and_many_pretokens_are_forgotten(monkeypatch):
    trie = token_counts.SegmentTrie({bytes([b]): -1.0 for b in range(256)})
    for at in range(0, 20_000, 1000):
        assert trie.count_words(Counter(f"{k:080d}" for k in range(at, at + 1000))) == 80_000
    assert not trie.known and len(trie.best) == 1
    monkeypatch.setattr(token_counts, "KNOWN", 500)
    for at in range(0, 5000, 100):
        assert trie.count_words(Counter(f"{k:06d}" for k in range(at, at + 100))) == 600
        assert len(trie.known) <= 600


@needs_tables
def test_pages_of_the_template(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        text = html_text.main_text(r["html"])
        assert text and "</" not in text and "&copy" not in text and "©" not in text.split("\n\n")[-1]
        plain = html_text.main_text(r["html"].replace("<article>", "<div>").replace("</article>", "</div>"))
        assert plain == text == html_text.main_text(r["html"], widen=False)


def marked_page(rng):
    """A page without an article element, and the main text that its author marks."""
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) + str(rng.randrange(99)) for _ in range(n))
    links = lambda n: "".join(f'<li><a href="/{rng.randrange(99)}">{words(2)}</a></li>' for _ in range(n))
    title, body = words(6), [words(rng.randrange(30, 90)) for _ in range(rng.randrange(3, 9))]
    blocks = "".join(f"<p>{p[:40]}<b>{p[40:60]}</b>{p[60:]}</p>" for p in body)
    boxes = [f"<ul>{links(12)}</ul>", f'<div class="sidebar"><h3>x</h3><ul>{links(5)}</ul></div>', f'<div id="comments"><p>{words(60)}</p></div>', f'<div class="cookie-notice">{words(9)} <a href="/c">ok</a></div>']
    rng.shuffle(boxes)
    at = rng.randrange(len(boxes) + 1)
    page = f'<html><body><div class="page">{"".join(boxes[:at])}<div class="story"><h1>{title}</h1>{blocks}</div>{"".join(boxes[at:])}</div></body></html>'
    return page, "\n\n".join([title, *body])


def test_marked_pages_without_article():
    rng = random.Random(11)
    for _ in range(60):
        page, text = marked_page(rng)
        assert html_text.main_text(page) == text


def test_an_article_loses_no_section():
    html = '<article><div class="article-header"><h1>Title</h1></div><p>a</p><section id="related-work"><h2 id="comments">R</h2><p>b</p></section><div class="side-effects"><p>c</p></div><p id="notice">d</p><div class="comments">x</div><div class="post-share-buttons">x</div><aside>x</aside><div id="comments">x</div></article>'
    assert html_text.main_text(html) == "Title\n\na\n\nR\n\nb\n\nc\n\nd"


@pytest.mark.parametrize("html", ["<article>" + "<b>x " * 100_000, "<div>" * 100_000 + "x" + "</i>" * 100_000, "<b><article>" + "<i>" * 100_000 + "t" + "</b>" * 100_000, "<p>" + "<li><p>x" * 50_000, "<a x='" * 100_000])
def test_unclosed_tags_take_linear_time(html):
    began = time.process_time()
    html_text.main_text(html)
    assert time.process_time() - began < 5


def test_density_choice_and_noise():
    body = "".join(f"<p>{'word ' * 40}{i}</p>" for i in range(4))
    links = "".join(f'<li><a href="/{i}">some link text {i}</a></li>' for i in range(30))
    html = f'<html><head><title>t</title></head><body><ul>{links}</ul><div id="content">{body}</div><div class="comments"><p>{"reader " * 90}</p></div><div class="cookie-notice">ok</div><form>search</form></body></html>'
    assert html_text.main_text(html) == "\n\n".join("word " * 40 + str(i) for i in range(4))
    assert html_text.main_text("<article><p>a<br>b <i>c</i>\n d<p>e &lt;x&gt;<script>if (a<b) {}</script></article>") == "a b c d\n\ne <x>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><p title=it's>One two</p><p>Three 'four'</p></article>", "One two\n\nThree 'four'"),
        ("<article><p title=\"a>b\" x='c>\"d'>Text</p></article>", "Text"),
        ('<article><p title="open>Text</p><p>More</p></article>', "Text\n\nMore"),
        ('<article><p a = "x>y" b=">">T', "T"),
        ("<article><p>1 < 2 and 3 > 2</p><p>end <", "1 < 2 and 3 > 2\n\nend <"),
    ],
)
def test_quotation_marks_in_tags(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("attributes", ['style="overflow: hidden"', 'href="/the-hidden-city"', 'title="the hidden truth"', "title='class=menu'", 'data-id="menu"', "data-class=menu", "href=/a/hidden", 'title="open hidden', "data-hidden"])
def test_names_inside_values_hide_nothing(attributes):
    assert html_text.main_text(f"<body><div {attributes}><p>One two</p></div></body>") == "One two"
    assert html_text.main_text(f"<article><p>One <a {attributes}>two</a></p></article>") == "One two"


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN", 'hidden=""', "x=1 hidden", 'title="a"hidden', "aria-hidden=true", "class=menu", "id = 'menu'", 'style="a: b" class="x menu"', "role=navigation"])
def test_whole_names_hide(attributes):
    assert html_text.main_text(f"<body><div><p>One two</p></div><div {attributes}>gone</div></body>") == "One two"


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>t</title><body><article><p>One two</p></article>", "<head><meta charset=x><script>a</script><style>b</style><div><p>One two</p></div>", "<html><head><link href=x><p>One two",
        "<html><head><title>t</title></head><body><p>One two</p></body></html>", "<html><head><title>t</title>\n <noscript>n</noscript>One two", "<html><head><title>t</title><article>One two</head></article>", "<head><head><title>t</title><body><p>One two",
    ],
)
def test_an_open_head_ends_where_the_body_starts(page):
    assert html_text.main_text(page) == "One two"


def test_scores_are_posteriors_of_two_gaussians():
    """Against log-densities from inverses and determinants."""
    rng = np.random.default_rng(8)
    d = len(quality_model.STATISTICS)
    rows = [rng.normal(size=(300, d)) @ rng.normal(size=(d, d)) * 0.5 + k for k in (0.0, 0.4)]
    model = quality_model.QuadraticDiscriminant.from_moments({k: (len(x), x.sum(0), x.T @ x) for k, x in enumerate(rows)}, pooled=0.3, ridge=0.01)
    every = np.concatenate(rows)
    centre, scale = every.mean(0), every.std(0)
    z = [(x - centre) / scale for x in rows]
    covs = [np.cov(x.T, bias=True) for x in z]
    within = sum(covs) / 2
    logs = []
    for own, cov in zip(z, covs, strict=True):
        cov = 0.7 * cov + 0.3 * within
        cov = 0.99 * cov + 0.01 * np.trace(cov) / d * np.eye(d)
        away = (every - centre) / scale - own.mean(0)
        logs.append(np.log(0.5) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away))
    assert np.allclose(model.score(every), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))), atol=1e-7)


@needs_tables
def test_held_out_quality(spark):
    sf = SF.replace("0.001", "0.1")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in queries.op5_quality_discriminant(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(quality_model.held_out_bucket(r["doc_id"]) == 1 for r in held)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.99


def test_rules_of_hosts_and_paths(spark):
    urls = {"http://x.example.org/es/a": "example.org/es/", "http://example.org/en/12": "example.org/en/1", "https://myexample.org/es/": "org/", "http://a.com/fr/x": "com/fr/", "http://a.com/de/": "com/de/", "http://a.com/dex": None, "org": None, "http://ORG/": "org/", "x://org?/": None}
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {list(urls)[r["page_id"]]: r["rule"] for r in url_filter.judge(df).collect()} == urls


def test_trees_learn_a_lexical_rule(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 7}.example.{'org' if k else 'net'}/{'9' * 12 if k else 'page'}/{rng.randrange(99)}") for i in range(400) for k in [rng.random() < 0.5]]
    rules = (("org", "/", "block"), ("net", "/", "allow"))
    judged = url_filter.judged_by_rules(spark.createDataFrame(rows, "page_id long, url string"), rules)
    model = url_filter.fit(judged)
    fresh = spark.createDataFrame([(1, "http://h1.example.io/999999999999/5"), (2, "http://h1.example.io/page/5")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(fresh, rules, model=model).collect()} == {1: "block", 2: "allow"}


def test_compiled_trees_agree_with_their_nodes(spark):
    rng = random.Random(4)
    rows = [(i, f"http://h{rng.randrange(9)}.example.{rng.choice(['org', 'net'])}/{rng.choice(['aa', 'b1', 'c'])}/{rng.randrange(9999)}?x={rng.randrange(9)}") for i in range(500)]
    rules = (("org", "/aa/", "block"), ("org", "/", "allow"), ("net", "/b1/", "block"))
    judged = url_filter.judged_by_rules(spark.createDataFrame(rows, "page_id long, url string"), rules)
    model = url_filter.fit(judged)
    scored = url_filter._with_rates(url_filter.lexical(judged.withColumns(url_filter._buckets())), model.rates, model.base_rate)
    want = {r["page_id"]: [float(r[c]) for c in url_filter.LEXICAL] for r in scored.collect()}

    def walk(tree, x):
        while tree.left is not None:
            tree = tree.left if x[tree.feature] <= tree.threshold else tree.right
        return tree.value

    for r in url_filter.probabilities(judged, model).collect():
        margin = sum(w * walk(t, want[r["page_id"]]) for w, t in model.trees)
        assert r["block_probability"] == pytest.approx(1 / (1 + np.exp(-2 * margin)), abs=1e-8)


def test_a_repeated_url_is_learnt_once(spark):
    """30,000 rows of one URL leave the other URLs in the sample."""
    rows = [(0, "http://hot.example.org/aa/1")] * 30_000 + [(i, f"http://h{i % 5}.example.org/{'aa' if i % 3 else 'bb'}/{i}") for i in range(1, 300)]
    rules = (("org", "/aa/", "block"), ("org", "/bb/", "allow"))
    judged = url_filter.judged_by_rules(spark.createDataFrame(rows, "page_id long, url string"), rules)
    model = url_filter.fit(judged, sample=200)
    assert model.trees and model.base_rate == pytest.approx(200 / 299, abs=0.01)


@needs_tables
def test_held_out_urls(spark):
    """Half of the distinct labelled URLs; the trees see the others only."""
    judged = url_filter.judged_by_rules(spark.read.parquet(f"{SF.replace('0.001', '0.1')}/pages.parquet"))
    half = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(2)) == 0
    model = url_filter.fit(judged.where(half))
    held = url_filter.probabilities(judged.where(~half & F.col("rule").isNotNull()), model).dropDuplicates(["url"])
    r = held.agg(F.avg(((F.col("block_probability") > 0.5) == (F.col("rule_verdict") == "block")).cast("int")).alias("right"), F.avg((F.col("rule_verdict") == "allow").cast("int")).alias("allow")).first()
    assert r["right"] > 0.95 > r["allow"]


def test_word_hashes_ignore_boundaries():
    words = lambda texts: [h.tolist() for _, h in shingles.word_hashes(texts)]
    assert words(["Ab c", "ab  C\n"]) == [words(["ab c"])[0]] * 2
    big = "word next " * 250_000
    assert words(["x", big, "y"])[1] == words(["word next"])[0] * 250_000
    assert words([None, ""]) == [[], []]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    own = minmax_dedup.permutations(400)
    a = np.unique(shingles.mix(rng.integers(0, 1 << 62, 900).astype(np.uint64)))
    b = np.concatenate([a[:700], shingles.mix(rng.integers(0, 1 << 62, 200).astype(np.uint64))])
    same = (minmax_dedup.signature(a, *own) == minmax_dedup.signature(b, *own)).mean()
    assert abs(same - 700 / 1100) < 0.05


def test_chain_of_links_is_one_component(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)]
    got = {r["node"]: r["component"] for r in minmax_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def word_sets(texts, n):
    return {k: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for k, t in texts.items() if (w := t.lower().split())}


def brute_components(sets):
    root = {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {k: low if r == high else r for k, r in root.items()}
    return root


def family(rng, n, fields, words, change):
    """Texts of one template; each of its fields is drawn anew with a chance of ``change``."""
    base = [f"t{i}" for i in range(6 * fields)]
    texts = {}
    for d in range(n):
        own = list(base)
        for k in range(0, len(own), 6):
            if rng.random() < change:
                own[k] = f"w{rng.randrange(words)}"
        texts[d] = " ".join(own)
    return texts


@pytest.mark.parametrize("change", [0.03, 0.08, 0.15, 0.5])
def test_groups_of_a_template_agree_with_brute_force(spark, change):
    texts = family(random.Random(7), 90, 40, 12, change)
    got = minmax_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shingle=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(word_sets(texts, 4))


def test_a_family_costs_fewer_comparisons_than_its_pairs(spark, monkeypatch):
    """300 documents of one template below the threshold: each pair is compared once at most."""
    texts, counted, confirm = family(random.Random(1), 300, 50, 60, 0.5), [], minmax_dedup.confirmed
    monkeypatch.setattr(minmax_dedup, "confirmed", lambda pairs, *a: (counted.append(pairs.count()), confirm(pairs, *a))[1])
    got = minmax_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shingle=4).collect()
    assert all(r["kept"] for r in got) and sum(counted) < 300 * 299 / 2 / 4


def test_copies_of_a_common_shingle_grow_less_than_its_square(spark, monkeypatch):
    """400 and 1,600 documents of one shingle: each pair of two components meets once, in stripes, with at most 8 times the copies."""
    monkeypatch.setattr(minmax_dedup, "STRIPE_PAIRS", 50)
    made = {}
    for m in (400, 1600):
        rng = random.Random(m)
        rows = [(1, d, d // 3, n := rng.randrange(20, 30), n - rng.randrange(5), d % 7) for d in range(m)]
        rows += [(2, *r[1:]) for r in rows[:4]]
        first = spark.createDataFrame(rows, "s long, doc_id long, c long, n int, room int, cell long")
        made[m] = minmax_dedup.dealt(first, block=4).count()
        if m == 400:
            got = [(r["a"], r["b"]) for r in minmax_dedup.candidates(first, 80, block=4).collect()]
            fit = {(p[1], q[1]) for p in rows[:m] for q in rows[:m] if p[1] < q[1] and p[2] != q[2] and 180 * min(p[4], q[4]) >= 80 * (p[3] + q[3])}
            assert len(set(got)) == len(got) and set(got) == fit
    assert made[1600] <= 8.1 * made[400] and made[400] <= 400 * 10 + 4


def test_hot_keys_join_like_any(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 500 + [2] * 3 + [3])], "k long, v long")
    info = rows.groupBy("k").count().where("k < 3").withColumn("x", F.col("k") * 10)
    for how, want in (("inner", 503), ("left", 504)):
        got = workspace.join_with_hot_keys(rows, info, "k", "count", 504 * workspace.HOT_KEYS // 40, how).collect()
        assert len(got) == want and all(r["x"] == r["k"] * 10 or r["k"] == 3 and r["x"] is None for r in got)
    wide = info.select("k", F.lit("w").alias("w"))
    assert sorted((r["k"], r["v"], r["w"]) for r in workspace.join_salted(rows, wide, "k", "v", part=7).collect()) == [(1, i, "w") for i in range(500)] + [(2, i, "w") for i in range(500, 503)]


def test_png_round_trip():
    for n in (0, 1, 64, 65, 5000):
        data = random.Random(n).randbytes(n)
        samples, length = media.from_png(media.to_png(media.pad(data), n))
        assert samples[:n] == data and length == n and len(samples) % 64 == 0 and len(samples) >= 64


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    rows, lines, above = rng.integers(0, 256, (3, 64)), [], np.zeros(64, int)
    for row in rows:
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], above[:-1]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        lines.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        above = row
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(name)))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 3, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert media.from_png(png)[0] == rows.astype(np.uint8).tobytes()


def test_ranges_and_retries(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(40)], "doc_id long, text string").coalesce(1)
    media.store(docs, f"file://{tmp_path}/m", archive_bytes=3000).collect()
    whole = {r["name"]: bytes(r["payload"]) for r in media.read_archives(spark, f"file://{tmp_path}/m").collect()}
    parts = media.read_archives(spark, f"file://{tmp_path}/m", range_bytes="500").collect()
    assert len(parts) == len(whole) == 40 and {r["name"]: bytes(r["payload"]) for r in parts} == whole
    fs, _ = media.open_store(f"file://{tmp_path}/m")
    path = sorted(Path(tmp_path, "m").glob("*.zip"))[0]
    reader = media.MemberReader(fs, str(path), attempts=3, wait=0)
    info, fails, read = reader.directory()[1], [OSError("lost"), ValueError("bad")], reader._at
    reader._at = lambda i: (_ for _ in ()).throw(fails.pop()) if fails else read(i)
    assert reader.member(info)[1] == 3
    raw = bytearray(path.read_bytes())
    raw[info.header_offset + 60] ^= 255
    path.write_bytes(raw)
    rows = media.read_archives(spark, f"file://{tmp_path}/m", on_error="row", attempts="1").collect()
    assert sum(r["error"] is not None for r in rows) == 1 and len(rows) == 40


def test_the_manifest_names_what_is_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").coalesce(1)
    media.store(docs, f"file://{tmp_path}/m", archive_bytes=600).write.parquet(f"{tmp_path}/manifest")
    stale = sorted(Path(tmp_path, "m").glob("*.zip"))[0]
    Path(tmp_path, "m", "part-000009-99-00000.zip").write_bytes(stale.read_bytes())
    Path(tmp_path, "m", "part-000009-99-00001.zip").write_bytes(b"no archive")
    got = media.read_archives(spark, f"file://{tmp_path}/m", manifest=f"file://{tmp_path}/manifest").collect()
    assert sorted(int(r["name"].removesuffix(".png")) for r in got) == list(range(20))
    rows = media.read_archives(spark, f"file://{tmp_path}/m", on_error="row", attempts="1").collect()
    assert [r["name"] for r in rows if r["error"]] == [None] and len(rows) > 20


def test_ranges_cover_every_byte_once():
    archives = [("a", 100), ("b", 7), ("c", 0), ("d", 250)]
    for size, most in ((30, 100), (30, 3), (1000, 5)):
        parts = media.plan_ranges(archives, size, most)
        spans = sorted(s for part in parts for s in part)
        assert len(parts) <= max(most, 1) + 1
        for name, total in archives:
            own, at = [s for s in spans if s[0] == name], 0
            for _, a, b in own:
                assert a == at < b
                at = b
            assert at == total


@needs_tables
def test_media_reads_back(spark, docs):
    for r in queries.op9_media_archive(spark, SF).collect():
        data = docs[r["doc_id"]].encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        stored = media.to_png(padded, len(data))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(padded))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


@needs_tables
def test_pipeline_is_its_stages(spark, docs):
    kept = {r["doc_id"] for r in queries.QUERIES["pipeline"](spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert kept < docs.keys() and not any(labels.get(k) == 0 for k in kept)
    words = {k: re.findall(r"[^ \t-\r]+", docs[k].translate({i: i + 32 for i in range(65, 91)})) for k in kept}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in words.items()}
    assert not [(a, b) for a in kept for b in kept if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
