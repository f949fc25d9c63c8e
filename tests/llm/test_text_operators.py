"""Toxicity, repetition rules, HTML and quality."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np

import pytest

from skein.llm import html, quality, repetition, toxicity
from skein.llm.common import table


def brute_repetition(words):
    n = len(words)
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    windows = {j for i in range(n - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    covered, longest = set(), 0
    for i in range(n):
        for j in range(n):
            h = 0
            while i != j and max(i, j) + h < n and words[i + h] == words[j + h]:
                h += 1
            if h >= repetition.MIN_REPEAT:
                covered |= set(range(i, i + h))
                longest = max(longest, h)
    return len(windows), len(covered), longest


def test_repetition_against_all_pairs():
    r = random.Random(3)
    texts = [[], [b"a"], [b"a"] * 7, [b"a"] * 40]
    for k in range(120):
        words = [r.choice(b"abcdefgh"[: r.choice([1, 2, 3, 8])].decode()).encode() for _ in range(r.randint(0, 60))]
        texts.append(words + words[5:18] + words[:9] if k % 3 == 0 else words)
    got = list(zip(*repetition.repetition(texts), strict=True))
    assert got == [brute_repetition(t) for t in texts]
    one_by_one = [tuple(int(x[0]) for x in repetition.repetition([t])) for t in texts]
    assert one_by_one == got


def test_suffix_ranks_sort_suffixes():
    words = [3, 1, 3, 1, 3, 1, 2]
    rank, _ = repetition.suffix_ranks(np.array(words), np.full(7, 7), (2,))
    assert sorted(range(7), key=lambda i: words[i:]) == np.argsort(rank).tolist()


def test_rules_edges(edge, edge_rows, no_rows):
    got = sorted(tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in repetition.rules(edge).collect())
    want = []
    for _, t, *_ in edge_rows:
        words = (t or "").encode().split()
        n = len(words)
        repeated = brute_repetition(words)[0] if n < 100 else n - 1  # the long text: one word at its end occurs once
        want.append((n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t or ""), 0, repeated, n < 50 or 100 * repeated > 50 * n))
    assert got == sorted(want)
    assert repetition.rules(no_rows).count() == 0


def test_rules_verdict(spark):
    clean = " ".join(f"w{i}" for i in range(300))
    block = " ".join(f"b{i}" for i in range(60))
    rows = [(1, clean), (2, f"{clean}\n{block} {block} {block} {block}"), (3, "same line\nsame line\n \n \nother"), (4, f"{clean} {clean}")]
    got = {r.doc_id: r for r in repetition.rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and not got[2].kept and not got[2].base_failed and got[2].longest_repeat == 180
    assert got[3].n_dup_lines == 1 and got[3].base_failed and got[4].base_failed


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style></head><body class="no-sidebar"><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies, ok?</div><nav><ul><li><a href=/>Home</a></ul></nav><div class="wrap"><div class="sidebar"><p>Side, text, here, more</p></div>
<article><div class='article-header'><h1>Head &amp; line</h1></div><div class='site alert'>Notice!</div><p>First para, with   commas, and&nbsp;more.<p>Second<br>line <b>bold<p>Third</b> <i>it<ul><li>one</li><li>two</ul>
<table><tr><td>c1<td>c2</table><blockquote>quote</blockquote><div class="ad">Buy!</div><form><input>Name</form><section id="comments"><p>Nice, article, thanks, bye</p></section></article>
</div><footer>f</footer><script>if(a<b){"</p>"}</script></body>"""


def test_html_page():
    assert html.main_text(PAGE).split("\n") == ["Head & line", "First para, with commas, and more.", "Second line bold", "Third it", "one", "two", "c1", "c2", "quote"]


def test_html_without_article():
    body = "".join(f"<p>Sentence number {i}, with a comma, and some more words to count.</p>" for i in range(5))
    page = f"<div id=menu><a href=a>one</a><a href=b>two</a></div><div><h2>Title</h2><div class=text>{body}</div><div class='related links'><a>x</a></div></div>"
    assert html.main_text(page).split("\n")[0] == "Title" and html.main_text(page).count("\n") == 5 and "two" not in html.main_text(page)


def test_html_edges(spark):
    assert [html.main_text(x) for x in (None, "", "plain & simple\n text", "<p>a" + "<div>" * 3000 + "b", "<script>never closed", "<p", "a<b", "<p>&lt;p&gt; &#233;&eacute;")] == ["", "", "plain & simple text", "a\nb", "", "<p", "a<b", "<p> éé"]
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "c"), (1, "u", "<p>x</p>", "c"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html.extract(pages).na.fill("-").na.fill(-1).collect())) == [(-1, "-", "", 0), (1, "u", "x", 1), (1, "u", "x", 1)]
    assert html.extract(pages.limit(0)).count() == 0


def test_toxic_texts_are_found(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    known = labels.where("crc32(cast(doc_id as string)) % 3 <> 0")
    out = toxicity.grade(docs, toxicity.fit(docs, known)).toPandas().merge(labels.toPandas(), on="doc_id")
    held = out[[zlib.crc32(str(i).encode()) % 3 == 0 for i in out.doc_id]]
    assert held[held.toxic_y == 0].toxic_x.mean() < 0.03
    assert held[held.toxic_y == 1].toxic_x.mean() > 0.6  # in English and three other languages, from some 30 examples
    assert ((out.severity >= 0) & (out.severity <= 3)).all() and out.grade.between(0, 3).all()


def labelled(spark, texts, toxic):
    rows = list(enumerate(texts))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")


def test_cumulative_link_orders_grades(spark):
    r = random.Random(1)
    texts, toxic = [], []
    for _ in range(400):
        n = r.choice([0, 0, 0, 1, 3, 8])
        texts.append(" ".join([f"w{r.randrange(500)}" for _ in range(40)] + ["insultword"] * n))
        toxic.append(int(n > 0))
    m = toxicity.fit(*labelled(spark, texts, toxic))
    p = m.above(np.array([m.margin("insultword " * n) for n in (0, 1, 3, 8)]))
    assert (np.diff(m.thresholds) > 0).all() and (np.diff(p.sum(axis=1)) > 0).all()
    assert p[0, 0] < 0.5 < p[1, 0] and p[3].sum() > 1.5


def brute_toxicity(pairs, most):
    """The model by definition, with every text in memory."""
    pairs = sorted(set(pairs), key=lambda p: (hashlib.md5((p[0] or "").encode()).digest(), p[1]))
    words = [re.findall(r"[^\W\d_]+", (t or "").lower()) for t, _ in pairs]
    of = lambda w: {w + "$"} | {w[:n] for n in (4, 5, 6, 7) if len(w) >= n}
    y = np.array([v for _, v in pairs])
    holds = [set().union(*map(of, ws)) for ws in words]
    toxic = collections.Counter(f for h, v in zip(holds, y, strict=True) if v for f in h)
    clean = collections.Counter(f for h, v in zip(holds, y, strict=True) if not v for f in h)
    lift = {f: math.log((n + 0.5) / (y.sum() + 1)) - math.log((clean[f] + 0.5) / (len(y) - y.sum() + 1)) for f, n in toxic.items() if n >= max(2, int(0.01 * y.sum()))}
    names = sorted((f for f in lift if lift[f] > math.log(4)), key=lambda f: (-round(toxic[f] * lift[f], 9), f))[:most]
    typical = {f for f in names if toxic[f] > 9 * clean[f]}
    grade = [0 if not v else 1 if n <= 1 else 2 if n <= 4 else 3 for v, n in ((v, sum(bool(of(w) & typical) for w in ws)) for ws, v in zip(words, y, strict=True))]
    cells = [(i, names.index(f), math.log1p(n)) for i, ws in enumerate(words) for f, n in collections.Counter(f for w in ws for f in of(w)).items() if f in set(names)]
    row, col, value = map(np.array, zip(*cells, strict=True))
    w, t = toxicity.fit_cumulative(row, col, value, len(names), np.array(grade), 0.2, 500)
    return {f: x for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, t


def test_fit_matches_brute_force(spark):
    r = random.Random(7)
    bad = ["stupid", "stupidly", "Vermin", "scum", "ИДИОТ"]
    texts = [" ".join([f"{r.choice(['stuff', 'green', 'Walk', 'été'])}{'abcdefg'[: r.randrange(8)]}" for _ in range(30)] + r.choices(bad, k=r.choice([0, 0, 1, 3, 6]))) for _ in range(150)]
    toxic = [int(any(b.lower() in t.lower() for b in bad)) if i % 9 else r.randrange(2) for i, t in enumerate(texts)]
    texts, toxic = [*texts, *texts[:20], None, "", ""], [*toxic, *toxic[:20], 0, 1, 0]  # copies count once
    model = toxicity.fit(*labelled(spark, texts, toxic))
    weights, thresholds = brute_toxicity([(t or "", v) for t, v in zip(texts, toxic, strict=True)], toxicity.MAX_FEATURES)
    assert len(weights) > 5 and model.weights.keys() == weights.keys()
    assert all(math.isclose(model.weights[f], w, rel_tol=1e-6, abs_tol=1e-8) for f, w in weights.items()) and np.allclose(model.thresholds, thresholds)


def test_repeated_ids_keep_the_fit_bounded(spark):
    """One labelled id with many texts: those of the least digests are used, the same at each run."""
    docs = spark.createDataFrame([(1, f"vermin number {'abcdefghij'[i % 10] * (i + 4)}") for i in range(60)] + [(i, f"calm words {'klmnopq'[i % 7] * i}") for i in range(2, 12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 12)], "doc_id long, toxic int")
    fits = [toxicity.fit(d, labels, max_rows=11) for d in (docs, docs.repartition(5))]
    assert fits[0].weights == fits[1].weights and fits[0].weights["vermin$"] > 0


def test_toxicity_edges(spark, edge, edge_rows, no_rows):
    model = toxicity.Model({"bad$": 5.0}, np.array([2.0, 3.0, 4.0]))
    out = toxicity.grade(edge, model).collect()
    assert len(out) == len(edge_rows) and not any(r.toxic for r in out)
    assert toxicity.grade(no_rows, model).count() == 0 and toxicity.keep(edge, model).columns == edge.columns
    labels = spark.createDataFrame([(1, None), (None, 1), (99, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.fit(edge, labels).weights == {} and toxicity.fit(no_rows, labels).weights == {}
    assert toxicity.word_counts("ab " * 600_000)["ab"] == 600_000


def test_quality_held_out(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(docs, labels)
    out = docs.select("doc_id", quality.held_out(docs.doc_id).alias("h"), quality.score(docs.text, model).alias("s")).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (out.h == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    held = out[out.h]
    assert (held[held.quality == 1].s >= 0.7).mean() > 0.9 and (held[held.quality == 0].s >= 0.7).mean() < 0.2


def test_discriminant_matches_the_formula():
    r = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = {c: r.normal(c, 1 + c, (400, d)) @ r.normal(0, 1, (d, d)) for c in (0, 1)}
    model = quality.solve({c: (len(v), v.sum(axis=0), v.T @ v) for c, v in x.items()})
    z = (x[1][:5] - model.centre) / model.scale
    for k in range(5):
        logs = []
        for c in (0, 1):
            cov = model.factors[c] @ model.factors[c].T
            gap = z[k] - model.means[c]
            logs.append(-0.5 * (gap @ np.linalg.inv(cov) @ gap + np.linalg.slogdet(cov)[1]))
        want = 1 / (1 + math.exp(-(logs[1] - logs[0] + math.log(model.prior / (1 - model.prior))) / quality.TEMPERATURE))
        assert math.isclose(model.score(x[1][k : k + 1])[0], want, rel_tol=1e-6, abs_tol=1e-12)


def test_quality_edges(spark, edge, edge_rows, no_rows):
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, quality int")
    model = quality.fit(edge, labels)
    assert model.means is None and 0 < model.prior < 1
    full = quality.solve({c: (50, v.sum(axis=0), v.T @ v) for c, v in ((0, quality.statistics(["!! A b"] * 50)), (1, quality.statistics([f"word {i} and some more" * (i % 5) for i in range(50)])))})
    for m in (model, full):
        scores = [r[0] for r in edge.select(quality.score(edge.text, m)).collect()]
        assert len(scores) == len(edge_rows) and all(0 <= s <= 1 for s in scores)
    assert quality.keep(no_rows, full).count() == 0 and quality.keep(edge, full, threshold=0.0).columns == edge.columns
    assert np.isfinite(quality.statistics([None, "", " ", "x" * 100_000, "é\n\n"])).all()


HOSTILE = {
    "open tags": lambda n: "<a" * (n // 2), "attributes": lambda n: "<a " + "x=1/ " * (n // 5) + '"', "sections": lambda n: "<![CDATA[" * (n // 9), "nested": lambda n: "<div>" * (n // 5) + "text here, and more",
    "inline": lambda n: "<p>" + "<b>" * (n // 3) + "text", "quotes": lambda n: '<a x="y>" ' * (n // 10), "odd quotes": lambda n: '<a p="<b" ' * (n // 10) + "q='", "titles": lambda n: "<title>x" * (n // 8),
    "items": lambda n: "<li><ul>" + "<div>" * (n // 10) + "<li>x</li>" * (n // 20), "ends": lambda n: "<div>" * (n // 10) + "</x>" * (n // 8), "reference": lambda n: "&#" + "9" * n + ";", "comments": lambda n: "<!--" * (n // 4),
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_time_is_linear_in_a_page(kind):
    began = time.process_time()
    html.main_text(HOSTILE[kind](1 << 20))
    assert time.process_time() - began < 8  # a square would take hours


#: Pages and the blocks a reader would call the article.
LABELLED = [
    ("<body><form action='/'><div class='menu'><a href=1>Home</a></div><div><p>One, two, three.</p><p>Four, five and six.</p><p>Seven, eight, nine.</p></div><input></form></body>", ["One, two, three.", "Four, five and six.", "Seven, eight, nine."]),
    ("<article><h1>Sources</h1><p>All of them, in order of age.</p><ul><li><a href=1>First book</a></li><li><a href=2>Second book</a></li><li><a href=3>Third book</a></li></ul></article>", ["Sources", "All of them, in order of age.", "First book", "Second book", "Third book"]),
    ("<div id=nav><ul><li><a href=1>News</a><li><a href=2>Sport</a></ul></div><main><article><div><div><div><p>Deep in here, far from the top.</p><p>And once more, to be sure.</p></div></div></div></article></main><div class=comments><p>First, haha, what a read, friends.</p></div>", ["Deep in here, far from the top.", "And once more, to be sure."]),
    ("<p title='a > b'>Quoted &gt; sign, &amp; more.</p><p class=\"x>Lost quote, text goes on.</p>", ["Quoted > sign, & more.", "Lost quote, text goes on."]),
    ("<body><div><a href=1>Top</a> <a href=2>List</a> <a href=3>About</a></div><p>Plain page, no container at all.</p></body>", ["Plain page, no container at all."]),
    ("<article><p>Before, the text.</p><div class='advert'>Buy now, cheap</div><aside>See also</aside><form><label>Mail</label><input></form><p>After, the text.</p><footer>Contact</footer></article>", ["Before, the text.", "After, the text."]),
]


def test_labelled_pages_word_by_word():
    hit = found = wanted = 0
    for page, blocks in LABELLED:
        got, want = (collections.Counter(x.split()) for x in (html.main_text(page), "\n".join(blocks)))
        hit, found, wanted = hit + (got & want).total(), found + got.total(), wanted + want.total()
        assert html.main_text(page) == "\n".join(blocks)
    assert hit / found == hit / wanted == 1
