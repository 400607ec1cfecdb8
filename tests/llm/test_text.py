"""Extraction, languages, quality, licenses and the pipeline."""

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import html_text, language, licenses, near_dup, packing, quality
from barloom.llm.grams import BUCKETS, gram_buckets
from tests.llm.cases import SF, documents, empty_documents, plain

# ---- html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";x(0)</script></head>
<body><header><a href="/">Home</a></header><nav><ul><li>Menu</li></ul></nav><!-- ad --><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p><b>First
 block &lt;x&gt;<br><p>Second&nbsp;block</p><aside>Side</aside><form><input>Send</form><p>Third <i>one</i>.</p>
<section class="comments"><p>Nice</p></section></article><footer>&copy; foot</footer></body></html>"""


def test_blocks_of_an_article():
    want = ["Head & line", "First block <x>", "Second block", "Third one."]
    assert html_text.extract(PAGE) == want
    assert html_text.extract(PAGE, "html/body/article") == want
    # cut off anywhere, blocks before the cut are still right
    cut = PAGE.index("Third <i>") + 8
    assert html_text.extract(PAGE[:cut]) == [*want[:3], "Third"]


@pytest.mark.parametrize("page", ["", "plain text", "<p", "<", "a < b & c", "<!-- never closed", "<script>x", "</p></div>", "<a title='x>y'>z</a>"])
def test_broken_pages_give_something(page):
    got = html_text.extract(page)
    assert all(b and b == " ".join(b.split()) for b in got)
    if page == "a < b & c":
        assert got == ["a < b & c"]


def test_template_finds_the_region_without_an_article_tag(spark):
    page = (
        "<html><body><div class='top'>Site name</div><div class='body-text'><p>{a}</p><p>{b}</p></div>"
        "<div class='low'>All rights of the site</div></body></html>"
    )
    rows = [(i, f"http://a.example.com/{i}", page.format(a=f"alpha {i} " * 9, b=f"beta {i * 7} " * 5)) for i in range(8)]
    rows += [(50, None, None), (51, "http://b.example.com/x", PAGE), (51, "http://b.example.com/x", PAGE)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    found = {r.host: r for r in html_text.templates(pages.select(html_text.host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))).collect()}
    assert found["a.example.com"].region == "html/body/div.body-text||"
    got = Counter(tuple(r) for r in html_text.main_text(pages).collect())
    for i in range(8):
        text = "\n".join([" ".join(f"alpha {i} ".split() * 9), " ".join(f"beta {i * 7} ".split() * 5)])
        assert got[i, f"http://a.example.com/{i}", text, len(text)] == 1
    text = "\n".join(html_text.extract(PAGE))
    assert got[51, "http://b.example.com/x", text, len(text)] == 2 and got[50, None, "", 0] == 1
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    import html as references

    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S).group(1)
        blocks = [" ".join(references.unescape(re.sub(r"<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner.replace("<b>", "").replace("</b>", ""))]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def texts_of_host(spark, pages):
    rows = [(i, f"http://a.example.com/{i}", page) for i, page in enumerate(pages)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_region_is_found_by_its_whole_path(spark):
    page = "<html><body><div class='top'>Site name</div><div><p>alpha {0} x</p><p>beta {0} y</p></div></body></html>"
    assert texts_of_host(spark, [page.format(i) for i in range(8)]) == [f"alpha {i} x\nbeta {i} y" for i in range(8)]
    # the element that a path names, not the first of that name
    nested = "<html><body><section><div>Start</div></section><div><div><p>alpha {0}</p></div><div class='x'>fix</div></div></body></html>"
    assert texts_of_host(spark, [nested.format(i) for i in range(8)]) == [f"alpha {i}" for i in range(8)]
    cells = "<table><tr><td>Menu of the site</td><td><p>alpha {0}</p><p>beta {0}</p></td></tr></table>"
    assert texts_of_host(spark, [cells.format(i) for i in range(8)]) == [f"alpha {i}\nbeta {i}" for i in range(8)]


def test_region_holds_a_heading_beside_one_long_paragraph(spark):
    page = "<html><body><div>Site name</div><section><h2>Head {0}</h2><p>{1}</p></section><div>Low</div></body></html>"
    texts = texts_of_host(spark, [page.format(i, f"long {i} " * 80) for i in range(8)])
    assert texts == [f"Head {i}\n" + " ".join(f"long {i}".split() * 80) for i in range(8)]


def test_template_is_taken_out_of_the_region(spark):
    """Text that repeats on all pages under any class goes, what stands on one page alone stays."""
    page = (
        "<html><body><article><h1>Head {0}</h1><div class='zz'>Join our list today</div><p>By <a>writer {0}</a></p>"
        "<div class='social'>Follow us</div><p>body {0}</p><p>Advertisement</p>{1}<p>end {0}</p><p>Advertisement</p></article></body></html>"
    )
    extra = "<div class='notice'>Only here</div><math><mi>x</mi></math><div class='comments-section'>Nice</div>"
    texts = texts_of_host(spark, [page.format(i, extra if i == 3 else "") for i in range(8)])
    for i, text in enumerate(texts):
        own = ["Only here", "x"] if i == 3 else []
        assert text.split("\n") == [f"Head {i}", f"writer {i}", f"body {i}", *own, f"end {i}"]


def test_copies_of_a_page_are_no_template(spark):
    page = "<html><body><article><h1>Head {0}</h1><p>text {0}</p></article></body></html>"
    texts = texts_of_host(spark, [page.format(0)] * 6 + [page.format(1), page.format(2)])
    assert texts == [f"Head {i}\ntext {i}" for i in [0] * 6 + [1, 2]]
    # a page of nothing but template text is read by markup
    same = "<html><body><article><p>text</p></article>{0}</body></html>"
    assert texts_of_host(spark, [same.format(f"<nav>{i}</nav><!-- {i} -->") for i in range(5)]) == ["text"] * 5


def test_compound_names_are_dropped():
    page = "<article><p>a</p>{}<p>b</p></article>"
    for name in ("comments-section", "related-posts", "ad-slot", "cookie-banner", "share__list"):
        assert html_text.extract(page.format(f"<div class='{name}'>no</div>")) == ["a", "b"]
    assert html_text.extract(page.format("<div class='ad-free'>yes</div><div class='address-line'>too</div>")) == ["a", "yes", "too", "b"]


# ---- quality


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def labels(spark):
    ids = [r.doc_id for r in documents(spark).where("doc_id >= 100 and doc_id < 130").select("doc_id").collect()]
    return spark.createDataFrame([(i, 1, 0, "x") for i in ids] + [(None, 1, 0, "x"), (131, None, None, "x")], "doc_id long, quality int, toxic int, text string")


def test_quality_scores(spark):
    docs = documents(spark, [(5000, "rep eat ed words here now " * 9 + "x y z"), (5001, "a\nb\na\n\n\na\n b\nb"), (5002, "$$ ## | " * 40)])
    rows = quality.quality_scores(docs, labels(spark)).collect()
    texts = plain(docs)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == Counter(
        (d, *brute_base(t)) for d, t in texts
    )
    trusted_ids = {r.doc_id for r in labels(spark).collect() if r.quality == 1}
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for d, t in texts:
        counts = np.bincount(gram_buckets(t.encode()), minlength=BUCKETS)
        raw += counts
        if d in trusted_ids and d is not None:
            trusted += counts
    ratio = np.log((trusted + 0.5) / (trusted.sum() + 0.5 * BUCKETS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * BUCKETS))
    by_id = {}
    for d, t in texts:
        g = gram_buckets(t.encode())
        by_id[d] = (ratio[g].mean() if len(g) else 0.0, brute_base(t)[5])
    for r in rows:
        score, failed = by_id[r.doc_id]
        assert r.log_ratio == pytest.approx(score, abs=1e-9)
        assert r.kept == (not failed and r.log_ratio >= quality.THRESHOLD)
    kept = quality.keep_good(docs, labels(spark))
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)


def test_quality_without_labels_or_documents(spark):
    none = labels(spark).limit(0)
    rows = quality.quality_scores(documents(spark), none).collect()
    assert all(r.log_ratio == 0 and r.kept == (not r.base_failed) for r in rows)
    assert quality.quality_scores(empty_documents(spark), none).count() == 0


def test_quality_on_held_out_labels(spark):
    """Fitted on labelled rows of one table, measured on another one's."""
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    ratios = quality.fit_ratios(docs, marks)
    rows = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    base = {r.doc_id: quality.base_counts(r.text)[5] for r in rows}
    kept = {r.doc_id: not base[r.doc_id] and quality._mean(ratios, r.text) >= quality.THRESHOLD for r in rows}
    good = [kept[r.doc_id] for r in rows if r.quality == 1 and not base[r.doc_id]]
    bad = [kept[r.doc_id] for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.1


# ---- language


def test_languages_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.99
    assert np.mean([r.kept for r in rows]) > 0.98


def test_languages_of_odd_rows(spark):
    docs = documents(spark, [(6001, "Страница на другом языке " * 30)]).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.col("lang")))
    rows = language.identify(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in plain(docs))
    by_id = {r.doc_id: r for r in rows}
    assert not by_id[0].kept and by_id[0].lang_pred == "und" and not by_id[6001].kept
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)
    assert language.identify(empty_documents(spark)).count() == 0


def test_evidence_is_fused(spark):
    """Ambiguous text is decided by declaration, suffix and the host's other pages."""
    german, french = "der die das und nicht ist eine " * 20, "le la les des est une pas dans " * 20
    rows = []
    for i in range(40):
        rows.append((i, german, "de", f"http://a{i % 4}.beispiel.de/{i}"))
        rows.append((100 + i, french, "fr-FR", f"http://b{i % 4}.exemple.fr/{i}"))
    rows += [(500, "xq", "de", "http://a0.beispiel.de/x"), (501, "xqz", "de", "http://a0.beispiel.de/x"), (502, "xqz", "fr", "http://b1.exemple.fr/x"), (503, "xqz", None, "http://b1.exemple.fr/y"), (504, "xqz", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, declared string, url string")
    found = language.with_language(pages, text="html", declared="declared", address="url", languages=["de", "fr"])
    got = {r.page_id: r.language_id for r in found.collect()}
    assert all(got[i].lang_pred == "de" and got[100 + i].lang_pred == "fr" for i in range(40))
    assert got[500].lang_pred == "und"
    best = {i: got[i].posterior for i in (501, 502, 503, 504)}
    assert best[501] > 0.9 and best[502] > 0.9 and best[503] > best[504]


def test_markup_language(spark):
    pages = [
        ('<!-- <html lang="xx"> --><HTML class=a LANG="de-AT">', "de-AT"),
        ("<html xml:lang=fr>", "fr"),
        ("<html data-x='1'><meta content='es' http-equiv='Content-Language'>", "es"),
        ("<html hreflang='en'><p lang='de'>", ""),
        (None, ""),
    ]
    df = spark.createDataFrame(pages, "html string, want string")
    assert all(r.got == r.want for r in df.select("want", language.html_language(F.col("html")).alias("got")).collect())
    codes = spark.createDataFrame([("deu",), ("ENG",), ("fre-CA",), ("spa",), ("nob",)], "c string")
    assert [r[0] for r in codes.select(language._declared(F.col("c"))).collect()] == ["de", "en", "fr", "es", "nob"]


def test_languages_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: re.search(r'<html lang="(\w+)"', r.html).group(1) for r in pages.collect()}
    rows = language.identify_pages(pages).collect()
    assert {r.page_id for r in rows} == set(want)
    assert np.mean([r.lang_pred == want[r.page_id] for r in rows]) > 0.95


@pytest.mark.parametrize("declared", [None, "long", "but one"])
def test_languages_that_nothing_declares(spark, declared):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    codes = {"de": "deu", "en": "eng", "es": "spa", "fr": "fra"}
    if declared is None:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    elif declared == "long":
        docs = docs.replace(codes, subset=["lang"])
    else:
        docs = docs.withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    rows = language.identify(docs).collect()
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.95
    assert np.mean([r.kept for r in rows]) > 0.95


def test_addresses(spark):
    urls = ["https://User@M.Site.co.uk:80/p?q#r", "src7", "//x.de/", None, "http://"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [tuple(r) for r in df.select(*language.address_parts(F.col("u")).values()).collect()]
    assert got == [("m.site.co.uk", "co.uk", "uk"), ("src7", "", ""), ("x.de", "x.de", "de"), ("", "", ""), ("", "", "")]


# ---- licenses


def brute_phrases(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    starts, found = [], set()
    for phrase, label in licenses.PHRASES.items():
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                starts.append(i)
                found.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(found))


def test_license_scan(spark):
    extra = [
        (7000, "Released under the MIT License. Under the MIT license, Apache License, Version 2.0; CC-BY-NC cc by nc"),
        (7001, "Released undr the MIT Licence."),
        (7002, "Permission is hereby grantd, free of charge, to any persons obtaining a copy"),
        (7003, "under the mit"),
        (7004, "x " * 5000 + "Licensed under the Apache Licence, Version 2,0"),
    ]
    docs = documents(spark, extra)
    rows = licenses.license_scan(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == Counter(
        (d, *brute_phrases(t)) for d, t in plain(docs)
    )
    by_id = {r.doc_id: r for r in rows}
    assert by_id[7000].labels == "apache-2,cc-by-nc,mit" and by_id[7000].score == 1
    for doc_id, label in [(7001, "mit"), (7002, "mit"), (7004, "apache-2")]:
        r = by_id[doc_id]
        assert r.base_labels == "" and r.labels == label and 0.8 < r.score < 1
        assert r.notices and all(n.edits > 0 for n in r.notices)
    assert by_id[7003].labels == "" and by_id[7003].score == 0
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in rows)
    assert licenses.license_scan(empty_documents(spark)).count() == 0


def test_worse_hits_before_the_best_one_are_found():
    scanner = licenses.NoticeScanner(licenses.NOTICES)
    texts = ["released undar the mit licence", "released under the mit license", "releasd under the mit license"]
    for order in ([0, 1], [1, 0], [0, 2, 1], [0, 0, 2, 1, 2]):
        found = scanner.scan(" zz ".join(texts[i] for i in order))
        assert [f[3] for f in found] == [[2, 0, 1][i] for i in order]
        assert all(a[2] <= b[1] for a, b in zip(found, found[1:], strict=False))


def test_every_bounded_edit_is_found():
    import random

    scanner = licenses.NoticeScanner(licenses.NOTICES)
    draw = random.Random(4)
    for notice, label in licenses.NOTICES.items():
        edits = max(1, len(notice) // licenses.CHARS_PER_EDIT)
        for _ in range(20):
            text = list(notice)
            for _ in range(edits):
                at = draw.randrange(len(text))
                text[at] = draw.choice(["", "q", text[at] + "q"])
            found = scanner.scan("some words before " + "".join(text) + " and after")
            assert label in {f[0] for f in found}


# ---- pipeline


def test_pipeline_equals_its_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    out = corpus_pipeline.run(spark, SF)
    first = language.identify(docs).where("kept").select("doc_id")
    left = docs.join(first, "doc_id", "left_semi").select(*docs.columns).cache()
    second = quality.quality_scores(left, marks).where("kept").select("doc_id")
    left = left.join(second, "doc_id", "left_semi").select(*docs.columns).cache()
    third = near_dup.near_duplicates(left, 5).where("kept").select("doc_id")
    ids = {r.doc_id for r in third.collect()}
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == ids
    assert 0 < len(ids) < docs.count()
    assert out.columns == [c.split(" ")[0] for c in packing.PIECES.split(", ")]


def test_stages_keep_the_columns(spark):
    docs = documents(spark).withColumn("n_chars", F.length("text"))
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert rows.columns == docs.columns, name
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
