"""Columns under the names that operators use inside, and pages that are very deep."""

import math
import time
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import html_text, language, near_dup
from barloom.llm.common import stage_columns

#: Names of columns inside the language and near-duplicate stages, now and before.
NAMES = (
    "host parent suffix declared row language_id host_counts parent_counts best counts _host _parent _suffix _declared _digest _id "
    "_least _most _node digest turn least most node component_id component known n_shingles rep sig d1 d2 key n pivot other size "
    "block body cluster home left right a b kept posterior text_score lang_pred first row_"
).split()


def crowded(spark, rows):
    """``doc_id, text, lang, source`` rows under one more column for each name, with a value of its own."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return stage_columns(docs.select("*", *(F.lit(f"value of {n}").alias(n) for n in NAMES)), "crowded")


def texts():
    rng = np.random.default_rng(8)
    words = "der die das und nicht ist eine mit auf für".split()
    french = "le la les des est une pas dans pour avec".split()
    make = lambda own: " ".join(rng.choice(own, 40)) + f" w{rng.integers(0, 10**9)}"
    rows = [(i, make(words if i % 2 else french), "de" if i % 2 else "fr", f"src{i % 3}.{'de' if i % 2 else 'fr'}") for i in range(60)]
    rows += [(100 + i, rows[i][1], *rows[i][2:]) for i in range(5)]  # copies
    return [*rows, (7, rows[9][1] + " more", "de", None), (200, None, None, None), (None, "der die das und nicht ist eine " * 5, "de", "src1.de")]


def check_values(df, kept):
    assert kept.columns == df.columns
    for r in kept.collect():
        assert all(r[n] == f"value of {n}" for n in NAMES)


def test_columns_keep_their_values_in_filters(spark):
    df = crowded(spark, texts())
    kept = language.keep_identified(df, languages=["de", "fr"])
    check_values(df, kept)
    plain = df.select("doc_id", "text", "lang", "source")
    want = language.keep_identified(plain, languages=["de", "fr"])
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in want.collect())
    judged = language.with_language(df, languages=["de", "fr"])
    assert judged.columns == [c for c in df.columns if c != "language_id"] + ["language_id"]
    assert {r.language_id.lang_pred for r in judged.collect()} <= {"de", "fr", "und"}
    once = near_dup.keep_one_of_each(df)
    check_values(df, once)
    assert Counter(r.doc_id for r in once.collect()) == Counter(r.doc_id for r in near_dup.keep_one_of_each(plain).collect())


def test_of_rows_equal_in_id_and_text_always_the_same_one_stays(spark):
    rows = [(1, "some text of a few words", n) for n in range(20)]
    found = set()
    for order in (1, -1, 3):
        docs = spark.createDataFrame(rows[::order] if order != 3 else rows[7:] + rows[:7], "doc_id long, text string, number long")
        found.add(tuple(r.number for r in near_dup.keep_one_of_each(docs).collect()))
    assert len(found) == 1 and len(next(iter(found))) == 1


def test_posteriors_equal_a_plain_recomputation(spark):
    languages = ["de", "fr"]
    rows = [r for r in texts() if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {(r.doc_id, r.text): r.language_id for r in language.with_language(docs, languages=languages).collect()}
    parts = language.address_parts(F.col("source"))
    own = docs.select("*", *(c.alias(f"p_{n}") for n, c in parts.items())).collect()
    model = language.fit_text_model(language.evidence(docs, "text", "lang", "source"), languages)
    best = [None if (s := language.text_evidence(model, r.text or "")) is None or s.max() < language.LEAST_TEXT else int(s.argmax()) for r in own]
    tables = {n: defaultdict(lambda: [0, 0]) for n in ("host", "parent", "suffix", "lang")}
    overall = [0, 0]
    for r, b in zip(own, best):
        if b is not None:
            overall[b] += 1
            for n, v in (("host", r.p_host), ("parent", r.p_parent), ("suffix", r.p_suffix), ("lang", r.lang)):
                tables[n][v][b] += 1
    for r in own:
        found = language.text_evidence(model, r.text or "")
        if found is None:
            assert got[r.doc_id, r.text].lang_pred == "und"
            continue
        share = [(c + 1) / (sum(overall) + 2) for c in overall]
        for n, v in (("suffix", r.p_suffix), ("parent", r.p_parent), ("host", r.p_host)):  # the suffix once
            if v is not None and v in tables[n] and (n != "suffix" or v):
                counts = tables[n][v]
                share = [(c + language.HOST_PULL * s) / (sum(counts) + language.HOST_PULL) for c, s in zip(counts, share)]
        log = [language.TEXT_WEIGHT * f + math.log(s) for f, s in zip(found, share)]
        if r.lang in tables["lang"] and r.lang:
            values = {v: c for v, c in tables["lang"].items() if v}
            totals = [sum(c[k] for c in values.values()) for k in range(2)]
            log = [x + math.log((values[r.lang][k] + 1) / (totals[k] + len(values) + 1)) for k, x in enumerate(log)]
        top = max(log)
        want = [math.exp(x - top) for x in log]
        assert abs(got[r.doc_id, r.text].posterior - max(want) / sum(want)) < 1e-9


def test_time_and_paths_of_deep_pages_stay_in_proportion():
    for page in ("<font>w " * 60_000, "<div>" * 30_000 + "deep" + "</div>" * 30_000, "<b><i>w </u>" * 30_000):
        began = time.process_time()
        tokens = html_text._page_tokens(page)
        assert time.process_time() - began < 6
        assert max(e[1].count("/") for e in tokens.values() if e[1]) < html_text.DEEPEST
    assert html_text.extract("<div>" * 5000 + "a<p>b</p>" + "</div>" * 5000) == ["a", "b"]


def test_masses_of_elements_add_up_to_the_page():
    page = "<html><body><div class=x>aa<p>bbb<p>c</div><div>dddd</div>" + "<div>" * 300 + "ee" + "</div>" * 300 + "</body></html>"
    tokens = html_text._page_tokens(page)
    masses = {e[1]: e[4] for e in tokens.values() if e[0] == "open"}
    assert tokens[0][4] == masses["html"] == masses["html/body"] == 12 and masses["html/body/div.x||"] == 6
