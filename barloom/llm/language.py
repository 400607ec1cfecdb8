"""Language identification by Bayesian fusion of four kinds of evidence.

* text: likelihood of its hashed byte trigrams under each language. Neighbouring trigrams are not
  independent, so the mean log-likelihood counts as ``TEXT_WEIGHT`` observations;
* declared language: how often a language's texts carry each declaration;
* address suffix: the same for the last label of the host name, where it is a country code;
* host: share of each language among the texts of the host, smoothed towards its parent domain,
  which is smoothed towards its suffix, then towards the whole corpus.

Everything is counted over all rows. Three passes: trigram counts per language (a class is what a
row declares), then evidence tables from the text alone, then the fused decision. A language that no
row declares is learned from the rows without a known declaration whose commonest function words are
its own.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import sliced
from barloom.llm.grams import BUCKETS, count_vectors, gram_buckets, gram_counts

#: Languages that are told apart; others are rejected.
LANGUAGES = ["de", "en", "es", "fr"]
UNKNOWN = "und"
TEXT_WEIGHT = 20.0
#: Rows of the parent that each level of the host hierarchy adds to its own counts.
HOST_PULL = 20.0
#: Posterior below which a document is rejected.
LEAST_POSTERIOR = 0.6
#: Mean log-likelihood (above that of uniform noise) below which a text is in none of the languages.
LEAST_TEXT = 0.5

#: Three-letter codes of the languages with a two-letter one that documents often carry.
LONG_CODES = {
    "ara": "ar", "chi": "zh", "zho": "zh", "cze": "cs", "ces": "cs", "dan": "da", "deu": "de", "dut": "nl", "eng": "en",
    "fin": "fi", "fra": "fr", "fre": "fr", "ger": "de", "gre": "el", "ell": "el", "heb": "he", "hin": "hi", "hun": "hu",
    "ita": "it", "jpn": "ja", "kor": "ko", "nld": "nl", "nor": "no", "pol": "pl", "por": "pt", "ron": "ro", "rum": "ro",
    "rus": "ru", "spa": "es", "swe": "sv", "tur": "tr", "ukr": "uk", "vie": "vi",
}
#: Function words of the languages, to learn one that nothing declares.
FUNCTION_WORDS = {
    "de": "der die das und nicht ist eine ein den dem von mit auf für sich auch im zu wird sind",
    "en": "the of and to in that is was for it with as on be this are from which were have",
    "es": "el los las del y que una por con para se no más como pero su lo es al está",
    "fr": "le les des du et est une dans pour qui que pas sur au avec ce il elle sont aux",
}
#: Function words, and their lead on the next language, that a text needs to be learned from.
LEAST_WORDS = 3

RESULT = "lang_pred string, posterior double, text_score double, kept boolean"


def address_parts(address: Column) -> dict[str, Column]:
    """Host, parent domain (last two labels) and suffix (last label) of a URL or bare host name.

    A name without a dot has no parent and no suffix; a null address has no host.
    """
    host = F.lower(F.regexp_extract(F.coalesce(address.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    labels = F.split(host, r"\.")
    return {
        "host": host,
        "parent": F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(F.lit("")),
        "suffix": F.when(F.size(labels) > 1, F.element_at(labels, -1)).otherwise(F.lit("")),
    }


def _declared(column: Column) -> Column:
    """First part of a language tag in lower case, three-letter codes as two letters; empty when null."""
    tag = F.lower(F.regexp_extract(F.coalesce(column.cast("string"), F.lit("")), r"^\s*([A-Za-z]*)", 1))
    short = F.create_map(*(F.lit(x) for pair in LONG_CODES.items() for x in pair))
    return F.coalesce(short[tag], tag)


def html_language(page: Column) -> Column:
    """Language that a page declares: ``lang`` or ``xml:lang`` of its html tag, else the
    content-language of a meta tag; empty when null or none. Comments do not count."""
    own = F.regexp_replace(F.coalesce(page.cast("string"), F.lit("")), r"(?s)<!--.*?-->", "")
    value = r"""\s*=\s*["']?\s*([A-Za-z][\w-]*)"""
    tag = F.regexp_extract(own, r"(?i)<html(?=\s)[^>]*?\s(?:xml:)?lang" + value, 1)
    meta = F.regexp_extract(own, r"""(?i)<meta\s(?=[^>]*http-equiv\s*=\s*["']?content-language)[^>]*?\bcontent""" + value, 1)
    return F.when(tag != "", tag).otherwise(meta)


def evidence(df: DataFrame, text: str = "text", declared: str = "lang", address: str = "source") -> DataFrame:
    """Only the columns that identification reads, under names of its own."""
    return df.select(
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        _declared(F.col(declared)).alias("declared"),
        *(c.alias(n) for n, c in address_parts(F.col(address)).items()),
    )


def language_by_words(text: str, words: dict[str, frozenset[str]]) -> str:
    """The language most of whose function words a text has; empty where none leads clearly."""
    own = text.lower().split()
    ranked = sorted(((sum(w in found for w in own), x) for x, found in words.items()), reverse=True)
    behind = ranked[1][0] if len(ranked) > 1 else 0
    return ranked[0][1] if ranked and ranked[0][0] - behind >= LEAST_WORDS else ""


def fit_text_model(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """Log probabilities [language, bucket]; a language that nothing declares is learned by its function
    words, and one without those, or without such texts, stays uniform."""
    counts = count_vectors(gram_counts(rows.select(F.col("declared").alias("class"), "text"), lower=True), languages)
    missing = [i for i, x in enumerate(languages) if not counts[i].sum() and x in FUNCTION_WORDS]
    if missing:
        words = {x: frozenset(FUNCTION_WORDS[x].split()) for x in languages if x in FUNCTION_WORDS}

        @F.pandas_udf("string")
        def by_words(texts):
            return texts.map(lambda text: language_by_words(text, words))

        open_rows = rows.where(~F.col("declared").isin(languages)).select(by_words("text").alias("class"), "text")
        found = count_vectors(gram_counts(open_rows.where(F.col("class").isin([languages[i] for i in missing])), lower=True), languages)
        for i in missing:
            counts[i] = found[i]
    return np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))


def text_evidence(model: np.ndarray, text: str) -> np.ndarray | None:
    """Mean log-likelihood of each language above uniform noise; None for a text without trigrams."""
    found = gram_buckets(text.encode().lower())
    if not len(found):
        return None
    return model[:, found].mean(axis=1) + np.log(BUCKETS)


class Fusion:
    """Everything the decision needs besides the row: sizes depend on the languages and suffixes only."""

    def __init__(self, model, languages, declared, overall):
        self.model, self.languages = model, languages
        self.declared, self.overall = declared, overall

    def prior(self, host, parent, suffix) -> np.ndarray:
        """Each argument: counts of the languages at that level, or None."""
        share = (self.overall + 1.0) / (self.overall.sum() + len(self.overall))
        for counts in (suffix, parent, host):
            if counts is not None:
                own = np.asarray(counts, np.float64)
                share = (own + HOST_PULL * share) / (own.sum() + HOST_PULL)
        return share

    def decide(self, text, declared, host_counts, parent_counts, suffix_counts) -> tuple[str, float, float, bool]:
        scores = text_evidence(self.model, text)
        if scores is None:
            return UNKNOWN, 0.0, 0.0, False
        log = TEXT_WEIGHT * scores + np.log(self.prior(host_counts, parent_counts, suffix_counts))
        if declared in self.declared:
            log = log + self.declared[declared]
        share = np.exp(log - log.max())
        share /= share.sum()
        best = int(share.argmax())
        score = float(scores[best])
        posterior = float(share[best])
        kept = posterior >= LEAST_POSTERIOR and score >= LEAST_TEXT
        return (self.languages[best] if score >= LEAST_TEXT else UNKNOWN), posterior, score, kept


def _counts(pairs: DataFrame, key: str, languages: list[str]) -> DataFrame:
    """``key, counts``: texts of each language for each value of ``key``."""
    sums = [F.sum(F.when(F.col("best") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(languages))]
    table = pairs.groupBy(key).agg(*sums)
    return table.select(key, F.array(*(F.col(f"n{i}") for i in range(len(languages)))).alias(f"{key}_counts"))


def _likelihoods(table: list, languages: list[str]) -> dict[str, np.ndarray]:
    """log P(value | language), smoothed, of the values in the collected ``key, counts`` rows."""
    values = {r[0]: np.array(r[1], np.float64) for r in table if r[0]}
    if not values:
        return {}
    total = np.sum(list(values.values()), axis=0)
    return {v: np.log((n + 1.0) / (total + len(values) + 1.0)) for v, n in values.items()}


def fit(rows: DataFrame, languages: list[str]):
    """(fusion, host table, parent table) from all ``rows`` of :func:`evidence`."""
    model = fit_text_model(rows, languages)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [text_evidence(model, t) for t in batch.column("text").to_pylist()]
            own = [None if s is None or s.max() < LEAST_TEXT else int(s.argmax()) for s in found]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("declared", "host", "parent", "suffix")), pa.array(own, pa.int32())],
                names=["declared", "host", "parent", "suffix", "best"],
            )

    from barloom.llm.common import stage_columns

    seen = rows.mapInArrow(best, "declared string, host string, parent string, suffix string, best int")
    pairs = seen.where("best is not null").groupBy("declared", "host", "parent", "suffix", "best").agg(F.count(F.lit(1)).alias("n"))
    pairs = stage_columns(pairs, "language-evidence")
    # language tags and country codes: two-letter words, a bounded list
    short = lambda c: _counts(pairs.where(F.col(c).rlike("^[a-z]{2}$")), c, languages)
    declared, suffix = short("declared").collect(), short("suffix").collect()
    overall = np.zeros(len(languages))
    for r in pairs.groupBy("best").agg(F.sum("n").alias("n")).collect():
        overall[r["best"]] = r["n"]
    fusion = Fusion(model, languages, _likelihoods(declared, languages), overall)
    return fusion, _counts(pairs, "host", languages), _counts(pairs, "parent", languages), dict((r[0], r[1]) for r in suffix)


def _judged(df: DataFrame, text: str, declared: str, address: str, languages: list[str]) -> DataFrame:
    """``row`` (a struct of all columns of ``df``) and ``language_id``: whatever the columns are called, they
    meet no name used here."""
    fusion, hosts, parents, suffixes = fit(evidence(df, text, declared, address), languages)

    @F.pandas_udf(RESULT)
    def decide(texts, declarations, suffix, host_counts, parent_counts):
        import pandas as pd

        rows = [
            fusion.decide(t, d, h, p, suffixes.get(s))
            for t, d, s, h, p in zip(texts, declarations, suffix, host_counts, parent_counts, strict=True)
        ]
        return pd.DataFrame(rows, columns=["lang_pred", "posterior", "text_score", "kept"])

    parts = [c.alias(n) for n, c in address_parts(F.col(address)).items()]
    own = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), own, _declared(F.col(declared)).alias("declared"), *parts)
    rows = rows.join(hosts, "host", "left").join(parents, "parent", "left")
    return rows.select("row", decide("text", "declared", "suffix", "host_counts", "parent_counts").alias("language_id"))


def with_language(
    df: DataFrame, text: str = "text", declared: str = "lang", address: str = "source", languages: list[str] = LANGUAGES
) -> DataFrame:
    """``df`` with a struct column ``language_id`` (``RESULT``), which replaces one of that name.

    A null or too short text has no trigrams: language ``und``, rejected. Null declarations and
    addresses are no evidence. Of equal posteriors the first language counts. Repeated rows give repeated
    results, an empty table none; other columns stay as they are under any name. The host tables join
    from the right; Spark broadcasts them only where it measures them below its threshold, and splits
    hot hosts otherwise.
    """
    judged = _judged(df, text, declared, address, languages)
    return judged.select(*(F.col("row").getField(c).alias(c) for c in df.columns if c != "language_id"), "language_id")


def identify(
    df: DataFrame, key: str = "doc_id", text: str = "text", declared: str = "lang", address: str = "source", languages: list[str] = LANGUAGES
) -> DataFrame:
    """``key, lang_pred, posterior, text_score, kept`` of every row, as of ``with_language``."""
    return _judged(df, text, declared, address, languages).select(F.col("row").getField(key).alias(key), "language_id.*")


def identify_pages(pages: DataFrame, languages: list[str] = LANGUAGES) -> DataFrame:
    """``page_id, lang_pred, posterior, text_score, kept`` of every row of ``pages`` (``page_id``, ``url``,
    ``html``): the main text, the language that the markup declares, and the host of the address."""
    from barloom.llm import html_text

    # the text comes with the markup of its own row
    rows = html_text.main_text(pages, F.struct(html_language(F.col("html")).alias("declared"))).select("page_id", "url", "text", "more.declared")
    return identify(rows, "page_id", declared="declared", address="url", languages=languages)


def keep_identified(
    df: DataFrame, text: str = "text", declared: str = "lang", address: str = "source", languages: list[str] = LANGUAGES
) -> DataFrame:
    """The rows of ``df`` whose language is one of the known ones, all columns as they are."""
    return _judged(df, text, declared, address, languages).where("language_id.kept").select("row.*")
