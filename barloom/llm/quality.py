"""Quality rules: plain counts of every document, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed byte trigrams: one of trusted documents, one of the
raw corpus. A document's score is the mean log ratio of its trigrams (longer texts are not favoured),
and one fixed threshold decides about every document; nothing is drawn at random.

The corpus counts cover every document. The trusted side is fitted on at most ``TRUSTED_ROWS``
labelled rows, those with the smallest hash of ``doc_id``.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import documents, sliced
from barloom.llm.grams import count_vectors, gram_buckets, gram_counts

#: Bound of the trusted sample.
TRUSTED_ROWS = 4000
#: Mean log ratio under which a document is rejected.
THRESHOLD = -0.5
#: Counts added to every bucket.
SMOOTHING = 0.5
#: White space and symbols of the rules.
WHITE = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"

SCORES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, log_ratio double, kept boolean"
)


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words covered by windows of ``size`` words that stand twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(size)), strict=False))
    if len(set(windows)) == n:
        return 0
    first: dict[tuple, int] = {}
    covered = np.zeros(len(words) + 1, np.int64)
    for at, window in enumerate(windows):
        before = first.setdefault(window, at)
        if before != at:
            covered[at] += 1
            covered[at + size if at + size <= len(words) else len(words)] -= 1
            covered[before] += 1
            covered[before + size] -= 1
    return int(np.count_nonzero(np.cumsum(covered[:-1]) > 0))


def duplicate_lines(text: str) -> int:
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    own = [line for line in lines if line.strip(WHITE)]
    return len(own) - len(set(own))


def base_counts(text: str) -> tuple[int, int, int, int, int, bool]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` of one text."""
    words = text.encode().split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, WHITE))
    repeats = repeated_words(words)
    failed = n_words < 10 or 100 * repeats > 20 * n_words
    return n_words, word_chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats, failed


def log_ratios(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket; zero everywhere without trusted text."""
    if not trusted.sum():
        return np.zeros_like(raw)
    share = lambda n: np.log((n + SMOOTHING) / (n.sum() + SMOOTHING * len(n)))
    return share(trusted) - share(raw)


def fit_ratios(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS) -> np.ndarray:
    """Log ratios of the corpus ``docs`` against the rows that ``labels`` call good and not toxic."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    ids = good.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_rows).withColumn("class", F.lit("trusted"))
    # at most trusted_rows ids: a bounded broadcast
    marked = documents(docs).join(F.broadcast(ids), "doc_id", "left").withColumn("class", F.coalesce("class", F.lit("other")))
    trusted, other = count_vectors(gram_counts(marked), ["trusted", "other"])
    return log_ratios(trusted, trusted + other)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``SCORES`` of every row of ``docs`` (``doc_id``, ``text``).

    A null text counts as one without words, which fails the rules. With no usable label the ratio
    is 0 for every document and the rules decide alone. Repeated rows give repeated results.
    """
    ratios = fit_ratios(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            base = [base_counts(t) for t in texts]
            means = [_mean(ratios, t) for t in texts]
            columns = [pa.array([b[i] for b in base], pa.int64()) for i in range(5)]
            failed = [b[5] for b in base]
            kept = [not f and m >= threshold for f, m in zip(failed, means, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns, pa.array(failed, pa.bool_()), pa.array(means, pa.float64()), pa.array(kept, pa.bool_())],
                names=[c.split(" ")[0] for c in SCORES.split(", ")],
            )

    return documents(docs).mapInArrow(score, SCORES)


def _mean(ratios: np.ndarray, text: str) -> float:
    found = gram_buckets(text.encode())
    return float(ratios[found].mean()) if len(found) else 0.0


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules and the ratio keep, all columns as they are."""
    ratios = fit_ratios(docs, labels)

    @F.pandas_udf("boolean")
    def good(texts):
        return texts.map(lambda t: not base_counts(t)[5] and _mean(ratios, t) >= threshold).astype(bool)

    return docs.where(good(F.coalesce(F.col("text").cast("string"), F.lit(""))))
