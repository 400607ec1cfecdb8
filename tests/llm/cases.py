"""Documents with every awkward kind of text, under clashing column names."""

import pyarrow.parquet as pq
from pyspark.sql import DataFrame

SF = "/root/testdata/sf0.001"

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n",
    "a",
    " lead and trail ",
    "two  spaces\n\nlines\n after",
    "don't l'eau 's rock'n'roll 12'x",
    "<|endoftext|> inside <|startoftext|>",
    "İstanbul é ´ 日本語 ’tis",
    "tab\tvertical\x0bform\x0creturn\r",
    "x" * 9000,
    "word " * 6000,
    "é" * 3000 + " " + "q" * 700,
]


def documents(spark, extra_rows=()) -> DataFrame:
    """Odd texts, real ones, repeated rows, a null id; more columns with names operators use inside."""
    real = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()[:60]
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(100 + r["doc_id"], r["text"]) for r in real]
    rows += [(100 + real[0]["doc_id"], real[0]["text"])] * 2  # the same row again
    rows += [(900 + i, real[1]["text"]) for i in range(3)]  # exact copies
    rows += [(None, real[2]["text"]), *extra_rows]
    data = [(d, t, "x", 1, "y", 2.0, "en", "src0") for d, t in rows]
    return spark.createDataFrame(
        data, "doc_id long, text string, key string, node int, class string, score double, lang string, source string"
    )


def empty_documents(spark) -> DataFrame:
    return documents(spark).limit(0)


def plain(df) -> list[tuple]:
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
