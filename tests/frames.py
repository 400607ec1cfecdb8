"""Small bar frames for tests."""

import datetime as dt

import numpy as np
import pandas as pd

from barloom.schemas import MARKET_DATA


def days(n, start="2000-01-01", step=1):
    first = dt.date.fromisoformat(start)
    return [first + dt.timedelta(days=i * step) for i in range(n)]


def walk(ticker, n, seed=0, start="2000-01-01", step=1):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    return pd.DataFrame(
        {
            "ticker": ticker,
            "date": days(n, start, step),
            "open": close,
            "high": close * 1.01,
            "low": close * 0.99,
            "close": close,
            "volume": 1000.0,
        }
    )


def bars_frame(spark, *parts):
    """Bars in shuffled row order, so nothing can rely on arrival order."""
    pdf = pd.concat(parts, ignore_index=True).sample(frac=1.0, random_state=1)
    return spark.createDataFrame(pdf, MARKET_DATA)


def ordered(df, *keys):
    pdf = df.toPandas()
    return pdf.sort_values(list(keys or ("ticker", "date"))).reset_index(drop=True)
