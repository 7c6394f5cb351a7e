"""A URL filter: logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes of the n-grams, buckets, the base of the rolling hash, and units of a quantised weight.
SIZES, BUCKETS, BASE, UNIT = (3, 4, 5), 1 << 15, 131, 1_000_000
#: URLs with a higher probability of being unwanted are blocked.
THRESHOLD = 0.5
#: (scheme and authority's user left out) host, path.
HOST, PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"

#: The labelled table: 1 for gambling, pills, adult, tracking and link farms, 0 for the rest.
LABELLED: list[tuple[str, int]] = [
    *((u, 1) for u in """
http://spam-links.example.com/buy/now http://www.link-farm.example.net/a/1 https://best-spam.example.org/x/22 http://content-farm.example.com/page/3
https://m.casino-royal.example.com/play http://casino-online.example.net/slots/7 https://www.grand-casino.example.org/bonus http://big-win.example.com/jackpot
https://free-spins.example.net/odds http://bets-today.example.org/en/12 https://www.sport-bets.example.com/live http://freebet-tips.example.net/fr/8
http://diet-pills.example.net/order https://pills-online.example.com/de/4 http://www.buy-pills.example.org/rx https://cheap-meds.example.com/es/9
https://adult-cams.example.com/v/1 http://www.adult-dating.example.org/en/6 https://blog.adult-video.example.com/fr/3 http://xxx-adult.example.net/a
http://ads-server.example.com/click https://m.ads-banner.example.org/en/5 http://track-click.example.net/de/44 https://www.ads-network.example.com/imp
https://poker-win.example.org/table http://www.slots-free.example.com/spin https://loans-cheap.example.net/apply http://m.cheap-loans.example.com/es/71
http://cheap-watches.example.org/shop https://free-ringtones.example.com/dl http://spam-site.example.net/fr/10 https://server-farm-ads.example.com/en/230
http://casino-bonus.example.org/en/17 https://www.online-bets.example.org/de/910 http://blog.discount-pills.example.net/en/87 http://adult-chat.example.com/es/64
""".split()),
    *((u, 0) for u in """
http://www.library.example.org/catalogue/12 https://news.example.com/2021/05/story https://blog.gardening.example.net/en/spring https://docs.example.org/en/latest/install
http://university.example.edu/physics/101 https://www.museum.example.org/de/sammlung https://m.weather.example.com/fr/paris https://recipes.example.net/es/paella
http://www.history.example.com/en/44 https://blog.travel.example.org/en/rome https://health.example.org/en/vaccines http://theatre.example.com/fr/programme
https://www.science.example.net/en/231 http://m.music.example.com/de/88 https://community.example.org/forum/5 https://opensource.example.com/en/project
http://therapy.example.org/en/12 https://www.mathematics.example.com/en/proof http://blog.thanet.example.net/es/9 https://thornton.example.com/en/7
https://another.example.org/de/533 http://www.station.example.net/en/60 https://m.winter.example.org/en/61 http://blog.adulation.example.com/fr/2
https://farming.example.org/en/soil http://alphabet.example.com/en/91 https://www.trackside.example.net/fr/19 http://spills.example.org/es/20
https://blog.cheapside.example.com/en/31 http://freedom.example.net/de/3 https://www.padstow.example.org/en/4 http://spamalot.example.com/en/theatre
https://winning-essays.example.org/en/8 https://www.north-east.example.net/en/27 http://well-being.example.com/de/41 https://m.text-book.example.org/fr/15
http://ththere.example.com/en/414 https://tionion.example.net/de/77?page=2 http://www.thering.example.com/fr/8 https://erthan.example.org/es/350.html
""".split()),
]


@dataclass
class UrlModel:
    """weights: of each bucket, as integers in 1 / UNIT, so that sums are exact in any order."""

    weights: np.ndarray
    bias: int


def grams(parts: list[str], field: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each character n-gram of ^part$, by a rolling hash that starts from the field's and the size's number."""
    marked = [np.frombuffer(f"^{p}$".encode("utf-32-le", "surrogatepass"), np.uint32) for p in parts]
    lengths = np.array([len(x) for x in marked], np.int64)
    codes = np.concatenate(marked).astype(np.int64) if marked else np.zeros(0, np.int64)
    row, end = np.repeat(np.arange(len(parts)), lengths), np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(codes))
    rows, buckets = [], []
    for n in SIZES:
        ok = np.flatnonzero(at + n <= end)
        h = np.full(len(ok), field * 16 + n, np.int64)
        for i in range(n):
            h = (h * BASE + codes[ok + i]) % BUCKETS
        rows.append(row[ok])
        buckets.append(h)
    return np.concatenate(rows), np.concatenate(buckets)


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    (r, b), (s, c) = grams(hosts, 1), grams(paths, 2)
    return np.concatenate([r, s]), np.concatenate([b, c])


def split(url: str) -> tuple[str, str]:
    import re

    h, p = re.match(HOST, url), re.match(PATH, url)
    return (h[1].lower() if h else ""), (p[1] if p else "")


def train(labelled: list[tuple[str, int]] = LABELLED, steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> UrlModel:
    """Full-batch gradient descent in numpy from zero weights; the same table gives the same model. Rows with a null URL are left out."""
    kept = [(u, y) for u, y in labelled if u is not None]
    hosts, paths = zip(*(split(u) for u, _ in kept), strict=True)
    row, bucket = features(list(hosts), list(paths))
    y, w, b = np.array([float(y) for _, y in kept]), np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        z = np.bincount(row, w[bucket], len(y)) + b
        g = 1 / (1 + np.exp(-z)) - y
        w -= rate * (np.bincount(bucket, g[row], BUCKETS) / len(y) + decay * w)
        b -= rate * float(g.mean())
    return UrlModel(np.rint(w * UNIT).astype(np.int64), round(b * UNIT))


def score_urls(pages: DataFrame, model: UrlModel, id_col: str = "page_id", url_col: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """(id, host, score, blocked) of each row: score is the log-odds in millionths, and is blocked beyond threshold's.

    Host in lower case and path are cut out of the URL in the JVM; what isn't a URL with a scheme has both empty and
    still gets a score. A null URL has host, score and blocked null. Repeated rows are scored alike, an empty table gives an
    empty one. Map-only; the model's size is fixed by BUCKETS.
    """
    url, limit = F.col(f"`{url_col}`").cast("string"), round(float(np.log(threshold / (1 - threshold))) * UNIT)
    picked = pages.select(F.col(f"`{id_col}`").alias("id"), F.lower(F.regexp_extract(url, HOST, 1)).alias("host"), F.regexp_extract(url, PATH, 1).alias("path"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(1), batch.column(2)
            row, bucket = features(hosts.fill_null("").to_pylist(), paths.fill_null("").to_pylist())
            score = np.zeros(batch.num_rows, np.int64)
            np.add.at(score, row, model.weights[bucket])
            score += model.bias
            none = hosts.is_null().to_numpy(zero_copy_only=False)
            yield pa.record_batch([batch.column(0), hosts, pa.array(score, mask=none), pa.array(score > limit, mask=none)], ["id", "host", "score", "blocked"])

    from pyspark.sql.types import StructType

    out = StructType().add("id", pages.schema[id_col].dataType).add("host", "string").add("score", "long").add("blocked", "boolean")
    return picked.mapInArrow(f, out).withColumnRenamed("id", id_col)


def oracle(model: UrlModel | None = None, threshold: float = THRESHOLD) -> str:
    model = model or train()
    limit = round(float(np.log(threshold / (1 - threshold))) * UNIT)
    weights = ", ".join(f"({i}, {int(model.weights[i])})" for i in np.flatnonzero(model.weights))
    parts = []
    for field, part in ((1, "host"), (2, "path")):
        for n in SIZES:
            h = str(field * 16 + n)
            for i in range(n):
                h = f"(({h} * {BASE} + unicode(substr(s, (k + {i})::INT, 1))) % {BUCKETS})"
            parts.append(f"SELECT page_id, {h} AS bucket FROM (SELECT page_id, s, unnest(range(1, length(s) - {n - 2})) AS k FROM (SELECT page_id, '^' || {part} || '$' AS s FROM cut))")
    return f"""WITH cut AS (SELECT page_id, lower(regexp_extract(url, '{HOST}', 1)) AS host, regexp_extract(url, '{PATH}', 1) AS path FROM pages),
    grams AS ({" UNION ALL ".join(parts)}), weights(bucket, w) AS (VALUES {weights}),
    sums AS (SELECT page_id, sum(w)::BIGINT AS s FROM grams JOIN weights USING (bucket) GROUP BY page_id)
    SELECT page_id, host, coalesce(s, 0) + {model.bias} AS score, coalesce(s, 0) + {model.bias} > {limit} AS blocked FROM cut LEFT JOIN sums USING (page_id)"""
