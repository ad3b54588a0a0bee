"""URL filters (op 5): host and path rules, and logistic regression on hashed character n-grams.

The longest rule whose host is the url's host or a parent domain of it, and whose path begins the
url's, decides; where none fits, the model does. The model is trained on the driver from a small
labelled table (``LABELLED``, or any of at most ``MAX_LABELLED`` rows) and travels as one array.

Nulls: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged
by the model. Repeated rows are judged each. Extra columns are ignored, whatever their names; an empty
table gives no rows; a url of any length is judged whole. Of rules of equal length that fit, the later
one of the list decides. A probability at the threshold blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import ascii_lower

DIM = 1 << 14
GRAMS = (2, 3, 4)
#: Chosen on held-out addresses of the labelled table.
THRESHOLD = 0.6
MAX_LABELLED = 10_000

#: (rule, verdict); a rule is a host with its path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: What the labelled hosts are named after: kinds of unwanted sites, and plain words. No address of a table that the operator is applied to is among them.
UNWANTED = "ads adserver tracker clickbait banner popup adult xxx porn cams escort casino poker slots roulette bets betting jackpot pills viagra meds pharmacy loans payday spam phishing malware keygen warez torrent scam replica pill drugs steroids gamble gambling lottery bingo spammer spamming adults nudes fetish adclick trackers tracking betslip freespins".split()
WANTED = "news library school science history recipes travel music city archive museum garden weather health sports books maps forum wiki docs university theatre film nature gallery journal market bakery clinic council energy forest harbour hotel kitchen language mountain ocean office paper photo planet radio river road shop station stone street studio summer teacher tower valley village water winter window bridge island meadow orchard pottery railway nothing thing theory thread thumb there weathers mother brother leather feather gather together neither clothing breathing teaching reading writing meeting evening morning nation motion portion section mention option action attention condition question tradition version edition fashion mission region onion opinion million person reason season lesson common salmon lemon ribbon carbon horizon button cotton than another rather athens northern southern eastern western entrance another distance reasons answers ourselves outing housing heather earth hearing shearing earring ringing singing standing landing hanging".split()
HOSTS = ("{}.example.com", "www.{}-online.example.net", "m.my-{}.example.org", "{}hub.example.net", "blog.{}.example.org")
PATHS = ("/en/{}", "/fr/{}.html", "/de/{}/", "/es/{}")


def labelled(words: list[str], unwanted: int) -> list[tuple[str, str, int]]:
    """(host, path, unwanted) of two addresses for each word; paths are dealt alike to both labels."""
    return [(HOSTS[(i + 2 * j) % len(HOSTS)].format(w), PATHS[(i + j) % len(PATHS)].format(7 * i + j + 1), unwanted) for i, w in enumerate(words) for j in (0, 1)]


#: A small labelled table of invented addresses on reserved example domains.
LABELLED = (*labelled(UNWANTED, 1), *labelled(WANTED, 0))


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def grams(host: str, path: str) -> np.ndarray:
    found = {f"{part}{text[i : i + n]}" for part, text in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in GRAMS for i in range(len(text) - n + 1)}
    return np.fromiter((zlib.crc32(g.encode()) % DIM for g in sorted(found)), np.int64, len(found))


def fitted(examples=LABELLED, rounds: int = 1000, rate: float = 0.5, penalty: float = 1e-3) -> np.ndarray:
    """Weights, the intercept last, by full-batch gradient descent from zero."""
    if len(examples) > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    own = [grams(h, p) for h, p, _ in examples]
    y = np.array([label for _, _, label in examples], float)
    row, col = np.repeat(np.arange(len(own)), [len(g) for g in own]), np.concatenate(own) if own else np.empty(0, np.int64)
    scale = 1 / np.sqrt(np.maximum(1, [len(g) for g in own]))
    w = np.zeros(DIM + 1)
    # Both labels weigh alike, however many addresses have them.
    balance = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum())) * len(own)
    for _ in range(rounds if len(own) else 0):
        z = np.bincount(row, w[col], len(own)) * scale + w[DIM]
        error = balance * (y - 1 / (1 + np.exp(-z)))
        w[:DIM] += rate * (np.bincount(col, (error * scale)[row], DIM) - penalty * w[:DIM])
        w[DIM] += rate * error.mean()
    return w


def probabilities(weights: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """Of many addresses at once: one sum of weights for each."""
    own = [grams(h, p) for h, p in zip(hosts, paths, strict=True)]
    n = np.array([len(g) for g in own], np.int64)
    total = np.bincount(np.repeat(np.arange(len(own)), n), weights[np.concatenate(own)], len(own)) if n.sum() else np.zeros(len(own))
    return 1 / (1 + np.exp(-(total / np.sqrt(np.maximum(1, n)) + weights[DIM])))


def judged(pages: DataFrame, rules=RULES, weights: np.ndarray | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, host, path, rule, probability (of being unwanted), verdict."""
    weights = fitted() if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = probabilities(weights, b.column("host").to_pylist(), b.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, "probability"])

    host, path = host_and_path(F.col("url"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # longer rules wrap shorter ones, and later ones earlier
        domain, _, rest = text.partition("/")
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    parsed = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    schema = StructType([*parsed.schema.fields, StructField("probability", DoubleType())])
    model = F.when(F.col("probability") >= threshold, "block").otherwise("allow")
    return parsed.mapInArrow(run, schema).select("page_id", "url", "host", "path", rule.alias("rule"), "probability", F.coalesce(verdict, model).alias("verdict"))
