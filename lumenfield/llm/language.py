"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence are added as log odds: character n-gram likelihoods of the visible text,
the language that the markup declares, the address suffix (country domains and language folders),
and a host prior. The host prior is smoothed hierarchically: counts of languages by text, by
host, shrink towards those of the registrable domain, and these towards all pages; all three are
grouped aggregations, so a host that holds a third of all pages is pre-aggregated like any other. A
page's own text takes no part in the prior it gets.

How far declaration and suffix can be trusted is counted too: for every declared language the
share of pages whose text agrees, smoothed with a uniform prior.

The text model is fitted on the whole texts of at most ``PER_LANGUAGE`` labelled documents of each
language, chosen by a hash of the id. Pages are read whole, in pieces of ``PIECE`` bytes.

Defined results: a page with null or empty html has no text evidence; a null url gives no suffix and
host evidence; without any evidence the pages' most frequent language wins, ties going to the
first in the alphabet. Null ids and repeated rows are judged like others. Without labelled
documents the language is null. An empty table of pages gives no rows. Very long pages are read whole, piece by piece.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .textkit import mix
from .urls import split_url
from .workspace import Workspace, ship

PER_LANGUAGE = 400
PIECE = 1 << 20
#: Lengths of n-grams in bytes, and slots of each hashed table.
GRAMS, SLOTS = (1, 2, 3, 4), 1 << 15
#: The text's log likelihood counts for at most so many independent grams: neighbours overlap.
INDEPENDENT = 60.0
#: Strength of the parents in the smoothing of host and domain counts.
PRIOR_HOST, PRIOR_DOMAIN, PRIOR_CLAIM = 8.0, 20.0, 4.0
#: Country domains with one main language.
SUFFIX_LANGUAGE = {"at": "de", "br": "pt", "ch": "de", "cn": "zh", "de": "de", "es": "es", "fr": "fr", "ie": "en", "it": "it", "jp": "ja", "mx": "es", "nl": "nl", "pl": "pl", "pt": "pt", "ru": "ru", "uk": "en", "us": "en"}

#: What is not running text, by the end that closes it. Behind its last end an opening tag has none, so that nothing is searched twice.
_HIDDEN = [(re.compile(rb"<!--.*?-->", re.S), re.compile(rb"-->"))]
for _tag in (b"script", b"style", b"nav", b"title", b"aside", b"footer"):
    _HIDDEN.append((re.compile(rb"<" + _tag + rb"\b.*?</" + _tag + rb"\s*>", re.S), re.compile(rb"</" + _tag + rb"\s{0,64}>")))
_HIDDEN.append((re.compile(rb"<div\b[^<>]*class=.?(?:ad|ads|banner)\b.*?</div\s*>", re.S), re.compile(rb"</div\s{0,64}>")))
_MARKUP = re.compile(rb"<[^<>]*>|&[a-z#0-9]{1,32};")


def visible(html: bytes) -> bytes:
    """Running text, lower-cased; navigation, advertisements and footers are often in another language."""
    text = html.lower()
    for hidden, end in _HIDDEN:
        last = max((m.end() for m in end.finditer(text)), default=0)
        text = hidden.sub(b" ", text[:last]) + text[last:]
    return b" ".join(_MARKUP.sub(b" ", text).split())


def _gram_slots(data: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(max(0, len(data) - n + 1), np.uint64)
    for j in range(n):
        h = h * np.uint64(257) + data[j : len(data) - n + 1 + j]
    return (mix(h) & np.uint64(SLOTS - 1)).astype(np.int64)


def _pieces(data: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Pieces that share n - 1 bytes, so that every n-gram lies in one."""
    for a in range(0, max(1, len(data) - n + 1), PIECE):
        yield data[a : a + PIECE + n - 1]


class TextModel:
    """Naive Bayes over hashed byte n-grams."""

    def __init__(self, texts: list[bytes], languages: list[str]):
        self.languages = sorted(set(languages))
        self.tables = {}
        for n in GRAMS if self.languages else ():
            counts = np.full((SLOTS, len(self.languages)), 0.02)
            for text, lang in zip(texts, languages):
                for piece in _pieces(np.frombuffer(text, np.uint8), n):
                    counts[:, self.languages.index(lang)] += np.bincount(_gram_slots(piece, n), minlength=SLOTS)
            log = np.log(counts / counts.sum(0))
            self.tables[n] = (log - log.mean(1, keepdims=True)).astype(np.float32)

    def log_odds(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        total, seen = np.zeros(len(self.languages)), 0
        for n in GRAMS:
            for piece in _pieces(data, n):
                slots = _gram_slots(piece, n)
                total += self.tables[n][slots].sum(0)
                seen += len(slots)
        return total * (min(seen, INDEPENDENT) / seen) if seen else total


def train(documents: DataFrame, per_language: int = PER_LANGUAGE) -> TextModel:
    """documents: doc_id, text, lang. Null or empty texts and null languages do not teach."""
    known = documents.where("lang is not null and doc_id is not null").select("doc_id", "lang")
    order = F.row_number().over(Window.partitionBy("lang", "part").orderBy("h", "doc_id"))
    # first the smallest hashes within parts of a language, then within the language: no task sees all of it
    cut = known.withColumns({"h": F.xxhash64("doc_id", F.lit("language-sample")), "part": F.pmod(F.xxhash64("doc_id"), F.lit(64))}).withColumn("r", order).where(F.col("r") <= per_language)
    picked = cut.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= per_language).select("doc_id", "lang")
    # at most per_language rows of each language
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "lang", "text").where("text != ''").distinct().orderBy("doc_id", "lang", "text").collect()
    return TextModel([b" ".join(r.text.encode("utf-8", "replace").lower().split()) for r in rows], [r.lang for r in rows])


def identify(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """page_id, language, confidence, text_language, declared, suffix: one row for each row of ``pages``."""
    spark = pages.sparkSession
    ws = Workspace(spark, "language")
    model = train(documents)
    langs = model.languages
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select("page_id", none.alias("language"), F.lit(0.0).alias("confidence"), none.alias("text_language"), none.alias("declared"), none.alias("suffix"))
    shared = ship(spark, model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared()
        for batch in batches:
            html = batch.column("html").cast(pa.large_binary())
            odds = [m.log_odds(visible(h.as_py() or b"")).tolist() for h in html]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "head")), pa.array(odds, pa.list_(pa.float64()))], ["page_id", "url", "head", "odds"])

    # the declaration stands in the html element, wherever that starts
    head = F.regexp_extract("html", r"(?is)<html\b([^>]*)>", 1).alias("head")
    kind = pages.schema["page_id"].dataType.simpleString()
    told = pages.select("page_id", "url", head, "html").mapInArrow(read, f"page_id {kind}, url string, head string, odds array<double>")
    declared = F.lower(F.regexp_extract("head", r"""(?i)\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    host, path = split_url(F.col("url"))
    tld = F.substring_index(host, ".", -1)
    folder = F.lower(F.regexp_extract(path, r"^/([A-Za-z]{2})(?:/|$)", 1))
    by_tld = F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])[tld]
    ours = F.array(*map(F.lit, langs))
    suffix = F.when(F.array_contains(ours, folder), folder).when(F.array_contains(ours, by_tld), by_tld)
    claim = F.when(F.array_contains(ours, declared), declared)
    top = F.element_at(ours, F.array_position("odds", F.array_max("odds")).cast("int"))
    silent = F.forall("odds", lambda x: x == 0)
    seen = told.select("page_id", "odds", claim.alias("declared"), suffix.alias("suffix"), F.when(~silent, top).alias("text_language"), host.alias("host"))
    seen = ws.save(seen.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)), "seen")

    vote = lambda x: F.coalesce((F.col("text_language") == x).cast("double"), F.lit(0.0))
    votes = ws.save(seen.groupBy("host", "domain").agg(*[F.sum(vote(x)).alias(x) for x in langs]), "votes")
    domains = votes.groupBy("domain").agg(F.array(*[F.sum(x) for x in langs]).alias("by_domain"))
    every = votes.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(x) for x in langs]).first()
    total = sum(every[x] for x in langs)
    base = {x: (every[x] + 1) / (total + len(langs)) for x in langs}
    counts = votes.where("host != ''").join(domains, "domain").select("host", F.array(*langs).alias("by_host"), "by_domain")
    # a page's own vote does not count for itself
    own = F.array(*[vote(x) for x in langs])
    less = lambda c: F.zip_with(c, own, lambda n, o: n - o)
    summed = lambda c: F.aggregate(c, F.lit(0.0), lambda a, n: a + n)
    shrunk = lambda c, parent, strength: F.zip_with(c, parent, lambda n, p: (n + strength * p) / (summed(c) + strength))
    flat = F.array(*[F.lit(float(base[x])) for x in langs])
    by_domain = shrunk(less("by_domain"), flat, PRIOR_DOMAIN)
    by_host = shrunk(less("by_host"), by_domain, PRIOR_HOST)

    def trust(column: str) -> dict[str, list[float]]:
        """log P(claim | language) for each claim, at most one row for each pair of languages."""
        rows = seen.where(F.col(column).isNotNull() & F.col("text_language").isNotNull()).groupBy(column, "text_language").count().collect()
        n = {(r[0], r[1]): r["count"] for r in rows}
        of = {x: sum(v for (_, t), v in n.items() if t == x) for x in langs}
        return {c: [float(np.log((n.get((c, x), 0) + PRIOR_CLAIM * (0.7 if c == x else 0.3 / max(1, len(langs) - 1))) / (of[x] + PRIOR_CLAIM))) for x in langs] for c in langs}

    def evidence(column: str):
        table = trust(column)
        cases = F.array(*[F.lit(0.0)] * len(langs))
        for claim_, logs in table.items():
            cases = F.when(F.col(column) == claim_, F.array(*map(F.lit, logs))).otherwise(cases)
        return cases

    fused = seen.join(counts, "host", "left").withColumns({"a": evidence("declared"), "b": evidence("suffix"), "prior": F.coalesce(by_host, flat)})
    fused = fused.withColumn("score", F.expr("transform(odds, (x, i) -> x + a[i] + b[i] + ln(prior[i]))")).withColumn("most", F.array_max("score"))
    confidence = 1 / F.expr("aggregate(score, 0D, (s, x) -> s + exp(x - most))")
    return fused.select("page_id", F.element_at(ours, F.array_position("score", F.col("most")).cast("int")).alias("language"), confidence.alias("confidence"), "text_language", "declared", "suffix")
