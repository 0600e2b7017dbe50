"""Source divergence audit: how far the sources of a language differ in the words they use.

Two passes over whole texts. The first counts, exactly, the documents of each language that hold a term; terms
of at least ``LEAST_DOCUMENTS`` of them are kept. The second recounts occurrences: a task pads the terms of a run of
texts that may be kept with delimiters, builds an Aho-Corasick automaton from them and runs it over these texts, so that
an automaton never holds more than a run's own words. Which terms may be kept a bitmap of fixed size tells, and an
exact join afterwards; a bitmap too small for the vocabulary costs rows, not results.

Counts become one posting list a term, (source, occurrences). All groups have every kept term, most of them with
no occurrence, so a pair of sources is summed as if both held none, corrected by each source's histogram of counts and by
the terms that both hold. Only the last is worked out term by term, inside tasks, and leaves them as sums.

All numbers are integers and all divisions go down, so results are exact. Probabilities are in ``UNIT`` parts.

Defined results: null text, lang and source are empty strings and count as such. Documents are rows: repeated ids
are documents of their own. A group without kept terms has no occurrences; where a language keeps no term,
its pairs have the value 0 and there are no term rows. Ties in value are ranked by the bytes of the item. Of texts with bytes
that are no UTF-8 these bytes become replacement characters. An empty table gives no rows. Very long texts make a
run of their own. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .textkit import valid
from .workspace import Workspace, ship

UNIT = 1_000_000_000
LEAST_DOCUMENTS = 3
#: Ranks of terms that are reported.
TOP_TERMS = 200
#: Text of a run, in bytes: an automaton is built for each, a task holds one run at a time.
RUN_BYTES = 16 << 20
#: Terms that a task counts before it hands them on.
HELD = 400_000
#: Bits of the bitmap, whatever the vocabulary's size.
BITS = 1 << 27
#: Groups (language, source) whose totals are shipped to tasks; more are joined.
SHIPPED_GROUPS = 100_000
#: Pairs of postings that a task holds at once.
PAIRS = 1 << 21
#: Parts of a group in joins on languages and groups.
SALTS = 16

#: What is no letter is a delimiter; A-Z become lower-case, and bytes of longer characters are letters.
_FOLDED = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, str, bytes]]:
    raw = valid(batch.column("text").cast(pa.large_string())).cast(pa.large_binary())
    for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), raw):
        yield lang, source, text.as_buffer().to_pybytes().translate(_FOLDED)


def _strings(terms: list[bytes]) -> pa.Array:
    return pa.array(terms, pa.binary()).cast(pa.string())


def document_frequencies(documents: DataFrame) -> DataFrame:
    """(lang, term, n): the documents of each language that hold a term, for (text, lang, source) without nulls."""

    def rows(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, terms in held.items():
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(terms)), _strings(list(terms)), pa.array(list(terms.values()), pa.int64())], ["lang", "term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, _, text in _texts(batch):
                held[lang].update(set(text.split()))
                if sum(map(len, held.values())) >= HELD:
                    yield from rows(held)
                    held.clear()
        yield from rows(held)

    return documents.select("lang", "source", "text").mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def _bitmap(kept: DataFrame) -> np.ndarray:
    """One bit for each place that the hash of a kept term falls on; at most BITS / 64 words."""
    place = F.pmod(F.xxhash64("term"), F.lit(BITS)).alias("place")
    words = kept.select(place).selectExpr("cast(shiftright(place, 6) as int) as w", "shiftleft(1L, cast(place & 63 as int)) as b")
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint64)


def occurrences(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n), one row or more for each: occurrences of the terms that may be kept."""
    sent = ship(documents.sparkSession, _bitmap(kept))

    def count(texts: dict[tuple[str, str], list[bytes]]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        import xxhash

        bits = sent()
        by_lang: dict[str, list[str]] = defaultdict(list)
        for lang, source in texts:
            by_lang[lang].append(source)
        for lang, sources in by_lang.items():
            seen = list(set().union(*(text.split() for s in sources for text in texts[lang, s])))
            place = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in seen), np.uint64, len(seen)) & np.uint64(BITS - 1)
            may = (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)
            terms = [seen[k] for k in np.flatnonzero(may)]
            if not terms:
                continue
            automaton = ahocorasick.Automaton()
            for k, term in enumerate(terms):
                automaton.add_word(f" {term.decode('latin-1')} ", k)  # a character is a byte
            automaton.make_automaton()
            names = _strings(terms)
            for source in sources:
                padded = b" ".join([b"", *texts.pop((lang, source)), b""]).decode("latin-1")
                n = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(padded)), np.int64), minlength=len(terms))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(at)), pa.repeat(source, len(at)), names.take(pa.array(at)), pa.array(n[at])], ["lang", "source", "term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[tuple[str, str], list[bytes]] = defaultdict(list)
        size = 0
        for batch in batches:
            for lang, source, text in _texts(batch):
                texts[lang, source].append(text)
                size += len(text)
                if size >= RUN_BYTES:
                    yield from count(texts)
                    texts.clear()
                    size = 0
        yield from count(texts)

    return documents.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long")


def share(n, total, v) -> Column:
    """1 + floor(UNIT (n + 1) / (total + v)) of columns or names."""
    return F.lit(1).cast("long") + F.expr(f"({UNIT}L * ({n} + 1L)) div ({total} + {v})")


def _gap(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def _salted(rows: DataFrame, small: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """rows joined to a table with few rows a key; a key that many rows share is dealt to SALTS tasks. Spark broadcasts what is small."""
    salt = F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(copies, [*keys, "_salt"]).drop("_salt")


def _both_hold(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): what terms that both sources hold add to the histograms' sums, ordered pairs."""
    few = groups.limit(SHIPPED_GROUPS + 1).count() <= SHIPPED_GROUPS
    if few:
        known = {(r.lang, r.source): (r.total, r.v) for r in groups.collect()}  # at most SHIPPED_GROUPS rows
        sent = ship(postings.sparkSession, known)
        rows = postings.select("lang", "found.source", "found.n")
    else:
        flat = postings.select("lang", "term", F.explode("found").alias("f")).select("lang", "term", "f.source", "f.n")
        flat = _salted(flat, groups, ["lang", "source"], ["term"]).groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n", "total", "v")).alias("f"))
        rows = flat.select("lang", "f.source", "f.n", "f.total", "f.v")

    def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def flat_values(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("source")).to_numpy(zero_copy_only=False).astype(np.int64)
            langs = batch.column("lang").dictionary_encode()
            sources = batch.column("source").flatten().dictionary_encode()
            names, lang_names = sources.dictionary.to_pylist(), langs.dictionary.to_pylist()
            if not len(sources):
                continue
            lang = np.repeat(langs.indices.to_numpy(), sizes).astype(np.int64)
            group, place = np.unique(lang * len(names) + sources.indices.to_numpy(), return_inverse=True)
            n = flat_values(batch.column("n"))
            if few:
                had = sent()
                total, v = np.array([had[lang_names[g // len(names)], names[g % len(names)]] for g in group.tolist()], np.int64).reshape(-1, 2)[place].T
            else:
                total, v = flat_values(batch.column("total")), flat_values(batch.column("v"))
            p, none = 1 + UNIT * (n + 1) // (total + v), 1 + UNIT // (total + v)
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            width = np.repeat(sizes, sizes)
            ends = np.cumsum(width)
            a = 0
            while a < len(n):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] - width[a] + PAIRS, "right")))
                left = np.repeat(np.arange(a, b), width[a:b])
                right = first[left] + np.arange(len(left)) - np.repeat(np.cumsum(width[a:b]) - width[a:b], width[a:b])
                other = left != right
                left, right = left[other], right[other]
                add = gap(p[left], p[right]) - gap(p[left], none[right]) - gap(none[left], p[right]) + gap(none[left], none[right])
                pair, at = np.unique(place[left] * len(group) + place[right], return_inverse=True)
                sums = np.zeros(len(pair), np.int64)
                np.add.at(sums, at, add)
                one, two = group[pair // len(group)], group[pair % len(group)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang_names[g // len(names)] for g in one.tolist()], pa.string()), *(pa.array([names[g % len(names)] for g in c.tolist()], pa.string()) for c in (one, two)), pa.array(sums)],
                    ["lang", "source", "item", "value"],
                )
                a = b

    return rows.mapInArrow(run, "lang string, source string, item string, value long")


def _pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language."""
    others = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("other"))
    none_a, none_b = (f"(1L + {UNIT}L div ({t} + v))" for t in ("total", "other"))
    held = f"(1L + ({UNIT}L * (n + 1L)) div (total + v))"
    every = _salted(groups, others, ["lang"], ["source"]).where("source <> item")
    base = every.select("lang", "source", "item", F.expr(f"case when v = 0 then 0L else v * {_gap(none_a, none_b)} end").alias("value"))
    counts = postings.select("lang", F.explode("found").alias("f")).groupBy("lang", "f.source", "f.n").agg(F.count("*").alias("m"))
    # a source has as many rows here as different counts: about the square root of its occurrences
    met = _salted(_salted(counts, groups, ["lang", "source"], ["n"]), others, ["lang"], ["source", "n"]).where("source <> item")
    ahead = met.select("lang", "source", "item", F.expr(f"m * ({_gap(held, none_b)} - {_gap(none_a, none_b)})").alias("value"))
    back = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"m * ({_gap(none_b, held)} - {_gap(none_b, none_a)})").alias("value"))
    rows = base.unionByName(ahead).unionByName(back).unionByName(_both_hold(postings, groups))
    return rows.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _terms(postings: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value) of terms that a group uses more than its language."""
    rows = postings.select("lang", F.col("term").alias("item"), F.aggregate("found", F.lit(0).cast("long"), lambda s, x: s + x.n).alias("all_n"), F.explode("found").alias("f")).select("lang", "item", "all_n", "f.source", "f.n")
    rows = _salted(_salted(rows, groups, ["lang", "source"], ["item"]), langs, ["lang"], ["item"])
    rows = rows.select("lang", "source", "item", share("n", "total", "v").alias("p"), share("all_n", "all_total", "v").alias("q")).where("p > q")
    return rows.select("lang", "source", "item", F.expr(_gap("p", "q")).alias("value"))


def audit(documents: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources and the terms that mark a source."""
    ws = Workspace(documents.sparkSession, "divergence")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = documents.select(blank("lang"), blank("source"), blank("text"))
    kept = ws.save(document_frequencies(docs).where(F.col("n") >= LEAST_DOCUMENTS).select("lang", "term"), "kept")
    found = occurrences(docs, kept).join(kept, ["lang", "term"], "left_semi").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    postings = ws.save(found.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("found")), "postings")
    sums = postings.select("lang", F.explode("found").alias("f")).groupBy("lang", "f.source").agg(F.sum("f.n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    nought = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = ws.save(groups.select("lang", "source", nought("total"), nought("v")), "groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("all_total"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    pairs = ranked(_pairs(postings, groups), "pair")
    # partitions limit their own ranks before they are dealt by group
    terms = ranked(_terms(postings, groups, langs), "term").where(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(terms)
