"""Toxicity: a noisy channel restores disguised words, and labelled evidence scores the restored text.

A character language model of ``ORDER`` characters is counted over the words of all documents, in a table of fixed size.
The channel says how a writer may have disguised a letter: a digit or sign that looks like it, separators between letters,
letters written more than once, a star for any letter. A token with such signs becomes a lattice, and Viterbi's algorithm finds
its most probable reading; tokens that can be read in one way only, plain letters without repetition, are their own.
Runs of single characters make one lattice in which each gap joins letters or parts words.

Evidence is learned from labelled documents: for whole words and beginnings of words, how many toxic and other documents hold
them once restored. Evidence is a lower bound, and near copies teach once. A document is scored by its
strongest words, the number of words with evidence and that of all, weighed by a logistic fit in which no document is evidence
for itself; its score is never below the least toxic share of the documents that hold its strongest word.

The evidence is fitted on at most ``PER_CLASS`` labelled rows of each class; the language model is counted over all documents.

Defined results: null and empty texts, and texts without words, are scored as documents without evidence. Rows of a null doc_id
are scored like any other and do not teach. Labels other than 0 and 1 do not teach; of contradicting labels the higher counts.
Without labels of both kinds every score is the share of toxic ones, 0.5 without any. Repeated rows get equal scores, as scores
depend on the text alone and are rounded to ``DIGITS`` places. Tokens and runs longer than ``PIECE`` characters are restored in
pieces that overlap by ``OVERLAP``, so that no shorter word is cut. An empty table gives no rows. Extra columns stay as
they are, but for those named like the results, which are replaced.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .textkit import mix, slices, valid
from .workspace import Workspace, ship

ORDER = 5
#: Cells of the language model's table, whatever the corpus.
CELLS = 1 << 21
#: Weight of the shorter context in each estimate.
SHORTER = 3.0
#: Distinct words and tokens that a task remembers at once.
HELD = 400_000
PIECE, OVERLAP = 64, 24
#: Tokens that are decoded together.
TOGETHER = 4096
PER_CLASS = 4000
#: Beginnings of words that count as evidence, in characters.
BEGINNINGS = range(4, 9)
#: Documents that must hold a word, its least evidence, and the deviations by which its toxic share is lowered for chance.
LEAST_TOXIC, LEAST_EVIDENCE, DEVIATIONS = 2, 0.5, 3.0
DIGITS = 5
#: Words whose evidence is told apart; the others of a document are counted.
STRONGEST = 4

#: Letters that a digit or sign may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "§": "s", "¡": "i",
}
#: What each disguise costs, in natural logarithms.
DISGUISED, LEFT_OUT, ANY_LETTER, JOINED, PARTED = 1.5, 1.5, 3.5, 2.0, 1.0
DOUBLED, DOUBLE_KEPT, DOUBLE_LEFT = 4.0, 1.0, 0.5

_WORD = re.compile(r"[^\W\d_]+")
_REPEATED = re.compile(r"(.)\1")
_EDGES = re.compile(r"^([\W_]*)(.*?)([\W_]*)$", re.S)
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]{1,3}\S){2,}(?!\S)")
_UNSEEN = re.compile(r"[\u00ad\u0300-\u036f\u200b-\u200f\u2060\ufeff]")
#: An arc of a lattice: code point (0: nothing, 32: end of a word) and cost.
Arc = tuple[int, float]


def _code(points: np.ndarray) -> np.ndarray:
    """Code points in a byte: ASCII as it is, others by their remainder."""
    return np.where(points < 128, points, 128 + points % 127)


def _cells(order: int, context: np.ndarray, code: np.ndarray | None = None) -> np.ndarray:
    """Cells of an n-gram, or of its context alone, among CELLS."""
    cut = context & np.uint64((1 << 8 * (order - 1)) - 1)
    key = cut * np.uint64(512) + (np.uint64(256) if code is None else code)
    return (mix(key * np.uint64(8) + np.uint64(order)) & np.uint64(CELLS - 1)).astype(np.int64)


@dataclass
class CharacterModel:
    """Counts of n-grams and of their contexts, hashed to cells."""

    table: np.ndarray

    def log_probability(self, context: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Of each character after its context, the last ORDER - 1 codes in one word; 0 is the end of a word."""
        p = np.full(len(code), 1 / 64)
        for order in range(1, ORDER + 1):
            p = (self.table[_cells(order, context, code)] + SHORTER * p) / (self.table[_cells(order, context)] + SHORTER)
        return np.log(p)

    def decode(self, lattices: list[list[tuple[Arc, ...]]]) -> list[str]:
        """The most probable reading of each lattice: Viterbi's algorithm over all of them at once, a position a step."""
        out: list[str] = [""] * len(lattices)
        by_length = sorted(range(len(lattices)), key=lambda k: len(lattices[k]))
        for a in range(0, len(by_length), TOGETHER):
            some = by_length[a : a + TOGETHER]
            for k, text in zip(some, self._decoded([lattices[k] for k in some])):
                out[k] = text
        return out

    def _decoded(self, lattices: list[list[tuple[Arc, ...]]]) -> list[str]:
        # different sets of arcs, one after the other, and which set is where; the first moves nothing
        index: dict[tuple[Arc, ...], int] = {((0, 0.0),): 0}
        places = np.zeros((max(map(len, lattices)), len(lattices)), np.int64)
        for k, lat in enumerate(lattices):
            places[: len(lat), k] = [index.setdefault(arcs, len(index)) for arcs in lat]
        sizes = np.array([len(arcs) for arcs in index])
        starts = np.cumsum(sizes) - sizes
        point = np.array([p for arcs in index for p, _ in arcs])
        cost = np.array([c for arcs in index for _, c in arcs])
        token = np.arange(len(lattices))
        context, score = np.zeros(len(lattices), np.uint64), np.zeros(len(lattices))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        for at_step in places:
            which = at_step[token]
            ways = sizes[which]
            parent = np.repeat(np.arange(len(token)), ways)
            arc = np.repeat(starts[which], ways) + np.arange(len(parent)) - np.repeat(np.cumsum(ways) - ways, ways)
            p, before = point[arc], context[parent]
            code = _code(np.where(p == 32, 0, p)).astype(np.uint64)
            new = np.where(p == 0, before, np.where(p == 32, np.uint64(0), (before << np.uint64(8) | code) & np.uint64(0xFFFFFFFF)))
            value = score[parent] - cost[arc]
            says = np.flatnonzero((p != 0) & ~((p == 32) & (before == 0)))
            value[says] += self.log_probability(before[says], code[says])
            # of the ways into one state the best stays
            state = token[parent].astype(np.uint64) << np.uint64(32) | new
            order = np.lexsort((-value, state))
            best = order[np.r_[True, np.diff(state[order]) != 0]]
            token, context, score = token[parent[best]], new[best], value[best]
            steps.append((parent[best], p[best]))
        ends = np.flatnonzero(context != 0)
        score[ends] += self.log_probability(context[ends], np.zeros(len(ends), np.uint64))
        order = np.lexsort((-score, token))
        at = order[np.r_[True, np.diff(token[order]) != 0]]
        points = np.zeros((len(lattices), len(steps)), np.int64)
        for t in range(len(steps) - 1, -1, -1):
            parent, p = steps[t]
            points[:, t], at = p[at], parent[at]
        return ["".join(map(chr, row[row != 0].tolist())) for row in points]


def _readings(c: str, star: bool) -> tuple[Arc, ...] | None:
    """What one character may stand for, None for a gap."""
    if c.isalpha():
        return ((ord(c), 0.0),)
    if c in LOOKS_LIKE:
        return (*((ord(x), DISGUISED) for x in LOOKS_LIKE[c]), (ord(c), 0.0) if c.isdigit() else (0, LEFT_OUT))
    if c == "*" and star:
        return (*((x, ANY_LETTER) for x in range(97, 123)), (0, JOINED))
    return ((ord(c), 0.0),) if c.isdigit() else None


_GAP, _SPACE = ((0, JOINED), (32, PARTED)), ((0, JOINED / 2), (32, PARTED))


def lattice(token: str, spaced: bool = False, known: dict[tuple[str, bool], tuple[Arc, ...] | None] | None = None) -> list[tuple[Arc, ...]]:
    """Positions with what each may stand for; between the characters of a spaced run lie gaps. ``known`` keeps what was read before."""
    star, known = token.count("*") == 1, {} if known is None else known
    out: list[tuple[Arc, ...]] = []
    n, k = len(token), 0
    while k < n:
        c, run = token[k], 1
        while k + run < n and token[k + run] == c:
            run += 1
        k += run
        if (c, star) not in known:
            known[c, star] = _readings(c, star)
        one = known[c, star]
        if one is None:
            out.append(_GAP)
        elif spaced:
            for again in range(run):
                out += ([_SPACE] if out else []) + [(*one, (0, DOUBLED)) if again else one]
        elif run > 1 and c.isalpha():
            keep, leave = (0.0, DOUBLED) if run == 2 else (DOUBLE_KEPT, DOUBLE_LEFT)
            out += [one, ((ord(c), keep), (0, leave))]
        else:
            out += [one] * run
    return out


def pieces(token: str) -> list[str]:
    if len(token) <= PIECE:
        return [token]
    return [token[k : k + PIECE] for k in range(0, len(token) - OVERLAP, PIECE - OVERLAP)]


def folded(text: str) -> str:
    """Lower case in composed form, without marks and characters that cannot be seen."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = _UNSEEN.sub("", text)
    return text.lower()


@dataclass
class Restorer:
    """Reads disguised tokens by a character model and remembers what it has read."""

    model: CharacterModel
    known: dict[str, str] = field(default_factory=dict)
    cores: dict[str, str] = field(default_factory=dict)
    characters: dict = field(default_factory=dict)

    def learn(self, tokens: set[str]) -> list[str]:
        """Reads tokens that are new and returns their readings; a spaced run is a token that begins with a space."""
        if len(self.known) > HELD:
            for held in (self.known, self.cores, self.characters):
                held.clear()
        new = tokens.difference(self.known)
        found, waiting = self.cores, {}
        for token in new:
            if token.isalpha() and not _REPEATED.search(token):
                self.known[token] = token
                continue
            core = token if token[0] == " " else self.core(token)
            if core in found:
                continue
            if core[:1] == " " or not core.isalpha() or _REPEATED.search(core):
                if any(map(str.isalpha, core)):
                    waiting[core] = [lattice(p, core[0] == " ", self.characters) for p in pieces(core.lstrip(" "))]
                else:
                    found[core] = ""
            else:
                found[core] = core
        if waiting:
            read, at = self.model.decode([p for parts in waiting.values() for p in parts]), 0
            for core, parts in waiting.items():
                found[core] = " ".join(" ".join(read[at : at + len(parts)]).split())
                at += len(parts)
        for token in new:
            if token not in self.known:
                self.known[token] = found[token if token[0] == " " else self.core(token)]
        return [self.known[t] for t in new]

    @staticmethod
    def core(token: str) -> str:
        """The token without signs at its ends, but for one that may be its first or last letter."""
        left, core, right = _EDGES.match(token).groups()  # type: ignore[union-attr]
        if core and len(left) == 1 and left in LOOKS_LIKE:
            core = left + core
        if core and len(right) == 1 and right in "$@€":
            core += right
        return core

    def tokens(self, text: str) -> list[str]:
        """Tokens of a text in order; runs of single characters come as one."""
        out, end = [], 0
        for m in _SPACED.finditer(text):
            run = "".join(m.group().split())
            if sum(c.isalpha() for c in run) >= 2 and all(c.isalpha() or c in LOOKS_LIKE or c == "*" for c in run):
                out += text[end : m.start()].split()
                out.append(" " + run)
                end = m.end()
        return out + text[end:].split()

    def read(self, texts: list[str]) -> list[list[str]]:
        """The restored words of each text, one string a token."""
        parted = [self.tokens(folded(t)) for t in texts]
        self.learn(set().union(*parted) if parted else set())
        return [[self.known[t] for t in tokens] for tokens in parted]

    def distinct(self, texts: list[str]) -> tuple[list[set[str]], set[str]]:
        """(the different restored words of each text, those read for the first time)."""
        parted = [set(self.tokens(folded(t))) for t in texts]
        fresh = self.learn(set().union(*parted) if parted else set())
        return [_words(map(self.known.__getitem__, tokens)) for tokens in parted], _words(fresh)


def _words(readings: Iterable[str]) -> set[str]:
    words = set(readings)
    words.discard("")
    several = [w for w in words if " " in w]
    words.difference_update(several)
    return words.union(*map(str.split, several))


def _python_texts(column: pa.Array) -> list[str]:
    return [t or "" for t in valid(column).to_pylist()]


def character_model(documents: DataFrame) -> CharacterModel:
    """Counted over all words of all documents; tasks hand on the cells that they reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CELLS, np.int64)
        words: Counter[str] = Counter()

        def add() -> None:
            if not words:
                return
            weight = np.fromiter(words.values(), np.int64, len(words))
            size = np.fromiter(map(len, words), np.int64, len(words))
            points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
            pad = ORDER - 1
            begin = np.cumsum(size + pad + 1) - (size + pad + 1)
            at = np.arange(len(points)) + np.repeat(begin + pad - (np.cumsum(size) - size), size)
            flat = np.zeros(int((size + pad + 1).sum()), np.uint64)
            flat[at] = _code(points)
            said = np.concatenate([at, begin + pad + size])
            by = np.concatenate([np.repeat(weight, size), weight])
            context = np.zeros(len(said), np.uint64)
            for back in range(1, ORDER):
                context |= flat[said - back] << np.uint64(8 * (back - 1))
            for order in range(1, ORDER + 1):
                for cells in (_cells(order, context, flat[said]), _cells(order, context)):
                    table[:] += np.bincount(cells, by, CELLS).astype(np.int64)
            words.clear()

        for batch in batches:
            for part in slices(batch):
                for text in _python_texts(part.column("text")):
                    words.update(_WORD.findall(folded(text)))
                if len(words) >= HELD:
                    add()
        add()
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], ["cell", "n"])

    got = documents.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    table = np.zeros(CELLS, np.float32)
    table[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return CharacterModel(table)


def restore(documents: DataFrame, model: CharacterModel, name: str = "restored") -> DataFrame:
    """All columns of ``documents`` with the text as read through the channel: words in lower case, parted by spaces."""
    keep = documents.drop(name)
    sent = ship(documents.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Restorer(sent())
        for batch in batches:
            for part in slices(batch):
                read = [" ".join(w for w in words if w) for words in reader.read(_python_texts(part.column("text")))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(read, pa.string())], [*part.schema.names, name])

    return keep.mapInArrow(run, T.StructType([*keep.schema.fields, T.StructField(name, T.StringType())]))


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return ["=" + word, *("^" + word[:k] for k in BEGINNINGS if k <= len(word))]


def _least_share(ours, n, sqrt):
    """Wilson's lower bound of a share, of numbers or columns: a word that few documents hold says little."""
    z = DEVIATIONS
    q = ours / n
    return (q + z * z / (2 * n) - z * sqrt(q * (1 - q) / n + z * z / (4 * n * n))) / (1 + z * z / n)


@dataclass
class ToxicityModel:
    characters: CharacterModel
    #: Documents that hold a feature: toxic ones, others.
    counts: dict[str, tuple[int, int]]
    totals: tuple[int, int]
    weights: np.ndarray
    share: float = 0.5
    constant: float | None = None
    _strong: dict[str, float] = field(default_factory=dict)

    def evidence(self, feature: str, taught: int | None = None) -> float:
        """Logarithm of the odds that a feature adds at the least, without the document itself if it has taught."""
        if feature not in self.counts:
            return 0.0
        ours, others = self.counts[feature]
        ours, others = ours - (taught == 1), others - (taught == 0)
        if ours <= 0:
            return 0.0
        share, low = self.totals[0] / sum(self.totals), float(_least_share(ours, ours + others, np.sqrt))
        return float(np.log(low / (1 - low)) - np.log(share / (1 - share)))

    def strength(self, word: str, taught: int | None = None) -> float:
        """The strongest evidence of a word, 0 if there is none."""
        return max(0.0, *(self.evidence(f, taught) for f in features(word) if f in self.counts), 0.0)

    def inputs(self, words: set[str], taught: int | None = None, strong: dict[str, float] | None = None) -> tuple[float, ...]:
        """1, the strongest words' evidence, and the logarithms of the numbers of words with evidence and of different words."""
        some = [strong[w] for w in words & strong.keys()] if strong is not None else [self.strength(w, taught) for w in words]
        found = sorted((v for v in some if v >= LEAST_EVIDENCE), reverse=True)
        best = [*found[:STRONGEST], *[0.0] * (STRONGEST - len(found))]
        return (1.0, *best, float(np.log1p(len(found))), float(np.log1p(len(words)) / 10))

    def scores(self, reader: Restorer, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        read, fresh = reader.distinct(texts)
        for word in fresh:
            if (value := self.strength(word)) >= LEAST_EVIDENCE:
                self._strong[word] = value
        x = np.array([self.inputs(words, strong=self._strong) for words in read]).reshape(len(texts), -1)
        least = np.where(x[:, 1] > 0, x[:, 1] + np.log(self.share / (1 - self.share)), -50)
        return np.round(1 / (1 + np.exp(-np.clip(np.maximum(x @ self.weights, least), -50, 50))), DIGITS)


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: the remainder of crc32 of the id as text by 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        w = w - np.linalg.solve(h, x.T @ (weight * (p - y)) + 0.05 * w)
    return w


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (y, text) with the least hash of three words that follow each other: near copies mostly share it."""
    for batch in batches:
        for part in slices(batch):
            out = []
            for text in _python_texts(part.column("text")):
                words = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in _WORD.findall(folded(text))], np.uint64)
                runs = words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(1 << 20) + words[2:] * np.uint64(1 << 31) if len(words) > 2 else words.sum(keepdims=True)
                out.append(int(mix(runs).min().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("y"), part.column("text"), pa.array(out, pa.int64())], ["y", "text", "sketch"])


def train(documents: DataFrame, labels: DataFrame, characters: CharacterModel | None = None, per_class: int = PER_CLASS) -> ToxicityModel:
    """Counts the evidence in at most ``per_class`` labelled rows of each class, chosen by a hash of the id.

    Texts stay on executors: counts of features that toxic documents share come back, then a few numbers for each row.
    """
    spark: SparkSession = documents.sparkSession
    characters = characters or character_model(documents)
    ours = labels.select("doc_id", F.col("toxic").alias("y")).where("doc_id is not null and y in (0, 1)")
    ours = ours.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    share = ours.agg(F.avg("y")).first()[0]
    if share is None or share in (0.0, 1.0):
        return ToxicityModel(characters, {}, (0, 0), np.zeros(STRONGEST + 3), constant=0.5 if share is None else float(share))
    order = F.xxhash64("doc_id", F.lit("toxicity-sample"))
    picked = ours.where("y = 0").orderBy(order).limit(per_class).unionByName(ours.where("y = 1").orderBy(order).limit(per_class))
    # twice per_class rows at most, so they may be broadcast
    texts = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("y", "text")
    texts = Workspace(spark, "toxicity").save(texts.mapInArrow(_sketched, "y int, text string, sketch long").dropDuplicates(["y", "sketch"]).drop("sketch"), "sample")
    sent = ship(spark, characters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Restorer(sent())
        for batch in batches:
            for part in slices(batch):
                held: tuple[Counter[str], Counter[str]] = Counter(), Counter()
                for y, words in zip(part.column("y").to_pylist(), reader.distinct(_python_texts(part.column("text")))[0]):
                    held[y].update({f for w in words for f in features(w)})
                names = list(held[0] | held[1])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([held[y][f] for f in names], pa.int64()) for y in (1, 0))], ["feature", "ours", "others"])

    totals = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel(characters, {}, (n1, n0), np.zeros(STRONGEST + 3), constant=float(share))
    part = n1 / (n1 + n0)
    found = texts.mapInArrow(count, "feature string, ours long, others long").groupBy("feature").agg(F.sum("ours").alias("ours"), F.sum("others").alias("others"))
    low = _least_share(F.col("ours"), F.col("ours") + F.col("others"), F.sqrt)
    odds = F.log(low / (1 - low)) - float(np.log(part / (1 - part)))
    kept = found.where((F.col("ours") >= LEAST_TOXIC) & (odds >= LEAST_EVIDENCE)).toArrow().to_pydict()  # of the sample's words
    model = ToxicityModel(characters, dict(zip(kept["feature"], zip(kept["ours"], kept["others"]))), (n1, n0), np.zeros(STRONGEST + 3), float(share))
    shipped = ship(spark, model)

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped()
        reader = Restorer(own.characters)
        for batch in batches:
            for some in slices(batch):
                y = some.column("y").to_pylist()
                x = [own.inputs(words, taught) for taught, words in zip(y, reader.distinct(_python_texts(some.column("text")))[0])]
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    got = texts.mapInArrow(see, "y int, x array<double>").toArrow().to_pydict()
    x, y = np.array(got["x"]), np.array(got["y"], float)
    order_ = np.lexsort((*x.T, y))
    x, y = x[order_], y[order_]
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    model.weights = _logistic(x, y, weight)
    return model


def score(documents: DataFrame, model: ToxicityModel, threshold: float = 0.7, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``documents`` with the score and whether it reaches the threshold; columns so named are replaced."""
    keep = documents.drop(*names)
    schema = T.StructType([*keep.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    sent = ship(documents.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent()
        reader = Restorer(own.characters)
        for batch in batches:
            for part in slices(batch):
                s = own.scores(reader, _python_texts(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [*part.schema.names, *names])

    return keep.mapInArrow(run, schema)
