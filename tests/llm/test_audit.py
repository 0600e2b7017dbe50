"""Source divergence, vector codes and toxicity against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.llm import codes, divergence, toxicity


# source divergence


def divergence_rows():
    rng = random.Random(5)
    words = ["the", "Über", "été", "x", "İz", "don't", "a1b", "end.of", "tab\tnew\nline", "mañana", "美", "Zoo", "zoo"]
    rows = []
    for k in range(160):
        source = rng.choice(["s1"] * 4 + ["s2", "s3", None, ""])
        rows.append((k, rng.choice(["en", "en", "fr", None]), source, " ".join(rng.choices(words, k=rng.randrange(12))) + (" only" + source if source else "")))
    rows += [(7, "en", "s1", None), (7, "en", "s1", "the the zoo"), (7, "en", "s1", "the the zoo"), (None, "en", "bare", "..."), (None, "xx", "alone", "one one one"), (None, "xx", "beside", None)]
    rows.append((999, "en", "s2", "long tale " * 30_000))
    return rows


def divergence_by_hand(rows):
    fold = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
    df, counts, groups = Counter(), defaultdict(Counter), set()
    for _, lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        df.update((lang, w) for w in set(fold(text)))
        counts[lang, source].update(fold(text))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [w for (g, w), n in df.items() if g == lang and n >= 3]
        own = {s: {w: counts[lang, s][w] for w in kept} for g, s in groups if g == lang}
        own[None] = {w: sum(c[w] for c in own.values()) for w in kept}
        p = {s: {w: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for w, n in c.items()} for s, c in own.items()}
        gap = lambda a, b: (a - b) ** 2 // b
        for s in own:
            if s is None:
                continue
            pairs = [(sum(gap(p[s][w], p[o][w]) for w in kept), o) for o in own if o is not None and o != s]
            terms = [(gap(p[s][w], p[None][w]), w) for w in kept if own[s][w] and p[s][w] > p[None][w]]
            for part, items, top in (("pair", pairs, len(pairs)), ("term", terms, 200)):
                for k, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:top], 1):
                    out.add((lang, s, part, item, v, k))
    return out


@pytest.mark.parametrize("many", [False, True])
def test_divergence_equals_dense_counts(spark, monkeypatch, many):
    if many:  # more groups than are shipped, little text and few pairs a task
        monkeypatch.setattr(divergence, "SHIPPED_GROUPS", 1)
        monkeypatch.setattr(divergence, "PAIRS", 3)
        monkeypatch.setattr(divergence, "HELD", 5)
        monkeypatch.setattr(divergence, "RUN_BYTES", 200)
        monkeypatch.setattr(divergence, "BITS", 64)
    rows = divergence_rows()
    df = spark.createDataFrame([(*r, 1, "clash", 2.0) for r in rows], "doc_id long, lang string, source string, text string, n long, term string, value double")
    got = [tuple(r) for r in divergence.audit(df.repartition(5)).collect()]
    assert len(got) == len(set(got)) and set(got) == divergence_by_hand(rows)
    assert divergence.audit(df.limit(0)).count() == 0


# vector codes


def code_rows():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.2, (60, 16))
    x[10:40] = x[10]  # copies
    x[40:50, :2] = x[41, :2]  # a part that some share
    rows = [(int(k), [float(np.float32(v)) for v in row], int(k % 3) if k % 5 else None) for k, row in enumerate(x[::-1])]
    rows += [(3, rows[3][1], 9), (3, [0.5] * 16, 9), (None, [0.25] * 16, 1), (70, None, 1), (71, [0.1] * 15 + [None], 1), (72, [float("nan")] * 16, 1), (73, [float("inf")] + [0.0] * 15, 1), (74, [], 1), (75, [1.0] * 8, 1), (76, [1.0] * 9, 1)]
    return rows


def codes_by_hand(rows):
    import math
    from fractions import Fraction

    kept = [(i, [math.floor(Fraction(v) * 4096) for v in x], lab) for i, x, lab in rows if x and len(x) == 16 and all(v is not None and math.isfinite(v) for v in x)]
    w = 2
    part = lambda x, p: x[p * w : (p + 1) * w]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, [codes._packed(part(r[1], p)) for p in range(8)]))
    books = [[part(r[1], p) for r in order[:16]] for p in range(8)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    assign = lambda x, p: min(range(len(books[p])), key=lambda e: (far(part(x, p), books[p][e]), e))
    for _ in range(6):
        of = [[assign(x, p) for _, x, _ in kept] for p in range(8)]
        for p in range(8):
            for e in range(len(books[p])):
                mine = [part(x, p) for (_, x, _), a in zip(kept, of[p]) if a == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    errors = [sum(far(part(x, p), books[p][assign(x, p)]) for p in range(8)) for _, x, _ in kept]
    by = defaultdict(int)
    for (_, _, lab), e in zip(kept, errors):
        by[lab] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{assign(x, p):02x}" for p in range(8)), e, by[lab]) for (i, x, lab), e in zip(kept, errors)), digest


@pytest.mark.parametrize("few", [True, False])
def test_codes_equal_plain_lloyd(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(codes, "FEW_LABELS", 0)
    rows = code_rows()
    df = spark.createDataFrame([(*r, "clash", 4) for r in rows], "vec_id long, embedding array<float>, label int, part string, row long")
    found = codes.compress(df.repartition(4))
    got = sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in codes.with_label_errors(found.vectors).collect())
    want, digest = codes_by_hand(rows)
    assert got == want and found.digest == digest


def test_codes_of_few_no_and_large_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int"
    rows = [(k, [float(2**k) * (1 if j % 2 else -1) + j / 8192 for j in range(16)], None) for k in (0, 3, 20, 25)]
    found = codes.compress(spark.createDataFrame(rows, schema))
    want, digest = codes_by_hand(rows)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in codes.with_label_errors(found.vectors).collect()) == want and found.digest == digest
    assert [len(b) for b in found.books] == [4] * 8
    huge = [(1, [1e30, 1.5] * 8, 1), (2, [1e30, 1.5] * 8, 1)]
    assert [r.error for r in codes.compress(spark.createDataFrame(huge, schema)).vectors.collect()] == [0, 0]
    none = codes.compress(spark.createDataFrame([(1, None, 1)], schema))
    assert codes.with_label_errors(none.vectors).count() == 0


# toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    plain = ["river", "window", "garden", "yellow", "bottle", "letter", "across", "mountain", "quiet", "a", "y", "the", "class", "mp3", "grass"]
    bad = ["idiot", "moron", "stupid", "worthless"]
    rows = []
    for k in range(600):
        words = rng.choices(plain, k=rng.randrange(5, 60))
        if k % 6 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words), int(k % 6 == 0)))
    documents = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = documents.select("doc_id", "toxic").where("doc_id % 7 < 6")
    return documents.drop("toxic"), labels


@pytest.fixture(scope="module")
def toxic_model(corpus):
    return toxicity.train(*corpus)


DISGUISES = ["1d10t", "i.d.i.o.t", "i d i o t", "IDIOOOOT", "id*ot", "m0r0n", "m-o-r-o-n", "$tupid", "stuuupiiid", "w0rthle55", "1 d 1 0 t", "wor\u200bthless", "m_o_r_o_n", "5tup!d", "iidiioott"]


def test_disguised_words_are_restored(toxic_model):
    reader = toxicity.Restorer(toxic_model.characters)
    for text in DISGUISES:
        words = " ".join(w for w in reader.read([f"the river {text} garden"])[0] if w).split()
        assert words[2] in ("idiot", "moron", "stupid", "worthless"), (text, words)
    for text in ("the class across grass", "yellow letter", "bottle, window! (garden)"):
        assert " ".join(w for w in reader.read([text])[0] if w) == re.sub(r"[^a-z ]", "", text)
    assert reader.read(["", "  ", "*** %% |"]) == [[], [], ["", "", ""]]


def test_viterbi_equals_all_readings(toxic_model):
    model = toxic_model.characters
    for token, spaced in (("1d10t", False), ("m0rr0n", False), ("idiot", True), ("a.b-c", False), ("id*ot", False), ("x9!@", False)):
        lattice = toxicity.lattice(token, spaced)
        best = None
        for path in itertools.product(*lattice):
            context, value = 0, -sum(c for _, c in path)
            for p in [p for p, _ in path if p] + [32]:
                if p == 32 and context == 0:
                    continue
                code = 0 if p == 32 else int(toxicity._code(np.array([p]))[0])
                value += float(model.log_probability(np.array([context], np.uint64), np.array([code], np.uint64))[0])
                context = 0 if p == 32 else (context << 8 | code) & 0xFFFFFFFF
            best = max(best or (-1e9, ""), (value, "".join(chr(p) for p, _ in path if p)))
        assert model.decode([lattice])[0].split() == best[1].split(), token


def test_planted_toxic_documents_score_high_and_clean_ones_low(spark, toxic_model):
    base = "river window garden " * 4
    rows = [(k, f"{base}{d} {base}", "x") for k, d in enumerate(DISGUISES)] + [(100, base, "x"), (101, None, "x"), (102, "", "x"), (None, base, "x"), (103, base * 3000 + "m0r0n " + base * 3000, "x"), (104, "... ***", "x"), (100, base, "x")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), toxic_model).collect()
    marks = defaultdict(set)
    for r in got:
        marks[r.doc_id].add((r.score, r.predicted))
    assert len(got) == len(rows) and all(len(v) == 1 for v in marks.values())
    flagged = {k for k, v in marks.items() if next(iter(v))[1] == 1}
    assert flagged == {*range(len(DISGUISES)), 103}
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), toxic_model).count() == 0


def test_restored_text_and_whole_runs(spark, toxic_model):
    text = "z " * 70 + "q. " + "b " * 90 + "i d i o t"
    rows = toxicity.restore(spark.createDataFrame([(1, "The M0R0N, river", "old"), (2, text, "old"), (3, None, "old")], "doc_id long, text string, restored string"), toxic_model.characters).collect()
    got = {r.doc_id: r.restored for r in rows}
    assert got[1] == "the moron river" and got[3] == "" and "idiot" in got[2].split()


def test_one_sided_and_missing_labels(spark, corpus):
    documents, labels = corpus
    for toxic, want in (("0", 0.0), ("1", 1.0), ("cast(null as int)", 0.5)):
        model = toxicity.train(documents.limit(20), labels.withColumn("toxic", F.expr(toxic)), toxicity.CharacterModel(np.zeros(toxicity.CELLS, np.float32)))
        assert {r.score for r in toxicity.score(documents.limit(5), model).collect()} == {want}


def test_held_out_rows_do_not_teach_and_are_told_right(spark):
    sf = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(documents, labels)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(documents, turned, model.characters).weights.tolist() == model.weights.tolist()
    scored = toxicity.score(documents.select("doc_id", "text"), model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).toPandas()
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in scored["doc_id"])
    right = (scored["predicted"] == scored["toxic"]).mean()
    hit = scored.loc[scored["toxic"] == 1, "predicted"].mean()
    wrong = scored.loc[scored["toxic"] == 0, "predicted"].mean()
    assert right > 0.98 and hit > 0.88 and wrong < 0.005, (right, hit, wrong)
