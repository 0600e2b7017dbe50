"""Each stage of the pipeline against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
import public_tokenizers
from lumenfield.llm import quality
from lumenfield.llm.workspace import Workspace
from test_documents import edits_within, shingles, spans, words_of

STAGE = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, spans string, __good int, text_hash string"


def make_rows():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: rng.choices(vocabulary, k=n)
    base = say(80)
    near = lambda: " ".join(w if k != at else "changed" for at in [rng.randrange(80)] for k, w in enumerate(base))
    texts = [(k, " ".join(say(rng.randint(1, 90)))) for k in range(60)]
    texts += [(100 + k, near()) for k in range(6)] + [(None, near()), (None, " ".join(base)), (50, near())]
    texts += [(7, "another text of id seven " + " ".join(say(30))), texts[3], texts[3], (200, None), (201, ""), (202, ""), (None, None), (None, None), (203, "   ")]
    texts += [(300, " ".join(say(20) + ITEM + say(20))), (None, " ".join(say(5) + ITEM[:-3] + say(5))), (301, " ".join(ITEM).upper()), (1, " ".join(ITEM))]
    texts += [(400, "my password = 'hunter2hunter2' and more " + " ".join(say(10))), (401, "AKIA" + "B" * 20), (402, " ".join(say(30_000)))]
    return [(i, t, "en", "s", None if t is None else len(t), "mine", 5, "clash") for i, t in texts]


ITEM = [f"item{k}" for k in range(25)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = make_rows()
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(ITEM)), (2, None), (3, ""), (None, "the")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def texts(rows):
    return collections.Counter((r[0], r[1]) for r in rows)


def groups(rows):
    """Sets of (id, text) that are near duplicates, by all pairs."""
    keys = list(texts(rows))
    sets = {k: shingles(k[1], 5) for k in keys}
    label = {k: n for n, k in enumerate(keys)}
    for a in keys:
        for b in keys:
            if sets[a] and sets[b] and label[a] != label[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    old, new = label[a], label[b]
                    label = {k: new if v == old else v for k, v in label.items()}
    out = collections.defaultdict(list)
    for k, v in label.items():
        out[v].append(k)
    return out.values()


def contaminated(text):
    return edits_within(ITEM, words_of(text or "")) <= 5


def redacted(text):
    if not text or not spans(text)[1]:
        return text
    end, parts = 0, []
    for a, _, b, kind in spans(text)[1]:
        if a >= end:
            parts.append(text[end:a] + f"[{kind}]")
        end = max(end, b)
    return "".join(parts) + text[end:]


def deduplicated(rows, out):
    """Checks a result of the near-dedup stage."""
    assert max(texts(out).values()) == 1
    for group in groups(rows):
        stayed = [k for k in group if texts(out)[k]]
        ids = [k[0] for k in group]
        least = min((i for i in ids if i is not None), default=None)
        assert len(stayed) == 1 and stayed[0][0] == least, group


def test_quality_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGE["quality_classifier"](spark, docs, folder)
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [tuple(r) for r in docs.collect()]
    good = model.score_texts(pa.array([r[1] for r in rows])) >= 0.3
    assert out.columns == docs.columns
    assert texts(out.collect()) == texts([r for r, g in zip(rows, good) if g])


def test_near_dedup_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGE["minhash_near_dedup"](spark, docs, folder)
    assert out.columns == docs.columns
    got = out.collect()
    deduplicated(make_rows(), got)
    assert all(r["spans"] == "mine" and r["__good"] == 5 for r in got)


def test_decontamination_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGE["benchmark_decontamination"](spark, docs, folder)
    gone = [r for r in make_rows() if contaminated(r[1])]
    assert out.columns == docs.columns and len(gone) == 4
    assert texts(out.collect()) == texts(make_rows()) - texts(gone)


def test_secret_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGE["secret_scan"](spark, docs, folder)
    assert out.columns == docs.columns
    got = out.collect()
    assert texts(got) == collections.Counter((r[0], redacted(r[1])) for r in make_rows())
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got) and sum("[" in (r.text or "") for r in got) == 2


def unpacked(rows):
    parts = collections.defaultdict(list)
    for r in rows:
        parts[r.sequence_id].append(r)
    docs = []
    for group in parts.values():
        assert sum(r.length for r in group) <= 4096
        docs += group
    whole = collections.Counter()
    for r in docs:
        whole[r.doc_id] += r.length
    return whole


def test_run_equals_its_stages_by_brute_force(spark, folder):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = make_rows()
    rows = [r for r, s in zip(rows, model.score_texts(pa.array([r[1] for r in rows]))) if s >= 0.3]
    rest = []
    for group in groups(rows):  # any text of the smallest id may stay, so compare ids and lengths of what is unambiguous
        least = min((k[0] for k in group if k[0] is not None), default=None)
        rest.append([k for k in group if k[0] == least])
    made = len(Workspace.made)
    out = corpus_pipeline.run(spark, folder).collect()
    assert len(Workspace.made) == made + 1
    size = lambda t: len(tokenizer.encode(redacted(t) or "", add_special_tokens=False).ids) + 1
    due = collections.Counter()
    for options in rest:
        clean = [k for k in options if not contaminated(k[1])]
        if clean and len(options) == 1:
            due[clean[0][0]] += size(clean[0][1])
    got = unpacked(out)
    unclear = {options[0][0] for options in rest if len(options) > 1}
    assert {k: v for k, v in got.items() if k not in unclear} == {k: v for k, v in due.items() if k not in unclear} and len(due) > 20


def test_stages_on_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 0
    assert STAGE["packing"](spark, docs, folder).count() == 0
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert STAGE["quality_classifier"](spark, rows, str(tmp_path)).count() == rows.count()
    assert STAGE["benchmark_decontamination"](spark, rows, str(tmp_path)).count() == rows.count()


def test_packing_stage(spark, folder):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGE["packing"](spark, docs, folder).collect()
    due = collections.Counter()
    for i, t, *_ in make_rows():
        due[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert unpacked(out) == due
    ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in out if r.doc_id == 402 for _ in [0]])
    assert len(ids) == due[402]
