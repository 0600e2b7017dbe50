"""One query for each operator, over its whole table; see the operators for their semantics."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import codes, decontaminate, divergence, embeddings, language, minhash, packing, quality, secrets, substring, toxicity, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *secrets.digest())


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, threshold=0.8).drop("text_hash", "first")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(_table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds with at most a fifth of its words edited."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), similarity=0.8)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)
    return packed.drop("ids")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(documents, _table(spark, sf_dir, "labels"))
    scored = quality.score(documents, model, threshold=0.3)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the toxic mark of the document that the number in its url's path names."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    named = pages.select("page_id", urls.document_number(F.col("url")).alias("doc_id")).where("doc_id is not null")
    marks = named.join(_table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").select("page_id", F.col("toxic").alias("bad"))
    return urls.judge(pages, marks)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codes.compress(_table(spark, sf_dir, "embeddings"))
    rows = codes.with_label_errors(found.vectors)
    return rows.select("vec_id", "code", "error", "label_error", F.lit(found.digest).alias("codebooks_sha256"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(documents, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model, threshold=0.7)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_secret_scan": op3_secret_scan,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_packing": op8_packing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_url_filter": op10_url_filter,
    "op11_source_divergence": op11_source_divergence,
    "op12_vector_codes": op12_vector_codes,
    "op13_toxicity": op13_toxicity,
}

_REACH = """reach AS (SELECT DISTINCT a AS id, a AS seen FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.seen),
  comp AS (SELECT id, min(seen) AS component FROM reach GROUP BY id)"""



def _sql_matches(name: str, kind: str, rank: int, pattern: str, group: int) -> str:
    """Matches of a pattern with their places: what lies before each, and the matches before it."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""{name} AS MATERIALIZED (SELECT doc_id, {rank} AS rank, '{kind}' AS kind, w, v, s - length(w) AS s, s AS e FROM
    (SELECT *, sum(gap + length(w)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS s FROM
      (SELECT doc_id, generate_subscripts(ms, 1) AS k, unnest(ms) AS w, unnest(vs) AS v, unnest(list_transform(gaps[1:len(ms)], lambda x: length(x))) AS gap FROM
        (SELECT doc_id, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {group}) AS vs, string_split_regex(t, {p}) AS gaps FROM d))))"""


def _secrets_sql() -> str:
    """Entropies of all windows come from the aggregate, not from incremental counts."""
    kinds = [_sql_matches(kind, kind, rank, p, group) for rank, (kind, (p, group, _)) in enumerate(secrets.KINDS.items())]
    base = " UNION ALL ".join(f"SELECT * FROM {kind} WHERE length(v) >= {least}" for kind, (_, _, least) in secrets.KINDS.items())
    allowed = " OR ".join(f"regexp_matches(w, '{p}')" for p in secrets.ALLOWED)
    n, limits = secrets.WINDOW, " ".join(f"WHEN regexp_matches(w, '{p}') THEN {least}" for p, least in secrets.CLASSES.values())
    counts = ", ".join(f"count_if(kind = '{kind}')::BIGINT AS n_{kind}" for kind in secrets.KINDS)
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank)"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents), {", ".join(kinds)},
  base AS MATERIALIZED ({base}), {_sql_matches("tried", "entropy", len(kinds), secrets.CANDIDATE, 0)},
  left_over AS (SELECT * FROM tried x WHERE NOT ({allowed}) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s <= x.s AND x.e <= b.e)),
  extra AS (SELECT * FROM left_over WHERE list_max(list_transform(range(1, length(w) - {n - 2}), lambda i: list_entropy(string_split(w[i:i + {n - 1}], '')))) >=
    CASE {limits} END),
  every AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
  found AS (SELECT doc_id, {counts}, {joined} FILTER (kind <> 'entropy') AS b, {joined} AS a FROM every GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in secrets.KINDS)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN found USING (doc_id)"""


def _urls_sql() -> str:
    """Rules are enumerated: every combination of up to ITEMS tokens of a labelled page is counted."""
    order = sorted(urls.RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'".format(v) for v, h, p in order)
    named = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for v, h, p in order)
    fold = lambda x: f"list_transform({x}, lambda w: regexp_replace(w, '[0-9]+', '0', 'g'))"
    some = lambda kind, x: f"list_transform(list_filter({x}, lambda w: w <> ''), lambda w: '{kind}:' || w)"
    words = fold("flatten(list_transform(ls[1:greatest(len(ls) - 2, 0)], lambda x: string_split_regex(x, '[-_]')))")
    parts = [some("domain", "[array_to_string(ls[greatest(len(ls) - 1, 1):], '.')]"), some("word", words), some("step", fold("string_split(path, '/')")), some("query", "list_transform(string_split(q, '&'), lambda x: string_split(x, '=')[1])")]
    every = parts[0]
    for part in parts[1:]:
        every = f"list_concat({every}, {part})"
    combos = []
    for n in range(1, urls.ITEMS + 1):
        names = [f"t{k}" for k in range(n)]
        tables = "terms t0 " + " ".join(f"JOIN terms {b} ON {b}.page_id = t0.page_id AND {b}.token > {a}.token" for a, b in zip(names, names[1:]))
        combos.append(f"SELECT [{', '.join(f'{t}.token' for t in names)}] AS a, t0.page_id, t0.bad FROM {tables}")
    return rf"""WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
  s AS (SELECT page_id, url, translate(regexp_extract(coalesce(rest, ''), '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '(?s)^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '(?s)\?([^#]*)', 1) AS q FROM u),
  p AS MATERIALIZED (SELECT *, CASE WHEN host <> '' THEN list_sort(list_distinct({every})) ELSE []::VARCHAR[] END AS items FROM (SELECT *, string_split(host, '.') AS ls FROM s)),
  known AS MATERIALIZED (SELECT page_id, max(toxic) AS bad FROM p JOIN labels ON doc_id = try_cast(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT) WHERE toxic IN (0, 1) GROUP BY page_id),
  every AS (SELECT page_id, bad, unnest(items) AS token FROM p JOIN known USING (page_id)),
  twins AS (SELECT min(token) AS token FROM (SELECT token, list_sort(array_agg(page_id)) AS held FROM every GROUP BY token) GROUP BY held),
  terms AS MATERIALIZED (SELECT * FROM every SEMI JOIN (SELECT token FROM every SEMI JOIN twins USING (token) GROUP BY token HAVING sum(bad) >= {urls.LEAST_COUNT}) x USING (token)),
  combos AS (SELECT a, count(*) AS n, sum(bad) AS b FROM ({" UNION ALL ".join(combos)}) GROUP BY a),
  rules AS MATERIALIZED (SELECT a, b / n AS confidence FROM combos, (SELECT count(*) AS total, sum(bad) AS bads FROM known)
    WHERE b >= {urls.LEAST_COUNT} AND b / n >= {urls.CONFIDENCE} AND b / n * total / bads >= {urls.LIFT}),
  pruned AS (SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM rules o WHERE len(o.a) < len(r.a) AND list_has_all(r.a, o.a) AND o.confidence >= r.confidence)),
  hit AS (SELECT page_id, max(struct_pack(c := confidence, m := array_to_string(a, ' & '))).m AS mined FROM p JOIN pruned ON list_has_all(items, a) GROUP BY page_id),
  fixed AS (SELECT page_id, host, path, CASE {named} END AS rule, CASE {fits} END AS v FROM p)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN mined IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN rule IS NULL THEN mined END AS mined FROM fixed LEFT JOIN hit USING (page_id)"""


def _codes_sql() -> str:
    """Lloyd's rounds over all vectors' parts, one after the other."""
    n = codes.PARTS
    steps = []
    for k in range(codes.ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, p, part, min((d, e)) AS best FROM
    (SELECT vec_id, p, part, e, list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN b{k} USING (p)) GROUP BY ALL)""")
        if k < codes.ROUNDS:
            steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean, entry) AS entry FROM b{k} LEFT JOIN
    (SELECT p, e, list((s - ((s % m) + m) % m) // m ORDER BY i) AS mean FROM
      (SELECT p, best[2] AS e, i, sum(part[i])::BIGINT AS s, count(*) AS m FROM (SELECT *, unnest(range(1, len(part) + 1)) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL) USING (p, e))""")
    last = codes.ROUNDS
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) > 0 AND len(embedding) % {n} = 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
  parts AS MATERIALIZED (SELECT vec_id, p, x[p * (len(x) // {n}) + 1:(p + 1) * (len(x) // {n})] AS part FROM (SELECT *, unnest(range({n})) AS p FROM v)),
  b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS entry FROM parts QUALIFY e < {codes.ENTRIES}),
  {", ".join(steps)},
  coded AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM a{last} GROUP BY vec_id),
  digest AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN v USING (vec_id), digest"""


def _divergence_sql() -> str:
    """Every group meets every kept term of its language, and every other source of it."""
    unit, top = divergence.UNIT, divergence.TOP_TERMS
    ranked = "row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INTEGER AS rank"
    return rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
  w AS MATERIALIZED (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  kept AS MATERIALIZED (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= {divergence.LEAST_DOCUMENTS}),
  c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
  g AS (SELECT DISTINCT lang, source FROM d),
  dense AS MATERIALIZED (SELECT lang, source, term, n, (1 + {unit} * (n + 1) // sum(n + 1) OVER (PARTITION BY lang, source))::BIGINT AS p
    FROM (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term)),
  whole AS MATERIALIZED (SELECT lang, term, (1 + {unit} * (n + 1) // sum(n + 1) OVER (PARTITION BY lang))::BIGINT AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL)),
  pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
  marks AS (SELECT dense.lang, source, dense.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM dense JOIN whole ON whole.lang = dense.lang AND whole.term = dense.term WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, {ranked} FROM every
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, {ranked} FROM marks) WHERE rank <= {top}"""


#: DuckDB SQL where it can express the operator on whole tables.
ORACLES: dict[str, str] = {
    "op1_warc": """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first FROM pages)""",
    "op3_secret_scan": _secrets_sql(),
    "op4_embedding_near_dedup": f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
  links AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.95), {_REACH}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM v LEFT JOIN comp ON comp.id = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) d ON d.a = vec_id""",
    "op5_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS k FROM w WHERE len(ws) > 0)),
  n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
  pairs AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM sh p JOIN sh q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL),
  links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), {_REACH}
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.id = doc_id""",
    "op6_substring_dedup": r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  win AS MATERIALIZED (SELECT doc_id, s, sha256(array_to_string(ws[s:s + 19], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
  later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
  gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
  words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
  cut AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(c, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)""",
    "op10_url_filter": _urls_sql(),
    "op11_source_divergence": _divergence_sql(),
    "op12_vector_codes": _codes_sql(),
}
