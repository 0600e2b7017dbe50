"""Secret scan with DataFrame functions only.

Base kinds come from fixed patterns. Further spans of kind ``entropy`` come from candidate strings
(runs of key characters): a window of ``WINDOW`` characters slides over the candidate. Its character
counts change by one for the character that leaves and the one that enters, the sum of
c * log2(c) over them by these two counts, and the largest Shannon entropy is held against the threshold of
the candidate's character class. The allow-list suppresses what only looks random.

Spans are in code points with an exclusive end. Null texts count as empty and have no spans. Rows
are judged one by one, so repeated rows, ties and null ids need no care; extra columns stay. An empty table gives no
rows, and very long texts are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Kinds in their order, pattern, group that is measured and its least length.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
#: Long candidates are worked off in pieces that overlap by a window less one character.
PIECE = 108
#: Character classes in the order in which they are tried, and the least entropy in bits of a window of each.
CLASSES = {"hex": ("^([0-9a-f]+|[0-9A-F]+)$", 3.1), "letters": ("^[A-Za-z]+$", 3.95), "alnum": ("^[A-Za-z0-9]+$", 3.8), "base64": ("^", 3.9)}
#: Strings that are no secrets: digits alone, UUIDs, slugs and paths of words and short numbers.
ALLOWED = [
    r"^[0-9+/_-]+$",
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^[-_/+]*([A-Za-z]{1,19}|[0-9]{1,4})([-_/+]+([A-Za-z]{1,19}|[0-9]{1,4}))+[-_/+]*$",
]


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _located(text: str, pattern: str, group: int) -> Column:
    """array<struct<start, end, value>> of all matches; value is the named group."""
    p = _literal(pattern)
    return F.expr(
        f"""if({text} rlike {p},
              aggregate(
                arrays_zip(transform(split({text}, {p}, -1), x -> char_length(x)), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group})),
                struct(0 as at, cast(array() as array<struct<start: int, end: int, value: string>>) as found),
                (acc, m) -> struct(
                  acc.at + m.`0` + coalesce(char_length(m.`1`), 0) as at,
                  if(m.`1` is null, acc.found, concat(acc.found, array(struct(acc.at + m.`0` as start, acc.at + m.`0` + char_length(m.`1`) as end, m.`2` as value)))) as found),
                acc -> acc.found),
              cast(array() as array<struct<start: int, end: int, value: string>>))"""
    )


def _entropy(c: str) -> str:
    """SQL for the largest window entropy of string ``c``, which is at most PIECE + WINDOW - 1 long.

    z.at: for each character its place among the distinct ones; acc.n: how many of each the window holds.
    """
    term = lambda n: f"if({n} > 1, {n} * log2({n}), 0D)"
    w = WINDOW
    # x: the counts after the character that leaves (o, or -1), then the one that enters (a)
    left = "if(o < 0, acc.n, transform(acc.n, (v, k) -> if(k = o, v - 1, v)))"
    gone = f"if(o < 0, 0D, {term('(acc.n[o] - 1)')} - {term('acc.n[o]')})"
    step = f"struct(transform(x.n, (v, k) -> if(k = a, v + 1, v)) as n, x.s + {term('(x.n[a] + 1)')} - {term('x.n[a]')} as s, acc.best as best)"
    scored = f"struct(y.n as n, y.s as s, if(i >= {w}, greatest(y.best, log2({w}D) - y.s / {w}D), y.best) as best)"
    bound = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    move = bound("x", f"struct({left} as n, acc.s + {gone} as s)", bound("y", step, scored))
    move = bound("a", "z.at[i - 1]", bound("o", f"if(i > {w}, z.at[greatest(0, i - {w + 1})], -1)", move))
    chars = f"split({c}, '')"
    places = f"struct(transform({chars}, x -> cast(array_position(array_distinct({chars}), x) - 1 as int)) as at, array_repeat(0, size(array_distinct({chars}))) as zero)"
    return bound("z", places, f"aggregate(sequence(1, size(z.at)), struct(z.zero as n, 0D as s, 0D as best), (acc, i) -> {move}, acc -> acc.best)")


def scan(documents: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """``documents`` with ``name``: array<struct<start, rank, end, kind>>, sorted. A column so named is replaced."""
    t = "__secret_text"
    out = documents.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    for kind, (pattern, group, _) in KINDS.items():
        out = out.withColumn(f"__secret_{kind}", _located(t, pattern, group))
    span = lambda kind, rank, src, keep: (
        f"transform(filter({src}, x -> {keep}), x -> struct(x.start as start, {rank} as rank, x.end as end, '{kind}' as kind))"
    )
    base = ", ".join(span(kind, rank, f"__secret_{kind}", f"char_length(x.value) >= {least}") for rank, (kind, (_, _, least)) in enumerate(KINDS.items()))
    out = out.withColumn("__secret_base", F.expr(f"concat({base})"))
    allowed = " or ".join(f"x.value rlike {_literal(p)}" for p in ALLOWED)
    inside = "exists(__secret_base, b -> b.start <= x.start and x.end <= b.end)"
    out = out.withColumn("__secret_tried", _located(t, CANDIDATE, 0))
    out = out.withColumn("__secret_tried", F.expr(f"filter(__secret_tried, x -> not ({allowed}) and not {inside})"))
    limit = "case " + " ".join(f"when x.value rlike '{p}' then {least}D" for p, least in CLASSES.values()) + " end"
    pieces = f"transform(sequence(0, greatest(0, (char_length(x.value) - {WINDOW}) div {PIECE})), k -> substring(x.value, cast(k * {PIECE} + 1 as int), {PIECE + WINDOW - 1}))"
    random = f"exists({pieces}, p -> {_entropy('p')} >= {limit})"
    out = out.withColumn("__secret_extra", F.expr(span("entropy", len(KINDS), "__secret_tried", random)))
    out = out.withColumn(name, F.expr("array_sort(concat(__secret_base, __secret_extra))"))
    return out.drop(t, "__secret_tried", "__secret_extra", "__secret_base", *(f"__secret_{k}" for k in KINDS))


def digest(spans: str = "spans") -> list[Column]:
    """Counts by base kind, the digest of base spans, and all spans as text."""
    joined = lambda src: f"concat_ws(',', transform({src}, x -> concat(x.kind, ':', x.start, ':', x.end)))"
    counts = [F.expr(f"cast(size(filter({spans}, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    base = joined(f"filter({spans}, x -> x.kind != 'entropy')")
    return [*counts, F.sha2(F.expr(base).cast("binary"), 256).alias("base_sha256"), F.expr(joined(spans)).alias("spans")]


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with every span of its text replaced by its kind in square brackets; overlapping spans become one."""
    spans = "__secret_spans"
    whole = F.expr(
        f"""aggregate({spans}, struct(0 as at, '' as out),
              (acc, x) -> struct(
                greatest(acc.at, x.end) as at,
                if(x.start >= acc.at, concat(acc.out, substring({text}, acc.at + 1, x.start - acc.at), '[', x.kind, ']'), acc.out) as out),
              acc -> concat(acc.out, substring({text}, acc.at + 1)))"""
    )
    return scan(documents, text, spans).withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(F.col(text))).drop(spans)
