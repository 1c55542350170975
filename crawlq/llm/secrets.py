"""Secret scan: strong patterns report at once, weak ones only in company.

Strong spans are assignments, access identifiers and long hexadecimal runs. A credential
often comes in several parts, each too common to report alone: an account name, a mixed token, an
address of a service. These weak parts are linked by an interval join: parts stand in bins as wide as the
scope, a weak part looks into its own bin and the two beside it, and each bin answers with the first and last
start per role. A weak part is reported when the parts that complete it start within the scope.

Everything is DataFrame and SQL functions. Patterns run in the row; only parts of texts with weak
parts are shuffled, keyed by text and bin, so one long text is spread over tasks and a bin gives a
bounded answer however many parts it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlq.functions.text import literal, once
from crawlq.llm.common import only, stored

SCOPE = 200

# The strong patterns, and the least length of group 2 or of the whole match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ that have 24 characters or more
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Weak parts: an account name, a token that mixes cases and digits, the address of a service.
IDENTITY = r"""(?i)\b(?:user(?:name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}"""
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{16,}"
ENDPOINT = r"""(?i)\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqps?|mongodb)://[^\x00-\x20"'<>]+|\b(?:[a-z0-9-]{1,63}\.){1,8}[a-z]{2,24}:[0-9]{2,5}\b"""

#: kind: (rank in the order of spans, role, pattern); the first three are strong.
KINDS = {
    "assign": (0, "secret", ASSIGN),
    "access": (1, "identity", ACCESS),
    "hex": (2, "secret", HEX),
    "weak_identity": (3, "identity", IDENTITY),
    "weak_secret": (4, "secret", TOKEN),
    "endpoint": (5, "endpoint", ENDPOINT),
}
STRONG = ("assign", "access", "hex")
#: What must start within the scope of a weak part of each role.
COMPLETED_BY = {"identity": ("secret",), "secret": ("identity",), "endpoint": ("identity", "secret")}

SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def _spans(kind: str) -> str:
    """SQL text: the matches of a kind as spans in code points, from the matches and the gaps between them."""
    rank = KINDS[kind][0]
    checked = f"__value_{kind}[i]" if kind == "assign" else f"__match_{kind}[i]"
    ok = f"length({checked}) >= {LEAST[kind]}" if kind in LEAST else "true"
    return f"""aggregate(sequence(0, size(__match_{kind}) - 1),
        struct(CAST(0 AS BIGINT) AS at, CAST(array() AS {SPAN}) AS spans),
        (s, i) -> struct(s.at + length(__gap_{kind}[i]) + length(__match_{kind}[i]) AS at,
          CASE WHEN {ok} THEN concat(s.spans, array(struct(s.at + length(__gap_{kind}[i]) AS start, {rank} AS rank,
            {literal(kind)} AS kind, s.at + length(__gap_{kind}[i]) + length(__match_{kind}[i]) AS end)))
          ELSE s.spans END AS spans),
        s -> s.spans)"""


def found_parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, strong and weak spans per row. Matches of a kind are leftmost and do not overlap."""
    df = only(docs, doc_id=doc_id, text=text).withColumn("text_key", F.xxhash64("text"))
    matches = {f"__match_{k}": f"regexp_extract_all(text, {literal(p)}, 0)" for k, (_, _, p) in KINDS.items()}
    df = once(df, matches | {"__value_assign": f"regexp_extract_all(text, {literal(ASSIGN)}, 2)"})
    df = once(
        df,
        {
            f"__gap_{k}": f"CASE WHEN size(__match_{k}) > 0 THEN split(text, {literal(p)}, -1) END"
            for k, (_, _, p) in KINDS.items()
        },
    ).drop("text")
    empty = f"CAST(array() AS {SPAN})"
    df = once(df, {f"__{k}": f"CASE WHEN size(__match_{k}) > 0 THEN {_spans(k)} ELSE {empty} END" for k in KINDS})
    df = df.select(
        "doc_id",
        "text_key",
        F.expr("array_sort(concat(" + ", ".join(f"__{k}" for k in STRONG) + "))").alias("strong"),
        F.expr("array_sort(concat(" + ", ".join(f"__{k}" for k in KINDS if k not in STRONG) + "))").alias("weak"),
    )
    return once(df, {"strong": "strong", "weak": "weak"})


def standing_alone(parts: DataFrame) -> DataFrame:
    """`parts` without the weak ones that overlap a strong span, as those are part of it.

    A strong span that starts no later overlaps where the furthest end so far lies beyond the part's start, and one
    that starts no earlier where the nearest start from there on lies before its end: two sorted passes over the spans of a text.
    """
    of_text = Window.partitionBy("doc_id", "text_key")
    strong = F.col("rank") < len(STRONG)
    furthest = F.max(F.when(strong, F.col("end"))).over(of_text.orderBy("start"))
    nearest = F.min(F.when(strong, F.col("start"))).over(of_text.orderBy(F.desc("start")))
    marked = parts.withColumn("__furthest", furthest).withColumn("__nearest", nearest)
    overlaps = "coalesce(__furthest > start, false) OR coalesce(__nearest < end, false)"
    return marked.where(f"rank < {len(STRONG)} OR NOT ({overlaps})").drop("__furthest", "__nearest")


def linked_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, text_key, linked: the weak spans whose complementary parts start at most `scope` code points away.

    A weak part that overlaps a strong span is part of that one and is left out.
    """
    role = "CASE rank " + " ".join(f"WHEN {r} THEN {literal(role)}" for r, role, _ in KINDS.values()) + " END"
    base = found.where("size(weak) > 0").dropDuplicates(["doc_id", "text_key"])
    parts = base.select("doc_id", "text_key", F.expr("inline(concat(strong, weak))"))
    parts = standing_alone(parts)
    parts = parts.withColumn("role", F.expr(role)).withColumn("bin", F.expr(f"start DIV {scope}"))
    bins = parts.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), F.col("bin").alias("at"), F.col("role").alias("other")).agg(
        F.min("start").alias("first"), F.max("start").alias("last")
    )
    asks = parts.where(f"rank >= {len(STRONG)}").withColumn("look", F.explode(F.expr("array(bin - 1, bin, bin + 1)")))
    joined = asks.join(
        bins,
        F.expr(f"""doc_id <=> id AND text_key = key AND look = at
            AND first <= start + {scope} AND last >= start - {scope}"""),
    )
    each = joined.groupBy("doc_id", "text_key", "start", "rank", "kind", "end", "role").agg(F.collect_set("other").alias("others"))
    complete = " OR ".join(
        f"(role = {literal(r)} AND " + " AND ".join(f"array_contains(others, {literal(o)})" for o in needs) + ")"
        for r, needs in COMPLETED_BY.items()
    )
    return (
        each.where(complete)
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("linked"))
    )


def secrets(docs: DataFrame, scope: int = SCOPE, **columns: str) -> DataFrame:
    """One row per input row: doc_id, text_key, strong and linked spans, and `spans`, both in order.

    A null or empty text has no spans. Repeated rows stay repeated and get equal spans.
    """
    found = stored(found_parts(docs, **columns))
    linked = linked_parts(found, scope)
    f, k = found.alias("f"), linked.alias("k")
    joined = f.join(k, F.expr("f.doc_id <=> k.doc_id AND f.text_key = k.text_key"), "left")
    return joined.select(
        "f.doc_id",
        "f.text_key",
        "strong",
        F.expr(f"coalesce(linked, CAST(array() AS {SPAN}))").alias("linked"),
        F.expr(f"array_sort(concat(strong, coalesce(linked, CAST(array() AS {SPAN}))))").alias("spans"),
    )


def redacted(docs: DataFrame, spans: DataFrame, mark: str = "[secret]", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs`, all columns, with every span in `text` replaced by `mark`; overlapping spans become one mark."""
    hits = spans.where("size(spans) > 0").dropDuplicates(["doc_id", "text_key"])
    hits = hits.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans"))
    joined = docs.join(hits, docs[doc_id].eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("__key")), "left")
    # Pieces between the merged spans; `until` is where the last span ended.
    new = f"""CASE WHEN __spans IS NULL THEN `{text}` ELSE aggregate(__spans,
        struct(CAST(0 AS BIGINT) AS until, CAST(array() AS array<string>) AS out),
        (s, x) -> CASE WHEN x.start < s.until OR (x.start = s.until AND s.until > 0) THEN struct(greatest(s.until, x.end) AS until, s.out AS out)
          ELSE struct(x.end AS until, concat(s.out, array(substring(`{text}`, CAST(s.until + 1 AS INT), CAST(x.start - s.until AS INT)))) AS out) END,
        s -> concat(array_join(concat(s.out, array(substring(`{text}`, CAST(s.until + 1 AS INT)))), {literal(mark)}))) END"""
    return joined.select(*[F.expr(new).alias(c) if c == text else docs[c] for c in docs.columns])
