"""Secret scan by a trigram inverted index, with DataFrame functions only.

For each rule a Boolean query over trigrams follows from its pattern: every
match must hold certain literal strings, hence all trigrams of one of them.
``trigram_postings`` lists the documents that hold a trigram of these queries
(in lower case), ``candidates`` intersects and unites the postings per
document, and only candidates are verified with the rule's pattern. A rule
without mandatory trigrams scans every document.

A match is a span of code points ``[start, end)``; matches of a rule don't
overlap and run from the left, as the pattern finds them, and those shorter
than the rule's minimum are dropped afterwards. Positions follow from the
lengths of the matches and of the pieces between them.

Null and empty texts have no spans. Rows with equal doc_id share their
candidate rules, and each is verified on its own text; a null doc_id is a key
like any other. An empty table gives an empty result. Extra columns are
ignored by ``secret_spans`` and kept by ``redact``. The list of a document's
spans grows with its matches, and its cost with their square.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramvec.llm.common import fresh


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0  #: what ``least`` measures
    least: int = 1  #: code points of the group
    base: bool = False


RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
MASK = "[SECRET]"

# ------------------------------------------------------- queries of a pattern
#: Literal strings that are followed at once, and characters of a class.
MOST_STRINGS, MOST_CHARS = 64, 8


def _exact(node) -> set[str] | None:
    """All strings that the node matches, if they are few."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                chars.add(chr(value).lower())
            elif kind is C.RANGE and value[1] - value[0] < MOST_CHARS:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return chars if len(chars) <= MOST_CHARS else None
    if op is C.SUBPATTERN:
        return _exact_sequence(arg[-1])
    if op is C.BRANCH:
        found = [_exact_sequence(x) for x in arg[1]]
        return set().union(*found) if all(x is not None for x in found) else None
    if op is C.MAX_REPEAT and arg[1] != C.MAXREPEAT and arg[1] <= 16:
        one, out, times = _exact_sequence(arg[2]), set(), {""}
        for n in range(arg[1] + 1):
            if one is None or len(times) > MOST_STRINGS:
                return None
            out |= times if n >= arg[0] else set()
            times = {a + b for a in times for b in one}
        return out
    return None


def _exact_sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        one = _exact(node)
        if one is None or len(out) * len(one) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND of ORs of trigram sets that hold in the lower case of any text with a match; [] if nothing must."""

    def of(strings: set[str]) -> list[list[frozenset[str]]]:
        if any(len(s) < 3 for s in strings):
            return []
        sets = {trigrams(s) for s in strings}
        return [sorted((x for x in sets if not any(y < x for y in sets)), key=sorted)]

    def walk(nodes) -> list[list[frozenset[str]]]:
        out, now = [], {""}
        for node in nodes:
            one = _exact(node)
            if one is not None and len(now) * len(one) <= MOST_STRINGS:
                now = {a + b for a in now for b in one}
                continue
            out += of(now)
            now = {""} if one is None else one
            if one is None and node[0] is C.SUBPATTERN:
                out += walk(node[1][-1])
            elif one is None and node[0] is C.MAX_REPEAT and node[1][0] > 0:
                out += walk(node[1][2])
        return out + of(now)

    return walk(parser.parse(pattern))


# -------------------------------------------------------------------- Spark
def trigram_postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """``(doc_id, trigram)`` for each of ``grams`` that a document holds in lower case."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = [F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]
    return low.select("doc_id", F.explode(F.array_compact(F.array(*held))).alias("trigram"))


def candidates(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``(doc_id, rules)``: documents whose postings satisfy the queries, with the kinds of these rules.

    The terms of all queries are a table whose size the rules fix, so it is
    broadcast. A set is satisfied if its documents' bits are all there.
    """
    spark = docs.sparkSession
    terms = []
    for rule in rules:
        query = trigram_query(rule.pattern)
        for part, sets in enumerate(query):
            for number, grams in enumerate(sets):
                for bit, gram in enumerate(sorted(grams)):
                    terms.append((rule.kind, part, (1 << len(query)) - 1, number, gram, 1 << bit, (1 << len(grams)) - 1))
    if not terms:
        return spark.createDataFrame([], "doc_id long, rules array<string>")
    table = spark.createDataFrame(terms, "kind string, part int, parts long, number int, trigram string, bit long, bits long")
    postings = trigram_postings(docs, sorted({t[4] for t in terms}))
    return (
        postings.join(F.broadcast(table), "trigram")
        .groupBy("doc_id", "kind", "part", "parts", "number", "bits")
        .agg(F.bit_or("bit").alias("seen"))
        .where("seen = bits")
        .groupBy("doc_id", "kind", "parts")
        .agg(F.expr("bit_or(shiftleft(1L, part))").alias("held"))
        .where("held = parts")
        .groupBy("doc_id")
        .agg(F.collect_set("kind").alias("rules"))
    )


def rule_spans(text: Column, rule: Rule) -> Column:
    """Array of ``(start, end)`` of the rule's matches."""
    pattern = F.lit(rule.pattern)
    parts = F.zip_with(
        F.zip_with(
            F.split(text, rule.pattern, -1),
            F.regexp_extract_all(text, pattern, F.lit(0)),
            lambda gap, found: F.struct(F.length(gap).alias("gap"), F.length(found).alias("n")),
        ),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)),
        lambda x, value: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), F.length(value).alias("own")),
    )
    none = F.array().cast("array<struct<start:int,end:int,own:int>>")
    walked = F.aggregate(
        F.filter(parts, lambda x: x["n"].isNotNull()),
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["n"]).alias("at"),
            F.array_append(
                acc["spans"],
                F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end"), x["own"].alias("own")),
            ).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    kept = F.filter(walked, lambda x: x["own"] >= rule.least)
    return F.when(text.rlike(rule.pattern), kept).otherwise(none)


SPANS = "array<struct<start:int,kind_no:int,kind:string,end:int>>"


def _named(number: int, kind: str):
    return lambda x: F.struct(
        x["start"].alias("start"), F.lit(number).alias("kind_no"), F.lit(kind).alias("kind"), x["end"].alias("end")
    )


def with_spans(docs: DataFrame, rules: list[Rule] = RULES, name: str = "spans") -> DataFrame:
    """``docs`` with all spans of their text, by start, then in the order of the rules."""
    own = fresh(docs, "_secret_")
    listed = candidates(docs, rules).select(F.col("doc_id").alias(f"{own}doc"), F.col("rules").alias(f"{own}rules"))
    joined = docs.join(listed.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col(f"{own}doc")), "left")
    found = []
    for number, rule in enumerate(rules):
        spans = F.transform(rule_spans(docs["text"], rule), _named(number, rule.kind))
        if trigram_query(rule.pattern):
            spans = F.when(F.array_contains(f"{own}rules", rule.kind), spans)
        found.append(F.coalesce(spans, F.array().cast(SPANS)))
    # one generated row, so that no later column evaluates the patterns again
    made = F.explode(F.array(F.array_sort(F.concat(*found)))).alias(name)
    return joined.select(*[docs[c] for c in docs.columns], made)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_spans(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``doc_id, spans`` of every document."""
    return with_spans(docs.select("doc_id", "text"), rules).select("doc_id", "spans")


def redact(docs: DataFrame, rules: list[Rule] = RULES, mask: str = MASK) -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mask``; ``n_chars``, if there, follows."""
    own = fresh(docs, "_secret_")
    name, changed = f"{own}spans", f"{own}hit"
    text = F.col("text")
    cut = F.aggregate(
        F.col(name),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.when(
                x["start"] >= acc["at"],
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask)),
            )
            .otherwise(acc["out"])
            .alias("out"),
            F.greatest(acc["at"], x["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    marked = with_spans(docs, rules, name)
    hit = F.size(name) > 0
    new = {"text": F.when(hit, cut).otherwise(text)}
    out = marked.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns], hit.alias(changed))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(changed), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def oracle() -> str:
    """DuckDB SQL for the query's rows, by plain scans of all texts."""
    parts = []
    for number, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {number} AS kind_no, '{rule.kind}' AS kind, {rule.base} AS base, {rule.least} AS least,
            regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS v,
            string_split_regex(text, '{pattern}') AS g FROM t"""
        )
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(parts)}),
lens AS (SELECT doc_id, kind_no, kind, base, least, [length(x) for x in m] AS m, [length(x) for x in v] AS v, [length(x) for x in g] AS g
  FROM found WHERE len(m) > 0),
spots AS (SELECT doc_id, kind_no, kind, base, least, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM lens),
spans AS (SELECT doc_id, kind_no, kind, base,
    CAST(list_sum(g[1:i]) + coalesce(list_sum(m[1:i - 1]), 0) AS BIGINT) AS s, m[i] AS n FROM spots WHERE v[i] >= least),
texts AS (SELECT *, kind || ':' || s || ':' || (s + n) AS one FROM spans)
SELECT t.doc_id,
  count(*) FILTER (WHERE kind = 'assign') AS n_assign,
  count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(one, ',' ORDER BY s, kind_no) FILTER (WHERE base), '')) AS base_sha256,
  coalesce(string_agg(one, ',' ORDER BY s, kind_no), '') AS spans
FROM t LEFT JOIN texts USING (doc_id) GROUP BY t.doc_id"""
