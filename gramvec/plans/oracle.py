"""DuckDB SQL for every registered query (the correctness oracle).

The SQL restates each operator's semantics on the raw tables with the same
regular expressions, md5 draws and hash arithmetic, so Spark and DuckDB must
agree row for row. Arrays are compared as joined strings or in long form.
"""

from __future__ import annotations

from gramvec.functions import text as T
from gramvec.functions.hashing import FNV_OFFSET_HI, FNV_OFFSET_LO  # noqa: F401  (documented constants)


def lit(s: str) -> str:
    """SQL string literal (DuckDB keeps backslashes literally)."""
    return "'" + s.replace("'", "''") + "'"


WS = lit(T.WS)
WS_PLUS = lit(T.WS + "+")


def marked_stops(text: str, lang: str) -> str:
    """``text`` with the stops of initials and abbreviations marked."""
    out = f"regexp_replace({text}, {lit(T.INITIALS)}, '\\1\\2' || chr(2) || '\\3\\4' || chr(2), 'g')"
    cases = " ".join(
        f"WHEN lower({lang}) IN ('{long}', '{code}') THEN regexp_replace({out}, {lit(T.abbreviation_pattern(code))}, '\\1\\2' || chr(2), 'g')"
        for long, code in T.LANGUAGE_CODES.items()
    )
    return f"CASE {cases} ELSE {out} END"


def sentences_cte(source: str = "documents") -> str:
    """``source`` has doc_id, lang and text."""
    return f"""
chunks AS (
  SELECT doc_id, unnest(c) AS raw, unnest(range(len(c))) AS sent_idx
  FROM (SELECT doc_id, string_split(regexp_replace({marked_stops('text', 'lang')}, {lit(T.SENTENCE_END)}, '\\1' || chr(1), 'g'), chr(1)) AS c
        FROM {source})
),
sentences AS (
  SELECT doc_id, CAST(sent_idx AS INTEGER) AS sent_idx,
    list_filter(string_split_regex(lower(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw,
        {lit(T.CLAUSE_PUNCT)}, ' \\1 \\2', 'g'),
        {lit(T.DROP_PUNCT)}, ' ', 'g'),
        {lit(T.NEG_CONTRACTION)}, ' \\1\\2', 'g'),
        {lit(T.CONTRACTION)}, ' \\1\\2', 'g'),
        {lit(T.NON_LETTER_OR_WS)}, '', 'g')), {WS_PLUS}), lambda x: x <> '') AS words
  FROM chunks WHERE NOT regexp_full_match(raw, {lit(T.WS + '*')})
)"""


TOKENS_CTE = """
tokens AS (
  SELECT doc_id, sent_idx, CAST(unnest(range(len(w))) AS INTEGER) AS pos, unnest(w) AS word
  FROM (SELECT doc_id, sent_idx, CASE WHEN len(words) = 0 THEN [''] ELSE words END AS w FROM sentences)
)"""

WORD_COUNT_CTE = """
word_count AS (
  SELECT word, cnt, doc_id AS first_doc, sent_idx AS first_sent, pos AS first_pos FROM (
    SELECT word, doc_id, sent_idx, pos,
           CAST(count(*) OVER (PARTITION BY word) AS BIGINT) AS cnt,
           row_number() OVER (PARTITION BY word ORDER BY doc_id, sent_idx, pos) AS rn
    FROM tokens) WHERE rn = 1
),
total AS (SELECT CAST(sum(cnt) AS BIGINT) AS total FROM word_count)"""


def drop_p_cte(threshold: float) -> str:
    return f"""
drop_probability AS (
  SELECT word, cnt, 1.0 - sqrt({float(threshold)!r} / (cnt / total)) AS drop_p FROM word_count, total
)"""


def vocab_cte(vocabulary_size: int, threshold: float) -> str:
    return f"""
vocab AS (
  SELECT word, CAST(rn - 1 AS INTEGER) AS word_id, cnt, 1.0 - sqrt({float(threshold)!r} / (cnt / total)) AS drop_p
  FROM (SELECT *, row_number() OVER (ORDER BY cnt DESC, first_doc, first_sent, first_pos) AS rn FROM word_count), total
  WHERE rn <= {int(vocabulary_size)}
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n"


def U(seed: int, tag: str, *cols: str) -> str:
    """The keyed md5 uniform in DuckDB."""
    key = ", ".join([str(int(seed)), lit(tag), *cols])
    return f"(('0x' || substr(md5(concat_ws('|', {key})), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


def fnv(expr: str, modulus: int | str, offset: int = 1) -> str:
    """FNV-1a 64 of the UTF-8 bytes of ``expr`` modulo ``modulus`` (a number or an SQL value) plus ``offset``."""
    return (
        f"CAST((list_reduce(list_transform(range(1, octet_length(encode({expr})) + 1), "
        f"lambda i: ('0x' || substr(hex(encode({expr})), 2 * i - 1, 2))::HUGEINT), "
        f"lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, "
        f"14695981039346656037::HUGEINT) % {modulus}) + {int(offset)} AS INTEGER)"
    )


def ngrams(expr: str, n: int) -> str:
    m = f"('*' || {expr} || '*')"
    return (
        f"list_concat(CASE WHEN length({m}) >= {n} THEN "
        f"list_transform(range(1, length({m}) - {n} + 2), lambda i: substr({m}, i, {n})) ELSE [] END, [{m}])"
    )


def pairs_cte(skip_window: int, seed: int, passes: int = 1) -> str:
    return f"""
ptok AS (
  SELECT CAST(p AS INTEGER) AS pass, doc_id, sent_idx, words, pos FROM
    (SELECT doc_id, sent_idx, words, CAST(unnest(range(len(words))) AS INTEGER) AS pos FROM sentences WHERE len(words) > 0),
    (SELECT unnest(range({int(passes)})) AS p)
),
pwin AS (
  SELECT *, words[pos + 1] AS target,
         CAST(1 + floor({U(seed, 'win', 'pass', 'doc_id', 'sent_idx', 'pos')} * {int(skip_window)}) AS INTEGER) AS win
  FROM ptok
),
pairs AS (
  SELECT pass, doc_id, sent_idx, pos, CAST(cpos - pos AS INTEGER) AS off, target, words[cpos + 1] AS context FROM (
    SELECT pass, doc_id, sent_idx, pos, target, words,
           CAST(unnest(range(greatest(pos - win, 0), least(pos + win, len(words) - 1) + 1)) AS INTEGER) AS cpos
    FROM pwin) WHERE cpos <> pos
)"""


PAIR_KEY_SQL = "pass, doc_id, sent_idx, pos, off"


def subsampled_cte(seed: int) -> str:
    return f"""
subsampled AS (
  SELECT p.* FROM pairs p
  JOIN drop_probability dt ON dt.word = p.target
  JOIN drop_probability dc ON dc.word = p.context
  WHERE {U(seed, 'sub_t', PAIR_KEY_SQL)} >= dt.drop_p AND {U(seed, 'sub_c', PAIR_KEY_SQL)} >= dc.drop_p
)"""


LABELLED_CTE = """
labelled AS (
  SELECT s.pass, s.doc_id, s.sent_idx, s.pos, s.off, s.target, v.word_id AS label
  FROM subsampled s JOIN vocab v ON v.word = s.context
)"""


def word_buckets_cte(n: int, num_buckets: int, source: str = "word_count") -> str:
    return f"""
wng AS (
  SELECT word, unnest(ng) AS g, unnest(range(len(ng))) AS gi FROM (SELECT word, {ngrams('word', n)} AS ng FROM {source})
),
word_buckets AS (
  SELECT word, list({fnv('g', num_buckets - 1, 1)} ORDER BY gi) AS bucket_ids FROM wng GROUP BY word
)"""


def ordered_cte(batch_size: int) -> str:
    return f"""
ordered AS (
  SELECT l.*, CAST(row_number() OVER (ORDER BY pass, doc_id, sent_idx, pos, off) - 1 AS BIGINT) AS ord,
         CAST((row_number() OVER (ORDER BY pass, doc_id, sent_idx, pos, off) - 1) // {int(batch_size)} AS BIGINT) AS batch_id
  FROM labelled l
),
hashed AS (
  SELECT o.*, wb.bucket_ids FROM ordered o JOIN word_buckets wb ON wb.word = o.target
),
full_hashed AS (
  SELECT *, max(len(bucket_ids)) OVER (PARTITION BY batch_id) AS width FROM hashed
  WHERE batch_id < (SELECT count(*) // {int(batch_size)} FROM ordered)
)"""


def H(seed: int, tag: str, *cols: str) -> str:
    key = ", ".join([str(int(seed)), lit(tag), *cols])
    return f"md5(concat_ws('|', {key}))"


def UH(hexed: str, slot: int) -> str:
    return f"(('0x' || substr({hexed}, {1 + 13 * int(slot)}, 13))::BIGINT / 4503599627370496::DOUBLE)"


def init_emb_cte(embedding_size: int, num_buckets: int, seed: int, buckets_source: str = "corpus_buckets") -> str:
    import math

    lim = math.sqrt(6.0 / (num_buckets + embedding_size))
    h = H(seed, "emb", "bucket_id", "CAST(d // 2 AS INTEGER)")
    u = f"CASE WHEN d % 2 = 0 THEN {UH(h, 0)} ELSE {UH(h, 1)} END"
    return f"""
emb AS (
  SELECT bucket_id, CAST(d AS INTEGER) AS d, CAST(({u} * 2.0 - 1.0) * {lim!r} AS FLOAT) AS x
  FROM {buckets_source}, (SELECT unnest(range({int(embedding_size)})) AS d)
  WHERE bucket_id <> 0
)"""


def init_ow_cte(embedding_size: int, seed: int, ids_source: str) -> str:
    import math

    sd = 1.0 / math.sqrt(embedding_size)
    h = H(seed, "w", "word_id", "d", "r")
    z = f"sqrt(-2.0 * ln(1.0 - {UH(h, 0)})) * cos({2.0 * math.pi!r} * {UH(h, 1)})"
    return f"""
ow_draws AS (
  SELECT word_id, CAST(d AS INTEGER) AS d, r, {z} AS z
  FROM {ids_source}, (SELECT unnest(range({int(embedding_size)})) AS d), (SELECT unnest(range(16)) AS r)
),
ow AS (
  SELECT word_id, d, CAST(arg_min(z, r) * {sd!r} AS FLOAT) AS w, CAST(0.0 AS FLOAT) AS bias
  FROM ow_draws WHERE abs(z) <= 2.0 GROUP BY word_id, d
)"""


CORPUS_BUCKETS_CTE = """
corpus_buckets AS (SELECT DISTINCT unnest(bucket_ids) AS bucket_id FROM word_buckets)"""


def negatives_cte(V: int, K: int, seed: int, oversample: int = 8) -> str:
    return f"""
neg_draws AS (
  SELECT batch_id, d, CAST(floor(exp({U(seed, 'neg', 'batch_id', 'd')} * ln({V + 1.0!r}))) - 1 AS INTEGER) AS wid
  FROM (SELECT DISTINCT batch_id FROM full_hashed), (SELECT unnest(range({int(oversample) * int(K)})) AS d)
),
neg_first AS (SELECT batch_id, wid, min(d) AS d FROM neg_draws GROUP BY batch_id, wid),
neg_ranked AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY d) AS k FROM neg_first),
negs AS (
  SELECT batch_id, CAST(k - 1 AS INTEGER) AS k, wid AS word_id,
         CAST(max(CASE WHEN k = {int(K)} THEN d END) OVER (PARTITION BY batch_id) + 1 AS INTEGER) AS tries
  FROM neg_ranked WHERE k <= {int(K)}
)"""


def nce_ctes(V: int, batch_size: int) -> str:
    """Logits of every (sample, candidate) from ``full_hashed``, ``emb``, ``ow``, ``negs``."""
    B = int(batch_size)
    p = f"((ln(wid + 2.0) - ln(wid + 1.0)) / ln({V + 1.0!r}))"
    return f"""
smp AS (SELECT batch_id, CAST(ord - batch_id * {B} AS INTEGER) AS i, label, bucket_ids FROM full_hashed),
dl AS (SELECT DISTINCT bucket_ids FROM smp),
docc AS (SELECT bucket_ids, unnest(bucket_ids) AS bucket_id FROM dl),
dsx AS (SELECT o.bucket_ids, e.d, sum(e.x) AS x FROM docc o JOIN emb e ON e.bucket_id = o.bucket_id GROUP BY o.bucket_ids, e.d),
dxl AS (SELECT bucket_ids, list(x ORDER BY d) AS xv FROM dsx GROUP BY bucket_ids),
owl AS (SELECT word_id, CAST(list(w ORDER BY d) AS DOUBLE[]) AS wv, max(bias) AS bias FROM ow GROUP BY word_id),
cand AS (
  SELECT s.batch_id, s.i, 0 AS j, s.label AS wid, 1.0 AS y, n.tries FROM smp s
    JOIN (SELECT DISTINCT batch_id, tries FROM negs) n ON n.batch_id = s.batch_id
  UNION ALL
  SELECT s.batch_id, s.i, n.k + 1 AS j, n.word_id AS wid, 0.0 AS y, n.tries FROM smp s JOIN negs n ON n.batch_id = s.batch_id
),
candp AS (SELECT *, {p} AS p FROM cand),
candl AS (SELECT *, CASE WHEN 1.0 - p = 1.0 THEN -p ELSE ln(1.0 - p) * (-p) / ((1.0 - p) - 1.0) END AS l1p FROM candp),
candv AS (SELECT *, tries * l1p AS yy, exp(tries * l1p) AS vv FROM candl),
candq AS (SELECT *, -(CASE WHEN vv = 1.0 THEN yy ELSE (vv - 1.0) * yy / ln(vv) END) AS q FROM candv),
logit AS (
  SELECT c.batch_id, c.i, c.j, c.wid, c.y, list_inner_product(x.xv, o.wv) + o.bias - ln(c.q) AS z
  FROM candq c JOIN smp s ON s.batch_id = c.batch_id AND s.i = c.i
  JOIN dxl x ON x.bucket_ids = s.bucket_ids JOIN owl o ON o.word_id = c.wid
)"""


def nce_grad_ctes(batch_size: int) -> str:
    """Mean gradient per model row over the batches that touched it (from ``logit``)."""
    B = float(batch_size)
    return f"""
gl AS (SELECT l.batch_id, l.i, l.wid, 1.0 / (1.0 + exp(-l.z)) - l.y AS g FROM logit l),
glx AS (SELECT gl.*, s.bucket_ids FROM gl JOIN smp s ON s.batch_id = gl.batch_id AND s.i = gl.i),
w_n AS (SELECT wid, count(DISTINCT batch_id) AS n FROM gl GROUP BY wid),
w_g AS (
  SELECT c.wid, x.d, sum(c.g * x.x) / {B!r} AS gsum FROM glx c JOIN dsx x ON x.bucket_ids = c.bucket_ids GROUP BY c.wid, x.d
),
b_g AS (SELECT wid, sum(g) / {B!r} AS gsum FROM gl GROUP BY wid),
grad_w AS (
  SELECT 'w' AS kind, w_g.wid AS id, CAST(w_g.d AS INTEGER) AS d, w_g.gsum / w_n.n AS g FROM w_g JOIN w_n ON w_n.wid = w_g.wid
  UNION ALL
  SELECT 'w', b_g.wid, -1, b_g.gsum / w_n.n FROM b_g JOIN w_n ON w_n.wid = b_g.wid
),
dxd AS (SELECT c.batch_id, c.i, o.d, sum(c.g * o.w) / {B!r} AS dx FROM gl c JOIN ow o ON o.word_id = c.wid GROUP BY c.batch_id, c.i, o.d),
occ AS (SELECT batch_id, i, unnest(bucket_ids) AS bucket_id FROM smp),
e_n AS (SELECT bucket_id, count(DISTINCT batch_id) AS n FROM occ GROUP BY bucket_id),
occn AS (SELECT batch_id, i, bucket_id, count(*) AS m FROM occ GROUP BY batch_id, i, bucket_id),
e_g AS (
  SELECT o.bucket_id, x.d, sum(o.m * x.dx) AS gsum FROM occn o JOIN dxd x ON x.batch_id = o.batch_id AND x.i = o.i
  GROUP BY o.bucket_id, x.d
),
grad_e AS (
  SELECT 'e' AS kind, e_g.bucket_id AS id, CAST(e_g.d AS INTEGER) AS d, e_g.gsum / e_n.n AS g
  FROM e_g JOIN e_n ON e_n.bucket_id = e_g.bucket_id
),
grads AS (SELECT * FROM grad_w UNION ALL SELECT * FROM grad_e)"""
