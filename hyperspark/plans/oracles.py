"""SQL that gives the same results as the queries, for an independent engine; pieces shared by several of them."""

from __future__ import annotations

from hyperspark.functions import text as T

SPACE = r"[ \t\n\x0b\f\r]+"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def values(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def clean(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '{SPACE}', ' ', 'g'), '^ +| +$', '', 'g')"


def sentences(column: str) -> str:
    return f"string_split(regexp_replace({column}, '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))"


def plain_words(column: str) -> str:
    """Runs of letters with a letter outside ASCII are no words here."""
    return f"regexp_replace({column}, '[\\p{{L}}\\p{{N}}_]*[\\x{{00AA}}\\x{{00B5}}\\x{{00BA}}\\x{{00C0}}-\\x{{02FF}}\\x{{0370}}-\\x{{1FFF}}\\x{{2C00}}-\\x{{2DFF}}\\x{{3005}}-\\x{{3007}}\\x{{3040}}-\\x{{D7FF}}\\x{{F900}}-\\x{{FDFF}}\\x{{FE70}}-\\x{{FEFC}}\\x{{FF10}}-\\x{{FF19}}\\x{{FF21}}-\\x{{FF3A}}\\x{{FF41}}-\\x{{FF5A}}\\x{{FF66}}-\\x{{FFDC}}][\\p{{L}}\\p{{N}}_]*', '€', 'g')"


def concept_words(column: str) -> str:
    return f"list_transform(regexp_extract_all({plain_words(column)}, '\\b[a-zA-Z][a-zA-Z\\-]{{1,39}}[a-zA-Z]\\b|\\b[a-zA-Z][a-zA-Z\\-]{{2,40}}\\b'), lambda w: lower(w))"


def cue_score(groups) -> str:
    parts = []
    for cues, weight in groups:
        test = " OR ".join(f"contains(low, {q(c)})" for c in cues)
        parts.append(f"(CASE WHEN {test} THEN {weight} ELSE 0 END)")
    return " + ".join(parts)


def detect_lang(column: str) -> str:
    """An expression over ``head`` (512 characters) and ``low`` (511, lower case) of a subquery."""
    scores = {k: cue_score(g) for k, g in T.LANGUAGE_CUES.items()}
    code = cue_score([((c,), w) for c, w in T.CODE_CUES.items()])
    least = "floor(length(head) / 7)"
    out = f"CASE WHEN {column} IS NULL OR {column} = '' THEN 'LANG_UNKNOWN'"
    for name, ranges in (("LANG_ARABIC", "\\x{0600}-\\x{06FF}"), ("LANG_CHINESE", "\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}"), ("LANG_RUSSIAN", "\\x{0400}-\\x{04FF}")):
        out += f" WHEN length(head) - length(regexp_replace(head, '[{ranges}]', '', 'g')) > {least} THEN '{name}'"
    out += f" WHEN {code} >= 3 THEN 'LANG_CODE'"
    for name, score in scores.items():
        out += f" WHEN {score} >= 2 THEN '{name}'"
    return out + f" WHEN ({scores['LANG_SPANISH']}) + ({scores['LANG_FRENCH']}) + ({scores['LANG_GERMAN']}) > 2 THEN 'LANG_MIXED' ELSE 'LANG_ENGLISH' END"


def words_language() -> str:
    """An expression over ``head`` (2000 characters) and ``words`` of a subquery."""
    out = "CASE"
    for name, ranges in (("LANG_HINDI", "\\x{0900}-\\x{097F}"), ("LANG_ARABIC", "\\x{0600}-\\x{06FF}"), ("LANG_CHINESE", "\\x{4E00}-\\x{9FFF}")):
        out += f" WHEN length(head) - length(regexp_replace(head, '[{ranges}]', '', 'g')) > 20 THEN '{name}'"
    hits = {name: f"len(list_filter(words, lambda w: w IN {values(known)}))" for name, known in T.STOPWORD_LANGUAGES.items()}
    best = f"greatest({', '.join(hits.values())})"
    for name, n in hits.items():
        out += f" WHEN {n} = {best} THEN '{name}'"
    return out + " END"


def domain(column: str) -> str:
    scores = {name: " + ".join(f"((length(lower({column})) - length(replace(lower({column}), {q(w)}, ''))) / {len(w)})::INT" for w in words) for name, words in T.DOMAIN_KEYWORDS.items()}
    best = f"greatest({', '.join(scores.values())})"
    return "CASE" + "".join(f" WHEN {s} = {best} THEN '{name}'" for name, s in scores.items()) + " END"


def causal(column: str) -> str:
    parts = []
    for ascii_pattern, template in T.CAUSAL_PATTERNS:
        pattern = ascii_pattern.replace("\\w", "[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]")
        a, b = f"regexp_extract(lower({column}), {q(pattern)}, 1)", f"regexp_extract(lower({column}), {q(pattern)}, 2)"
        parts.append(f"CASE WHEN length({a}) > 2 AND length({b}) > 2 AND {a} NOT IN {values(T.DOCUMENT_STOPWORDS)} AND {b} NOT IN {values(T.DOCUMENT_STOPWORDS)} THEN printf({q(template)}, {a}, {b}) END")
    return f"coalesce({', '.join(parts)}, '')"


_TOKENS = f"flatten(list_transform(regexp_extract_all(@COLUMN@, {q(T.TOKEN_PATTERN)}), lambda t: CASE WHEN regexp_matches(t, '^(http|www\\.)') THEN [t] WHEN regexp_matches(t, '^[A-Za-z0-9_''].*''[A-Za-z0-9_]*$') THEN [regexp_replace(lower(t), '^(.+)''([^'']*)$', '\\1'), regexp_replace(lower(t), '^(.+)''([^'']*)$', '\\2')] WHEN regexp_matches(t, '^[A-Za-z0-9_'']') THEN [lower(t)] ELSE [t] END))"

_BYTES = "list_transform(range(0, strlen(@COLUMN@)), lambda i: ('0x' || substr(hex(encode(@COLUMN@)), (2 * i + 1)::INT, 2))::BIGINT)"

def tokens(column: str) -> str:
    return _TOKENS.replace("@COLUMN@", column)


def byte_list(column: str) -> str:
    return _BYTES.replace("@COLUMN@", column)


#: Usable nodes with unit vectors; edges once per pair; edges with the resonance of their ends.
VN = """vn AS (SELECT *, list_transform(vec, lambda x: x::DOUBLE / sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[]))) AS v FROM nodes
 WHERE id IS NOT NULL AND len(vec) = 384 AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(vec::DOUBLE[], vec::DOUBLE[]) > 0)"""
CE = """ce AS (SELECT src, dst, first_idx AS adj_idx, least(greatest(weight, 0.001), 1.0) AS weight, type FROM
 (SELECT *, min(adj_idx) OVER (PARTITION BY src, dst) AS first_idx, row_number() OVER (PARTITION BY src, dst ORDER BY adj_idx DESC, weight DESC, type DESC) AS rn
  FROM edges WHERE src <> dst AND weight IS NOT NULL AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)) WHERE rn = 1)"""


def cross(a: str, b: str) -> str:
    vague = "('LANG_UNKNOWN', 'LANG_MIXED')"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} IN {vague} OR {b} IN {vague} OR {a} = {b} THEN 1.0 WHEN ({a} = 'LANG_CODE') <> ({b} = 'LANG_CODE') THEN 0.9 ELSE 0.82 END"


def resonance(a: str, b: str) -> str:
    return f"CASE WHEN bit_count(xor({a}.hash, {b}.hash)) <= 28 THEN greatest(least(list_dot_product({a}.v, {b}.v) * {cross(a + '.lang', b + '.lang')}, 1.0), 0.0) ELSE 0.0 END"


ER = f"er AS (SELECT ce.*, round({resonance('a', 'b')}, 9) AS res FROM ce JOIN vn a ON ce.src = a.id JOIN vn b ON ce.dst = b.id)"
#: Members of hyperedges made of the nodes active together, their weights, and node activations.
HM = """hm AS (SELECT edge_id, node, row_number() OVER (PARTITION BY edge_id ORDER BY node) AS pos FROM (SELECT DISTINCT query_id AS edge_id, unnest(active_nodes) AS node FROM feedback WHERE query_id IS NOT NULL)
 WHERE node IN (SELECT id FROM vn)),
he AS (SELECT edge_id, least(greatest(coalesce(avg(reward), 0), 0.0), 1.0) AS weight FROM (SELECT query_id AS edge_id, reward FROM feedback WHERE query_id IS NOT NULL) GROUP BY edge_id),
m16 AS (SELECT * FROM hm WHERE pos <= 16),
ac AS (SELECT id AS node, activation FROM vn WHERE activation IS NOT NULL)"""
