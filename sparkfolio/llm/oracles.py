"""DuckDB SQL of those operators' queries that SQL can state, written from the definitions."""

from __future__ import annotations

from .urlfilter import ALPHABET, ORDER, RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x20\x09-\x0D]+"

# ------------------------------------------------------------------------------------- op2
_PART = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"


def _rule(value: int) -> str:
    """CASE over the rules, longest first; value 0 is the rule, 1 its verdict."""
    tests = []
    for rule in sorted(RULES, key=lambda r: -len(r[0])):
        host, _, path = rule[0].partition("/")
        tests.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{rule[value]}'")
    return f"CASE {' '.join(tests)} END"


def _levels() -> str:
    """Probabilities of grams by length: interpolated with the contexts' number of kinds."""
    out = []
    for k in range(ORDER + 1):
        lower = f"{1 / ALPHABET!r}, {1 / ALPHABET!r}" if k == 0 else "l.pa, l.pb"
        below = "" if k == 0 else f" JOIN p{k - 1} l ON l.gram = substr(c.gram, 2)"
        pa, pb = lower.split(", ")
        out.append(
            f"""p{k} AS (SELECT c.gram, CASE WHEN x.na + x.ta > 0 THEN (c.a + x.ta * {pa}) / (x.na + x.ta) ELSE {pa} END AS pa,
  CASE WHEN x.nb + x.tb > 0 THEN (c.b + x.tb * {pb}) / (x.nb + x.tb) ELSE {pb} END AS pb
  FROM counts c JOIN contexts x ON x.k = c.k AND x.context = left(c.gram, length(c.gram) - 1){below} WHERE c.k = {k})"""
        )
    return ",\n".join(out)


def _ratio() -> str:
    out = "coalesce(ln(q0.pa / q0.pb), 0)"
    for k in range(1, ORDER + 1):
        out = f"coalesce(ln(q{k}.pa / q{k}.pb), coalesce(e{k}.value, 0) + {out})"
    return out


_GRAMS = ", ".join(f"substr(p, i + {ORDER - k}, {k + 1}) AS g{k}" for k in range(ORDER + 1))
_FOUND = "\n".join([*(f"  LEFT JOIN p{k} q{k} ON q{k}.gram = g{k}" for k in range(ORDER + 1)), *(f"  LEFT JOIN escapes e{k} ON e{k}.k = {k} AND e{k}.context = left(g{k}, {k})" for k in range(1, ORDER + 1))])
OP2 = f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{_PART}', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '{_PART}', 2), '') AS path, coalesce(regexp_extract(url, '{_PART}', 3), '') AS rest FROM pages),
judged AS (SELECT page_id, host, path, host || path || rest AS said, {_rule(0)} AS rule, {_rule(1)} AS fixed FROM parts),
decided AS (SELECT said, fixed, ('0x' || left(md5(said), 4))::INT % 5 = 0 AS later FROM judged WHERE rule IS NOT NULL),
positions AS (SELECT said, {_GRAMS} FROM (SELECT said, repeat(chr(2), {ORDER}) || said AS p, unnest(range(1, length(said) + 1)) AS i FROM (SELECT DISTINCT said FROM judged))),
counts AS (SELECT k, gram, count_if(fixed = 'allow')::DOUBLE AS a, count_if(fixed = 'block')::DOUBLE AS b
  FROM (SELECT fixed, unnest([{', '.join(f"{{'k': {k}, 'gram': g{k}}}" for k in range(ORDER + 1))}], recursive := true) FROM decided JOIN positions USING (said) WHERE NOT later) GROUP BY k, gram),
contexts AS (SELECT k, left(gram, length(gram) - 1) AS context, sum(a) AS na, sum(b) AS nb, count_if(a > 0)::DOUBLE AS ta, count_if(b > 0)::DOUBLE AS tb FROM counts GROUP BY ALL),
{_levels()},
escapes AS (SELECT k, context, CASE WHEN na > 0 THEN ln(ta / (na + ta)) ELSE 0 END - CASE WHEN nb > 0 THEN ln(tb / (nb + tb)) ELSE 0 END AS value FROM contexts WHERE k > 0),
scores AS (SELECT said, avg({_ratio()}) AS score FROM positions
{_FOUND}
  GROUP BY said),
bins AS (SELECT round(least(greatest(score, -5), 5) * 100)::INT AS step, count_if(fixed = 'allow')::DOUBLE AS a, count_if(fixed = 'block')::DOUBLE AS b FROM decided JOIN scores USING (said) WHERE later GROUP BY ALL),
gains AS (SELECT step, coalesce(sum(a) OVER (ORDER BY step DESC), 0) / nullif(sum(a) OVER (), 0) + coalesce(sum(b) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / nullif(sum(b) OVER (), 0) AS gain FROM bins),
cut AS (SELECT coalesce((SELECT step / 100.0 FROM gains WHERE gain IS NOT NULL ORDER BY gain DESC, abs(step), step DESC LIMIT 1), 0)::DOUBLE AS threshold)
SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN coalesce(score, 0) >= threshold THEN 'allow' ELSE 'block' END) AS verdict, round(coalesce(score, 0), 6)::DOUBLE AS score, threshold
FROM judged LEFT JOIN scores USING (said), cut"""

# ------------------------------------------------------------------------------------- op5
OP5 = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (SELECT x.doc_id AS u, y.doc_id AS v, any_value(x.n) AS nu, any_value(y.n) AS nv, count(*) AS together FROM each x JOIN each y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs WHERE 100 * together >= 85 * (nu + nv - together)),
reached AS (SELECT doc_id, doc_id AS from_id FROM sets UNION SELECT v, from_id FROM reached JOIN links ON u = doc_id),
parts AS (SELECT doc_id, min(from_id) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN parts USING (doc_id)"""

# ------------------------------------------------------------------------------------- op7
_ESCAPED = r"len(regexp_extract_all({}, '<\\*\|'))"
_ROLE = "replace(replace(role, '\\', '\\\\'), chr(10), '\\n')"
OP7 = f"""
WITH said AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(24 + length({_ROLE}) + {_ESCAPED.format(_ROLE)} + length(text) + {_ESCAPED.format('text')}) AS formatted FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted::BIGINT AS formatted_chars FROM whole"""

# ------------------------------------------------------------------------------------ op10
OP10 = """
WITH RECURSIVE given AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
good AS (SELECT * FROM given WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: abs(x))) > 0),
links AS (SELECT x.vec_id AS u, y.vec_id AS w FROM good x JOIN good y ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
reached AS (SELECT vec_id, vec_id AS from_id FROM given UNION SELECT w, from_id FROM reached JOIN links ON u = vec_id),
parts AS (SELECT vec_id, min(from_id) AS component_id FROM reached GROUP BY vec_id),
degrees AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM parts LEFT JOIN degrees USING (vec_id)"""
