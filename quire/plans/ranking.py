"""DuckDB twin of ``quire.operators.rank``: one recursive query.

Each round of the recursion makes one pick in every open chunk, or closes a
chunk that has no sentence left to pick and opens its successor with what was
kept.  A sentence is a struct: text, n (tokens), t (distinct words), x (their
weights), mass, rel, red (greatest overlap with a picked one), on (picked).
"""

from __future__ import annotations

from quire.operators.rank import BUDGET, ENDS, REDUNDANCY, RELEVANCE, SCALE
from quire.plans.registry import D_NW, d_tokens

WIN, OVL = 128, 32
STRIDE = WIN - OVL

# (doc_id, tok, chunks): token windows of the whole text
D_WINDOWS = f"""
tk AS (SELECT doc_id, {d_tokens('text')} AS tok FROM documents WHERE text IS NOT NULL),
nw AS (SELECT *, CASE WHEN len(tok) = 0 THEN 0 WHEN len(tok) <= {WIN} THEN 1
                 ELSE CAST(ceil((len(tok) - {WIN}) / {STRIDE}.0) AS BIGINT) + 1 END AS n FROM tk),
ca AS (SELECT doc_id, list_transform(CASE WHEN n > 0 THEN generate_series(0, n - 1) ELSE [] END,
          lambda i: list_slice(tok, i * {STRIDE} + 1, i * {STRIDE} + {WIN})) AS chunks FROM nw),
cr AS (SELECT doc_id, CAST(generate_subscripts(chunks, 1) - 1 AS INTEGER) AS chunk_no, unnest(chunks) AS w FROM ca)"""

_NORM = f"lower(regexp_replace(k, '{D_NW}', '', 'g'))"

_WEIGHTS = f"""
wd AS (SELECT DISTINCT doc_id, {_NORM} AS w FROM (SELECT doc_id, unnest(tok) AS k FROM tk)),
nd AS (SELECT count(*) AS n FROM tk WHERE len(tok) > 0),
df AS (SELECT w, length(bin((SELECT n FROM nd) // count(*))) AS x FROM wd WHERE w <> '' GROUP BY w),
dm AS (SELECT doc_id, map_from_entries(list(struct_pack(k := w, v := x))) AS m FROM wd JOIN df USING (w) GROUP BY doc_id)"""


def _sentences(weighted: bool) -> str:
    weight = "list_transform(t, lambda w: m[w])" if weighted else "list_transform(t, lambda w: 1::BIGINT)"
    maps = "LEFT JOIN dm USING (doc_id)" if weighted else ""
    return f"""
se AS (SELECT doc_id, chunk_no, w, list_filter(range(1, len(w) + 1), lambda j: j = len(w) OR contains('{ENDS}', right(w[j], 1))) AS e FROM cr),
ss AS (SELECT doc_id, chunk_no, unnest(list_transform(range(1, len(e) + 1), lambda j: list_slice(w, CASE WHEN j = 1 THEN 1 ELSE e[j - 1] + 1 END, e[j]))) AS s,
         generate_subscripts(e, 1) AS no FROM se),
st AS (SELECT doc_id, chunk_no, no, array_to_string(s, ' ') AS text, CAST(len(s) AS BIGINT) AS n,
         list_distinct(list_filter(list_transform(s, lambda k: {_NORM}), lambda w: w <> '')) AS t FROM ss),
sx AS (SELECT doc_id, chunk_no, no, text, n, t, {weight} AS x FROM st {maps}),
sc AS (SELECT doc_id, chunk_no, list(struct_pack(text := text, n := n, t := t, x := x, mass := coalesce(list_sum(x), 0)::BIGINT,
         rel := 0::BIGINT, red := 0::BIGINT, "on" := false) ORDER BY no) AS c FROM sx GROUP BY doc_id, chunk_no)"""


def _with_relevance(c: str) -> str:
    """The sentences of a list with relevance set and nothing picked."""
    return f"""list_transform({c}, lambda e: struct_pack(text := e.text, n := e.n, t := e.t, x := e.x, mass := e.mass,
      rel := CASE WHEN e.mass = 0 THEN 0 ELSE {SCALE} * coalesce(list_sum(list_transform(range(1, len(e.t) + 1),
        lambda j: e.x[j] * (len(list_filter({c}, lambda f: list_contains(f.t, e.t[j]))) - 1))), 0)::BIGINT
        // (e.mass * greatest(len({c}) - 1, 1)) END, red := 0::BIGINT, "on" := false))"""


def d_ranked(weighted: bool, carry: bool) -> str:
    """CTEs up to ``ranked(doc_id, step, output)``."""
    return f"WITH RECURSIVE {D_WINDOWS},{_WEIGHTS + ',' if weighted else ''}{_sentences(weighted)},{d_fold(carry)}"


def d_fold(carry: bool, fold: str = "fold", ranked: str = "ranked") -> str:
    """The two CTEs of a fold over the sentences ``sc``."""
    shared = """coalesce(list_sum(list_transform(range(1, len(e.t) + 1), lambda j: CASE WHEN list_contains(b.t, e.t[j]) THEN e.x[j] ELSE 0 END)), 0)::BIGINT"""
    follow = f"""
    SELECT doc_id, step, {_with_relevance('base')} AS c, 0::BIGINT AS used, false AS done
    FROM (SELECT f.doc_id, f.step + 1 AS step, list_filter(f.c, lambda e: e."on") || sc.c AS base
          FROM {fold} f JOIN sc ON sc.doc_id = f.doc_id AND sc.chunk_no = f.step + 1 WHERE f.done)""" if carry else ""
    return f"""
{fold}(doc_id, step, c, used, done) AS (
  SELECT doc_id, chunk_no, {_with_relevance('c')}, 0::BIGINT, false FROM sc {'WHERE chunk_no = 0' if carry else ''}
  UNION ALL (
    SELECT doc_id, step,
      CASE WHEN p IS NULL THEN c ELSE list_transform(c, lambda e, i: struct_pack(text := e.text, n := e.n, t := e.t, x := e.x, mass := e.mass, rel := e.rel,
        red := CASE WHEN e."on" OR i = p THEN e.red ELSE greatest(e.red, {SCALE} * {shared} // greatest(e.mass, b.mass, 1)) END, "on" := e."on" OR i = p)) END AS c,
      CASE WHEN p IS NULL THEN used ELSE used + b.n END AS used, p IS NULL AS done
    FROM (SELECT *, c[p] AS b FROM (
      SELECT *, 100000 - ((best % 100000 + 100000) % 100000) AS p FROM (
        SELECT *, list_max(list_transform(list_filter(range(1, len(c) + 1), lambda i: NOT c[i]."on" AND (used = 0 OR (used + c[i].n <= {BUDGET} AND {RELEVANCE} * c[i].rel > {REDUNDANCY} * c[i].red))),
          lambda i: ({RELEVANCE} * c[i].rel - {REDUNDANCY} * c[i].red) * 100000 - i)) AS best
        FROM {fold} WHERE NOT done)))
    {'UNION ALL' if carry else ''} {follow})),
{ranked} AS (SELECT doc_id, CAST(step AS INTEGER) AS step,
             array_to_string(list_transform(list_filter(c, lambda e: e."on"), lambda e: e.text), chr(10)) AS output
           FROM {fold} WHERE done)"""
