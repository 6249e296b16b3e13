"""DuckDB SQL for the queries that SQL expresses."""

from __future__ import annotations

from .mixing import BUDGET_PERMILLE, DEFAULT_WEIGHT, DOMAINS, MAX_EPOCHS, SEED, WEIGHTS

EXACT_DEDUP = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
"""

DECONTAMINATE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bwin AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i+9], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
bset AS (SELECT DISTINCT n, win FROM bwin),
ns AS (SELECT DISTINCT n FROM bset),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, win FROM dwin SEMI JOIN bset USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k COLLATE "C") AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m JOIN bwin USING (n, win)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _case(column: str, weights: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {DEFAULT_WEIGHT} END" if weights else str(DEFAULT_WEIGHT)


def _fill(name: str, nodes: str, parent: str, level: str) -> str:
    """Water-filling of one level, from rows with parent columns, the level's column, cap, w, pb."""
    by = f"PARTITION BY {parent}" if parent else ""
    cols = f"{parent}, {level}" if parent else level
    return f"""
{name}_o AS (SELECT *, coalesce(sum(cap) OVER ({by} ORDER BY CAST(cap AS DOUBLE) / w, {cols} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb, sum(w) OVER ({by} ORDER BY CAST(cap AS DOUBLE) / w, {cols} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wo FROM ({nodes})),
{name}_f AS (SELECT *, cap * wo <= (pb - cb) * w AS fl FROM {name}_o),
{name}_s AS (SELECT *, pb - sum(CASE WHEN fl THEN cap ELSE 0 END) OVER ({by}) AS r, sum(CASE WHEN fl THEN 0 ELSE w END) OVER ({by}) AS sw FROM {name}_f),
{name} AS (SELECT {cols}, CAST(CASE WHEN fl THEN cap ELSE least(cap, floor(CAST(r AS DOUBLE) * w / sw)) END AS BIGINT) AS b FROM {name}_s)"""


def mixing_sql(docs: str = "documents") -> str:
    number = "TRY_CAST(nullif(regexp_extract(source, '^src([0-9]{1,4})$', 1), '') AS INT)"
    domain = "CASE " + " ".join(f"WHEN {number} BETWEEN {r[0]} AND {r[-1]} THEN '{n}'" for n, r in reversed(list(DOMAINS.items()))) + " ELSE 'other' END"
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM {docs}),
d AS (SELECT *, {domain} AS domain FROM t),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, sum(n_tokens)::BIGINT * {MAX_EPOCHS} AS cap FROM d GROUP BY ALL),
top AS (SELECT least(CAST(floor(sum(supply) * {BUDGET_PERMILLE} / 1000) AS BIGINT), sum(cap)) AS pb FROM leaf),{_fill('b1', f"SELECT domain, sum(cap) AS cap, {_case('domain', WEIGHTS['domain'])} AS w, any_value(pb) AS pb FROM leaf, top GROUP BY domain", '', 'domain')},{_fill('b2', f"SELECT domain, lang, sum(cap) AS cap, {_case('lang', WEIGHTS['lang'])} AS w, any_value(b) AS pb FROM leaf JOIN b1 USING (domain) GROUP BY domain, lang", 'domain', 'lang')},{_fill('b3', f"SELECT domain, lang, source, cap, {_case('source', WEIGHTS['source'])} AS w, b AS pb FROM leaf JOIN b2 USING (domain, lang)", 'domain, lang', 'source')},
plan AS (SELECT domain, lang, source, CASE WHEN supply > 0 THEN b // supply ELSE 1 END AS whole, CASE WHEN supply > 0 THEN b % supply ELSE b END AS rest FROM leaf JOIN b3 USING (domain, lang, source)),
o AS (SELECT d.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat('{SEED}:', whole + 1, ':', coalesce(CAST(doc_id AS VARCHAR), ''))) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach FROM d JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN rest > 0 AND reach <= rest THEN 1 ELSE 0 END AS BIGINT) AS n_copies FROM o WHERE whole > 0 OR (rest > 0 AND reach <= rest)
"""


ORACLES: dict[str, str] = {"op3_mixing": mixing_sql(), "op6_decontaminate": DECONTAMINATE, "op10_exact_dedup": EXACT_DEDUP}
