"""DuckDB SQL that states each registered query's result independently."""

from __future__ import annotations

from stagecraft.catalog.fixtures import (
    CAPPED, DROPOUT_RATE, FLIP_WORDS, POOL_SEED, RUN_VARIANTS, SHUFFLE_SEED, WHOLE,
)
from stagecraft.config import CHAIN_EDGES, STAGES
from stagecraft.functions.text import FLIP_PAIRS, FLIP_PREFIX

_WORDS = "[" + ", ".join(f"'{w}'" for w in FLIP_WORDS) + "]"


def _cut(k: int) -> str:
    return (f"coalesce(array_to_string(list_slice(w, len(w) * {k} // 6 + 1, "
            f"len(w) * {k + 1} // 6), ' '), '')")


PAPERS = f"""
words AS (
  SELECT doc_id, source, n_chars,
         list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS w
  FROM documents),
cuts AS (
  SELECT doc_id, source, n_chars, len(w) AS n,
         {", ".join(f"{_cut(k)} AS s{k}" for k in range(6))}
  FROM words),
papers AS (
  SELECT doc_id AS seq,
    CASE WHEN doc_id <> 5 THEN 'P' || doc_id END AS paper_id,
    s0 AS summary_title,
    CASE WHEN doc_id % 41 = 0 THEN NULL WHEN doc_id % 43 = 0 THEN '   '
         ELSE '  ' || s1 || ' ' END AS research_question_hypothesis,
    s2 AS methodological_details, s3 AS procedures_architectures,
    CASE WHEN n < 6 OR doc_id % 4 = 0 THEN s4 ELSE s4 || ' ' ||
      CASE WHEN doc_id % 3 = 0 THEN upper(({_WORDS})[doc_id % 28 + 1])
           ELSE ({_WORDS})[doc_id % 28 + 1] END ||
      CASE WHEN doc_id % 5 = 0 THEN ' improve degrade' ELSE '' END END AS key_results,
    s5 AS interpretation_implications,
    CASE doc_id // 20 % 10 WHEN 0 THEN NULL WHEN 1 THEN 'n.d.' WHEN 2 THEN '2025'
      WHEN 3 THEN '2025-03-01' WHEN 4 THEN '2030' WHEN 5 THEN 'c. 2019' WHEN 6 THEN '12345'
      WHEN 7 THEN '0000' ELSE (2010 + doc_id % 15)::VARCHAR END AS oa_year,
    CASE doc_id // 20 % 20 WHEN 0 THEN 2018.7::DOUBLE WHEN 1 THEN 2025.0::DOUBLE
      WHEN 10 THEN 'NaN'::DOUBLE END AS source_year,
    CASE WHEN doc_id % 13 <> 0 THEN n_chars % 120 END AS oa_cited_by_count,
    CASE WHEN doc_id % 17 = 0 THEN ' ' WHEN doc_id % 19 = 0 THEN NULL
         WHEN doc_id BETWEEN 1 AND 3 THEN 'rare' ELSE ' ' || source || ' ' END AS field_subfield
  FROM cuts)"""

_TRIM = "trim({}, e' \\t\\r\\n')"
_YEAR = """coalesce(nullif(coalesce(
      try_cast(nullif(regexp_extract(oa_year, '[0-9]{4}'), '') AS INTEGER),
      CASE WHEN NOT isnan(source_year) THEN trunc(source_year)::INTEGER END), 0), -1)"""
_FIELD = "coalesce(nullif(" + _TRIM.format("coalesce(field_subfield, 'None')") + ", ''), 'unknown')"
_COLUMNS = dict(WHOLE.stage_columns)

CHAINS = PAPERS + f""",
built AS (
  SELECT {", ".join(f"{_TRIM.format(c)} AS {s}"
                    for s, c in _COLUMNS.items())},
    coalesce(paper_id, 'None') AS id, {_YEAR} AS year,
    coalesce(oa_cited_by_count, 0) AS citations, {_FIELD} AS field, seq
  FROM papers
  WHERE {" AND ".join(f"{_TRIM.format(c)} <> ''" for c in _COLUMNS.values())}),
chains AS (
  SELECT *, CASE WHEN year = {WHOLE.test_year} THEN 'test'
    WHEN year <> -1 AND year <= {WHOLE.train_cutoff_year} THEN 'train'
    WHEN ('0x' || substr(md5(id), 1, 8))::BIGINT % 1000 / 1000.0 < {WHOLE.random_split_test_frac}
      THEN 'test' ELSE 'train' END AS split
  FROM built)"""

_ROW = ", ".join((*STAGES, "id", "year", "citations", "field", "seq"))
_FULL = "concat_ws(' ', " + ", ".join(STAGES) + ")"


def _ctx(last: int) -> str:
    return "concat_ws(' ', " + ", ".join(STAGES[: last + 1]) + ")"


CAPS = CHAINS + f""",
field_capped AS (
  SELECT * FROM chains WHERE split = 'test'
  UNION ALL
  SELECT * FROM chains WHERE split = 'train'
  QUALIFY row_number() OVER (PARTITION BY field ORDER BY seq) <= {CAPPED.max_papers_per_field}),
capped AS (
  SELECT * FROM field_capped
  QUALIFY row_number() OVER (PARTITION BY split ORDER BY seq)
    <= CASE split WHEN 'train' THEN {CAPPED.max_train_examples}
                  ELSE {CAPPED.max_test_examples} END)"""


# The settings that name a build, as sorted JSON, written out.
_SETTINGS = (
    '{"citation_column": "oa_cited_by_count", "dataset": "papers", "fallback_year_column": "source_year", '
    '"field_column": "field_subfield", "id_column": "paper_id", "max_papers_per_field": 20, "max_stage_chars": null, '
    '"max_test_examples": 200, "max_train_examples": 400, "random_split_test_frac": 0.1, "seq_column": "seq", '
    '"stage_columns": {"conclusion": "interpretation_implications", "experiment": "procedures_architectures", '
    '"hypothesis": "research_question_hypothesis", "method": "methodological_details", "result": "key_results", '
    '"title": "summary_title"}, "test_year": 2025, "train_cutoff_year": 2024, "year_column": "oa_year"}')
_SETTINGS_WHOLE = _SETTINGS.replace(": 20,", ": 0,").replace(": 200,", ": null,").replace(": 400,", ": null,")

_PAPER_COLUMNS = (
    "interpretation_implications", "key_results", "methodological_details", "oa_cited_by_count", "oa_year",
    "paper_id", "procedures_architectures", "research_question_hypothesis", "seq", "source_year", "summary_title")
_AS_TEXT = {"source_year": "CASE WHEN isnan(source_year) THEN 'NaN' ELSE source_year::VARCHAR END"}
_FRAMED = ", ".join(
    f"coalesce(length({t}) || ':' || {t}, '-')" for t in (
        _AS_TEXT.get(c, f"{c}::VARCHAR") for c in sorted([*_PAPER_COLUMNS, "field_subfield"])))
PRINT = """{name} AS (
  SELECT count(*) || '-' || coalesce(sum(('0x' || substr(md5(concat_ws('|', """ + _FRAMED + """)), 1, 15))::BIGINT), 0) AS input
  FROM {source})"""

BUILDS = CAPS + ",\n" + PRINT.format(name="print", source="papers") + f""",
fewer AS (SELECT * FROM papers WHERE seq % 3 <> 0),
""" + PRINT.format(name="fewer_print", source="fewer") + f""",
fewer_capped AS (
  SELECT * FROM chains WHERE seq % 3 <> 0 AND split = 'test'
  UNION ALL
  SELECT * FROM chains WHERE seq % 3 <> 0 AND split = 'train'
  QUALIFY row_number() OVER (PARTITION BY field ORDER BY seq) <= {CAPPED.max_papers_per_field}),
builds AS (
  SELECT input, split, count(*) AS n, true AS whole FROM capped, print GROUP BY ALL
  UNION ALL
  SELECT input, split, count(*), false FROM (SELECT * FROM fewer_capped
    QUALIFY row_number() OVER (PARTITION BY split ORDER BY seq)
      <= CASE split WHEN 'train' THEN {CAPPED.max_train_examples} ELSE {CAPPED.max_test_examples} END), fewer_print
  GROUP BY ALL)"""

# Every variant of the studies and the options in which it differs from the defaults.
_GRID = """
('lambda', '0.0', 'edge_loss_enabled=false;edge_loss_weight=0.0'), ('lambda', '0.25', 'edge_loss_weight=0.25'),
('lambda', '0.5', 'edge_loss_weight=0.5'), ('lambda', '1.0', ''), ('lambda', '2.0', 'edge_loss_weight=2.0'),
('ablation', 'full', ''), ('ablation', 'no_pred_tokens', 'use_pred_tokens=false'),
('ablation', 'no_long_range_edge', 'use_long_range_edge=false'),
('ablation', 'no_trivial_filter', 'use_trivial_edge_filter=false'),
('ablation', 'mse_loss', 'edge_loss_type="mse"'), ('ablation', 'no_edge_loss', 'edge_loss_enabled=false'),
('dropout', '0.0', 'loss_dropout=0.0'), ('dropout', '0.125', ''), ('dropout', '0.25', 'loss_dropout=0.25'),
('dropout', '0.5', 'loss_dropout=0.5'), ('dropout', '0.75', 'loss_dropout=0.75')"""


def _tokens(text: str, n: int | None = None) -> str:
    every = f"list_filter(regexp_split_to_array({text}, '[ \\t\\r\\n]+'), lambda x: x <> '')"
    return f"list_slice({every}, 1, {n})" if n else every


def _cut_tokens(text: str, n: int) -> str:
    return f"array_to_string({_tokens(text, n)}, ' ')"


def _flip(text: str) -> str:
    out, words = text, []
    for a, b in FLIP_PAIRS:
        words += [a, b]
        out = (f"regexp_replace({out}, CASE WHEN regexp_matches({text}, '(?i)\\b{a}\\b') "
               f"THEN '(?i)\\b{a}\\b' ELSE '(?i)\\b{b}\\b' END, "
               f"CASE WHEN regexp_matches({text}, '(?i)\\b{a}\\b') THEN '{b}' ELSE '{a}' END, 'g')")
    every = "(?i)\\b(" + "|".join(words) + ")\\b"
    return (f"CASE WHEN regexp_matches({text}, '{every}') THEN {out} "
            f"ELSE '{FLIP_PREFIX}' || {text} END")


def _encode(text: str, limit: int, dim: int = WHOLE.encoder_dim) -> str:
    """Unit vector as a list, by a list expression per bucket."""
    codes = (f"list_transform({_tokens(f'lower({text})', limit)}, lambda t: "
             f"(('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} + 1) * "
             f"CASE WHEN substr(md5(t), 9, 1) < '8' THEN 1 ELSE -1 END)")
    raw = (f"list_transform(range(1, {dim + 1}), lambda b: "
           f"(len(list_filter(c, lambda x: x = b)) - len(list_filter(c, lambda x: x = -b)))::DOUBLE)")
    return codes, raw


def vectors(source: str, key: str, text: str, limit: int, name: str) -> str:
    """CTE ``name(key, v)`` of unit vectors; an all-zero vector stays zero."""
    codes, raw = _encode(text, limit)
    return f"""{name}_c AS (SELECT {key}, {codes} AS c FROM {source}),
{name}_r AS (SELECT {key}, {raw} AS r FROM {name}_c),
{name} AS (SELECT {key}, list_transform(r, lambda x:
   CASE WHEN list_dot_product(r, r) = 0 THEN 0.0::DOUBLE
        ELSE x / sqrt(list_dot_product(r, r)) END) AS v FROM {name}_r)"""


POOLS = CHAINS + f""",
tests AS (SELECT * FROM chains WHERE split = 'test'),
circle AS (
  SELECT *, row_number() OVER (ORDER BY md5(id || '|{POOL_SEED}'), id,
                               md5(seq || '|{POOL_SEED}'), seq) - 1 AS idx,
         count(*) OVER () AS total, count(*) OVER (PARTITION BY id) AS same
  FROM tests),
arcs AS (SELECT *, min(idx) OVER (PARTITION BY id) + same AS after, total - same AS others
         FROM circle),
wants AS (
  SELECT a.seq AS pool, (a.after + (('0x' || substr(md5('pick|' || a.seq || '|{POOL_SEED}'), 1, 15))
           ::BIGINT % a.others + k.k) % a.others) % a.total AS idx
  FROM arcs a, range({WHOLE.n_distractors - 1}) k(k) WHERE k.k < a.others),
candidates AS (
  SELECT seq AS pool, seq AS cand, 'true' AS kind, result AS text, true AS is_true FROM tests
  UNION ALL
  SELECT seq, seq, 'flip', {_flip("result")}, false FROM tests
  UNION ALL
  SELECT w.pool, c.seq, 'random', c.result, false FROM wants w JOIN circle c USING (idx)),
pools AS (
  SELECT pool::VARCHAR AS pool_id, (row_number() OVER (PARTITION BY pool ORDER BY
           md5(pool || '|' || kind || '|' || cand || '|{POOL_SEED}'), kind, cand) - 1)::INTEGER AS pos,
         kind, text, is_true FROM candidates),
ctxs AS (SELECT seq::VARCHAR AS pool_id, {_ctx(3)} AS ctx FROM tests)"""

BM25 = POOLS + f""",
docs AS (SELECT pool_id, pos, is_true, {_tokens('lower(text)')} AS w FROM pools),
tf AS (SELECT pool_id, pos, term, count(*) AS tf
       FROM (SELECT pool_id, pos, unnest(w) AS term FROM docs) GROUP BY ALL),
pool_size AS (SELECT pool_id, count(*) AS n, avg(len(w)) AS avg_len FROM docs GROUP BY 1),
df AS (SELECT pool_id, term, count(*) AS df FROM tf GROUP BY ALL),
raw_idf AS (SELECT pool_id, term, ln(n - df + 0.5) - ln(df + 0.5) AS idf
            FROM df JOIN pool_size USING (pool_id)),
idf AS (SELECT pool_id, term, CASE WHEN idf < 0
          THEN 0.25 * avg(idf) OVER (PARTITION BY pool_id) ELSE idf END AS idf FROM raw_idf),
query AS (SELECT pool_id, term, count(*) AS qf FROM (
            SELECT pool_id, unnest({_tokens('lower(ctx)')}) AS term FROM ctxs) GROUP BY ALL),
bm25 AS (
  SELECT d.pool_id, d.pos, d.is_true, coalesce(sum(q.qf * i.idf * t.tf * 2.5
           / (t.tf + 1.5 * (0.25 + 0.75 * len(d.w) / p.avg_len))), 0) AS score
  FROM docs d JOIN pool_size p USING (pool_id)
  LEFT JOIN tf t ON t.pool_id = d.pool_id AND t.pos = d.pos
  LEFT JOIN query q ON q.pool_id = t.pool_id AND q.term = t.term
  LEFT JOIN idf i ON i.pool_id = t.pool_id AND i.term = t.term
  GROUP BY ALL)"""

DENSE = POOLS + ",\n" + vectors("ctxs", "pool_id", "ctx", None, "pred") + ",\n" + \
    vectors("pools", "pool_id, pos, is_true", "text", None, "cand") + """,
dense AS (SELECT c.pool_id, c.pos, c.is_true, list_dot_product(p.v, c.v) AS score
          FROM cand c JOIN pred p USING (pool_id))"""


def ranked(scores: str) -> str:
    return (f"(SELECT *, row_number() OVER (PARTITION BY pool_id "
            f"ORDER BY round(score, 6) + 0.0 DESC, pos) AS rank FROM {scores})")


def language_model(words: int | None) -> str:
    return CHAINS + f""",
toks AS (SELECT seq, split, {_tokens(_FULL, words)} AS w FROM chains),
grams AS (SELECT seq, split, unnest(w[:-2]) AS v, unnest(w[2:]) AS w FROM toks WHERE len(w) > 1),
pair_n AS (SELECT v, w, count(*) AS n FROM grams WHERE split = 'train' GROUP BY ALL),
first_n AS (SELECT v, count(*) AS n FROM grams WHERE split = 'train' GROUP BY ALL),
vocab AS (SELECT count(DISTINCT t) + 1 AS v FROM (
            SELECT unnest(w) AS t FROM toks WHERE split = 'train')),
nlls AS (
  SELECT g.seq, g.split, avg(-ln((coalesce(p.n, 0) + {WHOLE.smoothing})
             / (coalesce(f.n, 0) + {WHOLE.smoothing} * (SELECT v FROM vocab)))) AS nll
  FROM grams g LEFT JOIN pair_n p ON p.v = g.v AND p.w = g.w LEFT JOIN first_n f ON f.v = g.v
  GROUP BY ALL)"""


EDGES = "(VALUES " + ", ".join(f"({k}, {i}, {j})" for k, (i, j) in enumerate(CHAIN_EDGES)) + \
    ") e(k, i, j)"
_STAGE_LIST = "[" + ", ".join(STAGES) + "]"
PAIRS = CHAINS + f""",
pairs AS (
  SELECT c.id, c.seq, c.split, e.i, e.j,
         array_to_string(list_slice({_STAGE_LIST}, 1, e.i + 1), ' ') AS context,
         ({_STAGE_LIST})[e.j + 1] AS target
  FROM chains c, {EDGES})"""


def ordered(block: int, seed: int = SHUFFLE_SEED, source: str = "chains") -> str:
    return f"""positions AS (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY seq) - 1 AS pos FROM {source}),
ordered AS (
  SELECT *, (pos // {block} * {block} + row_number() OVER (PARTITION BY split, pos // {block}
     ORDER BY md5(id || '|' || seq || '|{seed}'), seq) - 1)::BIGINT AS order_pos FROM positions)"""


EMB = """
emb AS (
  SELECT a.vec_id AS pair_id, a.vec_id // 4 AS batch_id, e.i, e.j,
         a.embedding::DOUBLE[] AS pred, b.embedding::DOUBLE[] AS truth, a.label
  FROM embeddings a
  JOIN embeddings b ON b.vec_id = CASE WHEN a.vec_id // 4 % 5 = 0 THEN a.vec_id
       ELSE (a.vec_id + 1) % (SELECT count(*) FROM embeddings) END
  JOIN """ + EDGES + """ ON e.k = a.vec_id // 4 % 6),
edge_losses AS (
  SELECT batch_id, i, j, avg(list_dot_product(pred, truth)) AS cos,
         avg(1 - list_dot_product(pred, truth)) AS loss,
         avg(list_sum(list_transform(list_zip(pred, truth), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))
           AS mse
  FROM emb GROUP BY ALL),
surprise AS (
  SELECT pair_id, label::VARCHAR AS field, pair_id * 7919 % 101 AS citations,
         1 - list_dot_product(pred, truth) AS surprise FROM emb)"""


def labelled(source: str, key: str, strategy: str = "field_quartile") -> str:
    if strategy != "field_quartile":
        return f"""labelled AS (SELECT *, (ln(1 + citations) > (SELECT quantile_cont(ln(1 + citations), 0.5)
  FROM {source}))::INTEGER AS label FROM {source})"""
    return f"""labelled AS (
  SELECT s.*, (t.n >= 4 AND ln(1 + s.citations) >= t.q)::INTEGER AS label
  FROM {source} s JOIN (SELECT field, count(*) AS n, quantile_cont(ln(1 + citations), 0.75) AS q
                        FROM {source} GROUP BY 1) t USING (field))"""


def association(source: str) -> str:
    """CTEs rho(rho, n, p) and roc(auroc) over ``source`` and ``labelled``."""
    return f"""vals AS (SELECT round(surprise, 6) + 0.0 AS x, citations::DOUBLE AS y FROM {source}),
ranks AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
                 rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM vals),
rho_t AS (SELECT corr(rx, ry) AS rho, count(*) AS n,
          abs(corr(rx, ry)) * sqrt((count(*) - 2) / (1 - corr(rx, ry) ** 2)) AS t FROM ranks),
rho AS (SELECT rho, n, {t_p('t', 'n - 2')} AS p FROM rho_t),
roc_r AS (SELECT label, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r
          FROM (SELECT label, round(surprise, 6) + 0.0 AS s FROM labelled)),
roc AS (SELECT (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1)
           * (count(*) FILTER (label = 1) + 1) / 2.0)
           / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auroc FROM roc_r)"""


def t_p(t: str, df: str) -> str:
    """Two-sided p of |t| by the finite series, any integer df (term products in logs)."""
    c2 = f"(({df}) / (({df}) + {t} * {t}))"
    even = (f"{t} / sqrt(({df}) + {t} * {t}) * (1 + coalesce(list_sum(list_transform(range(1, (({df}) - 2) // 2 + 1), "
            f"lambda k: exp(k * ln({c2}) + list_sum(list_transform(range(1, k + 1), lambda m: ln((2 * m - 1) / (2 * m))))))), 0))")
    odd = (f"2 / pi() * (atan({t} / sqrt({df})) + CASE WHEN ({df}) = 1 THEN 0 ELSE "
           f"{t} / sqrt(({df}) + {t} * {t}) * sqrt({c2}) * (1 + coalesce(list_sum(list_transform(range(1, (({df}) - 3) // 2 + 1), "
           f"lambda k: exp(k * ln({c2}) + list_sum(list_transform(range(1, k + 1), lambda m: ln((2 * m) / (2 * m + 1))))))), 0)) END)")
    return f"1 - CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END"


def runs(study: str = "lambda") -> str:
    names = "[" + ", ".join(f"'{v}'" for v in RUN_VARIANTS[study]) + "]"
    return f"""
runs AS (
  SELECT '{study}' AS study, ({names})[user_id % 5 + 1] AS variant, event_id % 4 AS seed,
         avg(value) AS perplexity, count(*) AS steps, sum(value) AS wall_time_s,
         sum(event_id % 7)::BIGINT AS edges_run, avg(value) / 1000 AS mean_pairwise_cos,
         max(value) / 10 AS effective_rank
  FROM events GROUP BY ALL)"""


TESTS = """
paired AS (SELECT r.study, r.variant, r.seed, r.perplexity AS value, b.perplexity AS base_value
  FROM runs r JOIN runs b ON b.study = r.study AND b.seed = r.seed AND b.variant = '{base}'
  WHERE r.variant <> '{base}'),
tests AS (SELECT study, variant, avg(value) AS value_mean, avg(base_value) AS base_mean, count(*) AS n,
    avg(value - base_value) / (stddev_samp(value - base_value) / sqrt(count(*))) AS t_stat
  FROM paired GROUP BY ALL),
pvals AS (SELECT *, """ + t_p("abs(t_stat)", "n - 1") + """ AS p_value FROM tests),
steps AS (SELECT *, p_value <= 0.05 / (count(*) OVER (PARTITION BY study)
     - row_number() OVER (PARTITION BY study ORDER BY p_value, variant) + 1) AS ok FROM pvals),
holm AS (SELECT *, bool_and(ok) OVER (PARTITION BY study ORDER BY p_value, variant
     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS significant_holm FROM steps)"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    def add(name: str, ctes: str, select: str) -> None:
        q[name] = f"WITH {ctes.strip().lstrip(',')}\n{select}"

    # sources and sinks
    add("read_papers", PAPERS, "SELECT " + ", ".join([*_COLUMNS.values(), "paper_id", "oa_year",
        "source_year", "oa_cited_by_count", "field_subfield", "seq"]) + " FROM papers")
    add("write_shards", CHAINS, f"SELECT {_ROW}, split FROM chains")
    builds = f"SELECT md5('{_SETTINGS}')[:10] AS signature, input, split, n, whole AS reused FROM builds"
    add("build_or_reuse", BUILDS, builds + " WHERE whole")
    add("build_by_input", BUILDS, builds)
    add("build_whole", CHAINS + ",\n" + PRINT.format(name="print", source="papers"), f"""
SELECT md5('{_SETTINGS_WHOLE}')[:10] AS signature, input, split, count(*) AS n FROM chains, print GROUP BY ALL""")
    add("input_fingerprint", PAPERS + ",\n" + PRINT.format(name="print", source="papers"), "SELECT input FROM print")
    add("read_split", CHAINS, f"SELECT {_ROW}, split FROM chains WHERE split = 'test'")
    add("ingest_in_batches", CAPS + """,
span AS (SELECT min(doc_id) AS low, (max(doc_id) - min(doc_id)) // 4 + 1 AS step FROM documents)""",
        f"SELECT {_ROW}, split, ((seq - low) // step)::INTEGER AS batch_id FROM capped, span")
    add("ingest_stream", CAPS, f"SELECT {_ROW}, split FROM capped")
    summary = ("SELECT study, variant, round(avg(perplexity), 6) AS perplexity_mean, "
               "round(stddev_pop(perplexity), 6) AS perplexity_std, "
               "round(avg(mean_pairwise_cos), 6) AS mean_pairwise_cos")
    add("write_study", runs("ablation"), summary + " FROM runs GROUP BY ALL")
    add("plot_series", runs("dropout"), "SELECT variant::DOUBLE AS x, round(avg(perplexity), 6) AS y "
        "FROM runs GROUP BY ALL ORDER BY x")

    # projections and filters
    add("build_chains", CHAINS, f"SELECT {_ROW} FROM chains")
    add("parse_year", PAPERS, f"SELECT seq, {_YEAR} AS year FROM papers")
    add("normalise_field", PAPERS, f"SELECT seq, {_FIELD} AS field FROM papers")
    add("assign_split", CHAINS, "SELECT seq, id, year, split FROM chains")
    add("full_text", CHAINS, f"SELECT seq, {_FULL} AS full_text FROM chains")
    add("prefix_context", CHAINS, f"SELECT seq, {_ctx(3)} AS ctx FROM chains")
    add("edge_pairs", PAIRS, "SELECT id, seq, i, j, context, target FROM pairs")
    add("filter_edges", PAIRS, "SELECT seq, i, j, target FROM pairs WHERE NOT (i = 2 AND j = 4)")
    drop = (f"('0x' || substr(md5(batch_id || '|' || i || '|' || j || '|{SHUFFLE_SEED}'), 1, 15))"
            f"::BIGINT % 1000000 / 1e6 >= {DROPOUT_RATE}")
    add("edge_dropout", EMB, f"SELECT pair_id, batch_id, i, j FROM emb WHERE {drop}")
    add("flip_findings", CHAINS, f"SELECT seq, {_flip('result')} AS flipped FROM chains")
    add("truncate_tokens", CHAINS, "SELECT seq, "
        f"{_cut_tokens('result', WHOLE.max_stage_tokens)} AS stage, "
        f"{_cut_tokens(_ctx(3), WHOLE.context_tokens)} AS ctx, "
        f"{_cut_tokens(_FULL, WHOLE.full_text_tokens)} AS full_text FROM chains")
    add("log_citations", CHAINS, "SELECT seq, round(ln(1 + citations), 6) AS log_citations FROM chains")
    markers = "".join(f"[PRED{k}]" for k in range(WHOLE.num_pred_tokens))
    budget = WHOLE.context_tokens - WHOLE.num_pred_tokens
    add("prediction_prompt", CHAINS, f"SELECT seq, {_cut_tokens(_ctx(3), budget)} || ' {markers}' "
        "AS prompt FROM chains")

    # caps, order, batches
    add("cap_per_field", CAPS, "SELECT seq, field, split FROM field_capped")
    add("cap_per_split", CAPS, "SELECT seq, field, split FROM capped")
    add("head_n", CHAINS, f"SELECT seq, id FROM chains WHERE split = 'test' ORDER BY seq "
        f"LIMIT {CAPPED.perplexity_eval_examples}")
    block, size = CAPPED.shuffle_buffer, CAPPED.batch_size
    add("block_shuffle", CHAINS + ",\n" + ordered(block), "SELECT seq, split, order_pos FROM ordered")
    add("stripe", CHAINS + ",\n" + ordered(block),
        f"SELECT seq, split, (pos // {block} % 2)::INTEGER AS worker FROM ordered")
    own = (CHAINS + ",\n" + ordered(block) + f""",
own AS (SELECT *, pos // {block} % 2 AS worker, pos // {block} // 2 * {block} + pos % {block} AS own_pos
        FROM positions)""")
    worker_pos = f"""SELECT seq, id, split, worker::INTEGER AS worker,
  (own_pos // {block} * {block} + row_number() OVER (PARTITION BY split, worker, own_pos // {block}
   ORDER BY md5(id || '|' || seq || '|{SHUFFLE_SEED}'), seq) - 1)::BIGINT AS order_pos FROM own"""
    add("worker_order", own, worker_pos.replace("seq, id,", "seq,", 1))
    add("trainer_output", own, worker_pos)
    add("assign_batches", CHAINS + ",\n" + ordered(block),
        f"SELECT seq, split, order_pos // {size} AS batch_id FROM ordered")
    add("rank_candidates", BM25, f"SELECT pool_id, pos, is_true, rank::INTEGER AS rank FROM {ranked('bm25')}")

    # pools
    add("build_pools", POOLS, "SELECT pool_id, pos, kind, text, is_true FROM pools")
    add("shared_pools", POOLS,
        "SELECT pool_id, ctx, pos, kind, text, is_true FROM pools JOIN ctxs USING (pool_id)")
    add("bm25_scores", BM25, "SELECT pool_id, pos, is_true, round(score, 6) AS score FROM bm25")
    add("bm25_recall", BM25, "SELECT round(avg((rank = 1)::INTEGER), 6) AS recall_at_1 "
        f"FROM {ranked('bm25')} WHERE is_true")
    add("dense_scores", DENSE,
        "SELECT pool_id, pos, is_true, round(score, 6) + 0.0 AS score FROM dense")
    add("retrieval_metrics", DENSE, "SELECT round(avg((rank = 1)::INTEGER), 6) AS recall_at_1, "
        "round(avg((rank <= 5)::INTEGER), 6) AS recall_at_5, round(avg(1.0 / rank), 6) AS mrr "
        f"FROM {ranked('dense')} WHERE is_true")

    # encoders
    add("encode", CHAINS + ",\n" + vectors("chains", "seq", "result", None, "vec"),
        "SELECT seq, list_transform(v, lambda x: round(x, 6)) AS vec FROM vec")
    add("predict_stage", CHAINS + f", c AS (SELECT seq, {_ctx(3)} AS ctx FROM chains),\n"
        + vectors("c", "seq", "ctx", None, "vec"),
        "SELECT seq, list_transform(v, lambda x: round(x, 6)) AS vec FROM vec")
    add("l2_normalise", EMB, "SELECT pair_id, round(list_dot_product(pred, truth), 6) AS dot, "
        "round(sqrt(list_dot_product(pred, pred)), 5) AS norm, "
        "list_transform(pred, lambda x: round(x / sqrt(list_dot_product(pred, pred)), 5)) AS unit FROM emb")

    # labels and counts
    add("citation_labels", CHAINS + ",\n" + labelled("chains", "seq"), "SELECT seq, field, label FROM labelled")
    add("median_labels", CHAINS + ",\n" + labelled("chains", "seq", "median"), "SELECT seq, label FROM labelled")
    add("positive_rate", CHAINS + ", tests AS (SELECT * FROM chains WHERE split = 'test'),\n"
        + labelled("tests", "seq"),
        "SELECT field, round(avg(label), 6) AS positive_rate, count(*) AS n FROM labelled GROUP BY field")
    add("split_counts", CHAINS, "SELECT split, count(*) AS n FROM chains GROUP BY split")
    add("field_counts", CHAINS,
        "SELECT field, count(*) AS n FROM chains WHERE split = 'train' GROUP BY field")

    # language model
    add("bigram_model", language_model(None), "SELECT v, w, n FROM pair_n")
    add("token_nll", language_model(None),
        "SELECT seq, round(nll, 6) AS nll FROM nlls WHERE split = 'test'")
    add("perplexity", language_model(None), "SELECT round(exp(avg(nll)), 4) AS perplexity, "
        "round(avg(nll), 6) AS avg_nll FROM nlls WHERE split = 'test'")

    # losses and health
    add("edge_loss", EMB, "SELECT batch_id, i, j, round(cos, 6) AS cos, round(loss, 6) AS loss FROM edge_losses")
    add("edge_loss_mse", EMB, "SELECT batch_id, i, j, round(cos, 6) AS cos, round(mse, 6) AS loss FROM edge_losses")
    add("drop_trivial_edges", EMB, "SELECT batch_id, i, j FROM edge_losses WHERE cos <= 0.95")
    add("combined_loss", EMB, f"""SELECT b.batch_id, round(b.nll + 0.5 * coalesce(l.loss, 0), 6) AS loss
FROM (SELECT batch_id, sum(pair_id) / 1000.0 AS nll FROM emb GROUP BY 1) b
LEFT JOIN (SELECT batch_id, avg(loss) AS loss FROM edge_losses WHERE cos <= 0.95 AND {drop}
           GROUP BY 1) l USING (batch_id)""")
    add("edges_run", EMB, f"SELECT count(*) AS edges_run FROM edge_losses WHERE {drop}")
    add("mean_pairwise_cos", """
dims AS (SELECT u.k, sum(e.embedding[u.k]::DOUBLE) AS s, sum(e.embedding[u.k]::DOUBLE ** 2) AS s2
         FROM embeddings e, range(1, 65) u(k) GROUP BY 1), n AS (SELECT count(*) AS n FROM embeddings)""",
        "SELECT round((sum(s * s) - sum(s2)) / (max(n) * (max(n) - 1)), 6) AS mean_pairwise_cos FROM dims, n")
    add("gram_cells", "dims AS (SELECT unnest(range(1, 65))::INTEGER AS k)", """SELECT a.k - 1 AS i, b.k - 1 AS j, round(sum(e.embedding[a.k]::DOUBLE * e.embedding[b.k]::DOUBLE), 4) + 0.0 AS value
FROM embeddings e, dims a, dims b GROUP BY ALL""")
    add("surprise", EMB, "SELECT pair_id, round(surprise, 6) + 0.0 AS surprise FROM surprise")
    assoc = EMB + ",\n" + labelled("surprise", "pair_id") + ",\n" + association("surprise")
    add("spearman", assoc, "SELECT round(rho, 6) AS spearman_rho, round(p, 6) AS spearman_p, n FROM rho")
    add("auroc", assoc, "SELECT round(auroc, 6) AS auroc FROM roc")

    # studies
    add("study_grid", f"seeds AS (SELECT DISTINCT event_id % 4 AS seed FROM events), v AS (SELECT * FROM (VALUES {_GRID}) "
        "t(study, variant, settings))", "SELECT study, variant, seed, settings FROM v, seeds")
    add("pair_with_baseline", runs() + ",\n" + TESTS.format(base="0.0"),
        "SELECT study, variant, seed, round(value, 6) AS value, round(base_value, 6) AS base_value FROM paired")
    add("throughput", runs(), "SELECT variant, seed, round(steps / greatest(1e-9, wall_time_s), 6) "
        "AS steps_per_sec FROM runs")
    add("run_record", runs(), "SELECT study, variant, seed, steps, edges_run, round(wall_time_s, 4) AS wall_time_s, "
        "round(perplexity, 6) AS perplexity, round(perplexity / 100, 6) AS \"F1_recall1\", "
        "round(perplexity / 200, 6) AS \"F1_bm25_recall1\", round(mean_pairwise_cos, 6) AS \"F2_rho\", "
        "round(mean_pairwise_cos, 6) AS mean_pairwise_cos, round(effective_rank, 6) AS effective_rank FROM runs")
    add("summarise_lambda", runs(), summary + ", round(avg(effective_rank), 6) AS effective_rank, "
        "list(round(perplexity, 6) ORDER BY seed) AS perplexities FROM runs GROUP BY ALL")
    add("summarise_ablation", runs("ablation"), summary + " FROM runs GROUP BY ALL")
    add("summarise_dropout", runs("dropout"), "SELECT study, variant, round(avg(perplexity), 6) AS perplexity_mean, "
        "round(avg(steps / greatest(1e-9, wall_time_s)), 6) AS steps_per_sec_mean, "
        "round(avg(edges_run), 6) AS edges_run_mean FROM runs GROUP BY ALL")
    tests = runs() + ",\n" + TESTS.format(base="0.0")
    add("paired_ttest", tests, "SELECT study, variant, round(t_stat, 6) AS t_stat, round(p_value, 6) AS p_value FROM pvals")
    add("t_p_values", runs(), f"SELECT variant, seed, round(t, 6) AS t, df, round({t_p('t', 'df')}, 6) AS p "
        "FROM (SELECT variant, seed, perplexity / 20 AS t, steps % 40 + 1 AS df FROM runs)")
    add("holm", tests, "SELECT study, variant, significant_holm FROM holm")
    add("significance_report", tests, "SELECT study, variant, round(p_value, 6) AS p_value, significant_holm, "
        "value_mean < base_mean AS better_than_baseline FROM holm")

    # whole flows
    rows = f"tests2 AS (SELECT seq, field, citations, {_ctx(3)} AS ctx, result FROM tests),\n"
    lm_tail = language_model(None)[len(CHAINS):]
    ev = (BM25 + DENSE[len(POOLS):] + lm_tail + ",\n" + rows
          + vectors("tests2", "seq", "result", None, "res") + """,
surprise AS (SELECT t.seq, t.field, t.citations, 1 - list_dot_product(p.v, r.v) AS surprise
  FROM tests2 t JOIN pred p ON p.pool_id = t.seq::VARCHAR JOIN res r ON r.seq = t.seq),
dims AS (SELECT u.k, sum(v[u.k]) AS s, sum(v[u.k] ** 2) AS s2 FROM res, range(1, 65) u(k) GROUP BY 1),
""" + labelled("surprise", "seq") + ",\n" + association("surprise"))
    add("evaluate_all", ev, f"""SELECT family, metric, round(value, 4) AS value FROM (
SELECT 'perplexity' AS family, 'perplexity' AS metric, exp(avg(nll)) AS value FROM nlls WHERE split = 'test'
UNION ALL SELECT 'perplexity', 'avg_nll', avg(nll) FROM nlls WHERE split = 'test'
UNION ALL SELECT 'embedding_health', 'mean_pairwise_cos', (sum(s * s) - sum(s2)) /
  ((SELECT count(*) FROM res) * ((SELECT count(*) FROM res) - 1)) FROM dims
UNION ALL SELECT 'F1_model', 'recall_at_1', avg((rank = 1)::INTEGER) FROM {ranked('dense')} WHERE is_true
UNION ALL SELECT 'F1_model', 'recall_at_5', avg((rank <= 5)::INTEGER) FROM {ranked('dense')} WHERE is_true
UNION ALL SELECT 'F1_model', 'mrr', avg(1.0 / rank) FROM {ranked('dense')} WHERE is_true
UNION ALL SELECT 'F1_bm25', 'recall_at_1', avg((rank = 1)::INTEGER) FROM {ranked('bm25')} WHERE is_true
UNION ALL SELECT 'F2', 'spearman_rho', rho FROM rho
UNION ALL SELECT 'F2', 'spearman_p', p FROM rho
UNION ALL SELECT 'F2', 'auroc', auroc FROM roc
UNION ALL SELECT 'F2', 'positive_rate', avg(label) FROM labelled)""")
    train_pairs = PAIRS + lm_tail + ", trains AS (SELECT * FROM chains WHERE split = 'train'),\n" + \
        ordered(block, source="trains") + f""",
batched AS (SELECT seq, order_pos // {size} AS batch_id FROM ordered),
kept AS (SELECT b.batch_id, p.seq, p.i, p.j, p.context, p.target FROM pairs p JOIN batched b USING (seq)
         WHERE {drop}),
""" + vectors("kept", "batch_id, seq, i, j", "context", None, "pv") + ",\n" + \
        vectors("kept", "batch_id, seq, i, j", "target", None, "tv") + """,
el AS (SELECT batch_id, i, j, avg(list_dot_product(p.v, t.v)) AS cos FROM pv p
       JOIN tv t USING (batch_id, seq, i, j) GROUP BY ALL),
used AS (SELECT batch_id, avg(1 - cos) AS loss FROM el WHERE cos <= 0.95 GROUP BY 1),
base AS (SELECT batch_id, avg(nll) AS nll FROM nlls JOIN batched USING (seq) GROUP BY 1)"""
    add("training_losses", train_pairs, "SELECT batch_id, round(nll, 5) AS nll, "
        "round(nll + coalesce(u.loss, 0), 5) AS loss FROM base LEFT JOIN used u USING (batch_id)")
    return q
