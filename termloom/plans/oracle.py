"""DuckDB SQL for the registered queries, from shared common table expressions.

``CTES`` names the pieces; ``sql`` puts before a statement those that it uses,
directly or through others, in the order in which they are listed.
"""

from __future__ import annotations

import re

from termloom.functions.text import STOPWORDS
from termloom.operators import optimize
from termloom.operators.metrics import LEVELS
from termloom.plans.workload import CANDIDATES, WEIGHTS

A, B, G = WEIGHTS
_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_STOP = ", ".join(repr(x) for x in STOPWORDS)
_ANALYZED = f"list_filter({_TOKENS}, lambda x: x NOT IN ({_STOP}))"
_BM25 = "ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + {k1}::DOUBLE * (1.0::DOUBLE - {b}::DOUBLE + {b}::DOUBLE * dl / avgdl))"
_SLOT = "(('0x' || substr(md5(term), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings))"


def rnd(expr: str, places: int = 6) -> str:
    return f"(round(({expr})::DOUBLE, {places}) + 0.0::DOUBLE)"


def best(keys: str, score: str = "score", then: str = "doc_id") -> str:
    return f"row_number() OVER (PARTITION BY {keys} ORDER BY round({score}, 9) DESC, {then})"


def _sweep(k1: float, b: float) -> str:
    return f"SELECT {k1}::DOUBLE AS k1, {b}::DOUBLE AS b"


_ABLATION = [
    ("uniform", 0, 0, 0, 1),
    ("rm_only", 1, 0, 0, 0),
    ("bm25_only", 0, 1, 0, 0),
    ("semantic_only", 0, 0, 1, 0),
    ("rm_bm25", A, B, 0, 0),
    ("rm_semantic", A, 0, G, 0),
    ("bm25_semantic", 0, B, G, 0),
    ("our_method", A, B, G, 0),
]
_GRID, _SAMPLES = optimize.grid(), optimize.Sampler(((0.1, 5.0),) * 3, 42).points(1000)
_SENSITIVITY = [(1, 1, 1), (2, 1, 1), (1, 2, 1), (1, 1, 2), (0.1, 1, 1), (1, 0.1, 1), (1, 1, 0.1)]


def _points(points: list) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, {g!r}::DOUBLE)" for i, (a, b, g) in enumerate(points)) + ") v(weights_id, alpha, beta, gamma)"


def _evaluated(source: str, keys: str) -> str:
    """Per-query metrics of ``source`` (keys, qid, doc_id, score)."""
    on = ", ".join(f"j.{k}" for k in keys.split(", "))
    cuts = (1, 5, 10, 100)
    sums = [f"sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END) AS hit_{k}, sum(CASE WHEN rank <= {k} THEN gain ELSE 0 END) AS dcg_{k}, sum(CASE WHEN rank <= {k} THEN hit * hits / rank::DOUBLE ELSE 0 END) AS ap_{k}" for k in cuts]
    levels = [f'max(CASE WHEN hits >= greatest(ceil(round({x}::DOUBLE * n_rel, 9)), 1) THEN hits / rank::DOUBLE ELSE 0 END) AS "iprec_at_recall_{x:.2f}"' for x in LEVELS]
    levels = [x.replace(".00\"", "_00\"").replace("recall_0.", "recall_0_").replace("recall_1.", "recall_1_") for x in levels]
    names = ['"' + f"iprec_at_recall_{x:.2f}".replace(".", "_") + '"' for x in LEVELS]
    return f"""
  SELECT {keys}, n_ret::DOUBLE AS num_ret, n_rel::DOUBLE AS num_rel, n_hit::DOUBLE AS num_rel_ret,
    CASE WHEN n_rel > 0 THEN ap / n_rel ELSE 0 END AS map, coalesce(1.0::DOUBLE / first_hit, 0) AS recip_rank,
    CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END AS ndcg, CASE WHEN n_rel > 0 THEN hit_r / n_rel::DOUBLE ELSE 0 END AS "Rprec",
    CASE WHEN n_rel > 0 THEN pref / n_rel ELSE 0 END AS bpref, n_hit / n_ret::DOUBLE AS "set_P", CASE WHEN n_rel > 0 THEN n_hit / n_rel::DOUBLE ELSE 0 END AS set_recall,
    CASE WHEN n_hit > 0 THEN 2.0::DOUBLE * (n_hit / n_ret::DOUBLE) * (n_hit / n_rel::DOUBLE) / (n_hit / n_ret::DOUBLE + n_hit / n_rel::DOUBLE) ELSE 0 END AS "set_F",
    ({" + ".join(names)}) / 11.0::DOUBLE AS "11pt_avg", {", ".join(names)},
    {", ".join(f'hit_{k} / {k}.0::DOUBLE AS "P_{k}", CASE WHEN n_rel > 0 THEN hit_{k} / n_rel::DOUBLE ELSE 0 END AS recall_{k}, CASE WHEN ideal_{k} > 0 THEN dcg_{k} / ideal_{k} ELSE 0 END AS ndcg_cut_{k}, CASE WHEN n_rel > 0 THEN ap_{k} / n_rel ELSE 0 END AS map_cut_{k}, (hit_{k} > 0)::INT::DOUBLE AS success_{k}' for k in cuts)}
  FROM (
    SELECT {on}, any_value(n_rel) AS n_rel, any_value(ideal) AS ideal, {", ".join(f"any_value(ideal_{k}) AS ideal_{k}" for k in cuts)},
      count(*) AS n_ret, sum(hit) AS n_hit, min(CASE WHEN hit = 1 THEN rank END) AS first_hit, sum(gain) AS dcg, sum(hit * hits / rank::DOUBLE) AS ap,
      sum(CASE WHEN rank <= n_rel THEN hit ELSE 0 END) AS hit_r,
      sum(CASE WHEN hit = 1 THEN CASE WHEN bads > 0 THEN 1.0::DOUBLE - least(bads, n_rel) / least(n_rel, n_nonrel)::DOUBLE ELSE 1 END ELSE 0 END) AS pref,
      {", ".join(sums)}, {", ".join(levels)}
    FROM (
      SELECT *, sum(hit) OVER w AS hits, sum(bad) OVER w AS bads FROM (
        SELECT s.*, coalesce((q.rel >= 1)::INT, 0) AS hit, coalesce((q.rel < 1)::INT, 0) AS bad,
          row_number() OVER (PARTITION BY {", ".join("s." + k for k in keys.split(", "))} ORDER BY round(s.score, 6) DESC, s.doc_id::VARCHAR DESC) AS rank,
          greatest(coalesce(q.rel, 0), 0) / log2(row_number() OVER (PARTITION BY {", ".join("s." + k for k in keys.split(", "))} ORDER BY round(s.score, 6) DESC, s.doc_id::VARCHAR DESC) + 1.0::DOUBLE) AS gain
        FROM ({source}) s LEFT JOIN qrels q ON s.qid = q.qid AND s.doc_id = q.doc_id
      ) WINDOW w AS (PARTITION BY {keys} ORDER BY rank)
    ) j JOIN ideal i ON j.qid = i.qid GROUP BY {on}
  )"""


def _ndcg(points: str) -> str:
    """(weights_id, qid, ndcg_cut_10) of the candidates under every row of a table of weights."""
    return f"""SELECT weights_id, qid, CASE WHEN any_value(ideal_10) > 0 THEN sum(greatest(coalesce(rel, 0), 0) / log2(rank + 1.0::DOUBLE)) / any_value(ideal_10) ELSE 0 END AS ndcg_cut_10 FROM (
        SELECT weights_id, qid, doc_id, row_number() OVER (PARTITION BY weights_id, qid ORDER BY round(score, 6) DESC, doc_id::VARCHAR DESC) AS rank FROM (
          SELECT weights_id, qid, doc_id, base + alpha * pr + beta * pb + gamma * ps AS score FROM parts JOIN ideal USING (qid) CROSS JOIN {points}) QUALIFY rank <= 10)
        JOIN ideal USING (qid) LEFT JOIN qrels USING (qid, doc_id) GROUP BY weights_id, qid"""


CTES: dict[str, str] = {
    "docs_tok": f"SELECT doc_id, text, {_ANALYZED} AS toks FROM documents WHERE text IS NOT NULL",
    "docs_raw": f"SELECT doc_id, {_TOKENS} AS toks FROM documents WHERE text IS NOT NULL",
    "doc_stats": "SELECT doc_id, len(toks)::BIGINT AS dl FROM docs_tok",
    "postings": "SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM docs_tok) GROUP BY ALL",
    "term_stats": "SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM postings GROUP BY term",
    "coll": "SELECT count(*) AS n, avg(dl) AS avgdl FROM doc_stats",
    "query_toks": f"SELECT item_id AS qid, {_ANALYZED} AS toks FROM benchmark",
    "query_raw": f"SELECT item_id AS qid, {_TOKENS} AS toks FROM benchmark",
    "query_tokens": "SELECT qid, i AS pos, toks[i + 1] AS term FROM (SELECT qid, toks, unnest(range(len(toks))) AS i FROM query_raw)",
    "query_terms": "SELECT qid, i AS pos, toks[i + 1] AS term FROM (SELECT qid, toks, unnest(range(len(toks))) AS i FROM query_toks)",
    "wide": "SELECT p.term, p.doc_id, tf, df, dl, n, avgdl FROM postings p JOIN term_stats t ON p.term = t.term JOIN doc_stats d ON p.doc_id = d.doc_id CROSS JOIN coll WHERE p.term IN (SELECT term FROM query_terms)",
    "term_scores": f"SELECT term, doc_id, {_BM25.format(k1=1.2, b=0.75)} AS score FROM wide",
    "summed": "SELECT qid, doc_id, sum(score) AS score FROM query_terms JOIN term_scores USING (term) GROUP BY ALL",
    "ranked": f"SELECT qid, doc_id, score, {best('qid')} AS rank FROM summed",
    "top10": "SELECT * FROM ranked WHERE rank <= 10",
    "candidates": f"SELECT * FROM ranked WHERE rank <= {CANDIDATES}",
    "top100": "SELECT * FROM ranked WHERE rank <= 100",
    "short100": f"SELECT * FROM (SELECT *, {best('qid')} AS rank FROM (SELECT qid, doc_id, sum({_BM25.format(k1=0.9, b=0.4)}) AS score FROM query_terms JOIN wide USING (term) GROUP BY ALL)) WHERE rank <= 100",
    "qrels": """SELECT qid, doc_id, CASE WHEN phrase THEN 2 ELSE 1 END AS rel FROM (
        SELECT q.qid, p.doc_id, shared = wanted AND contains(' ' || array_to_string(d.toks, ' ') || ' ', ' ' || array_to_string(k.toks, ' ') || ' ') AS phrase
        FROM (SELECT qid, doc_id, count(*) AS shared FROM (SELECT DISTINCT qid, term FROM query_terms) JOIN postings USING (term) GROUP BY ALL) p
        JOIN (SELECT qid, count(DISTINCT term) AS wanted FROM query_terms GROUP BY qid) q ON p.qid = q.qid AND 4 * shared >= 3 * wanted
        JOIN docs_tok d ON p.doc_id = d.doc_id JOIN query_toks k ON k.qid = p.qid)""",
    "ideal": "SELECT qid, sum((rel >= 1)::INT) AS n_rel, sum((rel < 1)::INT) AS n_nonrel, sum(g) AS ideal, "
    + ", ".join(f"sum(CASE WHEN place <= {k} THEN g ELSE 0 END) AS ideal_{k}" for k in (1, 5, 10, 100))
    + " FROM (SELECT qid, rel, place, greatest(rel, 0) / log2(place + 1.0::DOUBLE) AS g FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS place FROM qrels)) GROUP BY qid",
    "shares": "SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(list_slice(toks, 1, 1000)) AS n, unnest(list_slice(toks, 1, 1000)) AS term FROM docs_tok) GROUP BY ALL",
    "weights10": "SELECT *, score / sum(score) OVER (PARTITION BY qid) AS doc_weight FROM top10",
    "rm": "SELECT qid, term, sum(doc_weight * tf / n) AS weight FROM weights10 JOIN shares USING (doc_id) GROUP BY ALL",
    "rm3": "SELECT qid, term, sum(weight) AS weight FROM (SELECT * FROM rm UNION ALL SELECT DISTINCT qid, term, 1.0::DOUBLE FROM query_terms) GROUP BY ALL",
    "expansion": f"SELECT * FROM (SELECT *, {best('qid', 'weight', 'term')} AS rank FROM rm3) WHERE rank <= 15",
    "own_terms": "SELECT term FROM query_tokens UNION SELECT term FROM expansion",
    "own_scores": f"SELECT term, doc_id, {_BM25.format(k1=1.2, b=0.75)} AS score FROM (SELECT p.term, p.doc_id, tf, df, dl, n, avgdl FROM postings p JOIN own_terms USING (term) JOIN term_stats t ON p.term = t.term JOIN doc_stats d ON p.doc_id = d.doc_id CROSS JOIN coll)",
    "coll_scores": f"SELECT term, avg(score) AS score FROM (SELECT *, {best('term')} AS i FROM own_scores) WHERE i <= 10 GROUP BY term",
    "own_vecs": f"SELECT term, embedding::DOUBLE[] AS vec FROM own_terms JOIN embeddings ON vec_id = {_SLOT}",
    "query_term_vecs": f"SELECT term, embedding::DOUBLE[] AS vec FROM (SELECT DISTINCT term FROM query_tokens) JOIN embeddings ON vec_id = {_SLOT}",
    "query_vecs": "SELECT qid, list(s ORDER BY d) AS vec FROM (SELECT qid, d, sum(vec[d]) AS s FROM query_tokens JOIN query_term_vecs USING (term) CROSS JOIN (SELECT unnest(range(1, 65)) AS d) GROUP BY ALL) GROUP BY qid",
    "semantic": "SELECT e.qid, e.term, greatest(0.0::DOUBLE, list_inner_product(q.vec, t.vec) / (sqrt(list_inner_product(q.vec, q.vec)) * sqrt(list_inner_product(t.vec, t.vec)))) AS similarity FROM expansion e JOIN own_vecs t ON e.term = t.term JOIN query_vecs q ON e.qid = q.qid",
    "features": "SELECT e.qid, e.rank, e.term, e.weight AS rm_weight, coalesce(c.score, 0) AS bm25_score, coalesce(s.similarity, 0) AS semantic_score FROM expansion e LEFT JOIN coll_scores c ON e.term = c.term LEFT JOIN semantic s ON e.qid = s.qid AND e.term = s.term",
    "doc_vec_terms": "SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(list_slice(toks, 1, 512)) AS term FROM docs_raw WHERE doc_id IN (SELECT doc_id FROM candidates))",
    "wanted_terms": "SELECT DISTINCT qid, term FROM (SELECT qid, term FROM query_tokens UNION ALL SELECT qid, term FROM expansion)",
    "doc_slots": f"SELECT DISTINCT doc_id, {_SLOT} AS slot FROM doc_vec_terms",
    "own_slots": f"SELECT qid, term, {_SLOT} AS slot FROM wanted_terms",
    "dots": "SELECT a.vec_id AS x, b.vec_id AS y, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dot FROM embeddings a JOIN (SELECT DISTINCT slot FROM own_slots) s ON a.vec_id = s.slot CROSS JOIN (SELECT e.* FROM embeddings e JOIN (SELECT DISTINCT slot FROM doc_slots) d ON e.vec_id = d.slot) b",
    "pair_dots": "SELECT d.doc_id, x AS slot, max(dot) AS similarity FROM doc_slots d JOIN dots ON y = d.slot GROUP BY ALL",
    "sims": "SELECT c.qid, c.doc_id, w.term, similarity FROM candidates c JOIN own_slots w ON c.qid = w.qid JOIN pair_dots p ON p.doc_id = c.doc_id AND p.slot = w.slot",
    "doc_vecs": f"SELECT term, embedding::DOUBLE[] AS vec FROM (SELECT DISTINCT term FROM doc_vec_terms) JOIN embeddings ON vec_id = {_SLOT}",
    "abl_weights": "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE, {g}::DOUBLE, {c}::DOUBLE)" for m, a, b, g, c in _ABLATION) + ") v(model, alpha, beta, gamma, constant)",
    "abl": "SELECT model, qid, rank, term, alpha * rm_weight + beta * bm25_score + gamma * semantic_score + constant AS importance FROM features CROSS JOIN abl_weights",
    "imp": f"SELECT *, {A}::DOUBLE * rm_weight + {B}::DOUBLE * bm25_score + {G}::DOUBLE * semantic_score AS importance FROM features",
    "base": "SELECT qid, doc_id, sum(similarity) AS base FROM query_tokens JOIN sims USING (qid, term) WHERE pos < 32 GROUP BY ALL",
    "parts": "SELECT qid, doc_id, base, sum(rm_weight * similarity) AS pr, sum(bm25_score * similarity) AS pb, sum(semantic_score * similarity) AS ps FROM base JOIN sims USING (qid, doc_id) JOIN features USING (qid, term) GROUP BY qid, doc_id, base",
    "reranked": f"SELECT qid, doc_id, score, {best('qid')} AS rank FROM (SELECT qid, doc_id, base + sum(importance * similarity) AS score FROM base JOIN sims USING (qid, doc_id) JOIN imp USING (qid, term) WHERE importance > 0 GROUP BY qid, doc_id, base)",
    "line_pairs": f"""SELECT qid, good_id, gain, doc_id, d, slope, CASE WHEN slope <> 0 THEN round(-d / slope, 9) END AS t FROM (
        SELECT p.qid, g.doc_id AS good_id, rel / ideal_10 AS gain, p.doc_id, p.base + {B}::DOUBLE * p.pb + {G}::DOUBLE * p.ps - (g.base + {B}::DOUBLE * g.pb + {G}::DOUBLE * g.ps) AS d, p.pr - g.pr AS slope
        FROM parts p JOIN parts g ON p.qid = g.qid JOIN qrels j ON j.qid = g.qid AND j.doc_id = g.doc_id AND rel > 0 JOIN ideal i ON i.qid = p.qid AND ideal_10 > 0)""",
    "line_moves": """SELECT qid, good_id, any_value(gain) AS gain, 0.1::DOUBLE AS t, 1 + count(*) FILTER (doc_id <> good_id AND CASE WHEN slope = 0 THEN d > 0 OR d = 0 AND doc_id::VARCHAR > good_id::VARCHAR WHEN slope > 0 THEN t <= 0.1 ELSE t > 0.1 END) AS moved
        FROM line_pairs GROUP BY qid, good_id UNION ALL SELECT qid, good_id, any_value(gain), t, sum(CASE WHEN slope > 0 THEN 1 ELSE -1 END) FROM line_pairs WHERE doc_id <> good_id AND t > 0.1 AND t < 5.0 GROUP BY qid, good_id, t""",
    "reranked_one": f"SELECT qid, doc_id, score, {best('qid')} AS rank FROM (SELECT qid, doc_id, base + sum((rm_weight + bm25_score + semantic_score) * similarity) AS score FROM base JOIN sims USING (qid, doc_id) JOIN features USING (qid, term) WHERE rm_weight + bm25_score + semantic_score > 0 GROUP BY qid, doc_id, base)",
    "recipe_eval": _evaluated("SELECT 'reranked' AS run_name, qid, doc_id, score FROM reranked_one UNION ALL SELECT 'first_stage', qid, doc_id, score FROM candidates", "run_name, qid"),
    "runs": "SELECT 'bm25' AS run_name, qid, rank, doc_id, score FROM top100 UNION ALL SELECT 'bm25_short', qid, rank, doc_id, score FROM short100 UNION ALL SELECT 'reranked', qid, rank, doc_id, score FROM reranked",
    "runs_eval": _evaluated("SELECT run_name, qid, doc_id, score FROM runs", "run_name, qid"),
    "top_eval": _evaluated("SELECT qid, doc_id, score FROM top100", "qid"),
    "first_eval": _evaluated("SELECT qid, doc_id, score FROM candidates", "qid"),
    "reranked_eval": _evaluated("SELECT qid, doc_id, score FROM reranked", "qid"),
    "runs_long": "SELECT run_name, metric, value FROM (SELECT run_name, avg(map) AS map, avg(ndcg_cut_10) AS ndcg_cut_10, avg(ndcg_cut_100) AS ndcg_cut_100, avg(recip_rank) AS recip_rank, avg(recall_100) AS recall_100, avg(\"P_10\") AS \"P_10\", 0.0::DOUBLE AS no_such_metric FROM runs_eval GROUP BY run_name) UNPIVOT (value FOR metric IN (map, ndcg_cut_10, ndcg_cut_100, recip_rank, recall_100, \"P_10\", no_such_metric))",
    "abl_runs": "SELECT model AS run_name, qid, doc_id, sum(score) AS score FROM (SELECT model, b.qid, doc_id, base AS score FROM base b CROSS JOIN abl_weights UNION ALL SELECT model, s.qid, s.doc_id, importance * similarity FROM abl JOIN sims s USING (qid, term) WHERE importance > 0) GROUP BY ALL UNION ALL SELECT 'first_stage', qid, doc_id, score FROM candidates",
    "abl_eval": _evaluated("SELECT * FROM abl_runs", "run_name, qid"),
    "simple_runs": "SELECT 'uniform_simple' AS run_name, b.qid, b.doc_id, base + sum(similarity) AS score FROM base b JOIN query_tokens q ON b.qid = q.qid AND q.pos < 5 JOIN sims s ON s.qid = b.qid AND s.doc_id = b.doc_id AND s.term = q.term GROUP BY b.qid, b.doc_id, base UNION ALL SELECT 'first_stage', qid, doc_id, score FROM candidates",
    "simple_eval": _evaluated("SELECT * FROM simple_runs", "run_name, qid"),
    "grid": _points(_GRID),
    "grid_eval": _ndcg("grid"),
    "grid_scores": f"SELECT weights_id, any_value(alpha) AS alpha, any_value(beta) AS beta, any_value(gamma) AS gamma, {rnd('avg(ndcg_cut_10)', 9)} AS score FROM grid_eval JOIN grid USING (weights_id) GROUP BY weights_id",
    "samples": _points(_SAMPLES),
    "samples_eval": _ndcg("samples"),
    "sens": _points(_SENSITIVITY),
    "sens_eval": _ndcg("sens"),
    "folds": "SELECT fold, CASE WHEN fold = item_id % 5 THEN 'testing' ELSE 'training' END AS split, item_id AS qid FROM benchmark CROSS JOIN (SELECT unnest(range(5))::INT AS fold)",
    "fold_best": f"""SELECT fold, weights_id, score FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, weights_id) AS i FROM (
        SELECT fold, weights_id, {rnd('avg(ndcg_cut_10)', 9)} AS score FROM grid_eval JOIN folds USING (qid) WHERE split = 'training' GROUP BY ALL)) WHERE i = 1""",
    "top_doc": "SELECT qid, doc_id FROM top10 WHERE rank = 1",
    "piece_words": """SELECT doc_id, term, width, (sum(width) OVER (PARTITION BY doc_id ORDER BY i) - width)::BIGINT AS start FROM (
          SELECT doc_id, i, term, greatest(1, ceil(length(term) / 4.0))::BIGINT AS width FROM (SELECT doc_id, unnest(range(len(toks))) AS i, unnest(toks) AS term FROM docs_raw WHERE doc_id IN (SELECT doc_id FROM top_doc)))""",
    "some_scores": """SELECT d.qid, d.doc_id, p.pos, s.score FROM top_doc d JOIN (SELECT doc_id, unnest(range(least(len(toks), 512))) AS pos, unnest(list_slice(toks, 1, 512)) AS term FROM docs_raw) p ON d.doc_id = p.doc_id
        JOIN (SELECT DISTINCT qid, term FROM query_terms) q ON q.qid = d.qid AND q.term = p.term JOIN term_scores s ON s.term = p.term AND s.doc_id = d.doc_id WHERE s.score > 0""",
    "doc_requests": """SELECT qid, doc_id, term FROM top_doc JOIN (
        SELECT qid, term FROM query_tokens UNION SELECT qid, array_to_string(list_slice(toks, 1, 2), ' ') FROM query_raw UNION SELECT qid, '?' FROM query_raw) USING (qid)""",
}


def sql(statement: str) -> str:
    need: set[str] = set()

    def add(text: str) -> None:
        for name in re.findall(r"[a-z_0-9]+", text):
            if name in CTES and name not in need:
                need.add(name)
                add(CTES[name])

    add(statement)
    parts = [f"{n} AS MATERIALIZED (\n{body}\n)" for n, body in CTES.items() if n in need]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + statement


def _columns(*names: str) -> str:
    return ", ".join(f'{rnd(chr(34) + n + chr(34))} AS "{n}"' for n in names)


def _per_query(*names: str) -> str:
    return f"SELECT qid, {_columns(*names)} FROM top_eval"


def _describe(c: str) -> str:
    return f"count({c}) AS n, {rnd(f'avg({c})')} AS mean, {rnd(f'median({c})')} AS median, {rnd(f'min({c})')} AS min, {rnd(f'max({c})')} AS max, {rnd(f'coalesce(stddev_samp({c}), 0)')} AS stdev"


def _spread(c: str) -> str:
    return f"{rnd(f'var_pop({c})', 9)} AS variance, {rnd(f'min({c})')} AS min, {rnd(f'max({c})')} AS max, {rnd(f'max({c}) - min({c})')} AS range"


def _pairs(value: str) -> str:
    return f"SELECT query_id, vec_id, {rnd(value)} AS value FROM (SELECT q.vec_id AS query_id, e.vec_id, q.embedding::DOUBLE[] AS a, e.embedding::DOUBLE[] AS b FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)"


def _terms(source: str, k: int = 20) -> str:
    return f"SELECT qid, rank, term, {rnd('weight')} AS weight FROM (SELECT *, {best('qid', 'weight', 'term')} AS rank FROM ({source})) WHERE rank <= {k}"


_DOC_TERM = f"""SELECT qid, doc_id, term, CASE WHEN count(part) = count(token) THEN coalesce(sum(part), 0) ELSE 0 END AS score FROM (
    SELECT r.qid, r.doc_id, r.term, x.token, s.score AS part FROM doc_requests r
    LEFT JOIN (SELECT DISTINCT term, unnest(list_filter(regexp_extract_all(lower(term), '[\\p{{L}}\\p{{N}}]+'), lambda y: y NOT IN ({_STOP}))) AS token FROM doc_requests) x ON r.term = x.term
    LEFT JOIN term_scores s ON s.term = x.token AND s.doc_id = r.doc_id) GROUP BY ALL"""
_COMPARED = "SELECT r.run_name, r.metric, {value} AS value, {base} AS baseline_value, {pct} AS improvement_pct, {diff} AS improvement_abs FROM {t} r JOIN (SELECT metric, value AS base FROM {t} WHERE run_name = '{b}') USING (metric) WHERE run_name <> '{b}'"


def _compared(t: str, b: str) -> str:
    return _COMPARED.format(t=t, b=b, value=rnd("value", 5), base=rnd("base", 5), pct=rnd("CASE WHEN base > 0 THEN (value - base) / base * 100 ELSE 0 END", 5), diff=rnd("CASE WHEN base > 0 THEN value - base ELSE value END", 5))


_STATEMENTS: dict[str, str] = {
    "tokenize_df_cf": "SELECT term, df, cf FROM term_stats",
    "index_stats": f"SELECT n AS n_docs, {rnd('avgdl')} AS avgdl, (SELECT count(*) FROM term_stats) AS n_terms, (SELECT count(*) FROM postings) AS n_postings, (SELECT sum(tf)::BIGINT FROM postings) AS n_tokens FROM coll",
    "index_validate": "SELECT (SELECT count(*) > 0 FROM documents) AS has_documents, (SELECT sum(tf) FROM postings) = (SELECT sum(dl) FROM doc_stats) AS counts_agree, (SELECT count(*) = 0 FROM postings WHERE term IS NULL OR term = '') AS terms_valid",
    "subword_merge": f"""SELECT key, word_idx, word, (sum(k) OVER (PARTITION BY key ORDER BY word_idx) - k)::BIGINT AS start_pos, (sum(k) OVER (PARTITION BY key ORDER BY word_idx))::BIGINT AS end_pos FROM (
        SELECT key, i::BIGINT AS word_idx, toks[i + 1] AS word, greatest(1, ceil(length(toks[i + 1]) / 4.0))::BIGINT AS k
        FROM (SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS key, {_TOKENS} AS toks, unnest(range(len({_TOKENS}))) AS i FROM conversations))""",
    "collection_scan": "SELECT doc_id, md5(text) AS text_md5, length(text)::BIGINT AS n_chars FROM (SELECT 'd' || doc_id AS doc_id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages) WHERE text <> ''",
    "query_texts": """SELECT p_partkey AS qid, CASE WHEN p_partkey % 3 = 0 AND p_name <> '' THEN p_name
        ELSE concat_ws(' ', CASE WHEN p_partkey % 3 = 1 THEN p_brand END, CASE WHEN p_size > 25 THEN p_type END) END AS text FROM part""",
    "bm25_topk": f"SELECT qid, rank, doc_id, {rnd('score')} AS score FROM top10",
    "bm25_topk_pruned": f"SELECT qid, rank, doc_id, {rnd('score')} AS score FROM top10",
    "phrase_hits": """SELECT qid, doc_id, count(*) AS n, min(i) AS first_place FROM (SELECT doc_id, toks, unnest(range(len(toks))) AS i FROM docs_tok) d
        JOIN (SELECT qid, toks[1] AS a, toks[2] AS b FROM query_toks) q ON toks[i + 1] = a AND (b IS NULL OR toks[i + 2] = b) GROUP BY ALL""",
    "bm25_doc_term": f"SELECT qid, doc_id, term, {rnd('score')} AS score FROM ({_DOC_TERM})",
    "bm25_collection_term": f"SELECT q.term, {rnd('coalesce(score, 0)')} AS score FROM (SELECT DISTINCT term FROM query_terms) q LEFT JOIN coll_scores USING (term)",
    "token_scores": f"""SELECT d.qid, d.doc_id, p.pos::BIGINT AS pos, {rnd('s.score')} AS score FROM top_doc d
        JOIN (SELECT doc_id, unnest(range(least(len(toks), 512))) AS pos, unnest(list_slice(toks, 1, 512)) AS term FROM docs_raw) p ON d.doc_id = p.doc_id
        JOIN (SELECT DISTINCT qid, term FROM query_terms) q ON q.qid = d.qid AND q.term = p.term JOIN term_scores s ON s.term = p.term AND s.doc_id = d.doc_id WHERE s.score > 0""",
    "token_spans": f"""SELECT d.qid, d.doc_id, pos::BIGINT AS pos, {rnd('s.score')} AS score FROM top_doc d JOIN (SELECT doc_id, term, unnest(range(start, start + width)) AS pos FROM piece_words) p ON d.doc_id = p.doc_id AND pos < 512
        JOIN (SELECT DISTINCT qid, term FROM query_terms) q ON q.qid = d.qid AND q.term = p.term JOIN term_scores s ON s.term = p.term AND s.doc_id = d.doc_id WHERE s.score > 0""",
    "dense_token_scores": f"""SELECT qid, doc_id, pos::BIGINT AS pos, {rnd('coalesce(score, 0)')} AS score FROM (SELECT DISTINCT qid, doc_id FROM some_scores) CROSS JOIN (SELECT unnest(range(512)) AS pos) LEFT JOIN some_scores USING (qid, doc_id, pos)""",
    "streaming_index": f"""SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_ANALYZED}) AS term FROM (
          SELECT doc_id, CASE WHEN doc_id % 20 = 3 THEN substring(text, 1, 200) WHEN doc_id % 10 = 3 THEN text || ' updated ' || source WHEN doc_id % 20 = 7 THEN 'again ' || lang WHEN doc_id % 10 = 7 THEN NULL ELSE text END AS text FROM documents)
        WHERE text IS NOT NULL) GROUP BY ALL) GROUP BY term""",
    "bm25_param_sweep": f"""SELECT k1, b, qid, rank, doc_id, {rnd('score')} AS score FROM (SELECT *, {best('k1, b, qid')} AS rank FROM (
        SELECT k1, b, qid, doc_id, sum({_BM25.format(k1='k1', b='b')}) AS score FROM query_terms JOIN wide USING (term)
        CROSS JOIN ({' UNION ALL '.join(_sweep(k, b) for k in (0.9, 1.2, 1.6, 2.0) for b in (0.4, 0.75, 1.0))}) GROUP BY ALL)) WHERE rank <= 5""",
    "rm1_terms": _terms("SELECT * FROM rm"),
    "rm3_terms": _terms("SELECT * FROM rm3"),
    "rm3_no_query_terms": _terms("SELECT rm.* FROM rm ANTI JOIN query_terms q ON rm.qid = q.qid AND rm.term = q.term"),
    "rm3_filtered": _terms(f"SELECT * FROM rm3 WHERE length(term) BETWEEN 3 AND 12 AND term NOT IN ({', '.join(repr(s) for s in STOPWORDS)})"),
    "expansion_stats": f"SELECT qid, {_describe('weight')} FROM expansion GROUP BY qid",
    "expansion_explain": "SELECT q.qid, array_to_string(q.toks, ' ') AS terms, count(*) AS n_feedback, string_agg(format('{:.4f}', round(score, 4)), ' ' ORDER BY rank) AS scores, bool_or(score < 0) AS log_scores FROM query_toks q JOIN top10 t ON q.qid = t.qid GROUP BY q.qid, q.toks",
    "simple_expansion": "SELECT qid, pos + 1 AS rank, term, 1.0::DOUBLE AS weight FROM query_tokens WHERE pos < 5",
    "expansion_df_filter": f"SELECT qid, rank, term, {rnd('weight')} AS weight, df FROM expansion JOIN (SELECT term, count(*) AS df FROM postings JOIN own_terms USING (term) GROUP BY term) USING (term) WHERE df >= 5",
    "expansion_merge": _terms(
        "SELECT qid, term, sum(weight) AS weight FROM ("
        + " UNION ALL ".join(
            f"SELECT qid, term, weight FROM (SELECT *, {best('qid', 'weight', 'term')} AS i FROM (SELECT qid, term, sum(dw * tf / n) AS weight FROM (SELECT *, score / sum(score) OVER (PARTITION BY qid) AS dw FROM top10 WHERE {c}) JOIN shares USING (doc_id) GROUP BY ALL)) WHERE i <= 20"
            for c in ("rank <= 5", "rank > 5")
        )
        + ") GROUP BY ALL"
    ),
    "feedback_truncation": f"SELECT qid, rank, doc_id, {rnd('score')} AS score, substr(text, 1, 500) AS text FROM top10 JOIN docs_tok USING (doc_id) WHERE rank <= 3",
    "log_score_weights": f"SELECT qid, doc_id, {rnd('CASE WHEN min(s) OVER w < 0 THEN exp(s) / sum(exp(s)) OVER w ELSE s / sum(s) OVER w END')} AS doc_weight FROM (SELECT *, ln(score / 100.0::DOUBLE) AS s FROM top10) WINDOW w AS (PARTITION BY qid)",
    "cosine_pairs": _pairs("greatest(0, list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))))"),
    "dot_pairs": _pairs("list_inner_product(a, b)"),
    "euclidean_pairs": _pairs("list_distance(a, b)"),
    "semantic_term_scores": f"SELECT qid, term, {rnd('similarity')} AS similarity FROM semantic",
    "similarity_matrix": f"SELECT q.qid, t.term, {rnd('greatest(0, list_inner_product(q.vec, t.vec) / (sqrt(list_inner_product(q.vec, q.vec)) * sqrt(list_inner_product(t.vec, t.vec))))')} AS similarity FROM query_vecs q CROSS JOIN (SELECT DISTINCT term, vec FROM query_term_vecs WHERE term IN (SELECT term FROM query_tokens WHERE pos = 0)) t",
    "similarity_distribution": f"SELECT qid, {rnd('avg(semantic_score)')} AS mean, {rnd('stddev_pop(semantic_score)')} AS stdev, {rnd('min(semantic_score)')} AS min, {rnd('max(semantic_score)')} AS max, coalesce(string_agg(term, ' ' ORDER BY term) FILTER (semantic_score > 0.3), '') AS high_terms FROM features GROUP BY qid",
    "similarity_quality": f"SELECT {rnd('corr(semantic_score, rm_weight)')} AS pearson, {rnd('avg(semantic_score)')} AS mean_value, {rnd('stddev_pop(semantic_score)')} AS stdev_value, {rnd('avg(rm_weight)')} AS mean_truth, {rnd('stddev_pop(rm_weight)')} AS stdev_truth FROM features",
    "importance_uniform": "SELECT qid, rank, term, 1.0::DOUBLE AS importance FROM expansion",
    "importance_rm_only": f"SELECT qid, rank, term, {rnd('weight')} AS importance FROM expansion",
    "importance_weighted": f"SELECT qid, rank, term, {rnd('importance')} AS importance FROM imp",
    "importance_explain": f"SELECT qid, rank, term, {_columns('rm_weight', 'bm25_score', 'semantic_score')}, {rnd(f'rm_weight * {A}')} AS rm_part, {rnd(f'bm25_score * {B}')} AS bm25_part, {rnd(f'semantic_score * {G}')} AS semantic_part, {rnd('importance')} AS importance FROM imp",
    "importance_explain_document": f"""SELECT qid, rank, term, {_columns('rm_weight', 'bm25_score', 'semantic_score')}, {rnd(f'rm_weight * {A}')} AS rm_part, {rnd(f'bm25_score * {B}')} AS bm25_part, {rnd(f'semantic_score * {G}')} AS semantic_part,
        {rnd(f'rm_weight * {A}::DOUBLE + bm25_score * {B}::DOUBLE + semantic_score * {G}::DOUBLE')} AS importance FROM (
        SELECT e.qid, e.rank, e.term, e.weight AS rm_weight, coalesce(s.score, 0) AS bm25_score, coalesce(m.similarity, 0) AS semantic_score
        FROM expansion e JOIN top_doc d ON e.qid = d.qid LEFT JOIN own_scores s ON s.term = e.term AND s.doc_id = d.doc_id LEFT JOIN semantic m ON m.qid = e.qid AND m.term = e.term)""",
    "ablation_importance": f"SELECT model, qid, rank, term, {rnd('importance')} AS importance FROM abl",
    "term_features": f"""SELECT e.qid, d.doc_id AS reference_doc_id, e.rank, e.term, {rnd('e.weight')} AS rm_weight, {rnd('coalesce(s.score, 0)')} AS bm25_score, {rnd('coalesce(m.similarity, 0)')} AS semantic_score
        FROM expansion e JOIN top_doc d ON e.qid = d.qid LEFT JOIN own_scores s ON s.term = e.term AND s.doc_id = d.doc_id LEFT JOIN semantic m ON m.qid = e.qid AND m.term = e.term""",
    "feature_stats": f"SELECT feature, count(*) AS n, {rnd('avg(value)')} AS mean, {rnd('coalesce(stddev_samp(value), 0)')} AS stdev, {rnd('min(value)')} AS min, {rnd('max(value)')} AS max FROM (FROM features UNPIVOT (value FOR feature IN (rm_weight, bm25_score, semantic_score))) GROUP BY feature",
    "feature_dataset_stats": f"SELECT count(DISTINCT qid) AS num_queries, count(*) AS num_terms, {rnd('count(*) / count(DISTINCT qid)::DOUBLE')} AS avg_expansion_terms FROM features",
    "feature_coverage": "SELECT " + ", ".join(f"{rnd(f'avg(({f} > 0)::INT)')} AS {f}_coverage" for f in ("rm_weight", "bm25_score", "semantic_score")) + " FROM features",
    "score_variance": f"SELECT qid, {_spread('score')} FROM top10 GROUP BY qid",
    "maxsim_scores": f"SELECT qid, doc_id, term, {rnd('similarity')} AS similarity FROM sims",
    "query_vectors": f"""SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY part, place, term) AS n, part, term, {rnd('u.weight')} AS weight, len(vec)::BIGINT AS dim FROM (
        SELECT qid, 0 AS part, pos AS place, term, 1.0::DOUBLE AS weight FROM query_tokens WHERE pos < 32 UNION ALL SELECT qid, 1, rank, term, importance FROM imp WHERE importance > 0) u JOIN own_vecs USING (term)""",
    "query_vectors_explain": "SELECT q.qid, array_to_string(q.toks, ' ') AS own_terms, string_agg(i.term, ' ' ORDER BY i.rank) AS expansion_terms, len(q.toks) + count(*) AS n_vectors FROM (SELECT qid, list_slice(toks, 1, 32) AS toks FROM query_raw) q JOIN imp i ON q.qid = i.qid WHERE importance > 0 GROUP BY q.qid, q.toks",
    "rerank_topk": f"SELECT qid, rank, doc_id, {rnd('score')} AS score FROM reranked",
    "rerank_sentence": f"""SELECT qid, {best('qid')} AS rank, doc_id, {rnd('score')} AS score FROM (
        SELECT c.qid, c.doc_id, sum(w.weight * list_inner_product(a.vec, b.vec)) AS score FROM candidates c
        JOIN (SELECT qid, term, 1.0::DOUBLE AS weight FROM query_tokens WHERE pos < 32 UNION ALL SELECT qid, term, importance FROM imp WHERE importance > 0) w ON c.qid = w.qid
        JOIN own_vecs a ON w.term = a.term
        JOIN (SELECT doc_id, list(s ORDER BY d) AS vec FROM (SELECT doc_id, d, sum(x) AS s FROM (SELECT doc_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS d
              FROM (SELECT doc_id, unnest(list_slice(toks, 1, 512)) AS term FROM docs_raw WHERE doc_id IN (SELECT doc_id FROM candidates)) JOIN doc_vecs USING (term)) GROUP BY ALL) GROUP BY doc_id) b ON b.doc_id = c.doc_id
        GROUP BY ALL)""",
    "p_at_k": _per_query("P_1", "P_5", "P_10", "P_100"),
    "recall_at_k": _per_query("recall_5", "recall_10", "recall_100"),
    "recip_rank": _per_query("recip_rank"),
    "average_precision": _per_query("map", "map_cut_5", "map_cut_10", "map_cut_100"),
    "ndcg_cut_10": _per_query("ndcg_cut_10"),
    "ndcg_cut_100": _per_query("ndcg_cut_100", "ndcg"),
    "rprec": _per_query("Rprec"),
    "success_k": _per_query("success_1", "success_5", "success_10"),
    "set_metrics": _per_query("num_ret", "num_rel", "num_rel_ret", "set_P", "set_recall", "set_F"),
    "bpref": _per_query("bpref"),
    "iprec_at_recall": _per_query(*(f"iprec_at_recall_{x:.2f}".replace(".", "_") for x in LEVELS), "11pt_avg"),
    "evaluate_all": f"""SELECT metric, {rnd('value')} AS value FROM (SELECT sum(num_ret) AS num_ret, sum(num_rel) AS num_rel, sum(num_rel_ret) AS num_rel_ret, avg(map) AS map, exp(avg(ln(greatest(map, 0.00001::DOUBLE)))) AS gm_map,
        avg(recip_rank) AS recip_rank, avg(ndcg) AS ndcg, avg("Rprec") AS "Rprec", avg(bpref) AS bpref, avg("set_P") AS "set_P", avg(set_recall) AS set_recall, avg("set_F") AS "set_F", avg("11pt_avg") AS "11pt_avg" FROM top_eval)
        UNPIVOT (value FOR metric IN (num_ret, num_rel, num_rel_ret, map, gm_map, recip_rank, ndcg, "Rprec", bpref, "set_P", set_recall, "set_F", "11pt_avg"))""",
    "line_search": f"""SELECT {rnd('t')} AS t, {rnd('coalesce(lead(t) OVER (ORDER BY t), 5.0)')} AS until, {rnd('sum(change) OVER (ORDER BY t)')} AS score FROM (
        SELECT t, sum(change) / (SELECT count(DISTINCT qid) FROM parts JOIN ideal USING (qid)) AS change FROM (
          SELECT t, worth - coalesce(lag(worth) OVER (PARTITION BY qid, good_id ORDER BY t), 0) AS change FROM (
            SELECT qid, good_id, t, CASE WHEN rank <= 10 THEN gain / log2(rank + 1.0::DOUBLE) ELSE 0 END AS worth FROM (SELECT qid, good_id, t, gain, sum(moved) OVER (PARTITION BY qid, good_id ORDER BY t) AS rank FROM line_moves)))
        WHERE change <> 0 OR t = 0.1 GROUP BY t)""",
    "rerank_for_evaluation": f"SELECT run_name, metric, {rnd('value')} AS value FROM (SELECT run_name, avg(map) AS map, avg(ndcg_cut_10) AS ndcg_cut_10, avg(ndcg_cut_100) AS ndcg_cut_100, avg(recip_rank) AS recip_rank, avg(recall_100) AS recall_100 FROM recipe_eval GROUP BY run_name) UNPIVOT (value FOR metric IN (map, ndcg_cut_10, ndcg_cut_100, recip_rank, recall_100))",
    "evaluate_runs_long": f"SELECT run_name, metric, {rnd('value')} AS value FROM runs_long",
    "compare_runs": _compared("runs_long", "bm25"),
    "results_pivot": """SELECT run_name, run_name = 'bm25' AS is_baseline, any_value(cell) FILTER (metric = 'map') AS map, any_value(cell) FILTER (metric = 'ndcg_cut_10') AS ndcg_cut_10 FROM (
        SELECT r.run_name, r.metric, CASE WHEN run_name = 'bm25' THEN format('{:.4f}', round(value, 9)) ELSE format('{:.4f}', round(value, 9)) || ' (' || CASE WHEN round(round(value, 9) - round(base, 9), 4) >= 0 THEN '+' ELSE '' END || format('{:.4f}', round(round(value, 9) - round(base, 9), 4) + 0.0) || ')' END AS cell
        FROM runs_long r JOIN (SELECT metric, value AS base FROM runs_long WHERE run_name = 'bm25') USING (metric)) GROUP BY run_name""",
    "original_vs_reranked": f"SELECT metric, {rnd('original')} AS original, {rnd('reranked')} AS reranked, {rnd('reranked - original')} AS difference FROM ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, (SELECT avg({m}) FROM first_eval) AS original, (SELECT avg({m}) FROM reranked_eval) AS reranked" for m in ("map", "ndcg_cut_10", "recip_rank"))
    + ")",
    "paired_significance": f"SELECT count(*) AS n, {rnd('avg(d)')} AS mean_difference, {rnd('CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) ELSE 0 END')} AS t, sum((d > 0)::INT)::BIGINT AS better, sum((d < 0)::INT)::BIGINT AS worse, sum((d = 0)::INT)::BIGINT AS equal FROM (SELECT round(b.ndcg_cut_10, 9) - round(a.ndcg_cut_10, 9) AS d FROM first_eval a JOIN reranked_eval b USING (qid))",
    "ablation_eval": _compared("(SELECT run_name, metric, value FROM (SELECT run_name, avg(map) AS map, avg(ndcg_cut_10) AS ndcg_cut_10 FROM abl_eval GROUP BY run_name) UNPIVOT (value FOR metric IN (map, ndcg_cut_10)))", "first_stage"),
    "ablation_from_feedback": _compared("(SELECT run_name, metric, value FROM (SELECT run_name, avg(map) AS map, avg(ndcg_cut_10) AS ndcg_cut_10 FROM abl_eval GROUP BY run_name) UNPIVOT (value FOR metric IN (map, ndcg_cut_10)))", "first_stage"),
    "simple_ablation_eval": _compared("(SELECT run_name, metric, value FROM (SELECT run_name, avg(map) AS map, avg(ndcg_cut_10) AS ndcg_cut_10 FROM simple_eval GROUP BY run_name) UNPIVOT (value FOR metric IN (map, ndcg_cut_10)))", "first_stage"),
    "custom_feature_importance": f"SELECT qid, rank, i.term, {rnd('coalesce(ln(1.0::DOUBLE + df), 0)')} AS log_df, {rnd('importance - 0.1::DOUBLE * coalesce(ln(1.0::DOUBLE + df), 0)')} AS importance FROM imp i LEFT JOIN (SELECT term, count(*) AS df FROM postings JOIN own_terms USING (term) GROUP BY term) t ON i.term = t.term",
    "optimizer_comparison": f"""SELECT method, weights_id, {rnd('tr')} AS train_score, {rnd('te')} AS test_score FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY tr DESC, weights_id) AS i FROM (
        SELECT method, weights_id, {rnd("avg(CASE WHEN NOT test THEN ndcg_cut_10 END)", 9)} AS tr, {rnd("avg(CASE WHEN test THEN ndcg_cut_10 END)", 9)} AS te FROM (
          SELECT method, weights_id, ndcg_cut_10, ('0x' || substr(md5(qid::VARCHAR), 1, 8))::BIGINT % 1000 < 500 AS test FROM (
            SELECT 'grid' AS method, weights_id, qid, ndcg_cut_10 FROM grid_eval UNION ALL SELECT 'random', {len(_GRID)} + weights_id, qid, ndcg_cut_10 FROM samples_eval)) GROUP BY ALL)) WHERE i = 1""",
    "grid_search_scores": f"SELECT weights_id, {_columns('alpha', 'beta', 'gamma', 'score')} FROM grid_scores",
    "grid_search_best": f"SELECT weights_id, {_columns('alpha', 'beta', 'gamma', 'score')} FROM (SELECT * FROM grid_scores ORDER BY score DESC, weights_id LIMIT 1)",
    "random_search": f"SELECT weights_id, {_columns('alpha', 'beta', 'gamma', 'score')} FROM (SELECT weights_id, any_value(alpha) AS alpha, any_value(beta) AS beta, any_value(gamma) AS gamma, {rnd('avg(ndcg_cut_10)', 9)} AS score FROM samples_eval JOIN samples USING (weights_id) GROUP BY weights_id ORDER BY score DESC, weights_id LIMIT 1)",
    "weight_sensitivity": f"SELECT count(*) AS n, {_spread('score')} FROM (SELECT {rnd('avg(ndcg_cut_10)', 9)} AS score FROM sens_eval GROUP BY weights_id)",
    "boundary_check": f"SELECT weights_id, weight, {rnd('value')} AS value, (value - 0.1::DOUBLE < 0.01 OR 3.0::DOUBLE - value < 0.01) AS at_bound FROM (SELECT weights_id, alpha, beta, gamma FROM grid_scores ORDER BY grid_scores.score DESC, weights_id LIMIT 1) UNPIVOT (value FOR weight IN (alpha, beta, gamma))",
    "cv_folds": "SELECT * FROM folds",
    "cv_best_weights": f"SELECT fold, weights_id, {rnd('score')} AS score FROM fold_best",
    "cv_aggregated_run": f"""SELECT qid, {best('qid')} AS rank, doc_id, {rnd('score')} AS score FROM (
        SELECT qid, doc_id, base + alpha * pr + beta * pb + gamma * ps AS score FROM parts JOIN folds USING (qid) JOIN fold_best USING (fold) JOIN grid USING (weights_id) WHERE split = 'testing')""",
    "holdout_split": "SELECT item_id AS qid, CASE WHEN ('0x' || substr(md5(item_id::VARCHAR), 1, 8))::BIGINT % 1000 < 200 THEN 'test' ELSE 'train' END AS split FROM benchmark",
    "train_alignment": """SELECT qid, missing = '' AS complete, missing FROM (SELECT k.qid, concat_ws(',', CASE WHEN k.qid NOT IN (SELECT qid FROM features) THEN 'features' END, CASE WHEN k.qid NOT IN (SELECT qid FROM qrels) THEN 'qrels' END,
        CASE WHEN k.qid NOT IN (SELECT qid FROM query_toks) THEN 'queries' END, CASE WHEN k.qid NOT IN (SELECT qid FROM top10) THEN 'runs' END) AS missing FROM query_toks k)""",
    "cross_dataset_eval": f"SELECT dataset, metric, {rnd('value')} AS value FROM (SELECT CASE WHEN qid % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, avg(map) AS map, avg(ndcg_cut_10) AS ndcg_cut_10 FROM top_eval GROUP BY ALL) UNPIVOT (value FOR metric IN (map, ndcg_cut_10))",
    "run_parse": "SELECT qid::VARCHAR AS qid, doc_id::VARCHAR AS doc_id, rank, round(score, 6) AS score, 'bm25' AS tag FROM top10",
    "qrels_parse": "SELECT qid::VARCHAR AS qid, doc_id::VARCHAR AS doc_id, rel FROM qrels",
    "scored_docs_scan": "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score::DOUBLE AS score FROM (SELECT quality * 2 + toxic AS qid, doc_id, (doc_id * 7919) % 1000 AS score FROM labels)",
    "id_overlap": f"""SELECT count(*) FILTER (l AND r) AS both, count(*) FILTER (l AND NOT r) AS only_labels, count(*) FILTER (r) AS n_run, {rnd('count(*) FILTER (l AND r) / greatest(count(*) FILTER (r), 1)::DOUBLE')} AS match_rate
        FROM (SELECT bool_or(src = 1) AS l, bool_or(src = 2) AS r FROM (SELECT doc_id, 1 AS src FROM labels UNION ALL SELECT doc_id, 2 FROM top100) GROUP BY doc_id)""",
    "id_shape": f"SELECT count(*) AS n, {rnd(chr(97) + 'vg(regexp_matches(id, ' + repr('[A-Za-z]') + ')::INT)')} AS with_letters, {rnd('avg(regexp_matches(id, ' + repr('^[0-9]+$') + ')::INT)')} AS all_digits FROM (SELECT unnest([doc_id::VARCHAR, source, lang]) AS id FROM documents)",
}

_STATEMENTS["rerank_info"] = f"""SELECT v.*, c.*, 64::BIGINT AS max_vectors, 512::BIGINT AS max_tokens
    FROM (SELECT count(*) AS n_queries, sum(own_n)::BIGINT AS n_vectors, max(own_n) AS most_vectors FROM (SELECT qid, count(*) AS own_n FROM ({_STATEMENTS['query_vectors']}) GROUP BY qid)) v,
    (SELECT count(*) AS n_candidates, count(DISTINCT doc_id) AS n_documents FROM candidates) c"""

ORACLE_SQL: dict[str, str] = {name: sql(statement) for name, statement in _STATEMENTS.items()}

ORACLE_SQL["subword_ids"] = f"""WITH RECURSIVE known AS (SELECT DISTINCT unnest({_TOKENS}) AS t FROM benchmark),
    vocabulary AS (SELECT DISTINCT piece, ('0x' || substr(md5(piece), 1, 8))::BIGINT AS id FROM (SELECT CASE WHEN i > 0 THEN '##' ELSE '' END || substr(t, (i * wide + 1)::BIGINT, wide) AS piece
        FROM (SELECT t, wide, unnest(range(greatest(1, ceil(length(t) / wide::DOUBLE))::BIGINT)) AS i FROM known CROSS JOIN (VALUES (2), (4)) w(wide)))),
    spoken AS (SELECT key, unnest(range(len(toks))) AS pos, unnest(toks) AS term FROM (SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS key, {_TOKENS} AS toks FROM conversations)),
    words AS (SELECT DISTINCT term FROM spoken WHERE length(term) <= 100),
    cuts AS (SELECT term, start, unnest(range(1, least(4, length(term) - start + 1) + 1)) AS size FROM (SELECT term, unnest(range(1, length(term) + 1)) AS start FROM words)),
    longest AS (SELECT term, start, max(size) AS size, arg_max(piece, size) AS piece, arg_max(id, size) AS id
        FROM cuts JOIN vocabulary ON piece = CASE WHEN start > 1 THEN '##' ELSE '' END || substr(term, start, size) GROUP BY term, start),
    walk AS (SELECT term, 1::BIGINT AS next, []::VARCHAR[] AS pieces, []::BIGINT[] AS ids FROM words
        UNION ALL SELECT w.term, w.next + l.size, list_append(w.pieces, l.piece), list_append(w.ids, l.id) FROM walk w JOIN longest l ON l.term = w.term AND l.start = w.next)
    SELECT key, pos::BIGINT AS pos, term, piece_no::BIGINT AS piece_no, piece, id FROM spoken
    JOIN (SELECT term, unnest(range(len(pieces))) AS piece_no, unnest(pieces) AS piece, unnest(ids) AS id FROM walk WHERE next = length(term) + 1) USING (term)"""
