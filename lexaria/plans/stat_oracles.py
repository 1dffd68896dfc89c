"""SQL of the statistics queries."""

from __future__ import annotations

from lexaria.operators.filters import FOREIGN
from lexaria.plans import evaluation_queries as eq
from lexaria.plans import text_queries as tq
from lexaria.plans.mechanism_queries import _ROUNDS
from lexaria.plans.stat_queries import DRAWS

_C = f"{eq._C}, v AS (SELECT *, passage % 4 AS domain FROM c)"
_L = eq._L
_TIMES = "(h >= 1580030169)::INT + (h >= 3160060337)::INT + (h >= 3950075421)::INT + (h >= 4213413783)::INT"


def _hash(key: str) -> str:
    return f"('0x' || substr(md5({key} || ':' || draw), 1, 8))::BIGINT"


def _interval(rows: str, by: str, key: str, stratum: str, value: str) -> str:
    """Common tables w (by, n, mean) and i (by, low, high) of a stratified bootstrap over rows."""
    cols = f"{by}, " if by else ""
    return f"""k0 AS (SELECT {cols}{stratum}, {value} AS val, draw, {_hash(key)} AS h FROM {rows}, range({DRAWS}) t(draw) WHERE {value} IS NOT NULL),
        k1 AS (SELECT {cols}draw, {stratum}, sum({_TIMES}) AS k, sum(({_TIMES}) * val) AS s, count(*) AS size FROM k0 GROUP BY ALL),
        k2 AS (SELECT {cols}draw, sum(s / k * size) / sum(size) AS m FROM k1 WHERE k > 0 GROUP BY ALL),
        i AS (SELECT {cols}round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM k2 GROUP BY ALL),
        w AS (SELECT {cols}count(*) AS n, round(avg({value}), 6) AS mean FROM {rows} WHERE {value} IS NOT NULL GROUP BY ALL)"""


_DELTA = "d AS (SELECT v.system, v.passage, v.domain, v.value - b.value AS delta FROM v JOIN v b ON b.passage = v.passage AND b.system = 'view' WHERE v.system <> 'view')"
_PAIRED = f"{_C}, {_DELTA}, {_interval('d', 'system', 'passage', 'domain', 'delta')}, z AS (SELECT system, count_if(abs(delta) > 1e-12)::BIGINT AS n_nonzero FROM d WHERE delta IS NOT NULL GROUP BY 1), pd AS (SELECT w.*, low, high, n_nonzero FROM w JOIN i USING (system) JOIN z USING (system))"
_GATES = """s AS (SELECT system, count(*) AS n, avg(value / 100 + 0.46) AS nli, count_if(coalesce(value, 0) < 2) AS below, count_if(value IS NULL) AS failed,
    avg(CASE WHEN n > 1 THEN 1.0::DOUBLE ELSE 0 END) AS ent FROM v GROUP BY 1),
    g AS (SELECT system, nli >= 0.95 AS nli_mean, below <= n * 0.05 AS nli_floor, failed = 0 AS facts, ent >= (SELECT ent FROM s
        WHERE system = 'view') - 1e-12 AS entities FROM s)"""
_CASES = """m AS (SELECT e.system, e.passage, count(*) AS k, round(max(e.value) - min(e.value), 6) AS drift FROM e GROUP BY 1, 2),
    p AS (SELECT s.system, q.passage FROM (SELECT DISTINCT system FROM e) s, (SELECT DISTINCT passage FROM e WHERE passage % 7 <> 0) q),
    r AS (SELECT coalesce(m.system, p.system) AS system, count_if(m.k IS NULL)::BIGINT AS missing, count_if(m.k > 1)::BIGINT AS repeated,
        count_if(p.system IS NULL)::BIGINT AS unexpected, count_if(m.drift > 50)::BIGINT AS drifted FROM m FULL JOIN p ON m.system = p.system
        AND m.passage = p.passage GROUP BY 1)"""
_FOREIGN = "(" + ", ".join(f"'{w}'" for w in FOREIGN) + ")"
_RATED = "floor(l_quantity / 10.0::DOUBLE) + 1"


def _confusion(window: str, score: str) -> str:
    return f"SELECT {window} AS window_, threshold, count_if({score} >= threshold AND quality = 1)::BIGINT AS tp, count_if({score} >= threshold AND quality = 0)::BIGINT AS fp, count_if({score} < threshold AND quality = 1)::BIGINT AS fn, count_if({score} < threshold AND quality = 0)::BIGINT AS tn FROM y, t GROUP BY ALL"


ORACLES = {
    "bootstrap_interval": f"WITH {_C}, {_interval('v', 'system', 'passage', 'domain', 'value')} SELECT system, n, mean, low, high FROM w JOIN i USING (system)",
    "paired_delta_interval": f"WITH {_PAIRED} SELECT system, n, mean, low, high, n_nonzero FROM pd",
    "cluster_rate_interval": f"""WITH {_L}, y AS (SELECT x.*, d.source FROM x JOIN documents d USING (doc_id)), s AS (SELECT source, count_if(score < 0.9
        AND quality = 1) AS k, count_if(quality = 1) AS n FROM y GROUP BY 1),
        h AS (SELECT draw, k, n, {_hash("source")} AS h FROM s, range({DRAWS}) t(draw)), d AS (SELECT draw,
            sum(({_TIMES}) * k)::DOUBLE / sum(({_TIMES}) * n) AS rate FROM h GROUP BY 1 HAVING sum(({_TIMES}) * n) > 0)
        SELECT (SELECT sum(k)::BIGINT FROM s) AS k, (SELECT sum(n)::BIGINT FROM s) AS n, (SELECT round(sum(k)::DOUBLE / sum(n), 6) FROM s) AS rate,
            round(quantile_cont(rate, 0.025), 4) AS low, round(quantile_cont(rate, 0.975), 4) AS high FROM d""",
    "threshold_rates": f"""WITH {_L}, t AS (SELECT unnest([0.5, 0.7, 0.8, 0.9, 0.95, 0.97]::DOUBLE[]) AS threshold), c AS (SELECT lang, threshold,
        count_if(score < threshold)::BIGINT AS k, count(*) AS n FROM x, t WHERE score IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, k::DOUBLE / n AS p,
        3.8416::DOUBLE AS z FROM c)
        SELECT lang, threshold, k, n, round(p, 6) AS rate,
            round(greatest((p + z / 2 / n) / (1 + z / n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + z / 4 / (n * n)) / (1 + z / n), 0), 6) AS low,
            round(least((p + z / 2 / n) / (1 + z / n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + z / 4 / (n * n)) / (1 + z / n), 1), 6) AS high FROM p""",
    "system_gates": f"WITH {_C}, {_GATES} SELECT * FROM g",
    "adoption_rule": f"""WITH {_PAIRED}, {_GATES}, j AS (SELECT pd.system, nli_mean AND nli_floor AND facts AND entities AS gates,
        n_nonzero <= n * 0.1 AS over_edit, mean <= -0.1 AS beyond_tie, high < 0 AS below_zero, mean / 100 >= -0.01 AS nli_kept FROM pd JOIN g USING (system))
        SELECT *, gates AND over_edit AND beyond_tie AND below_zero AND nli_kept AS adopt, CASE WHEN below_zero AND gates AND over_edit THEN 'confirmed'
            ELSE 'not confirmed' END AS verdict FROM j""",
    "regate": f"""WITH {_C}, r(rule, t) AS (VALUES ('none', -1.0), ('low', 25.0), ('middle', 50.0), ('high', 75.0)), x AS (SELECT v.system, rule,
        v.value >= t AS keep, CASE WHEN v.value >= t THEN v.value ELSE b.value END AS used FROM v JOIN v b ON b.passage = v.passage AND b.system = 'view'
        AND v.system <> 'view', r)
        SELECT system, rule, count_if(keep)::BIGINT AS swaps, count(*) AS n, round(avg(used), 6) AS mean, round(avg(used), 6) >= 50 AS passes FROM x
            GROUP BY 1, 2""",
    "amplification": f"""WITH {_C}, d AS (SELECT v.value, v.value - b.value AS d FROM v JOIN v b ON b.passage = v.passage AND b.system = 'view'
        AND v.system <> 'view')
        SELECT CASE WHEN value / 100 >= 0.95 THEN '≥0.95' WHEN value / 100 >= 0.9 THEN '0.90–0.95' WHEN value / 100 >= 0.8 THEN '0.80–0.90'
            ELSE '<0.80' END AS band, count(*) AS n, round(avg(d), 6) AS mean_delta, round(avg(CASE WHEN d < -5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS dropped
            FROM d GROUP BY 1""",
    "status_deltas": f"""WITH {_C}, s AS (SELECT domain, system, avg(value) AS value, avg(n) AS n FROM v GROUP BY 1, 2), j AS (SELECT a.domain,
        a.value - b.value AS v, b.n - a.n AS n FROM s a JOIN s b ON a.domain = b.domain AND a.system = 'purchase' AND b.system = 'click'),
        l AS (SELECT domain, 'value' AS metric, round(v, 6) AS delta FROM j UNION ALL SELECT domain, 'n', round(n, 6) FROM j) SELECT *, delta > 0 AS ahead
            FROM l""",
    "twin_join": f"""WITH d AS (SELECT config FROM ({eq.ORACLES["design_factorial"]})), k AS (SELECT config, regexp_replace(config, 'b=[a-z]+',
        'b=off') AS twin FROM d)
        SELECT CASE WHEN config = twin THEN 'is a twin' WHEN twin NOT IN (SELECT config FROM d) THEN 'no twin' ELSE 'paired' END AS reason, count(*) AS n,
            min(config) AS first FROM k GROUP BY 1""",
    "cube_report": f"""WITH {_C}, k AS (SELECT *, CASE WHEN passage % 2 = 0 THEN 'standard' ELSE 'control' END AS kind FROM v)
        SELECT system, domain, kind, grouping(system, domain, kind)::BIGINT AS level, count(*) AS n, round(avg(value), 6) AS mean,
            count_if(value > 50)::BIGINT AS n_changed FROM k GROUP BY CUBE (system, domain, kind)""",
    "matrix_report": f"WITH {eq._E}, {_CASES} SELECT * FROM r",
    "matrix_assembly": f"WITH {eq._E}, {_CASES} SELECT system, CASE WHEN drifted > 0 THEN 'conflict' WHEN missing > 0 THEN 'pending' ELSE 'complete' END AS state FROM r",
    "span_prf": """WITH s AS (SELECT l_orderkey AS k, l_shipdate::DATE - DATE '1970-01-01' AS a, l_shipdate::DATE - DATE '1970-01-01' + l_quantity::INT AS b,
        l_tax, l_discount FROM lineitem),
        g AS (SELECT DISTINCT k, a, b FROM s WHERE l_tax < 0.045), p AS (SELECT DISTINCT k, a, b FROM s WHERE l_discount < 0.055),
        n AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng, (SELECT count(*) FROM g JOIN p USING (k, a, b)) AS both_,
            (SELECT count(*) FROM p WHERE EXISTS (SELECT 1 FROM g WHERE g.k = p.k AND g.a < p.b AND p.a < g.b)) AS hp, (SELECT count(*) FROM g
                WHERE EXISTS (SELECT 1 FROM p WHERE g.k = p.k AND g.a < p.b AND p.a < g.b)) AS hg),
        l AS (SELECT 'exact' AS kind, np, ng, both_::DOUBLE / np AS p, both_::DOUBLE / ng AS r FROM n UNION ALL SELECT 'overlap', np, ng, hp::DOUBLE / np,
            hg::DOUBLE / ng FROM n)
        SELECT kind, np AS n_found, ng AS n_gold, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM l""",
    "ordinal_alpha": f"""WITH {eq._R}, u AS (SELECT unit, rating, count(*)::DOUBLE AS k FROM r GROUP BY 1, 2), m AS (SELECT *,
        sum(k) OVER (PARTITION BY unit) AS m FROM u), x AS (SELECT * FROM m WHERE m > 1),
        o AS (SELECT a.rating AS c, b.rating AS d, sum(CASE WHEN a.rating = b.rating THEN a.k * (a.k - 1) ELSE a.k * b.k END / (a.m - 1)) AS o FROM x a
            JOIN x b USING (unit) GROUP BY 1, 2), n AS (SELECT c, sum(o) AS n FROM o GROUP BY 1),
        g AS (SELECT a.c, b.c AS d, a.n AS nc, b.n AS nd, pow((SELECT sum(z.n) FROM n z WHERE z.c BETWEEN least(a.c, b.c) AND greatest(a.c,
            b.c)) - (a.n + b.n) / 2, 2) AS delta FROM n a, n b WHERE a.c <> b.c),
        s AS (SELECT sum(coalesce(o, 0) * delta) AS o, sum(nc * nd * delta) AS e FROM g LEFT JOIN o USING (c, d)), t AS (SELECT sum(n) AS n FROM n)
            SELECT n::BIGINT AS n_values, round(1 - o * (n - 1) / e, 9) AS alpha FROM s, t""",
    "grid_choice": f"""WITH {_L}, y AS (SELECT x.*, n_chars FROM x JOIN documents USING (doc_id)), t AS (SELECT unnest([0.8, 0.85, 0.9,
        0.95]::DOUBLE[]) AS threshold),
        g AS ({_confusion("200", "(CASE WHEN n_chars < 200 THEN score ELSE score - 0.02::DOUBLE END)")}
            UNION ALL {_confusion("800", "(CASE WHEN n_chars < 800 THEN score ELSE score - 0.02::DOUBLE END)")} UNION ALL {_confusion("NULL::INT", "score")}),
        q AS (SELECT *, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 9) END AS p, round((tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2,
            9) AS balanced FROM g)
        SELECT window_ AS "window", threshold, tp, fp, coalesce(p >= 0.9, false) AS able, balanced FROM q ORDER BY able DESC, balanced DESC NULLS LAST,
            p DESC NULLS LAST, window_ ASC NULLS LAST, threshold DESC LIMIT 1""",
    "edit_precision": """WITH b AS (SELECT l_orderkey, round(l_discount * 10, 4) AS p, (l_returnflag = 'R')::INT AS g,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY round(l_discount * 10, 4) DESC, l_linenumber, l_returnflag = 'R' DESC) AS k FROM lineitem
        WHERE l_tax >= 0.04), t AS (SELECT unnest([0.1, 0.3, 0.5, 0.7]::DOUBLE[]) AS threshold),
        c AS (SELECT threshold, count_if(p >= threshold)::BIGINT AS edits, count_if(p >= threshold AND g = 1)::BIGINT AS correct FROM b, t WHERE k = 1
            GROUP BY 1) SELECT *, 2 * correct - edits AS net, round(CASE WHEN edits > 0 THEN correct::DOUBLE / edits ELSE 0 END, 3) AS precision FROM c""",
    "best_rule": "SELECT p_size, price, p_partkey FROM (SELECT p_size, round(p_retailprice, 2) AS price, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY round(p_retailprice, 2) DESC, p_partkey DESC) AS k FROM part) WHERE k = 1",
    "exclusive_quartiles": "WITH r AS (SELECT c_nationkey, list_sort(list(round(c_acctbal, 2))) AS v FROM customer GROUP BY 1 HAVING count(*) > 1), p AS (SELECT *, len(v) AS n FROM r) SELECT c_nationkey, n, "
    + ", ".join(
        f"round(v[greatest(1, least(n - 1, floor((n + 1) * {i} / 4.0)))::INT] + (v[greatest(1, least(n - 1, floor((n + 1) * {i} / 4.0)))::INT + 1] - v[greatest(1, least(n - 1, floor((n + 1) * {i} / 4.0)))::INT]) * ((n + 1) * {i} / 4.0 - greatest(1, least(n - 1, floor((n + 1) * {i} / 4.0)))), 4)::DOUBLE AS q{i}" for i in (1, 2, 3)
    )
    + " FROM p",
    "sense_counts": """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT label,
        i, sum(x) AS s, count(*) AS n FROM e GROUP BY 1, 2), b AS (SELECT label, max(n) AS n, round(sqrt(sum(s * s)), 3) AS norm FROM s GROUP BY 1)
        SELECT label, n, norm, round(ln((n + 0.5::DOUBLE) / (sum(n) OVER () + count(*) OVER () * 0.5::DOUBLE)), 6) AS prior FROM b""",
    "warning_deltas": f"""WITH {tq._PAIRS_SQL}, w AS (SELECT doc_id, lower(substr(unnest(source), 1, 1)) AS g, 1 AS o, 0 AS n FROM q UNION ALL SELECT doc_id,
        lower(substr(unnest(output), 1, 1)), 0, 1 FROM q), c AS (SELECT doc_id, g, sum(o) AS o, sum(n) AS n FROM w GROUP BY 1, 2)
        SELECT doc_id, sum(greatest(n - o, 0))::BIGINT AS added, sum(greatest(o - n, 0))::BIGINT AS resolved, sum(least(o, n))::BIGINT AS shared FROM c
            GROUP BY 1""",
    "relation_mass": """WITH l AS (SELECT c_mktsegment AS key, c_nationkey AS s, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY c_mktsegment) AS p
        FROM customer GROUP BY 1, 2), r AS (SELECT s_nationkey AS f, count(*)::DOUBLE / sum(count(*)) OVER () AS q FROM supplier GROUP BY 1),
        j AS (SELECT key, CASE WHEN s = f THEN 0 WHEN a.n_regionkey = b.n_regionkey THEN 1 END AS relation, p * q AS m FROM l, r
            JOIN nation b ON b.n_nationkey = f JOIN nation a ON true WHERE a.n_nationkey = s) SELECT key, relation, round(sum(m), 9) AS mass FROM j
            GROUP BY 1, 2""",
    "related_words": """WITH p AS (SELECT a.n_name AS word, b.n_name AS other, CASE WHEN a.n_regionkey = b.n_regionkey THEN 0 ELSE 1 END AS r,
        a.n_regionkey AS s FROM nation a JOIN nation b ON a.n_name <> b.n_name AND (a.n_regionkey = b.n_regionkey OR (a.n_regionkey + 1) % 5 = b.n_regionkey))
        SELECT word, other, min(r)::INT AS relation, count(DISTINCT s)::INT AS n_senses FROM p GROUP BY 1, 2""",
    "edge_classes": """SELECT CASE WHEN a.n_regionkey = b.n_regionkey THEN 'same' WHEN (a.n_regionkey + 1) % 5 = b.n_regionkey THEN 'narrower' WHEN (b.n_regionkey + 1) % 5 = a.n_regionkey THEN 'broader' ELSE 'unlinked' END AS relation, count(*) AS n FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 GROUP BY 1""",
    "closure": "WITH RECURSIVE r AS (SELECT n_nationkey AS a, n_nationkey // 2 AS b, 1 AS s FROM nation WHERE n_nationkey > 0 UNION SELECT a, b // 2, s + 1 FROM r WHERE b > 0 AND s < 8) SELECT a, count(DISTINCT b) AS n, max(s)::INT AS steps FROM r GROUP BY 1",
    "top_candidate": "SELECT l_orderkey, price, l_linenumber FROM (SELECT l_orderkey, round(l_extendedprice, 2) AS price, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(l_extendedprice, 2) DESC, l_linenumber) AS k FROM lineitem WHERE l_tax >= 0.04) WHERE k = 1",
    "first_proposer": "SELECT p_partkey, CASE WHEN p_size > 40 THEN 0 WHEN p_retailprice > 1200 THEN 1 ELSE 2 END AS proposer FROM part WHERE p_size > 40 OR p_retailprice > 1200 OR length(p_name) > 30",
    "distinct_shortlist": "WITH k AS (SELECT p_brand, lower(string_split(p_type, ' ')[1]) AS kind, round(max(p_retailprice), 2) AS price FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY price DESC, kind) AS place FROM k) SELECT * FROM r WHERE place <= 3",
    "stride_scan": "SELECT doc_id, lang FROM documents WHERE doc_id % 10 = 3 ORDER BY doc_id LIMIT 50",
    "key_exclusion_sample": rf"""WITH RECURSIVE o AS (SELECT doc_id AS id, sha256('3:' || doc_id) AS h,
        sha256(array_to_string(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), ' ')) AS c, source AS d FROM documents), {_ROUNDS}
        SELECT id AS doc_id, d AS source FROM r WHERE state = 'taken' ORDER BY h LIMIT 40""",
    "length_batches": "SELECT source, batch, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM (SELECT source, n_chars, (row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1) // 32 AS batch FROM documents) GROUP BY 1, 2",
    "either_key_exclusion": r"""WITH t AS (SELECT conv_id, turn, role, lower(regexp_replace(trim(text, ' '), '\s+', ' ', 'g')) AS a FROM conversations),
        l AS (SELECT *, lead(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t), x AS (SELECT DISTINCT a FROM t WHERE role = 'system')
        SELECT conv_id, turn FROM l WHERE role <> 'system' AND NOT EXISTS (SELECT 1 FROM x WHERE x.a = l.a) AND NOT EXISTS (SELECT 1 FROM x
            WHERE x.a = l.b)""",
    "point_in_interval": """WITH s AS (SELECT l_orderkey, l_linenumber AS k, l_shipdate::DATE - DATE '1970-01-01' AS a,
        l_shipdate::DATE - DATE '1970-01-01' + l_quantity::INT AS b FROM lineitem)
        SELECT p.l_orderkey, any_value(p.b)::INT AS x, min(i.k) AS line FROM (SELECT l_orderkey, min(b) AS b FROM s WHERE k = 1 GROUP BY 1) p LEFT
            JOIN s i ON i.l_orderkey = p.l_orderkey AND i.k > 1 AND i.a <= p.b AND p.b < i.b GROUP BY 1""",
    "asof_fallback": """WITH v AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view') SELECT p.event_id, coalesce((SELECT max(us) FROM v WHERE v.user_id = p.user_id AND us <= epoch_us(p.ts)), (SELECT min(us) FROM v WHERE v.user_id = p.user_id AND us >= epoch_us(p.ts))) AS view_us FROM events p WHERE event_type = 'purchase'""",
    "verdict_reuse": "SELECT CASE WHEN EXISTS (SELECT 1 FROM orders f WHERE f.o_orderstatus = 'F' AND f.o_custkey = o.o_custkey AND f.o_orderpriority = o.o_orderpriority) THEN 'yes' ELSE '' END AS verdict, count(*) AS n FROM orders o WHERE o_orderstatus = 'O' GROUP BY 1",
    "rating_key": "SELECT c_mktsegment, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS condition, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "correlations": f"""WITH r AS (SELECT {_RATED} AS y, l_returnflag AS subset, round(l_discount * 100, 0) AS discount, round(l_tax * 100, 0) AS tax,
        ((l_shipdate::DATE - DATE '1992-01-01') % 50)::DOUBLE AS day FROM lineitem),
        l AS (SELECT subset, 'discount' AS metric, discount AS x, y FROM r UNION ALL SELECT subset, 'tax', tax, y FROM r UNION ALL SELECT subset, 'day', day,
            y FROM r),
        k AS (SELECT *, rank() OVER (PARTITION BY subset, metric ORDER BY x) + (count(*) OVER (PARTITION BY subset, metric, x) - 1) / 2.0::DOUBLE AS rx,
            rank() OVER (PARTITION BY subset, metric ORDER BY y) + (count(*) OVER (PARTITION BY subset, metric, y) - 1) / 2.0::DOUBLE AS ry FROM l)
        SELECT subset, metric, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM k GROUP BY 1, 2""",
    "votes_first_seen": f"""WITH {eq._R}, c AS (SELECT unit, rating, count(*) AS n, min(rater) AS first FROM r GROUP BY 1, 2), b AS (SELECT *,
        row_number() OVER (PARTITION BY unit ORDER BY n DESC, first, rating DESC) AS k FROM c)
        SELECT rating, count(*) AS n_units, sum(n)::BIGINT AS n_votes FROM b WHERE k = 1 GROUP BY 1""",
    "funnel": f"""WITH {tq._PAIRS_SQL}, c AS (SELECT doc_id, len(source) AS n, len(list_filter(range(1, len(source) + 1),
        lambda i: source[i] <> output[i])) AS changed FROM q), f AS (SELECT lang, changed, changed > n * 0.2 AS a, n < 20 AS b FROM c
        JOIN documents USING (doc_id))
        SELECT lang, CASE WHEN changed = 0 THEN 'copy' WHEN a AND b THEN 'blocked by several' WHEN a THEN 'blocked by over-edit' WHEN b
            THEN 'blocked by short' ELSE 'changed' END AS state, count(*) AS n FROM f GROUP BY 1, 2""",
    "document_sections": f"""WITH j AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE role = 'assistant'
        AND text IS NOT NULL GROUP BY 1), c AS (SELECT conv_id, {tq._counts_sql("text")} FROM j)
        SELECT conv_id, n_words, n_sentences, round(CASE WHEN n_words > 0
            THEN 0.39::DOUBLE * n_words / n_sentences + 11.8::DOUBLE * n_syllables / n_words - 15.59::DOUBLE END, 6) AS grade FROM c""",
    "locked_rows_three": """WITH d AS (SELECT CASE WHEN doc_id >= 500 THEN 'ose-' || (doc_id - 500) ELSE doc_id::VARCHAR END AS id, text FROM documents),
        l AS (SELECT doc_id::VARCHAR AS id FROM labels WHERE toxic = 1), h AS (SELECT sha256(text) AS h FROM d WHERE id IN (SELECT id FROM l))
        SELECT id FROM d WHERE id IN (SELECT id FROM l) OR sha256(text) IN (SELECT h FROM h) OR (id LIKE 'ose-%' AND substr(id, 5) IN (SELECT id FROM l))""",
    "column_edges": """WITH w AS (SELECT p_partkey, lower(string_split(p_name, ' ')[1]) AS a, lower(coalesce(string_split(p_name, ' ')[2], '')) AS b
        FROM part), n AS (SELECT *, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[1:i] = b[1:i])) AS n,
            replace(replace(replace(replace(replace(a, 'isa', 'iza'), 'ise', 'ize'), 'yse', 'yze'), 'our', 'or'), 'tre', 'ter') AS x,
                replace(replace(replace(replace(replace(b, 'isa', 'iza'), 'ise', 'ize'), 'yse', 'yze'), 'our', 'or'), 'tre', 'ter') AS y FROM w)
        SELECT p_partkey, round(n::DOUBLE / greatest(length(a), 1), 6) AS share, a <> b AND b <> '' AND x = y AS variant FROM n""",
    "phrase_rules": f"""WITH p AS (SELECT lower(p_name) AS a, lower(p_type) AS b, (p_size - 10) / 10.0::DOUBLE AS c, round(p_retailprice / 300, 2) AS q FROM part WHERE (p_partkey % 2 = 0 OR p_size > 5) AND p_size % 7 <> 0),
        r AS (SELECT string_split(CASE WHEN c < 0 THEN b ELSE a END, ' ') AS x, string_split(CASE WHEN c < 0 THEN a ELSE b END, ' ') AS y, abs(c) AS c, q FROM p),
        k AS (SELECT *, {" AND ".join(f"len(list_filter({v}, lambda w: NOT regexp_full_match(replace(replace(w, '-', ''), chr(39), ''), '[A-Za-z]+') OR w IN {_FOREIGN})) = 0" for v in "xy")} AS clean,
            {" = ".join(f"list_sort(list_distinct(list_filter({v}, lambda w: w NOT IN ('the', 'a', 'an'))))" for v in "xy")} AS same,
            list_filter(y, lambda w: NOT list_contains(x, w)) AS new, list_filter(x, lambda w: NOT list_contains(y, w)) AS gone FROM r)
        SELECT CASE WHEN len(x) NOT BETWEEN 2 AND 6 THEN 'length' WHEN len(y) > len(x) THEN 'longer' WHEN c < 1 THEN 'complexity' WHEN q < 4 THEN 'quality' WHEN NOT clean THEN 'unclean' WHEN same THEN 'article'
            WHEN len(list_intersect(new, ['is', 'are', 'was', 'were', 'be', 'been', 'being', 'am', '''s', '''re', '''m'])) > 0 THEN 'adds be' WHEN x[1] = y[1] OR x[-1] = y[-1] THEN 'padded'
            WHEN len(list_distinct(new)) <= 1 AND len(list_distinct(gone)) <= 1 THEN 'one word' ELSE 'kept' END AS reason, count(*) AS n, round(sum(c), 4) AS complexity FROM k GROUP BY 1""",
    "lexicon_scan": """WITH c AS (SELECT c_custkey AS line, lower(c_mktsegment || c_nationkey) AS word, round(c_acctbal / 100, 2) AS v FROM customer
        WHERE c_custkey > 1 AND c_custkey % 5 <> 0)
        SELECT word, round(arg_max(v, line) / 25.0::DOUBLE + 1, 6) AS value FROM c GROUP BY 1""",
    "ranked_substitutes": """WITH l AS (SELECT l_orderkey AS line, l_returnflag AS w, o_orderstatus AS t FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey), c AS (SELECT line, w, count(*) AS n FROM l WHERE w <> t GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY n DESC, w) AS k FROM c) SELECT a.line::BIGINT AS line, (SELECT count(*) FROM c
            WHERE c.line = a.line)::INT AS n, r.w AS first, r.n::INT AS votes FROM (SELECT DISTINCT line FROM l) a LEFT JOIN r ON r.line = a.line
            AND k = 1""",
    "source_scan": "SELECT p_partkey::VARCHAR AS id, length(p_name)::INT AS size, string_split(p_name, ' ')[1] AS target, (p_size > 25)::INT AS binary, round(p_size / 50.0::DOUBLE, 2) AS probability FROM part WHERE p_size % 4 <> 0",
    "line_zip": "SELECT n_nationkey::BIGINT AS line, n_name AS original, lower(n_name) || CASE WHEN n_nationkey < 20 THEN '|x ' || n_name ELSE '' END AS refs FROM nation",
    "expected_phrases": """WITH r AS (SELECT n_regionkey, list_sort(list(n_name)) AS x FROM nation GROUP BY 1) SELECT n_regionkey, 'first' AS phrase, lower(array_to_string(x, '|')) AS words FROM r UNION ALL SELECT n_regionkey, 'count', len(x)::VARCHAR FROM r""",
    "block_file": "SELECT n_regionkey, substr(n_name, 1, 1) AS key, min(n_name) AS value FROM nation GROUP BY 1, 2",
    "sentence_splits_scan": "SELECT p_partkey::BIGINT AS line, p_name AS source, p_type AS first, 'end' AS second FROM part WHERE p_partkey % 2 = 0 AND p_size % 3 = 0",
}
