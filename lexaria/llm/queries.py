"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaria.llm import chat_format, decontamination, delta_lloyd, divergence_rules, language_id, lm_scoring, ngram_join, ogg_media, secret_scan, sentencepiece_lattice, spelling_variants, url_filter, warc_archive


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_links(_read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(~language_id.held_out("doc_id", 4, 2)))
    return language_id.predict(docs, model).select("doc_id", language_id.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(_read(spark, sf_dir, "documents"), language_id.held_out("doc_id", 5, 1))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("score")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_read(spark, sf_dir, "documents"))


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The list of op6: the URLs of the pages whose id is divisible by this.
LISTED_EVERY = 100


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    listed = pages.filter(F.col("page_id") % LISTED_EVERY == 0).select("url")
    return url_filter.judge_urls(pages, listed, RULES)


def sentencepiece_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the whole texts' pieces, and of what decoding gives back."""
    return sentencepiece_lattice.round_trip(docs)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_digest(_read(spark, sf_dir, "documents"))


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_media.media_features(ogg_media.media_column(_read(spark, sf_dir, "documents")))


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.read_archives(warc_archive.write_archives(_read(spark, sf_dir, "pages")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text")
    )
    return chat_format.chat_digest(chat_format.parse_chats(chat_format.format_chats(rows.unionByName(extra))))


def op11_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules.judge_quality(_read(spark, sf_dir, "documents"))


CENTROIDS, ROUNDS = 40, 5


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd.cluster_report(_read(spark, sf_dir, "embeddings"), k=CENTROIDS, rounds=ROUNDS)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_forms(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_decontamination": op4_decontamination,
    "op5_secret_scan": op5_secret_scan,
    "op6_url_filter": op6_url_filter,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_ogg_media": op8_ogg_media,
    "op9_warc_archive": op9_warc_archive,
    "op10_chat_format": op10_chat_format,
    "op11_divergence_rules": op11_divergence_rules,
    "op12_delta_lloyd": op12_delta_lloyd,
    "op13_spelling_variants": op13_spelling_variants,
}

_HOST = r"translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '')"
_KEPT = r"list_sort(list_filter(string_split(coalesce(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), ''), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(ref|fbclid|gclid|utm_[a-z]+)(=|$)')))"


def _words(text: str) -> str:
    """SQL for the lower-cased words of a text."""
    return f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"


#: Distinct shingles of w, joined by spaces.
_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"


def _divergence_sql(common: int = 64) -> str:
    space, classes = "[ \\t\\n\\x0B\\f\\r]+", ["[aeiou]+", "[b-df-hj-np-tv-z]+", "[ \\t\\n\\x0B\\f\\r]+", "[A-Z]+", "\\p{L}+", "\\p{Nd}+", r"""[.,;:!?''"()-]+"""]
    steps = ["c0 AS (SELECT *, t AS r0 FROM d)"]
    steps += [f"c{i + 1} AS (SELECT *, regexp_replace(r{i}, '{p}', '', 'g') AS r{i + 1} FROM c{i})" for i, p in enumerate(classes)]
    counts = ", ".join(f"length(r{i}) - length(r{i + 1})" for i in range(len(classes)))
    js = lambda rows, name: f"""{name} AS (SELECT r, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
            + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS js FROM {rows} GROUP BY r)"""  # noqa: E731
    return f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
        {", ".join(steps)},
        k AS MATERIALIZED (SELECT r, doc_id, lang, t, r7 AS rest, [{counts}, length(r7)] AS c, list_filter(regexp_split_to_array(t, '{space}'), lambda x: x <> '') AS w,
            list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}]+'), lambda x: x <> '') AS lw FROM c7),
        o AS (SELECT lang, sum(len(lw)) AS total FROM k WHERE lang IS NOT NULL GROUP BY 1 HAVING sum(len(lw)) >= 1000),
        rc AS (SELECT lang, i, sum(x) AS q FROM (SELECT lang, unnest(c) AS x, unnest(range(8)) AS i FROM k JOIN o USING (lang)) GROUP BY 1, 2),
        rt AS (SELECT lang, sum(q) AS s FROM rc GROUP BY 1),
        wc AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(lw) AS word FROM k JOIN o USING (lang)) GROUP BY 1, 2),
        top AS MATERIALIZED (SELECT * FROM wc QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {common}),
        rw AS (SELECT lang, word, n::DOUBLE / total AS q FROM top JOIN o USING (lang)
            UNION ALL SELECT lang, NULL, (total - sum(n))::DOUBLE / total FROM top JOIN o USING (lang) GROUP BY lang, total),
        pc AS (SELECT r, x::DOUBLE / length(t) AS p, q::DOUBLE / s AS q FROM (SELECT r, lang, t, unnest(c) AS x, unnest(range(8)) AS i FROM k WHERE length(t) >= 200)
            JOIN rc USING (lang, i) JOIN rt USING (lang)),
        lw AS MATERIALIZED (SELECT r, lang, unnest(lw) AS word FROM k WHERE len(w) >= 200),
        hc AS (SELECT r, lang, top.word AS word, count(*) AS n FROM lw LEFT JOIN top USING (lang, word) GROUP BY 1, 2, 3),
        ht AS (SELECT r, sum(n) AS s FROM hc GROUP BY 1),
        hr AS (SELECT DISTINCT r, lang, s FROM hc JOIN ht USING (r)),
        pw AS (SELECT hr.r, coalesce(hc.n, 0)::DOUBLE / s AS p, q FROM hr JOIN rw USING (lang) LEFT JOIN hc ON hc.r = hr.r AND hc.word IS NOT DISTINCT FROM rw.word),
        {js("pc", "jc")}, {js("pw", "jw")},
        g AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS m FROM (SELECT r, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g,
            unnest(range(1, len(w) - 1)) AS i FROM k WHERE len(w) > 2)),
        v AS (SELECT r, count(DISTINCT spot) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS spot FROM g WHERE m > 1) GROUP BY r),
        b AS (SELECT r, doc_id, len(w) AS n_words, length(t) - c[3] AS word_chars, length(rest) - length(regexp_replace(rest, '[#*$%&|<>]', '', 'g')) AS n_symbols,
            len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]'))) -
            len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')))) AS n_dup_lines,
            coalesce(v.n, 0) AS n_repeat_words FROM k LEFT JOIN v USING (r)),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND coalesce(round(jc.js, 6), 0) <= 0.3 AND coalesce(round(jw.js, 6), 0) <= 0.4 AS kept, round(jc.js, 6) AS js_chars, round(jw.js, 6) AS js_words
        FROM f LEFT JOIN jc USING (r) LEFT JOIN jw USING (r)"""


def _lloyd_sql(k: int, rounds: int) -> str:
    """Plain Lloyd: every round compares every vector with every centroid."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""p{i} AS MATERIALIZED (SELECT r, vec_id, v, c, cv, list_sum(list_transform(list_zip(v, cv), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
            FROM x, c{i}),
        a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM p{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT c, k, count(*) AS n, sum(s)::BIGINT AS s FROM (SELECT c, unnest(v) AS s, unnest(range(len(v))) AS k FROM a{i}) GROUP BY c, k),
        n{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY k) AS nv FROM m{i} GROUP BY c),
        c{i + 1} AS MATERIALIZED (SELECT c, coalesce(nv, cv) AS cv FROM c{i} LEFT JOIN n{i} USING (c))""")
    return f"""
        WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * e::DOUBLE) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS cv FROM (SELECT sha256('2:' || vec_id) AS h, v FROM x) ORDER BY h, v LIMIT {k}),
        {", ".join(steps)}
        SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
            sha256(array_to_string(cv, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (c)"""


#: Table of CRC-32 from its polynomial.
_CRC = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"
_BYTES = "list_transform(range(strlen(s)), lambda i: CAST('0x' || substr(hex(encode(s)), 2 * i + 1, 2) AS BIGINT))"

ORACLES: dict[str, str] = {
    "op11_divergence_rules": _divergence_sql(),
    "op12_delta_lloyd": _lloyd_sql(CENTROIDS, ROUNDS),
    # neighbours by what is left when one code point goes, in place of segments
    "op13_spelling_variants": f"""
        WITH RECURSIVE t AS MATERIALIZED (SELECT {_CRC} AS t),
        o AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS o FROM documents),
        g AS (SELECT doc_id, translate(o, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS g, count(*) AS m FROM o WHERE length(o) >= 6 GROUP BY 1, 2),
        s AS (SELECT g, m, doc_id || ':' || g AS s FROM g),
        h AS (SELECT g, m, xor(list_reduce({_BYTES}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM s, t),
        k AS (SELECT CASE WHEN h % 199 = 0 THEN substr(g, 1, h % length(g)) || substr(g, h % length(g) + 2) ELSE g END AS word, m FROM h),
        w AS MATERIALIZED (SELECT word, sum(m)::BIGINT AS n FROM k WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
        v AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
        x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM v),
        p AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
            UNION SELECT x.word, w.word FROM x JOIN w ON x.cut = w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.cut = w.word),
        r AS (SELECT p.a AS word, w.word AS near, w.n AS near_n, row_number() OVER (PARTITION BY p.a ORDER BY w.n DESC, w.word) AS place,
            count(*) OVER (PARTITION BY p.a) AS n_near FROM p JOIN w ON w.word = p.b),
        f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
            FROM w LEFT JOIN (SELECT * FROM r WHERE place = 1) USING (word)),
        z AS (SELECT word, word AS stop, 0 AS step FROM f UNION ALL SELECT z.word, f.form, step + 1 FROM z JOIN f ON f.word = z.stop WHERE f.form IS NOT NULL)
        SELECT f.*, root FROM f JOIN (SELECT word, arg_max(stop, step) AS root FROM z GROUP BY word) USING (word)""",
    "op1_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest({_SHINGLES}) AS s FROM d),
        n AS (SELECT d.doc_id, count(s.s) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, (SELECT count(*) FROM l WHERE l.a = n.doc_id) AS n_links
        FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2""",
    "op4_decontamination": f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_words("text")} AS w FROM documents),
        dp AS (SELECT doc_id, r, len(w) AS n, unnest({_SHINGLES}) AS s, unnest(range(greatest(1, len(w) - 4))) AS k FROM d WHERE len(w) > 0),
        b AS (SELECT DISTINCT item_id, text, {_words("text")} AS w FROM benchmark),
        i AS (SELECT item_id, text, len(w) AS m, CAST(greatest(8, pow(2, ceil(log2(len(w))))) AS BIGINT) AS span, {_SHINGLES} AS l FROM b WHERE len(w) > 0),
        bs AS (SELECT item_id, text, span, s, min(CASE WHEN m < 5 OR k + 5 > m - greatest(1, m // 4) THEN 1 ELSE 0 END) AS late
            FROM (SELECT item_id, text, span, m, unnest(l) AS s, unnest(range(len(l))) AS k FROM i) GROUP BY 1, 2, 3, 4),
        n AS (SELECT item_id, text, count(*) FILTER (WHERE late = 0) AS n_question, count(*) FILTER (WHERE late = 1) AS n_answer FROM bs GROUP BY 1, 2),
        m AS (SELECT r, doc_id, item_id, text, s, late, unnest(CASE WHEN k >= span AND k % span + 4 < span THEN [k // span, k // span - 1]
            ELSE [k // span] END) AS p FROM dp JOIN bs USING (s)),
        h AS (SELECT r, doc_id, item_id, text, p, count(DISTINCT s) FILTER (WHERE late = 0) AS question_hits,
            count(DISTINCT s) FILTER (WHERE late = 1) AS answer_hits FROM m GROUP BY 1, 2, 3, 4, 5),
        g AS (SELECT *, row_number() OVER (PARTITION BY r, item_id, text ORDER BY question_hits + answer_hits DESC, p) AS place FROM h JOIN n USING (item_id,
            text)
            WHERE 5 * (question_hits + answer_hits) >= 4 * (n_question + n_answer) AND (question_hits > 0 OR n_question = 0) AND (answer_hits > 0
                OR n_answer = 0))
        SELECT doc_id, item_id, n_question, n_answer, question_hits, answer_hits FROM g WHERE place = 1""",
    "op9_warc_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        s AS (SELECT page_id, html, strlen(html) AS payload_bytes, unhex(sha1(html))::BIT::VARCHAR AS bits, max(page_id) OVER (PARTITION BY html) AS last
            FROM p)
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1,
                1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT
                + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
            CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
        FROM s""",
    "op6_url_filter": f"""
        WITH u AS (
            SELECT page_id, {_HOST} AS host, {_PATH} AS path, {_KEPT} AS kept FROM pages
        ), c AS (
            SELECT page_id, host, path,
                regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')
                    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canon
            FROM u
        ), r AS (
            SELECT *, CASE
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
            END AS rule FROM c
        ), l AS (SELECT DISTINCT canon FROM c WHERE page_id % {LISTED_EVERY} = 0 AND canon <> '')
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN canon IN (SELECT canon FROM l) THEN 'block' ELSE 'allow' END AS verdict
        FROM r""",
    "op10_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
        ), t AS (
            SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM c
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        ), e AS (
            SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|'))
                + CASE WHEN before IS NOT DISTINCT FROM role THEN 11 ELSE 22 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) END
                + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE 11 END AS chars
            FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
}
