"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import base64
import datetime
import random
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexaria.llm import chat_format, decontamination, language_id, lm_scoring, ngram_join, ogg_media, queries, secret_scan, sentencepiece_lattice, url_filter, warc_archive, words

LONG = " ".join(f"wort{i % 977} und noch {i}" for i in range(40_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, h long, key string, sid string, rid int, kind string, score string, hi string, lo int, `__x` int, date date"
TEXTS = [
    None, "", " \t\n", "one", "Two words", "a b c d", "the same text as before it is here", "the same text as before it is here",
    "THE SAME  text as before it is here", LONG, "123 456 ..", "é   ü", "x" * 100_000, "password=abcdefghijklmnop and more"
]


def rows(spark, texts=TEXTS, first=1):
    data = [
        (first + i, t, ["en", "de", None][i % 3], "s", len(t or ""), 1, 2, "k", "s", 3, "q", "z", "p", 4, 5, datetime.date(2020, 1, 1)) for i,
        t in enumerate(texts)
    ]
    data.append((None, "a row without an id has a text too", "en", "s", 5, 1, 2, "k", "s", 3, "q", "z", "p", 4, 5, None))
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return rows(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ngram_join(docs, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert len(got) == len(TEXTS) + 1
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[4] == (1, 4) and got[6] == (1, 6)
    assert got[7] == got[8] == got[9] == (4, 7)
    assert got[None] == (5, None)
    assert ngram_join.jaccard_components(none).count() == 0


def test_language_id(docs, none):
    model = language_id.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    assert got[1] == got[2] == got[3] == got[11] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values()) and got[10][0] in ("en", "de")
    assert language_id.train(none) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(none, None).count() == 0
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and {1, 2, 3, 11}.isdisjoint(r.doc_id for r in kept.select("doc_id").collect())


def test_lm_scoring(docs, none):
    got = lm_scoring.score_texts(docs, language_id.held_out("doc_id", 5, 1), steps=2).collect()
    assert len(got) == len(TEXTS) + 1
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1 and by[10].n_tokens == 160_001
    assert by[1].base_score == by[2].base_score and all(r.score < 0 and r.base_score < 0 for r in got)
    assert lm_scoring.score_texts(none, language_id.held_out("doc_id", 5, 1), steps=2).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame(
        [(1, "same text as before it is"), (1, "same text as before it is"), (2, None), (3, " "), (4, "one"), (5, "a b c")],
        "item_id long, text string"
    )
    got = sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect())
    assert got == [(4, 4), (7, 1), (8, 1), (9, 1)]
    assert decontamination.contaminated(none, items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in decontamination.drop_contaminated(docs, items).select("doc_id").collect()) == [0, 1, 2, 3, 5, 6, 10, 11, 12, 13, 14]


def test_secret_scan(docs, none):
    got = {r.doc_id: r for r in secret_scan.scan_secrets(docs).collect()}
    assert got[1].spans == "" and got[14].spans == "assign:0:25" and got[14].n_assign == 1
    clean = secret_scan.redact_secrets(docs)
    assert clean.columns == docs.columns
    row = clean.filter("doc_id = 14").first()
    assert row.text == "[secret] and more" and row.n_chars == 17
    assert clean.filter("doc_id = 1").first().text is None
    assert secret_scan.scan_secrets(none).count() == secret_scan.redact_secrets(none).count() == 0


def test_sentencepiece(docs, none):
    got = {r.doc_id: r for r in queries.sentencepiece_digest(docs).collect()}
    assert got[1].n_pieces is None and got[2].n_pieces == 0
    want = {r.doc_id: r.s for r in docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("s")).collect()}
    assert {k: r.decoded_sha256 for k, r in got.items()} == want
    assert queries.sentencepiece_digest(none).count() == 0


def test_ogg_media(docs, none):
    got = {r.doc_id: r for r in ogg_media.media_features(ogg_media.media_column(docs)).collect()}
    assert got[1].payload_bytes == got[2].payload_bytes == 192 and got[1].n_bytes == 0
    assert got[7].media_sha256 == got[8].media_sha256 and got[7].feature == got[8].feature
    assert ogg_media.media_features(ogg_media.media_column(none)).count() == 0


def test_url_filter(spark):
    pages = spark.createDataFrame(
        [
            (1, None, "r"), (2, "no scheme", "r"), (3, "http://A.Net", "r"), (4, "http://a.net/x", "r"),
            (5, "https://www.b.org/p/?utm_x=1&b=2&a=1#f", "r"), (5, "https://www.b.org/p/?utm_x=1&b=2&a=1#f", "r"), (6, "http://b.org/q", None)
        ],
        "page_id long, url string, rule string"
    )
    listed = spark.createDataFrame([("http://b.org/p?a=1&b=2",), ("http://b.org/p?a=1&b=2",), (None,), ("junk",)], "url string")
    rules = [("block", "net", "/"), ("allow", "a.net", "/x")]
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.judge_urls(pages, listed, rules).collect())
    assert got == [
        (1, "", "", "", "allow"), (2, "", "", "", "allow"), (3, "a.net", "", "", "allow"), (4, "a.net", "/x", "a.net/x", "allow"),
        (5, "www.b.org", "/p/", "", "block"), (5, "www.b.org", "/p/", "", "block"), (6, "b.org", "/q", "", "allow")
    ]
    assert url_filter.judge_urls(pages.limit(0), listed, rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, listed.limit(0), []).collect()} == {"allow"}


def test_warc(spark):
    pages = spark.createDataFrame(
        [
            (1, "u", None, 1), (2, None, "", 1), (3, "u\r\nX: y", "é<p>", 1), (4, "u", "é<p>", 1), (4, "u", "é<p>", 1), (None, "u", "z", 1),
            (7, "v", "y" * 9_000_000, 1)
        ],
        "page_id long, url string, html string, last int"
    )
    got = sorted(
        ((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc_archive.read_archives(warc_archive.write_archives(pages)).collect()),
        key=str
    )
    assert got == [
        (0, 1, "response", None), (1, 0, "revisit", 2), (2, 0, "response", None), (3, 5, "revisit", 4), (4, 5, "response", None),
        (4, 5, "response", None), (7, 9_000_000, "response", None)
    ]
    assert warc_archive.read_archives(warc_archive.write_archives(pages.limit(0))).count() == 0


def test_chat(spark):
    chats = spark.createDataFrame(
        [
            (1, 2, "user", "b", 0), (1, 1, "user", "a<|im_sep|>\\", 0), (1, 2, "user", "b", 0), (1, 3, None, None, 0),
            (None, None, "assistant", "x<|", 0), (2, 0, "as\nsistant<|", "y", 0)
        ],
        "conv_id long, turn long, role string, text string, t int"
    )
    formatted = chat_format.format_chats(chats)
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.parse_chats(formatted).collect()}
    assert got == {1: [("user", "a<|im_sep|>\\"), ("user", "b"), ("user", "b"), ("", "")], None: [("assistant", "x<|")], 2: [("as\nsistant<|", "y")]}
    assert chat_format.chat_digest(chat_format.parse_chats(chat_format.format_chats(chats.limit(0)))).count() == 0


def test_url_filter_beyond_broadcasts(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/p{i % 50}") for i in range(200)] + [(200, None)], "page_id long, url string")
    listed = pages.filter("page_id % 9 = 0").select("url")
    rules = [("allow", "h1.org", "/")]
    small = sorted(map(str, url_filter.judge_urls(pages, listed, rules).collect()))
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", -1)
    assert sorted(map(str, url_filter.judge_urls(pages, listed, rules).collect())) == small
    # pages that a rule decides, and those without a URL, don't go through the join on blocks
    held = []
    table = url_filter.Scratch.table
    monkeypatch.setattr(url_filter.Scratch, "table", lambda self, df: held.append(table(self, df)) or held[-1])
    assert url_filter.judge_urls(pages, listed, rules).count() == 201
    assert held[-1].count() == pages.filter("url not like 'http://h1.org%'").count()


def test_language_filter_without_labels(spark, docs):
    with pytest.warns(UserWarning, match="no text is rejected"):
        kept = language_id.keep_identified(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {1, 2, 3, 11}.isdisjoint(r.doc_id for r in kept.select("doc_id").collect()) and kept.count() == len(TEXTS) + 1 - 4


def test_language_filter_rejects_noise(spark):
    good = ["the quick brown fox jumps over the lazy dog and the cat sleeps in the sun"] * 30
    noise = ["".join(chr(0x4E00 + (i * 7919 + k * 104729) % 20000) for i in range(60)) for k in range(3)]
    docs = spark.createDataFrame([(i, t, "en" if i < 30 else None) for i, t in enumerate(good + noise)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in language_id.keep_identified(docs).collect()} == set(range(30))


def test_decontamination_in_shards(spark, docs, monkeypatch):
    items = spark.createDataFrame(
        [
            (i, f"{t} item{i}") for i,
            t in enumerate(["same text as before it is here", "a row without an id has a text", "one", "no such text at all in there"])
        ] + [(7, "same text as before it is")],
        "item_id long, text string"
    )
    whole = sorted(map(str, decontamination.contaminated(docs, items).collect()))
    kept = sorted(map(str, decontamination.drop_contaminated(docs, items).select("doc_id").collect()))
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 4)
    assert sorted(map(str, decontamination.contaminated(docs, items).collect())) == whole and whole
    assert sorted(map(str, decontamination.drop_contaminated(docs, items).select("doc_id").collect())) == kept


def test_words_of_a_regular_shape_differ(spark):
    """Words that a polynomial hash modulo a power of two takes for equal."""
    word = b"a"
    for _ in range(10):
        word += bytes(195 - c for c in word)
    texts = [word.decode(), bytes(195 - c for c in word).decode(), f"{word.decode()} {bytes(195 - c for c in word).decode()}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()} == {0: 0, 1: 1, 2: 2}
    got = queries.sentencepiece_digest(docs).join(docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("s")), "doc_id")
    assert got.filter("s = decoded_sha256").count() == 3


def _seconds(run, text):
    """CPU seconds of this process, without the cost of tracing memory."""
    began = time.process_time()
    run(text)
    return time.process_time() - began


def _peak(run, text):
    tracemalloc.start()
    run(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def _linear(run, half, whole):
    """Whether twice the text takes at most three times as long, in one of three trials: a busy machine doesn't tell."""
    return any(_seconds(run, whole) <= 3 * max(_seconds(run, half), 0.05) for _ in range(3))


HOSTILE = {
    "references": lambda n: 'a0="f8Kq2Lz9Xw4Tn7Vb"\n' + "".join(f'a{i + 1}="$a{i}" "$a{i}"\n' for i in range(3 * n)) + f"password=$a{3 * n}",
    "spaces": lambda n: "password" + " " * (3000 * n) + "x",
    "quotes": lambda n: 'password="\\' * (300 * n),
    "calls": lambda n: "password = f(b=" * (200 * n),
    "pairs": lambda n: "password=" * (400 * n),
    "elements": lambda n: "<password>" * (300 * n),
    "triples": lambda n: 'password="""' * (200 * n),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_secret_lexer_is_linear(name):
    make = HOSTILE[name]
    assert _linear(secret_scan.scan, make(50), make(100))
    assert _seconds(secret_scan.scan, make(100)) < 15 and _peak(secret_scan.scan, make(100)) < 300e6


def test_references_reach_the_literal():
    text = 'a0="f8Kq2Lz9Xw4Tn7Vb"\n' + "".join(f'a{i + 1}="$a{i}" "$a{i}"\n' for i in range(300)) + "password=$a300"
    assert (4, 3, 20) in secret_scan.scan(text)


@pytest.mark.parametrize(
    "text", [base64.b64encode(random.Random(1).randbytes(30_000)).decode(), "x" * 60_000, " " * 60_000], ids=["base64", "letters", "spaces"]
)
def test_long_units(text):
    with open(sentencepiece_lattice.MODEL, "rb") as f:
        encoder = sentencepiece_lattice.Encoder(f.read())

    def run(t):
        for _, _, data, offsets in words.chunks(pa.array([t])):
            ((ids, score, best),) = encoder(data, offsets, 4)
            assert encoder.pieces.decode(ids) == t.encode() and best[0][0] == score == int(encoder.pieces.score[ids].sum()) and len(best) == 4

    assert _linear(run, text[: len(text) // 2], text)
    assert _seconds(run, text) < 20 and _peak(run, text) < 500e6


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item of the benchmark with some words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    with pytest.warns(UserWarning):
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    item = "quite a long test item that nobody should train on at all today"
    texts = [*TEXTS, f"some words before {item} and some words after it", "a clean text that says nothing special about anything in the world"]
    folder = str(tmp_path)
    rows(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, folder).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        assert i == 4 or docs.columns == before.columns
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {1, 2, 3, 8, 9, 11, 15}.isdisjoint(kept) and {7, 14, 16, None} <= kept
