"""Registered queries without SQL against plain Python over the whole small tables."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lexaria.llm import ogg_media, queries, secret_scan, sentencepiece_lattice
from tests.oracle import SMALL


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: (r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()}


def test_op2(spark, texts):
    """Escape method C with exclusion, byte by byte, on dictionaries."""
    counts: dict = defaultdict(lambda: defaultdict(Counter))
    for i, (t, lang) in texts.items():
        if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            x = b"\0" * 3 + t.encode()
            for at in range(3, len(x)):
                for k in range(4):
                    counts[lang][x[at - k : at]][x[at]] += 1
    got = {r.doc_id: r for r in queries.op2_language_id(spark, SMALL).collect()}
    assert set(got) == set(texts)
    for i, (t, _) in texts.items():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
        if not re.search(r"[^\W\d_]", t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        if len(t) > 900:  # this twin is slow
            continue
        bits = {}
        for lang in sorted(counts):
            x, total = b"\0" * 3 + t.encode(), 0.0
            for at in range(3, len(x)):
                seen: set = set()
                for k in (3, 2, 1, 0):
                    c = {s: n for s, n in counts[lang].get(x[at - k : at], {}).items() if s not in seen}
                    if c:
                        if x[at] in c:
                            total -= math.log2(c[x[at]] / (sum(c.values()) + len(c)))
                            break
                        total -= math.log2(len(c) / (sum(c.values()) + len(c)))
                        seen |= set(c)
                else:
                    total += math.log2(256 - len(seen))
            bits[lang] = total
        assert bits[got[i].lang_pred] == pytest.approx(min(bits.values()), rel=1e-5)


def test_op3(spark, texts):
    counts, n = Counter(), 0
    tokens = {
        i: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")) if w] + [None] for i,
        (t, _) in texts.items()
    }
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(w)
            n += len(w)
    got = {r.doc_id: r for r in queries.op3_lm_scoring(spark, SMALL).collect()}
    assert set(got) == set(texts)
    for i, w in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (len(counts) + 1))) for x in w), rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and sum(r.score > r.base_score for r in held) > 0.9 * len(held)


def test_op5(spark, texts):
    got = {r.doc_id: r for r in queries.op5_secret_scan(spark, SMALL).collect()}
    assert set(got) == set(texts)
    assign = re.compile(
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    )
    for i, (t, _) in texts.items():
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12] + [
            (m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18
        ] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        said = [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans)]
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in spans) for x in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("literal")] == said


def test_op7(spark, texts):
    """Best scores by a plain Viterbi over the whole text."""
    with open(sentencepiece_lattice.MODEL, "rb") as f:
        pieces = sentencepiece_lattice.Pieces(f.read())
    known = {b: int(pieces.score[i]) for i, b in enumerate(pieces.bytes) if b and (len(b) > 1 or pieces.byte_id[b[0]] != i)}
    one = int(pieces.score[pieces.byte_id[0]])
    got = {r.doc_id: r for r in queries.op7_sentencepiece(spark, SMALL).collect()}
    assert set(got) == set(texts)
    for i, (t, _) in texts.items():
        r = got[i]
        assert r.decoded_sha256 == (None if t is None else hashlib.sha256(t.encode()).hexdigest())
        if not t or len(t) > 1500:
            continue
        data = b" " + t.encode()
        bare = [c.encode() not in pieces.single for c in data.decode() for _ in c.encode()]
        best: list = [0] + [None] * len(data)
        for e in range(1, len(data) + 1):
            options = [best[e - 1] + one] if bare[e - 1] and best[e - 1] is not None else []
            options += [best[s] + known[data[s:e]] for s in range(max(0, e - 48), e) if best[s] is not None and data[s:e] in known]
            best[e] = max(options, default=None)
        scores = [int(x) for x in r.n_best_scores.split(",")]
        assert r.best_score == best[-1] == scores[0] and scores == sorted(scores, reverse=True)


def test_op8(spark, texts):
    got = {r.doc_id: r for r in queries.op8_ogg_media(spark, SMALL).collect()}
    assert set(got) == set(texts)
    for i, (t, _) in texts.items():
        raw = (t or "").encode()
        size = max(1, -(-len(raw) // 192)) * 192
        payload, r = raw + b" " * (size - len(raw)), got[i]
        media = ogg_media.write_ogg(payload)
        # packets from the pages by a plain walk: pages of stream 1 and 2 in turn hold blocks of 3072 samples
        at, packets, pages = 0, defaultdict(list), 0
        while at < len(media):
            n = media[at + 26]
            lacing, serial, body = media[at + 27 : at + 27 + n], media[at + 14], at + 27 + n
            if not media[at + 5] & 1:
                packets[serial].append(b"")
            for k, v in enumerate(lacing):
                packets[serial][-1] += media[body : body + v]
                body += v
                if v < 255 and k < n - 1:
                    packets[serial].append(b"")
            at, pages = body, pages + 1
        blocks = [packets[1 + j % 2][1 + j // 2] for j in range(-(-size // 3072))]
        assert b"".join(blocks) == payload
        samples = [x - 128 for x in payload]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        said = json.loads(r.feature)
        assert (said["sum"], said["energy"], said["peak"], said["pages"], said["packets"]) == (
            sum(samples), sum(x * x for x in samples), max(map(abs, samples)), pages, len(blocks)
        )
        assert said["crossings"] == sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:]))
