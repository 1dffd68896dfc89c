"""The operators against plain implementations on small inputs."""

import base64
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexaria.llm import attention, chat_format, decontamination, language_id, ngram_join, ogg_media, queries, secret_scan, sentencepiece_lattice, url_filter, warc_archive, words
from tests.oracle import SMALL, same


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - {"op1_ngram_jaccard_join"}))  # test_jaccard_join has its own
def test_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_word_hashes_follow_the_definition():
    texts = ["A  b\tC", "", " x ", "é y\nz", "a\x1cb \x0bq", "w" * 3_000_000 + " v"]
    seen: dict[bytes, int] = {}
    for first, last, data, offsets in words.chunks(pa.array(texts)):
        s, e, h, bounds = words.chunk_words(data, offsets)
        for i in range(first, last):
            got = [bytes(data[a:b]).lower() for a, b in zip(s[bounds[i - first] : bounds[i - first + 1]], e[bounds[i - first] : bounds[i - first + 1]])]
            assert got == [w for w in re.split(rb"[\x20\x09-\x0D]+", texts[i].encode().lower()) if w]
            for w, k in zip(got, h[bounds[i - first] : bounds[i - first + 1]].tolist()):
                assert seen.setdefault(w, k) == k
    assert len(set(seen.values())) == len(seen)


def test_hash_index():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    index = words.HashIndex(keys[::2])
    found = index.find(keys)
    assert (found[::2] == np.arange(len(keys[::2]))).all() and (found[1::2] == -1).all()


def _near_copies(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 5, 6, 9, 14, 30, 60, 200]))]
        for _ in range(r.choice([1, 1, 3, 8])):
            copy = list(base)
            for _ in range(r.randrange(3)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy + [r.choice(vocabulary)] * r.randrange(2)))
    r.shuffle(texts)
    return texts


def test_jaccard_join(spark):
    texts = _near_copies(1)
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    links = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    root = list(range(len(sets)))
    for _ in sets:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_ppm_code_lengths():
    """Against escape method C with exclusion, one byte at a time."""
    r = random.Random(3)
    texts = ["".join(r.choice("abcd ") for _ in range(80)).encode() for _ in range(6)]
    counts = defaultdict(Counter)
    grams = Counter()
    for t in texts:
        x = b"\0" * 3 + t
        for i in range(3, len(x)):
            grams[int.from_bytes(x[i - 3 : i + 1], "big")] += 1
            for k in range(4):
                counts[x[i - k : i]][x[i]] += 1
    model = language_id.PpmModel(["q"], np.zeros(len(grams), dtype=np.int64), np.array(list(grams)), np.array(list(grams.values()), dtype=float))

    def bits(context, symbol):
        seen, out = set(), 0.0
        for k in (3, 2, 1, 0):
            c = {s: n for s, n in counts[context[len(context) - k :]].items() if s not in seen}
            if c:
                total = sum(c.values()) + len(c)
                if symbol in c:
                    return out - math.log2(c[symbol] / total)
                out -= math.log2(len(c) / total)
                seen |= set(c)
        return out + math.log2(256 - len(seen))

    for t in (b"abca d", b"dd", b"zab", b"a"):
        x = b"\0" * 3 + t
        want = sum(bits(x[i - 3 : i], x[i]) for i in range(3, len(x)))
        got = model.bits(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)]))[0][0, 0]
        assert got == pytest.approx(want, rel=1e-4)


def test_language_id_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = queries.op2_language_id(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def _model():
    counts = np.zeros(300)
    counts[:90] = np.arange(90, 0, -1)
    vocabulary = attention.Vocabulary(counts, 10)
    return vocabulary, attention.Attention(vocabulary)


def test_attention_is_causal_and_sums_to_one():
    vocabulary, model = _model()
    r = np.random.default_rng(0)
    tokens = r.integers(2, 90, 100)
    model.train(tokens, np.array([0, 60, 100]), steps=5)
    model.freeze()

    def logs(t):
        x, y, before, _ = attention.blocks_of(t, np.array([0, len(t)]))
        return model.log_probs(x, y, before).reshape(-1)[attention.SPAN :][: len(t) + 1], y.reshape(-1)[attention.SPAN :][: len(t) + 1]

    a, y = logs(tokens[:50])
    assert (y[:-1] == tokens[:50]).all() and y[-1] == attention.END and (a < 0).all()
    changed = tokens[:50].copy()
    changed[30:] = 3
    assert np.allclose(a[:30], logs(changed)[0][:30], atol=1e-5)
    total = 0.0
    for v in range(vocabulary.size):
        t = tokens[:40].copy()
        t[20] = v
        total += float(np.exp(logs(t)[0][20]))
    assert total == pytest.approx(1.0, abs=2e-3)


def test_attention_gradients():
    _, model = _model()
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    model.future = model.future.astype(np.float64)
    x, y, before, _ = attention.blocks_of(np.random.default_rng(2).integers(2, 90, 40), np.array([0, 40]))
    pick = np.array([1, 2, 3])
    xx, yy = np.concatenate([x[before[pick]], x[pick]], 1), y[pick]
    _, grad = model._step(xx, yy)
    r = np.random.default_rng(5)
    for k, v in model.p.items():
        at = tuple(r.integers(0, s) for s in v.shape)
        if k in ("M", "bm", "E"):
            at = (5, *at[1:])
        old = v[at]
        v[at] = old + 1e-4
        up = model._step(xx, yy)[0]
        v[at] = old - 1e-4
        down = model._step(xx, yy)[0]
        v[at] = old
        assert (up - down) / 2e-4 == pytest.approx(float(grad[k][at]), abs=2e-5)


def _items(seed, n=50):
    """Items that share most of their words, and some that share none."""
    r = random.Random(seed)
    shared = [f"s{i}" for i in range(16)]
    items = [" ".join([*shared, *(f"own{i}x{j}" for j in range(4))]) for i in range(n // 2)]
    return items + [" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * r.randrange(1, 3) for _ in range(r.randrange(1, 60))) for _ in range(n - n // 2)]


def _indexes(items):
    stats = decontamination.Statistics()
    hashes = decontamination._hashes(items)
    stats.add(hashes[: len(items) // 2])
    stats.add(hashes[len(items) // 2 :])
    return stats, decontamination.build(list(range(len(items))), items, stats)


def test_bm25_retrieval_is_complete():
    """Every class's walk and scores against all items scored one by one."""
    r = random.Random(4)
    items = _items(4)
    stats, indexes = _indexes(items)
    n, bags = len(items), [Counter(t.split()) for t in items]
    mean = sum(sum(b.values()) for b in bags) / n
    df = Counter(w for b in bags for w in b)
    idf = {w: math.log1p((n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    part = [{w: idf[w] * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w, k in b.items()} for b in bags]
    hits = 0
    for _ in range(60):
        source = r.choice(items).split()
        passage = set(r.sample(source, max(1, len(source) * r.choice([2, 3, 4]) // 4)) + [r.choice("abcxyz") for _ in range(4)])
        h = words.hash_text(np.frombuffer(" ".join(sorted(passage)).encode(), dtype=np.uint8))[2]
        want, got = {}, {}
        for index in indexes:
            term = np.unique(index.terms.find(h))
            term = term[term >= 0]
            _, found, score = index.retrieve(np.zeros(len(term), dtype=np.int64), term)
            got |= {int(index.ids[i]): s for i, s in zip(found.tolist(), score.tolist())}
        for i, p in enumerate(part):
            own = words.hash_text(np.frombuffer(items[i].encode(), dtype=np.uint8))[2]
            terms, _, share = stats.weigh(own)
            least = max(decontamination.least_score(own, terms, share, decontamination._shingles(own)[2]), 1e-6)
            s = sum(p.get(w, 0) for w in passage) / sum(p.values()) / least
            if s >= 1:
                want[i] = s
        hits += len(want)
        assert got == {i: pytest.approx(s) for i, s in want.items()}
    assert hits > 60


def test_decontamination_finds_all_that_verification_accepts():
    """Copies with words changed, cut and added, in texts of other words: found if and only if a passage has 0.8 of the shingles."""
    r = random.Random(9)
    items = [t for t in _items(9) if len(t.split()) >= 5]
    _, indexes = _indexes(items)
    texts = []
    for _ in range(400):
        copy = r.choice(items).split()
        for _ in range(r.randrange(4)):
            k = r.randrange(len(copy))
            copy[k : k + r.randrange(2)] = [r.choice(["other", "a", "s3"])] * r.randrange(2)
        copy = copy[r.randrange(3) :]
        copy = copy[: len(copy) - r.randrange(3)]
        texts.append(
            " ".join([r.choice(["x", "y", "s1", "b"]) for _ in range(r.randrange(90))] + copy + [r.choice(["x", "z", "s2"]) for _ in range(r.randrange(90))])
        )
    got = {(f[0], f[1]): f[3:] for f in decontamination.find_in(indexes, pa.array(texts))}
    want = {}
    for d, t in enumerate(texts):
        w = t.split()
        for i, item in enumerate(items):
            own = item.split()
            span = max(8, 1 << (len(own) - 1).bit_length())
            late = {}
            for k in range(len(own) - 4):
                late[tuple(own[k : k + 5])] = min(late.get(tuple(own[k : k + 5]), True), k + 5 > len(own) - max(1, len(own) // 4))
            for p in range(0, len(w), span):
                have = {tuple(w[k : k + 5]) for k in range(p, min(len(w), p + 2 * span) - 4)}
                a, q = (sum(x in have for x, z in late.items() if z == y) for y in (True, False))
                n_a, n_q = sum(late.values()), len(late) - sum(late.values())
                if 5 * (a + q) >= 4 * len(late) and (a or not n_a) and (q or not n_q) and ((d, i) not in want or a + q > sum(want[d, i][2:])):
                    want[d, i] = (n_q, n_a, q, a)
    assert got == want and len(want) > 120


def test_secret_patterns():
    key = "AKIA" + "Z9" * 8
    text = f'x password: "short" token = abcdefghijkl.mn {key} AKIAshort {"0a" * 8} SECRET="ABCDEFGHIJKL"\napi_key=token: 1234567890123456'
    want = []
    for kind, p, ok in (
        (0, r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        (1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), (2, r"[0-9a-f]+", lambda m: len(m[0]) >= 16)
    ):
        want += [(m.start(), kind, m.end()) for m in re.finditer(p, text) if ok(m)]
    assert secret_scan.base_spans(text) == sorted(want) and len(want) == 5


@pytest.mark.parametrize(
    "text,found",
    [
        ('k = "f8Kq2Lz9Xw4Tn7Vb"\nclient.password = k', ["f8Kq2Lz9Xw4Tn7Vb"]),
        ('DB_PWD="f8Kq2Lz9" + "Xw4Tn7Vb"', ["f8Kq2Lz9", "Xw4Tn7Vb"]),
        ('{"privateKey": "f8Kq2Lz9Xw4Tn7Vb", "color": "f8Kq2Lz9Xw4Tn7Vc"}', ["f8Kq2Lz9Xw4Tn7Vb"]),
        ('config["auth_token"] = "f8Kq2Lz9Xw4Tn7Vb"', ["f8Kq2Lz9Xw4Tn7Vb"]),
        ('A=f8Kq2Lz9Xw4Tn7Vb\nexport CLIENT_SECRET=${A}', ["f8Kq2Lz9Xw4Tn7Vb"]),
        ('pwd = "your_password_here"', []),
        ("pwd = changeme123", []),
        ("The secret: nobody knows; see http://example.org/a=b", []),
        ('const password: string = "f8Kq2Lz9Xw4Tn7Vb";', ["f8Kq2Lz9Xw4Tn7Vb"]),
        ('password = """f8Kq2Lz9Xw4Tn7Vb"""', ["f8Kq2Lz9Xw4Tn7Vb"]),
        ("password = f'f8Kq2Lz9Xw4Tn7Vb'", ["f8Kq2Lz9Xw4Tn7Vb"]),
        ('password = (\n  "f8Kq2Lz9"\n  "Xw4Tn7Vb"\n)', ["f8Kq2Lz9", "Xw4Tn7Vb"]),
        ('password = "f8Kq2Lz9" + \\\n  "Xw4Tn7Vb"', ["f8Kq2Lz9", "Xw4Tn7Vb"]),
        ('{"password": ["f8Kq2Lz9Xw4Tn7Vb"], "b": "f8Kq2Lz9Xw4Tn7Vc"}', ["f8Kq2Lz9Xw4Tn7Vb"]),
        ("password:\n  value: f8Kq2Lz9Xw4Tn7Vb\ncolor: f8Kq2Lz9Xw4Tn7Vc", ["f8Kq2Lz9Xw4Tn7Vb"]),
        ("<db><password>f8Kq2Lz9Xw4Tn7Vb</password></db>", ["f8Kq2Lz9Xw4Tn7Vb"]),
        ('<add key="password" value="f8Kq2Lz9Xw4Tn7Vb"/>', ["f8Kq2Lz9Xw4Tn7Vb"]),
        ('client.password = k\nk = "f8Kq2Lz9Xw4Tn7Vb"', ["f8Kq2Lz9Xw4Tn7Vb"]),
        ('k = "f8Kq2Lz9Xw4Tn7Vb"\npassword = k.strip()', ["f8Kq2Lz9Xw4Tn7Vb"]),
        ('a="f8Kq2L"\nb="z9Xw4Tn7"\npassword = a + b', ["f8Kq2L", "z9Xw4Tn7"]),
        ('password = os.getenv("DB", "f8Kq2Lz9Xw4Tn7Vb")', ["f8Kq2Lz9Xw4Tn7Vb"]),
        ('password = os.getenv("DB_PASSWORD_1x")', []),
        ('# k = "f8Kq2Lz9Xw4Tn7Vb"\npassword = k', []),
        ('color = "f8Kq2Lz9Xw4Tn7Vb"  # password', []),
    ],
)
def test_assignments(text, found):
    assert [text[s:e] for s, _, e in secret_scan.literal_spans(text)] == found


def _lattice_brute(pieces, text, n):
    lookup = {b: i for i, b in enumerate(pieces.bytes) if b and (len(b) > 1 or pieces.byte_id[b[0]] != i)}
    data, out = b" " + text.encode(), []
    covered = [c.encode() in pieces.single for c in data.decode() for _ in c.encode()]

    def walk(i, ids, score):
        if i == len(data):
            out.append((score, ids))
        for size in range(1, 49):
            p = lookup.get(data[i : i + size]) if i + size <= len(data) else None
            if p is not None:
                walk(i + size, [*ids, p], score + int(pieces.score[p]))
        if i < len(data) and not covered[i]:
            walk(i + 1, [*ids, int(pieces.byte_id[data[i]])], score + int(pieces.score[pieces.byte_id[data[i]]]))

    walk(0, [], 0)
    return sorted(out, key=lambda x: -x[0])[:n]


def test_n_best_segmentation():
    with open(sentencepiece_lattice.MODEL, "rb") as f:
        encoder = sentencepiece_lattice.Encoder(f.read())
    texts = ["Hello wor", "a  b", "ab\ncd é", "日本x", "▁ q", "the the", "zz\n\n z", "  ", "\t"]
    for first, last, data, offsets in words.chunks(pa.array(texts)):
        for text, (ids, _, best) in zip(texts[first:last], encoder(data, offsets, 4), strict=True):
            want = _lattice_brute(encoder.pieces, text, 4)
            assert [s for s, _ in best] == [s for s, _ in want]
            assert ids.tolist() in [p for s, p in want if s == want[0][0]]
            assert encoder.pieces.decode(ids) == text.encode()


@pytest.mark.parametrize("size", [1, 191, 192, 3072, 3073, 255 * 255, 70_000, 900_001])
def test_ogg_round_trip(size):
    payload = ogg_media.payload_of(bytes(random.Random(size).randrange(256) for _ in range(size)))
    media = ogg_media.write_ogg(payload)
    back, found = ogg_media.read_ogg(media)
    assert back == payload and found["streams"] == 2 and found["packets"] == -(-len(payload) // ogg_media.BLOCK)
    for at in (0, 30, len(media) // 2, len(media) - 1):
        with pytest.raises(ogg_media.OggError):
            ogg_media.read_ogg(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])


def test_ogg_crc():
    def slow(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc >> 31 else crc << 1
        return crc

    assert all(ogg_media.ogg_crc(x) == slow(x) for x in (b"", b"a", b"OggS" * 9, bytes(range(256))))


def test_warc_round_trip():
    records = [warc_archive.write_record(i, f"http://a/{i}", (f"<p>{i}</p>" * i).encode(), i % 3 > 0, None if i % 3 else 9) for i in range(200)]
    archive = warc_archive.write_archive(records)
    assert list(warc_archive.read_archive(archive)) == records and len(archive) < sum(map(len, records))
    page, size, digest, kind, refers, uri, payload = warc_archive.read_record(records[4])
    assert (page, size, kind, refers, uri, payload) == (4, 32, "response", None, "http://a/4", b"<p>4</p>" * 4)
    assert base64.b32decode(digest) and warc_archive.read_record(records[3])[3:5] == ("revisit", 9)
    with pytest.raises(Exception):
        list(warc_archive.read_archive(archive[:-2]))
    with pytest.raises(warc_archive.WarcError):
        warc_archive.read_record(records[4].replace(b"<p>4", b"<p>5", 1))
    assert list(warc_archive.read_archive(warc_archive.write_archive(records[:1]))) == records[:1]


def test_chat_mask(spark):
    """The mask's bytes, cut out of the formatted text, are the assistant's texts; adjacent rows of a role are one block."""
    chats = [
        (1, i, ["user", "assistant", "assistant"][i % 3], f"t{i} <|im_end|>\\ é" * (i % 4)) for i in range(20)
    ] + [(2, i, "assistant", f"é{i}") for i in range(700)]
    rows = {r.conv_id: r for r in chat_format.format_chats(spark.createDataFrame(chats, "conv_id long, turn long, role string, text string")).collect()}
    for conv, row in rows.items():
        raw = row.formatted.encode()
        kept = [raw[m.start : m.start + m.bytes].decode() for m in row["mask"]]
        assert [len(k) for k in kept] == [m.chars for m in row["mask"]]
        assert [re.sub(r"(?s)\\(.)", r"\1", k) for k in kept] == [t for c, _, r, t in chats if c == conv and r == "assistant"]
    assert rows[1].formatted.count(chat_format.START) == 14 and rows[2].formatted.count(chat_format.START) == 1


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"))
    table = url_filter.bloom_blocks(keys, "k", 16)
    probe = spark.range(2000).select("id", F.concat(F.lit("k"), "id").alias("k")).select("id", *url_filter._place(F.col("k"), 16)).join(table, "block")
    hit = F.expr(" and ".join(f"(w{i} & m{i}) = m{i}" for i in range(8)))
    got = {r.id for r in probe.filter(hit).collect()}
    assert set(range(500)) <= got and len(got) < 700


def test_held_out_split(spark):
    got = spark.range(50).select("id", language_id.held_out("id", 5, 1).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 1) for r in got)
