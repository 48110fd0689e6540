"""Operators of the training-data pipeline against brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrack.llm import bpe, covertree, jaccard, langid, mpeg, packing, queries, suffix_dedup, token_counts, tokens, urlfilter, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, anchor string, key long"
ODD = [
    (9001, None, None, None, None, "x", 1), (9002, "", "en", "s", 0, "x", 1), (9003, " \n\t ", "en", "s", 4, None, 1), (9004, "one two", "en", "s", 7, "x", None),
    (9005, "12 345 --", None, "s", 9, "x", 1), (9006, "a" * 5000, None, "s", 9, "x", 1), (9007, "It's ΣΑΣ Éa é <|endoftext|>x's  \x1c y\u0085z 1234 \U0001f600!?", "fr", "s", 9, "x", 1),
    (9008, "one two", "en", "s", 7, "x", None), (9009, "<|startoftext|>", "en", "s", 7, "x", None),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """The smallest table, whole, with odd rows, a very long text and near copies added; extra columns clash with inner names."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x", 1) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng, extra = random.Random(3), []
    for k in range(40):
        words = rows[k][1].split(" ")
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(99)}"
        extra.append((8000 + k, " ".join(words), rows[k][2], "s", 1, "x", 1))
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    extra += [(8100 + k, f"{rng.random()} {passage[k * 5:]} {rng.random()}" * (1 + k % 2), "en", "s", 1, "x", 1) for k in range(14)]
    extra.append((8200, " ".join(r[1] for r in rows[:80]), "en", "s", 1, "x", 1))
    return spark.createDataFrame(rows + extra + ODD, DOC).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def roots(n, links):
    parent = {x: x for x in n}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in n}


def test_cover_tree(spark, sf_dir):
    rng = np.random.default_rng(1)
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    base = np.array(rows[0][1])
    rows += [(5000 + k, (base + rng.normal(0, 0.006 * (1 + k % 7), len(base))).tolist(), 3) for k in range(80)]
    rows += [(6000 + k, rows[1][1], rows[1][2]) for k in range(5)]
    bad = [(7000, None, 1), (7001, [], 1), (7002, [0.0] * 64, 1), (7003, [None] + [1.0] * 63, 1), (7004, [float("nan")] + [1.0] * 63, 1), (7005, [float("inf")] + [1.0] * 63, 1), (7006, rows[0][1], None), (7007, [1.0, 2.0], 1), (7008, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumnRenamed("x", "y")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_vectors(df).collect()}
    sound = [r for r in rows + bad[-2:] if r[2] is not None]
    x = {r[0]: np.float32(r[1]).astype(float) for r in sound}
    x = {k: v / np.sqrt(v @ v) for k, v in x.items()}
    links = [(a[0], b[0]) for i, a in enumerate(sound) for b in sound[:i] if a[2] == b[2] and len(a[1]) == len(b[1]) and x[a[0]] @ x[b[0]] >= 0.98]
    n = Counter(v for link in links for v in link)
    root = roots([r[0] for r in rows + bad], links)
    assert got == {k: (n[k], root[k], root[k] == k) for k in root}
    assert len(links) > 500
    assert covertree.near_vectors(df.limit(0)).count() == 0


def test_cover_tree_prunes_exactly():
    rng = np.random.default_rng(2)
    p = covertree._unit(np.concatenate([rng.normal(size=(300, 8)), rng.normal(size=(1, 8)) + rng.normal(0, 0.05, (200, 8))]))
    a, b = covertree.Tree(p[:260]), covertree.Tree(p[260:])
    got = {(int(i), int(j)) for xs, ys in covertree.dual_pairs(a, b, False, 0.98) for i in xs for j in ys}
    assert got == set(zip(*map(list, np.nonzero(p[:260] @ p[260:].T >= 0.98)), strict=True))
    for node, kids in enumerate(a.children):
        assert all(a.radius[k] <= a.radius[node] / 2 + 1e-12 for k in kids)


def test_bpe_matches_library(docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.encode_texts(docs, path).collect()}
    brief = {r.doc_id: r for r in bpe.digests(docs, path).collect()}
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].ids == " ".join(map(str, ids)), r.doc_id
        assert got[r.doc_id].decoded == t.decode(ids, skip_special_tokens=False)
        assert brief[r.doc_id].n_tokens == len(ids) and brief[r.doc_id].ids_sha256 == hashlib.sha256(got[r.doc_id].ids.encode()).hexdigest()
    assert bpe.encode_texts(empty, path).count() == 0


def test_bpe_of_every_character():
    """All code points, also those that Python's Unicode tables do not know yet."""
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    t, codec = Tokenizer.from_file(path), bpe.BpeCodec(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 512):
        texts = [" ".join(f"a{chr(c)}B {chr(c)}" for c in points[k : k + 16]) for k in range(at, min(at + 512, len(points)), 16)]
        assert [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] == [[int(x) for x in ids.split()] for ids in codec.encode_batch(texts)[0]]


def test_words_kept_do_not_show(monkeypatch):
    """A cache that is always full gives the same ids; long words pass through it."""
    path = queries.tokenizer("word_bpe_49k.json")
    texts = [f"w{k % 7} x{k} {'long' * 40} w{k % 3}" for k in range(60)]
    whole = bpe.BpeCodec(path).encode_batch(texts)
    tight = bpe.BpeCodec(path)
    tight.ids.limit = tight.text.limit = 900
    assert [tight.encode_batch([t]) for t in texts] == [([a], [b]) for a, b in zip(*whole, strict=True)]
    assert tight.ids.old and not any(len(w) > 64 for w in tight.ids.room())


def test_byte_level_ids_match_library():
    from tokenizers import Tokenizer

    path, rng = queries.tokenizer("byte_bpe_50k.json"), random.Random(4)
    texts = ["", " ", "a  b", "x ", "a\n b", "it's, you'LL", "<|endoftext|> a<|endoftext|>", "\x1c \x85\u2003z", "é" * 700, " " * 200_000 + "x", "語 1²٣ ⅷ"]
    texts += ["".join(rng.choice(" \n\tab'é1!語\u0301\U0001f600") for _ in range(rng.randrange(80))) for _ in range(300)]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += [" ".join(f"a{chr(c)}b {chr(c)}1" for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    for as_text in (False, True):
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = as_text
        ids, bounds = tokens.Encoder(path, as_text).encode(texts, 7)
        for k, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == [*e.ids, 7]
    ids, bounds = tokens.encoder(path).encode([], 7)
    assert not len(ids) and bounds.tolist() == [0]


def test_segment_tree_merges_like_a_scan():
    rng = random.Random(5)
    for _ in range(300):
        merges, number = {}, {}
        for rank in range(12):
            pair = (rng.choice(["a", "b", "ab", "ba", "aa", "aba"]), rng.choice(["a", "b", "ab", "ba"]))
            a, b, c = (number.setdefault(x, len(number)) for x in (*pair, "".join(pair)))
            merges.setdefault((a, b), (rank, c))
        word = [number.setdefault(rng.choice("ab"), len(number)) for _ in range(rng.randrange(1, 40))]
        slow = word.copy()
        while found := [(merges[p][0], i) for i, p in enumerate(zip(slow, slow[1:])) if p in merges]:
            i = min(found)[1]
            slow[i : i + 2] = [merges[slow[i], slow[i + 1]][1]]
        assert bpe.merge_symbols(word, {a << 16 | b: (rank << 32, c) for (a, b), (rank, c) in merges.items()}) == slow


def test_mpeg_round_trip(docs, empty):
    got = {r.doc_id: r for r in mpeg.measure_media(mpeg.encode_media(docs)).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert g.n_frames == len(padded) // 192 and abs(g.duration_s - g.n_frames * 0.024) < 1e-9 and "bad_crc=0;skipped=0" in g.feature
    assert mpeg.measure_media(mpeg.encode_media(empty)).count() == 0


@pytest.mark.parametrize(("units", "at"), [(1, 89), (2, 137), (7, 89), (8, 137)])
def test_mpeg_trailer_mark_inside_the_last_frame(spark, units, at):
    payload = bytes(b"a" * 192 * (units - 1) + b"b" * at + b"TAG").ljust(192 * units - 5, b"c")
    data = mpeg.write_mpeg(payload)
    assert data[-128:-125] == b"TAG"
    for stream in (data, data + b"TAG" + b" " * 125):
        s = mpeg.read_mpeg(stream)
        assert mpeg.payload_of(stream, s) == mpeg.pad(payload) and (len(s.offsets), s.skipped, s.bad_crc) == (units, 0, 0)
    r = mpeg.measure_media(mpeg.encode_media(spark.createDataFrame([(1, payload.decode())], "doc_id long, text string"))).first()
    assert r.payload_sha256 == hashlib.sha256(mpeg.pad(payload)).hexdigest() and r.seek_every == mpeg.read_mpeg(data).offsets.tolist() and len(r.seek_every) == units


def test_mpeg_resynchronises():
    data = mpeg.write_mpeg(b"x" * 192 * 9)
    s = mpeg.read_mpeg(data)
    assert len(s.offsets) == s.table["frames"] == 9 and s.table["bytes"] == len(data) - s.offsets[0] + 288 and s.tags["TXXX:bytes"] == str(192 * 9)
    cut = int(s.offsets[4])
    torn = mpeg.read_mpeg(data[:cut] + b"\xff\xfb\x00junk\xff" + data[cut:] + b"TAG" + b" " * 125)
    assert len(torn.offsets) == 9 and torn.skipped == 8
    bad = bytearray(data)
    bad[int(s.offsets[2]) + 10] ^= 1
    assert mpeg.read_mpeg(bytes(bad)).bad_crc == 1
    assert len(mpeg.read_mpeg(b"").offsets) == 0 and mpeg.read_mpeg(b"\xff" * 50).skipped == 50
    assert mpeg.parse_header(int.from_bytes(bytes([0xFF, 0xFB, 0x90, 0x64]), "big"))[:3] == (417, 1152, 44100)


def test_mpeg_payloads_that_look_like_structure():
    """Marks of tags, tables and headers at every offset of the last block, and random payloads, come back whole."""
    rng = random.Random(6)
    for blocks in (1, 2):
        for mark in (b"TAG", b"ID3\x04\x00\x00", b"Xing", b"Info", b"VBRI", b"\xff\xfb\x94\xc0", b"\xff" * 9):
            for at in range(mpeg.UNIT - len(mark) + 1):
                data = b"x" * (mpeg.UNIT * (blocks - 1) + at) + mark
                stream = mpeg.read_mpeg(made := mpeg.write_mpeg(data))
                assert mpeg.payload_of(made, stream) == mpeg.pad(data) and stream.skipped == stream.bad_crc == 0
    for _ in range(200):
        data = bytes(rng.choice([0xFF, 0xFA, 0xFB, 0x54, 0x41, 0x47, 0, rng.randrange(256)]) for _ in range(rng.randrange(1200)))
        made = mpeg.write_mpeg(data)
        stream = mpeg.read_mpeg(made)
        assert mpeg.payload_of(made, stream) == mpeg.pad(data) and stream.seconds * 48000 == 1152 * len(stream.offsets)
        assert all(made[o : o + 2] == b"\xff\xfa" for o in stream.offsets.tolist())


def test_mpeg_rates_trailers_and_vbri():
    def frames(hz, n):  # MPEG-1 Layer III, 64 kbit/s, mono, without checksum
        size = 144 * 64_000 // [44100, 48000, 32000][hz]
        return [bytes([0xFF, 0xFB, 5 << 4 | hz << 2, 0xC0]) + bytes(size - 4) for _ in range(n)]

    assert mpeg.read_mpeg(b"".join(frames(1, 10) + frames(2, 10))).duration == pytest.approx(0.24 + 0.36, abs=1e-12)
    trailer = b"TAG" + b"name".ljust(30, b"\0") + b"who".ljust(30) + bytes(30) + b"1999" + b"note".ljust(28, b"\0") + b"\x00\x07" + b"\x11"
    audio = b"".join(frames(1, 3))
    stream = mpeg.read_mpeg(b"junk" + audio + trailer)
    assert stream.tags == {"ID3v1:title": "name", "ID3v1:artist": "who", "ID3v1:year": "1999", "ID3v1:comment": "note", "ID3v1:track": "7", "ID3v1:genre": "17"}
    assert stream.offsets.tolist() == [4, 196, 388] and stream.skipped == 4
    first = bytearray(frames(2, 1)[0])
    first[36:66] = b"VBRI" + bytes(6) + (3 * 192).to_bytes(4, "big") + (3).to_bytes(4, "big") + bytes([0, 2, 0, 1, 0, 2, 0, 2]) + bytes([1, 128, 0, 192])
    stream = mpeg.read_mpeg(bytes(first) + b"".join(frames(2, 3)))
    assert stream.table == {"frames": 3, "bytes": 576, "frames_per_entry": 2, "entry_bytes": [384, 192]} and len(stream.offsets) == 3
    # a stray header that the stream behind it does not bear out is no frame
    stray = frames(0, 1)[0][:4] + bytes(204) + frames(1, 1)[0][:4]
    assert mpeg.read_mpeg(stray + bytes(100) + audio).offsets.tolist()[-3:] == [len(stray) + 100 + 192 * k for k in range(3)]
    assert mpeg.read_mpeg(b"").duration == 0


def test_separator_scan(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    flat = token_counts.write_flat(docs, path, 50256, block_ids=700).persist()
    found = token_counts.manifest(flat).join(token_counts.separator_scan(flat, 50256), ["file", "ordinal"])
    assert {r.doc_id: r.n_tokens for r in found.collect()} == {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert token_counts.separator_scan(token_counts.write_flat(empty, path, 50256), 50256).count() == 0
    blocks = [(0, 0, [7, 9, 7]), (0, 1, []), (0, 2, [7, 7, 9]), (0, 3, [9, 5]), (1, 0, [4]), (2, 0, [9]), (3, 0, [])]
    df = spark.createDataFrame([(f, b, np.array(x, "<u2").tobytes()) for f, b, x in blocks] + [(4, 0, None)], "file long, block long, data binary")
    assert sorted((r.file, r.ordinal, r.start, r.n_tokens) for r in token_counts.separator_scan(df, 9).collect()) == [(0, 0, 0, 1), (0, 1, 2, 3), (0, 2, 6, 0), (0, 3, 7, 1), (1, 0, 0, 1), (2, 0, 0, 0)]


def test_language_id(spark, docs, empty):
    model = langid.fit(docs.filter(~langid.held_out()), "doc_id", "text", "lang")
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect() if r.lang and r.doc_id < 8000}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(held) > 20 and np.mean([got[k].lang_pred == truth[k] for k in held]) >= 0.95
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (9001, 9002, 9003, 9005))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(empty, "doc_id", "text", "lang")).collect()} == {"und"}
    one = docs.filter("lang = 'fr'")
    assert langid.predict(one, langid.fit(one, "doc_id", "text", "lang")).filter("lang_pred = 'fr'").count() == one.count()


def test_language_id_reads_whole_runs(spark):
    """Words glued into runs far over 64 letters: what stands behind a common beginning decides."""
    rng, words = random.Random(8), {"en": ["the", "which", "would", "through", "thought"], "de": ["nicht", "zwischen", "schön", "über", "straße"]}
    same = "x" * 80
    rows = [(k, same + "".join(rng.choice(words[lang]) for _ in range(n)), lang) for k, (lang, n) in enumerate((lang, n) for lang in words for n in [40] * 30 + [5000] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, "doc_id", "text", "lang")
    assert {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()} == {k: lang for k, _, lang in rows}
    for k, text, _ in rows[::7]:
        assert (langid.gram_counts(text) == grams_by_hand(text)).all() and (langid.gram_counts(text, 5) == grams_by_hand(text)).all()
    assert langid.gram_counts("1\u0301 _٣", 2) is None and langid.gram_counts("") is None


def grams_by_hand(text):
    """Counts of hashed 1- to 4-grams, character by character."""
    chars = [0, 0, 32]
    for c in text.lower() + " ":
        if c.isalpha() or chars[-1] != 32:
            chars.append(ord(c) if c.isalpha() else 32)
    n = np.zeros(langid.DIM, np.int64)
    for i in range(3, len(chars)):
        h = 0
        for k in range(4):
            h += chars[i - k] * 2654435761**k
            n[(h * int(langid.SPREAD[k]) & 0xFFFFFFFF) >> (32 - langid.BITS)] += 1
    return n


def language_by_hand(text, model):
    """Family by the largest decision value, then a vote of the pairs inside it."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    n = grams_by_hand(text)
    told = [sum((n[i] / n.sum()) ** 0.5 * model.weights[i, m] for i in np.flatnonzero(n)) + model.bias[m] for m in range(len(model.bias))]
    ranked = sorted(range(len(model.families)), key=lambda f: -told[f])
    inside = [x for x in model.langs if langid.FAMILY.get(x, x) == model.families[ranked[0]]]
    wins, least = Counter(), {x: 8.0 for x in inside}
    for m, (a, b) in enumerate(model.pairs, len(model.families)):
        if a in inside:
            wins[a if told[m] >= 0 else b] += 1
            least[a], least[b] = min(least[a], told[m]), min(least[b], -told[m])
    best = sorted(inside, key=lambda x: (wins[x], least[x], x))[-1]
    apart = told[ranked[0]] - told[ranked[1]] if len(ranked) > 1 else 8.0
    return best, 1 / (1 + np.exp(-2 * apart)) / (1 + np.exp(-2 * least[best]))


def test_language_id_like_a_slow_predictor(spark, docs, sf_dir):
    """Every row: label and score of the loop, repeated and odd rows included; extra columns stay, clashing ones give way."""
    model = langid.fit(docs.filter(~langid.held_out()), "doc_id", "text", "lang")
    again = docs.filter("doc_id < 40 or doc_id > 8999")
    rows = docs.filter("doc_id < 60 or doc_id between 8000 and 8110 or doc_id > 9000").unionAll(again).selectExpr("*", "key as score", "anchor as lang_pred").collect()
    assert len(rows) > 150
    got = langid.predict(spark.createDataFrame(rows), model)
    assert got.columns == [*docs.columns, "lang_pred", "score"]
    told = {}
    for r in got.collect():
        lang, score = told.setdefault(r.text, language_by_hand(r.text, model))
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-9) and 0 <= r.score <= 1
    # ties of ids, null ids and a tiny total sample: still one answer for equal texts
    twins = docs.select("text", "lang").withColumn("doc_id", F.lit(None).cast("long"))
    small = langid.fit(twins, "doc_id", "text", "lang", sample_total=8)
    assert small.langs == model.langs and langid.predict(twins, small).filter("lang_pred = 'und'").count() == langid.predict(docs, model).filter("lang_pred = 'und'").count()
    query = queries.op5_language_id(spark, sf_dir)
    assert query.filter("held_out is null or lang_pred is null").count() == 0


def word_sets(rows):
    out = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        out[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def jaccard_truth(rows):
    s = word_sets(rows)
    ids = sorted(s)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if s[a] and s[b] and min(len(s[a]), len(s[b])) * 5 >= 4 * max(len(s[a]), len(s[b])) and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    return {k: (len(s[k]), root) for k, root in roots(ids, links).items()}, links


def test_jaccard(docs, empty):
    truth, links = jaccard_truth(docs.collect())
    assert len(links) > 30
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs).collect()} == truth
    assert jaccard.jaccard_groups(empty).count() == 0


def test_jaccard_rounds_of_stars(spark):
    """A bucket full of chains and of members that only share a passage: later stars have to find what the first missed."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(120)]
    for k in range(60):
        if k % 12 == 0:
            words = base.copy()
        words = words.copy()
        words[(k * 17) % len(words)] = f"n{k}"
        rows.append((k, " ".join(words)))
    passage = base[:40]
    rows += [(100 + k, " ".join(passage + [rng.choice(vocabulary) for _ in range(12)])) for k in range(80)]
    rows += [(200 + k, " ".join(f"r{k}x{i}" for i in range(n))) for k, n in enumerate([1, 2, 5, 6, 7, 9, 9, 64, 65])] + [(300, rows[0][1]), (300, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    truth, _ = jaccard_truth(df.distinct().collect())
    got = jaccard.jaccard_groups(df).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == truth


def test_slices_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    for n in [1, 2, 3, 4, 5, 8, 20, 51, 63, 64, 100, 127, 128, 129, 160, 399, 400, 2000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = rng.integers(0, max(1, n // 9 + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, max(0, (n - drop) * 5 // 4 - n), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
                none = np.zeros(0, np.uint64)
                assert len(np.intersect1d(jaccard.slice_keys(a, none), jaccard.slice_keys(b, none)))


def check_packing(rows, truth):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(truth)
    for k, pieces in by_doc.items():
        ids, at = truth[k], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    room = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        room += 0 if at & (at - 1) == 0 else 1024 - at
    assert room == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    truth = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    check_packing(packing.pack(docs, path).collect(), truth)
    assert packing.pack(empty, path).count() == 0


def test_hilbert_curve_is_a_walk():
    side = 8
    cells = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_key(cells, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def suffix_truth(texts, n=200):
    seen = Counter(t[i : i + n] for t in texts.values() for i in range(len(t) - n + 1))
    out = {}
    for k, t in texts.items():
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[k] = (len(t), int(gone.sum()), spans, bytes(c for c, g in zip(t, gone, strict=False) if not g))
    return out


def test_suffix_dedup(docs, empty):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    truth = suffix_truth(texts)
    assert sum(v[1] for v in truth.values()) > 10_000
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == truth
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_edges(spark):
    """Low-entropy texts, periodic ones, strings of 199, 200 and 201 bytes, and two occurrences in one document."""
    rng = random.Random(9)
    s = lambda n: "".join(rng.choice("ab") for _ in range(n))
    p199, p200, p201 = s(199), s(200), s(201)
    rows = [f"x{p199}y", f"z{p199}w", f"1{p200}2", f"3{p200}4", f"5{p201}6", f"7{p201}8{s(300)}", "ab" * 300, "q" * 450, "é" * 150, "é" * 101 + s(50), p200 + "-" + p200, "é" * 99 + "ab" * 99]
    rows += ["".join(rng.choice(["abcdefghij" * 7, "klmno" * 9, "x"]) for _ in range(40)) for _ in range(12)]
    texts = {k: t.encode() for k, t in enumerate(rows)}
    df = spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == suffix_truth(texts)
    twice = suffix_dedup.remove_repeats(spark.createDataFrame([(1, s(500)), (1, s(0))], "doc_id long, text string").limit(1).crossJoin(spark.range(2)).drop("id")).collect()
    assert [r.n_removed for r in twice] == [500, 500]


def test_suffix_dedup_in_stretches(spark, monkeypatch):
    """Cells cut between stretches of a long text, and anchors dealt to many parts, change nothing."""
    rng = random.Random(21)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = {k: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(900))) + shared[k * 9 :][: 300 + 40 * k] * (1 + k % 2) + "z" * (k * 60) for k in range(12)}
    truth = {k: sum(spans[1] - spans[0] for spans in v) for k, v in suffix_spans({k: t.encode() for k, t in texts.items()}).items()}
    raw = np.frombuffer(texts[11].encode(), np.uint8)
    whole = suffix_dedup.cells(raw, 200, 64)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 97)
    cut = suffix_dedup.cells(raw, 200, 64)
    starts = [np.concatenate([np.arange(f, t + 1) for f, t in zip(c[0], c[1])]) for c in (whole, cut)]
    anchors = [np.concatenate([np.repeat(q, t - f + 1) for f, t, q in zip(c[0], c[1], c[2])]) for c in (whole, cut)]
    assert np.array_equal(*starts) and np.array_equal(*anchors)
    monkeypatch.undo()
    monkeypatch.setattr(suffix_dedup, "PART_CELLS", 1)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == truth
    hot = (np.array([5, 9], np.uint64), np.array([4, 1]))
    parts = suffix_dedup.salts_of(hot, np.array([5] * 50 + [9, 7], np.uint64), -3, np.arange(52))
    assert set(parts[:50].tolist()) == {1, 2, 3, 4} and parts[50:].tolist() == [1, 0]


def suffix_spans(texts, n=200):
    seen = Counter(t[i : i + n] for t in texts.values() for i in range(len(t) - n + 1))
    out = {}
    for k, t in texts.items():
        gone = sorted({j for i in range(len(t) - n + 1) if seen[t[i : i + n]] > 1 for j in range(i, i + n)})
        runs = [x for x in gone if x - 1 not in set(gone)], [x + 1 for x in gone if x + 1 not in set(gone)]
        out[k] = list(zip(*runs))
    return out


def test_url_filter(spark, sf_dir):
    odd = [(9001, None), (9002, "no scheme/en/"), (9003, "HTTP://WWW.Example.COM/en/7x?y=://a.net/de/"), (9004, "https://net/de/8"), (9005, "http://xexample.net/de/8"), (9006, "http://com?/en/"), (9007, "ftp://a.example.net/de/8#z"), (9008, "://org/es/")]
    df = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").union(spark.createDataFrame(odd, "page_id long, url string"))

    def truth(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:at].lower(), rest[at:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        return host, path, best and best.name, best.verdict if best else "allow"

    got = urlfilter.judge_urls(df, queries.RULES).collect()
    want = {r.page_id: truth(r.url) for r in df.collect()}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == want
    assert {v[2] for v in want.values()} >= {"com/en/", "net/de/", "org/es/", None}
    assert urlfilter.judge_urls(df.limit(0), queries.RULES).count() == 0
    assert urlfilter.judge_urls(df, []).filter("verdict = 'allow'").count() == df.count()


def test_warc(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows += [(9000, None, None), (9001, "", ""), (9002, "http://a/\r\nX: y", "é" * 500), (9003, "http://b:80/%0A?q", "é" * 500), (9004, "http://[bad", "é" * 500), (9005, "http://b/", "short\r\n\r\nWARC/1.1"), (9006, "x", "short\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    history = warc.archive_history(df)
    got = history.collect()
    best = {}
    for p, _, h in rows:
        best[h or ""] = max(p, best.get(h or "", p))
    for r, (page, url, html) in zip(sorted(got, key=lambda r: r.page_id), sorted(rows), strict=True):
        raw = (html or "").encode()
        again = len(raw) >= 1000 and best[html] != page
        assert (r.page_id, r.url, r.payload_bytes, r.payload_digest) == (page, url or "", len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", best[html]) if again else ("response", None))
    inorder = sorted(got, key=lambda r: r.place)
    assert [(r.url_key, r.stamp, r.page_id) for r in inorder] == sorted((r.url_key, r.stamp, r.page_id) for r in got)
    assert warc.archive_history(df.limit(0)).count() == 0


def test_warc_stamps(spark):
    """Captures of two URLs at mixed times, with ties, repeated rows and null times, come in order of URL key, time and page."""
    rng = random.Random(3)
    urls = ["http://b.example.com/x", "http://a.example.org/?q=1"]
    times = ["2024-03-01T10:00:00Z", "2023-12-31T23:59:59Z", "2024-03-01T09:59:59Z", None]
    rows = [(k, urls[rng.randrange(2)], f"<p>{rng.randrange(5)}" * rng.choice((1, 400)), rng.choice(times), "x") for k in range(300)]
    rows += [rows[0], rows[0], (None, urls[0], "none", times[0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, taken string, stamp string").repartition(5)
    got = sorted(warc.archive_history(df, stamp_col="taken").collect(), key=lambda r: r.place)
    want = sorted((warc.url_key(u), t or warc.EPOCH, k is not None, k or 0) for k, u, _, t, _ in rows)
    assert [(r.url_key, r.stamp, r.page_id is not None, r.page_id or 0) for r in got] == want
    assert {r.stamp for r in warc.archive_history(df).collect()} == {warc.EPOCH}


def test_loser_tree():
    rng = random.Random(6)
    for k in range(0, 12):
        runs = [sorted(rng.randrange(30) for _ in range(rng.randrange(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    base = docs.drop("anchor", "key")
    base.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.text for r in base.collect()}
    kept = {k: t for k, t in rows.items() if t and any(c.isalpha() for c in t)}
    truth, _ = jaccard_truth([r for r in base.collect() if r.doc_id in kept])
    kept = {k: t.encode() for k, t in kept.items() if truth[k][1] == k}
    left = {k: v[3].decode("utf-8", "ignore") for k, v in suffix_truth(kept).items()}
    t = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), {k: [*t.encode(x, add_special_tokens=False).ids, 0] for k, x in left.items() if x})
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_stages_keep_rows_without_ids_and_shared_ids(spark):
    import corpus_pipeline

    rng = random.Random(31)
    clean = ["".join(rng.choice("abcdefghij ") for _ in range(300)) for _ in range(5)]
    words = " ".join(f"w{k}" for k in range(60))
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def run(stage, rows):
        out = stage(spark, spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in rows], schema), "")
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        return Counter((r.doc_id, r.text, r.source, r.n_chars) for r in out.collect())

    def want(rows):
        return Counter((k, t, s, len(t or "")) for k, t, s in rows)

    stay = [(None, clean[0], "a"), (None, clean[0], "b"), (None, words, "c"), (7, clean[1], "d"), (7, clean[2], "e"), (2, words, "f"), (9, None, "g"), (9, "", "h")]
    go = [(7, words, "i"), (8, words + " w", "j"), (10, clean[1], "k")]
    assert run(corpus_pipeline.near_duplicates, stay + go) == want(stay)
    assert sum(run(corpus_pipeline.near_duplicates, [(5, words, "a")] * 3 + [(6, words, "a")]).values()) == 1

    both = "".join(rng.choice("klmnopqrst ") for _ in range(250))
    rows = [(None, clean[0], "a"), (None, "<" + both + ">", "b"), (7, clean[1], "c"), (7, clean[2] + both, "d"), (9, None, "e"), (9, "", "f"), (3, both, "g"), (4, clean[3], "h"), (4, clean[3], "h")]
    after = [(None, clean[0], "a"), (None, "<>", "b"), (7, clean[1], "c"), (7, clean[2], "d"), (9, None, "e"), (9, "", "f")]
    assert run(corpus_pipeline.repeated_passages, rows) == want(after)


def test_rows_without_ids_and_shared_ids(spark):
    """Null ids and ids that several texts share must not crash any operator, and give the results that docstrings state."""
    rng = random.Random(12)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(None, long), (None, "y" + long), (1, long + "tail"), (2, "two words here"), (2, "x" * 30), (2, long[:250]), (None, None), (3, "two words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = suffix_dedup.remove_repeats(df).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in cut) == sorted([(0, 400, 400), (0, 401, 400), (1, 404, 400), (2, 14, 0), (2, 30, 0), (2, 250, 250), (0, 0, 0), (3, 14, 0)])
    assert {r.n_removed for r in cut if r.doc_id is None} == {0, 400} and [r.n_removed for r in cut if r.doc_id == 1] == [400]
    groups = jaccard.jaccard_groups(df).collect()
    assert len(groups) == 8 and {r.component_id for r in groups if r.doc_id is None} == {None} and {r.component_id for r in groups if r.doc_id == 3} == {2}
    path = queries.tokenizer("byte_bpe_50k.json")
    assert packing.pack(df, path).select("doc_id", "sequence_id").count() >= 8
    assert token_counts.separator_scan(token_counts.write_flat(df, path, 50256), 50256).count() == 8
    assert bpe.digests(df, queries.tokenizer("word_bpe_49k.json")).count() == mpeg.measure_media(mpeg.encode_media(df)).count() == 8
    labelled = df.selectExpr("doc_id", "text", "'en' as lang")
    assert langid.predict(labelled, langid.fit(labelled, "doc_id", "text", "lang")).count() == 8
    pages = spark.createDataFrame([(None, "http://a/", "z" * 2000), (None, "http://a/", "z" * 2000), (4, "http://a/", "z" * 2000), (5, "http://a/", "z" * 2000), (5, "http://a/", "q" * 2000)], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.archive_history(pages).collect()) == [(0, "response", None), (0, "response", None), (4, "revisit", 5), (5, "response", None), (5, "response", None)]
    vectors = spark.createDataFrame([(None, [1.0, 2.0], 1), (7, [1.0, 2.0], 1), (8, [2.0, 4.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id or 0, r.n_links) for r in covertree.near_vectors(vectors).collect()) == [(0, 0), (7, 1), (8, 1)]


def test_extra_columns_with_inner_names(spark, sf_dir):
    """Input columns named like the operators' own intermediate ones, repeated rows and very long urls change no result."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").filter("page_id < 60")
    long = [(900, "http://example.com/en/" + "7" * 50_000, "x" * 3000), (901, "ftp://A.NET/de/8?" + "q" * 20_000, None), (902, None, "y"), (903, "no scheme", "x" * 3000), (902, None, "y")]
    pages = pages.select("page_id", "url", "html").union(spark.createDataFrame(long, "page_id long, url string, html string"))
    names = ["host", "path", "rule", "verdict", "best", "payload", "payload_digest", "refers_to", "n", "stamp", "place", "archive", "url_key", "copies", "data"]
    odd = pages.withColumns({c: F.lit("x") for c in names})
    plain, clash = (sorted(map(tuple, urlfilter.judge_urls(p, queries.RULES).collect()), key=str) for p in (pages, odd))
    assert plain == clash and len(plain) == pages.count()
    told = {r[0]: r[3:] for r in plain}
    assert told[900] == ("example.com/en/7", "allow") and told[901] == ("net/de/", "allow") and told[902] == told[903] == (None, "allow")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    plain, clash = (sorted(map(tuple, warc.archive_history(p).select(*columns).collect()), key=str) for p in (pages, odd))
    assert plain == clash and [r[3:] for r in plain if r[0] in (900, 903)] == [("revisit", 903), ("response", None)]
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    odd = vectors.withColumns({c: F.lit(1) for c in ("rep", "key", "v", "sound", "cell", "chunk", "n", "n_links", "component_id", "kept", "pivot", "a", "b")})
    plain, clash = (sorted(map(tuple, covertree.near_vectors(p).collect()), key=str) for p in (vectors, odd))
    assert plain == clash
    texts = [(1, "one two three four five six seven"), (2, "one two three four five six seven"), (3, "p" * 450), (4, "q" + "p" * 450), (5, None), (6, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    odd = df.withColumns({c: F.lit("x") for c in ("row", "runs", "first", "last", "rep", "digest", "sketch", "keys", "hot_keys", "curve", "ids", "id", "kept", "anchor", "salt", "word", "bits", "media", "v", "score")})
    path = queries.tokenizer("byte_bpe_50k.json")
    for f in (jaccard.jaccard_groups, suffix_dedup.remove_repeats, lambda d: packing.pack(d, path), lambda d: mpeg.measure_media(mpeg.encode_media(d)), lambda d: bpe.digests(d, queries.tokenizer("word_bpe_49k.json"))):
        assert sorted(map(str, f(df).drop("sequence_id", "offset").collect())) == sorted(map(str, f(odd).drop("sequence_id", "offset").collect()))
