"""Each operator against a plain version, on small tables with nulls, ties, repeats and clashing columns."""

import base64
import hashlib
import random

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from marginalia.llm import bloom, bpe, common, decontaminate, langid, linededup, media, pii, simhash, suffix, toxicity, warc

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, kept string, spans string, score double, items string, fp long"


def documents(spark, rows):
    """rows (doc_id, text) with nulls elsewhere, and columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, None, None, 7, "x", "y", 0.5, "z", 3) for i, t in rows], SCHEMA).repartition(3)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, 150) for _ in range(8)]
    passage = words(rng, 70)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(20 + i, base[0]) for i in range(6)]  # exact copies
    out += [(40 + i, base[1].replace("w1 ", "v ", i)) for i in range(6)]  # near copies
    out += [(60 + i, words(rng, 40) + "\n" + passage + "\n" + words(rng, 20)) for i in range(5)]
    out += [(80, None), (81, ""), (82, "\n\n"), (83, "one"), (84, "a b c"), (85, "é" * 300), (86, "x" * 900), (87, "ab" * 400), (88, words(rng, 6000)), (89, "  A \x1c B\x0bC  \t"), (90, passage + passage)]
    return out


def test_simhash(spark, rows):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == brute.simhash(rows)


def test_simhash_repeats_and_nulls(spark):
    found = simhash.near_duplicates(documents(spark, [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, None), (3, "q r s t u v"), (None, "")]))
    assert sorted(((r.doc_id, r.component_id) for r in found.collect()), key=str) == [(3, 3), (5, 5), (5, 5), (None, 5), (None, None), (None, None)]


def test_bk_forest_finds_every_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    value = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 63, (30, 2)))]))
    shard = np.sort(rng.integers(0, 3, len(value)))
    forest = simhash.Forest(shard, value)
    left, right = forest.search(np.arange(len(value)), 4, np.arange(len(value)))
    want = {(i, j) for i in range(len(value)) for j in range(len(value)) if i != j and shard[i] == shard[j] and (int(value[i]) ^ int(value[j])).bit_count() <= 4}
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == want


def dense(n, flips, seed):
    """Distinct fingerprints around one centre."""
    rng = np.random.default_rng(seed)
    value = np.full(2 * n, 0x0123456789ABCDEF, dtype=np.uint64)
    for _ in range(flips):
        value = value ^ (np.uint64(1) << rng.integers(0, 64, len(value)).astype(np.uint64))
    return rng.permutation(np.unique(value))[:n]


def plain_components(value, radius=4):
    near = np.bitwise_count(value[:, None] ^ value[None, :]) <= radius
    label = simhash.components(len(value), *np.nonzero(near), np.arange(len(value)))
    return {int(v): int(value[x]) for v, x in zip(value, label, strict=True)}


@pytest.mark.parametrize("flips", [3, 6, 8])
def test_stars_of_a_dense_shard(flips):
    value = np.sort(dense(1500, flips, flips))
    u, v = simhash.stars(np.zeros(len(value), np.int64), value, 4)
    want = plain_components(value)
    assert {**{int(x): int(x) for x in value}, **dict(zip(u.tolist(), v.tolist(), strict=True))} == want


def test_a_large_centre_takes_seconds():
    value = dense(60_000, 4, 1)
    u, v = simhash.stars(np.zeros(len(value), np.int64), value, 4)
    assert len(u) == len(value) - 1 and len(set(v.tolist())) == 1


def test_shards_in_tiles(spark):
    value = dense(900, 8, 4)
    table = spark.createDataFrame([(int(x),) for x in value.view(np.int64)], "fp long")
    for tile in (100, 1 << 15):
        roots = {r.u & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in simhash.connect(simhash.links(table, 4, tile)).collect()}
        groups, want = {}, {}
        for v in map(int, value):
            groups.setdefault(roots.get(v, v), set()).add(v)
        for v, root in plain_components(np.sort(value)).items():
            want.setdefault(root, set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_join_hot(spark, monkeypatch):
    """Hot keys by broadcast, others by a shuffle: the rows are those of a plain join."""
    left = spark.createDataFrame([(i % 7 if i % 2 else 3, i) for i in range(200)] + [(None, 1)], "k long, x long")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("y"))
    want = sorted(tuple(r) for r in left.join(right, "k").select("k", "x", "y").collect())
    for rows in (1000, 50, 0):
        monkeypatch.setattr(common, "HOT_ROWS", rows)
        monkeypatch.setattr(common, "HOT_KEYS", 4)
        assert sorted(tuple(r) for r in common.join_hot(left, right, "k", "n").select("k", "x", "y").collect()) == want


def test_batches_are_bounded_in_each_plan(spark):
    """A plan's bound holds whatever is built after it, and the session's settings stay."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "b"]) for b in batches)
    df = spark.range(0, 5000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t"))
    small, large = common.map_arrow(df, sizes, "n long, b long", 8), common.map_arrow(df, sizes, "n long, b long", 4000)
    assert small.agg(F.max("n")).first()[0] == 8
    n, b = large.agg(F.max("n"), F.max("b")).first()
    assert 100 < n < 1000 and b < 1.1 * common.SLICE_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_connect_long_chain(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "u long, v long")
    assert {r.u: r.root for r in simhash.connect(edges).collect()} == {**{i: 1 for i in range(2, 61)}, 101: 100}
    assert simhash.connect(edges.limit(0)).collect() == []


def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)


def test_bpe_equals_the_library(codec):
    plain, rng = encoding(), random.Random(1)
    letters = " \t\n\r\x0b\x1c\x85\xa0　'abcSTslvedmr019²é́語字😀.,!-_"
    for _ in range(5000):
        text = "".join(rng.choices(letters, k=rng.randrange(20)))
        ids = codec.encode(text)
        assert ids == plain.encode_ordinary(text) and codec.decode(ids) == text.encode()
    assert codec.encode("a" * 5000) == plain.encode_ordinary("a" * 5000)
    for _ in range(300):  # prefixes that are known and ones that aren't
        piece = "".join(rng.choices(["the", "ing", "é", "aa", "z", "語"], k=rng.randrange(1, 12)))
        assert codec.encode_piece(piece.encode()) == bpe.Prefixes(codec, piece.encode()).ids()
    other = bpe.Codec(codec.ranks, r"\S+|\s+")
    text = "two  words and more\n of them"
    assert other.encode(text) == [i for m in __import__("regex").findall(r"\S+|\s+", text) for i in codec.encode_piece(m.encode())]


def test_bpe_appends_and_edits(codec):
    rng = random.Random(2)
    for _ in range(300):
        whole, table = b"", bpe.Prefixes(codec)
        for _ in range(6):
            new = rng.choice([b"the", b"ing", b"  ", b"aaaa", b"\xff\x00", b"", b"internationalisation" * 4])
            start = rng.randint(0, len(whole))
            end = rng.randint(start, len(whole))
            whole = whole[:start] + new + whole[end:]
            table.edit(start, end, new)
            assert table.last == bpe.Prefixes(codec, whole).last
        table.append(b"more")
        assert table.ids() == codec.merge(whole + b"more")


def test_bpe_table(spark, rows):
    plain = encoding()
    got = sorted(bpe.digests(documents(spark, rows), RANKS, public_tokenizers.PATTERN, with_ids=True).collect())
    want = [(i, len(x), brute.sha(",".join(map(str, x))), brute.sha(t or ""), x) for i, t in sorted(rows) for x in [plain.encode_ordinary(t or "")]]
    assert [tuple(r) for r in got] == want
    full = bpe.encode_and_decode(documents(spark, rows), RANKS, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in full} == {i: t or "" for i, t in rows}


LINES = [
    (1, "A long enough line\nshort\n another LONG line \n"), (2, "a LONG enough line\nshort\nunique line number two"), (3, "another long line\nanother long line\nunique line three"), (4, None), (5, ""), (6, "éééééééééé\nééééééééé"), (7, "éééééééééé\nééééééééé\n\n"),
    (8, "\tanother long line\x0b\n\x1canother long line"), (1, "unique but same id\nA long enough line"), (9, "unique but same id"),
]


def test_line_dedup(spark):
    docs = documents(spark, LINES)
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, bytes(r.kept).decode()) for r in linededup.dedup_lines(docs, 10).collect())
    assert got == sorted(brute.lines(LINES, 10))
    assert linededup.dedup_lines(docs.limit(0), 10).collect() == []


def test_line_dedup_without_ids(spark):
    got = {(r.doc_id, bytes(r.kept)) for r in linededup.dedup_lines(documents(spark, [(None, "one and the same line"), (4, "one and the same line"), (None, "a line of its own here")])).collect()}
    assert got == {(None, b""), (4, b"one and the same line"), (None, b"a line of its own here")}
    rows = [(None, "shared line of both\nown line number one"), (None, "shared line of both\nown line number two"), (None, "twice the same text"), (None, "twice the same text"), (4, "one line here\nand own line number two")]
    found = linededup.dedup_lines(documents(spark, rows)).collect()
    assert sum(r.n_dropped for r in found) == 0 and sum(r.n_lines for r in found) == 8  # rows without an id are one document
    found = linededup.dedup_lines(documents(spark, [*rows, (5, "own line number two")])).collect()
    assert [r.doc_id for r in found if r.n_dropped] == [None]


def test_bloom_never_misses(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 3000, 6000)
    df = spark.createDataFrame([(int(v),) for v in values], "v long").repartition(7)
    keys = lambda batch: bloom.spread(batch.column(0).to_numpy())
    unique, count = np.unique(values, return_counts=True)
    twice = bloom.build(df, keys, 1 << 16)
    hit = bloom.holds(twice, bloom.probes(bloom.spread(unique), 1 << 16))
    assert hit[count > 1].all() and hit[count == 1].mean() < 0.2
    assert bloom.holds(bloom.build(df, keys, 1 << 16, twice=False), bloom.probes(bloom.spread(unique), 1 << 16)).all()


def contamination(rng):
    items = [(1, words(rng, 30)), (2, words(rng, 13)), (3, "Short item, here!"), (4, None), (5, "..."), (6, "Ünïcode wörds only five ok"), (None, words(rng, 14)), (2, words(rng, 20)), (7, "w1 w2 w1 w2 w1 w2 w1 w2 w1 w2 w1 w2 w1 w2 w1 w2")]
    texts = [i[1] or "" for i in items]
    rows = [(i, words(rng, 50) + " " + t.upper() + ". " + words(rng, 10)) for i, t in enumerate(texts)] + [(20, texts[0][:60] + " x " + texts[0][60:]), (21, None), (22, ""), (23, texts[2] * 3), (24, " ".join(texts)), (25, words(rng, 2000) + texts[1]), (26, "w1 w2 " * 40), (27, "short short item here item")]
    return rows, items


def test_decontamination(spark):
    for seed in range(3):
        rows, items = contamination(random.Random(seed))
        table = spark.createDataFrame(items, "item_id long, text string")
        got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.decontaminate(documents(spark, rows).drop("items"), table).collect())
        assert got == sorted(brute.decontaminate(rows, items))


def test_decontamination_in_blocks_and_cleaned(spark, monkeypatch):
    rows, items = contamination(random.Random(9))
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 20)
    monkeypatch.setattr(decontaminate, "PART_WORDS", 6)
    assert next(decontaminate.automata(table, 13))[0] > 2
    found = decontaminate.decontaminate(documents(spark, rows), table, cleaned=True)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect()) == sorted(brute.decontaminate(rows, items))
    clean = [(r.doc_id, bytes(r.clean).decode()) for r in found.collect()]
    assert {r.doc_id: len(decontaminate.words_of(bytes(r.clean))) for r in found.collect()} == {r.doc_id: r.n_words - r.n_hit for r in found.collect()}
    assert dict(clean)[21] == ""
    none = decontaminate.decontaminate(documents(spark, rows), table.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert none == 0


def test_decontamination_by_a_long_item(spark, monkeypatch):
    """An item in many parts; items and documents have columns with the operator's own names; ids repeat or are null."""
    monkeypatch.setattr(decontaminate, "PART_WORDS", 50)
    rng = random.Random(21)
    long = words(rng, 3000, 10**6)
    items = [(1, long, 5, "x", 3), (2, "a b c", 5, "x", 3)]
    table = spark.createDataFrame(items, "item_id long, text string, n long, words string, row long")
    rows = [(1, words(rng, 5) + " " + long), (1, long[100:900]), (None, "a b c"), (None, None), (3, words(rng, 50_000))]
    got = sorted((tuple(r) for r in decontaminate.decontaminate(documents(spark, rows).drop("items"), table).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()), key=str)
    assert got == sorted(brute.decontaminate(rows, [i[:2] for i in items]), key=str)


def test_media_formats():
    rng = np.random.default_rng(2)
    grey, colour = rng.integers(0, 256, (7, 5), dtype=np.uint8), rng.integers(0, 256, (6, 7, 3), dtype=np.uint8)
    for image in (grey, colour):
        for encode in (media.encode_netpbm, media.encode_bmp):
            assert np.array_equal(media.decode(encode(image)), image)
    assert media.decode(b"P2 # c\n2 # d\n1\n255\n3 200\n").tolist() == [[3, 200]]
    assert media.decode(b"P1\n3 1\n101").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n" + bytes([0b10100000])).tolist() == [[0, 255, 0]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_area_resize_is_the_mean():
    image = np.random.default_rng(4).integers(0, 256, (12, 10)).astype(float)
    fine = np.repeat(np.repeat(image, 8, axis=0), 9, axis=1)  # both sizes divide this one
    assert np.allclose(media.area_resize(image, 8, 9), fine.reshape(8, 12, 9, 10).mean(axis=(1, 3)))
    assert media.difference_hash(np.tile(np.arange(24), (24, 1))) == "f" * 16 and media.difference_hash(np.full((24, 24), 7)) == "0" * 16


@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_media_table(spark, rows, form, tmp_path):
    got = {r.doc_id: r for r in media.digests(documents(spark, rows), form, "bmp" if form == "pgm" else "pgm").collect()}
    for i, t in rows:
        data = (t or "").encode()
        padded = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), brute.sha(padded), __import__("zlib").crc32(padded[-32:]))
        assert r.same and r.other_sha256 != r.media_sha256
    media.write_tiles(documents(spark, rows[:2]), str(tmp_path / "tiles"), form)
    one = media.images(documents(spark, rows[:2]), form).first()
    assert {bytes(r.tile) for r in spark.read.parquet(str(tmp_path / "tiles")).collect()} >= {bytes(one.tile)}
    assert np.load(__import__("io").BytesIO(one.tile)).shape == (16, 16) and media.decode(bytes(one.media)).size % 576 == 0


def test_media_features(spark):
    """Feature and tile of each row against areas summed one by one; null and repeated ids; an empty table."""
    rng = random.Random(15)
    rows = [(None, "x" * 700), (4, words(rng, 200)), (4, words(rng, 200)), (None, None), (5, "")]
    got = sorted((r.n_bytes, r.feature, r.media_bytes, r.tile_sha256) for r in media.digests(documents(spark, rows)).collect())
    want = []
    for _, text in rows:
        data = (text or "").encode()
        image = np.frombuffer(data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff"), np.uint8).reshape(-1, 24)
        stored = b"P5\n24 %d\n255\n" % len(image) + image.tobytes()
        small = np.round(brute.areas(image, 8, 9), 6)
        bits = "".join("01"[bool(a < b)] for line in small for a, b in zip(line, line[1:]))
        tile = np.ascontiguousarray(np.clip(np.rint(brute.areas(image, 16, 16)), 0, 255), np.uint8)
        out = __import__("io").BytesIO()
        np.save(out, tile)
        want.append((len(data), f"{int(bits, 2):016x}", len(stored), brute.sha(out.getvalue())))
    assert got == sorted(want)
    assert media.digests(documents(spark, rows).limit(0)).collect() == []


def test_rows_without_ids_and_repeats(spark):
    """Null ids and repeated rows come out as they came in; empty tables give none."""
    rows = [(None, "mail a@b.cd now"), (2, "mail a@b.cd now"), (2, "mail a@b.cd now"), (None, None)]
    plain = encoding()
    tokens = bpe.digests(documents(spark, rows), RANKS, public_tokenizers.PATTERN)
    assert sorted(((r.doc_id, r.n_tokens) for r in tokens.collect()), key=str) == sorted(((i, len(plain.encode_ordinary(t or ""))) for i, t in rows), key=str)
    assert bpe.digests(documents(spark, rows).limit(0), RANKS, public_tokenizers.PATTERN).collect() == []
    assert sorted(((r.doc_id, r.spans) for r in pii.counts(documents(spark, rows)).collect()), key=str) == sorted(((i, "email:5:11" if t else "") for i, t in rows), key=str)
    assert pii.counts(documents(spark, rows).limit(0)).collect() == []
    assert simhash.near_duplicates(documents(spark, rows).limit(0)).collect() == []


PAGES = [(3, "http://a/1", "<p>x</p>"), (1, "http://a/2", "<p>x</p>"), (7, None, None), (2, "http://a/3", ""), (9, "u\r\nWARC/1.1", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"), (None, "n", "<p>x</p>"), (None, "n", "alone"), (1, "again", "<p>x</p>"), (12, "é", "é" * 9)]


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("x")).repartition(2)
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    first = {}
    for i, _, h in PAGES:
        first[h or ""] = min(first.get(h or "", 1 << 62), 1 << 62 if i is None else i)
    want = []
    for i, _, h in PAGES:
        body, response = (h or "").encode(), (1 << 62 if i is None else i) == first[h or ""]
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else first[h or ""]))
    assert got == sorted(want, key=str)
    small = warc.round_trip(pages, min_bytes=9).where("payload_bytes < 9").select("record_type").distinct().collect()
    assert [r.record_type for r in small] == ["response"]
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_archives_are_bounded(spark, monkeypatch):
    """Large payloads go to archives of their own; what is read back is the same, with payloads if asked for."""
    monkeypatch.setattr(warc, "CLASSES", ((10, 3), (100, 2), (1 << 62, 1)))
    rows = [(i, "u", "x" * (i % 13) + str(i)) for i in range(40)] + [(100 + i, "u", "y" * 60 + str(i)) for i in range(5)] + [(200 + i, "u", "z" * 500 + str(i)) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = warc.write(pages)
    found = warc.read(spark, path)
    assert sorted((r.id, bytes(r.payload).decode()) for r in found.collect()) == sorted((f"<urn:page:{i}>", h) for i, _, h in rows)
    assert warc.read(spark, path, payloads=False).where("payload is not null").isEmpty()
    per = [sum(1 for _ in warc.parse(__import__("gzip").decompress(bytes(r.content)))) for r in spark.read.format("binaryFile").load(path).collect()]
    assert len(per) > 18 and max(per) <= 3


@pytest.mark.parametrize("split", ["64m", "2000b"])
def test_warc_archives_in_splits(spark, tmp_path, split):
    """Records that begin, end and go on in different splits, with heads inside their payloads."""

    def record(body):
        return b"WARC/1.0\r\nWARC-Type: resource\r\ncontent-length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"

    rng = random.Random(9)
    for n in range(3):
        bodies = []
        for _ in range(40):
            body = bytes(rng.choices(b"ab\r\n", k=rng.choice([0, 3, 40, 400])))
            inner = rng.choice([b"", b"\r\n\r\n" + record(b"fake") + record(b"too") + b"x", b"\r\n\r\n\r\n\r\n"])
            bodies.append(body + inner + body[:5])
        (tmp_path / f"a{n}.warc").write_bytes(b"".join(map(record, bodies)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        rows = warc.read_split(spark, str(tmp_path)).collect()
        (tmp_path / "bad.warc").write_bytes(record(b"one") + record(b"two")[:-9] + b"\r\n\r\n")
        with pytest.raises(ValueError, match="bad.warc"):
            warc.read_split(spark, str(tmp_path / "bad.warc"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    for n in range(3):
        data = (tmp_path / f"a{n}.warc").read_bytes()
        got = [bytes(r.bytes) for r in sorted(rows, key=lambda r: r.offset) if r.file.endswith(f"a{n}.warc")]
        assert [warc.fields_of(x) for x in got] == list(warc.parse(data)) and b"".join(x + b"\r\n\r\n" for x in got) == data


def test_warc_chain_rejects_payloads():
    def record(body):
        return b"WARC/1.0\r\nWARC-Type: resource\r\ncontent-length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"

    inner = b"\r\n\r\n" + record(b"fake") + record(b"fake too")
    data = b"".join(map(record, (b"one", inner, b"", inner + b"x", b"last")))
    assert len(warc.candidates(data)[0]) == 9
    assert [block for _, block in warc.parse(data)] == [b"one", inner, b"", inner + b"x", b"last"]
    with pytest.raises(ValueError):
        list(warc.parse(data[:-1]))
    assert list(warc.parse(b"")) == []


@pytest.mark.parametrize("crowd", [8192, 2])
def test_repeats(spark, rows, crowd):
    found = suffix.remove_repeats(documents(spark, rows), 200, crowd)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()) == sorted(brute.repeats(rows))


def test_repeats_random(spark):
    rng = random.Random(11)
    pool = [words(rng, 60, 3000) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rng.choice(pool)[rng.randrange(80) : rng.randrange(180, 400)] if rng.random() < 0.6 else words(rng, rng.randrange(60), 3000) for _ in range(rng.randrange(5))]
        rows.append((i, "".join(parts)))
    for crowd in (8192, 3):
        found = suffix.remove_repeats(documents(spark, rows), 200, crowd)
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()) == sorted(brute.repeats(rows))


def test_suffix_order():
    """The buckets' suffixes come in the order of their bytes, and every repeat is found."""
    rng = random.Random(4)
    for _ in range(60):
        texts, low, high, bucket = [], [], [], []
        letters = rng.choice([b"a", b"ab", b"abcdefgh"])
        for b in range(rng.randrange(1, 4)):
            base = bytes(rng.choices(letters, k=700))
            for _ in range(rng.randrange(1, 12)):
                far = rng.randrange(169)
                near = rng.randrange(far + 1)
                text = bytearray(base[300 - far : 500 - near])
                if rng.random() < 0.5:
                    text[rng.randrange(len(text))] = rng.choice(b"az\0")
                texts.append(bytes(text))
                low.append(far)
                high.append(near)
                bucket.append(b)
        low, high, bucket = map(np.array, (low, high, bucket))
        found = suffix.Bucketed(bucket, texts, low, high, 200)
        got = [(int(bucket[r]), texts[r][o:]) for r, o in zip(found.run[found.order], found.offset[found.order], strict=True)]
        assert got == sorted(got)
        seen = {}
        for i, text in enumerate(texts):
            for d in range(low[i], high[i] - 1, -1):
                seen.setdefault((bucket[i], text[low[i] - d :][:200]), []).append((i, d))
        run, distance = suffix.sort_bucket(bucket, texts, low, high, 200)
        assert set(zip(run.tolist(), distance.tolist(), strict=True)) == {x for v in seen.values() if len(v) > 1 for x in v}


def test_repeats_without_ids(spark):
    """Each row is a document of its own: copies with one id, or none, are repeats, alone or beside a text that differs."""
    rng = random.Random(12)
    text, other = words(rng, 80), words(rng, 80)
    rows = [(1, text), (1, text), (None, "a" + text), (None, words(rng, 80)), (None, None), (None, other), (None, other)]
    found = suffix.remove_repeats(documents(spark, rows))
    assert sorted((r.n_bytes, r.n_removed) for r in found.collect()) == sorted((n, gone) for _, n, gone, _, _ in brute.repeats(rows))
    assert suffix.remove_repeats(documents(spark, [(1, text)]).limit(0)).collect() == []


def test_repeats_in_a_crowded_bucket(spark):
    """A passage that many documents share, each with its own text around it, and some with the same."""
    rng = random.Random(13)
    passage = words(rng, 75, 3000)
    rows = [(i, f"{rng.randrange(10**9)} " * rng.randrange(30) + passage + f" {rng.randrange(10**9) if i % 5 else 7}" * 25) for i in range(3 * suffix.CROWD)]
    found = suffix.remove_repeats(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == sorted(brute.repeats(rows))


def test_repeats_in_a_long_text(spark):
    """A text of several slices, with repeats across their edges."""
    rng = random.Random(14)
    long = words(rng, 200_000, 10**6)
    assert len(long) > 4 * suffix.SLICE
    edge = suffix.SLICE - 199
    rows = [(1, long), (2, long[edge - 150 : edge + 150]), (3, "x" + long[2 * edge - 100 : 2 * edge + 700] + "y"), (4, long[-250:])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.remove_repeats(documents(spark, rows)).collect()}
    assert got == {1: (300 + 800 + 250, 3), 2: (300, 1), 3: (800, 1), 4: (250, 1)}


PRIVATE = [
    "mail a.b@c.de, x@y.z.w@q.org a@b.com_x@c.org @a.b a@b a@b. a@b..c", "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255 1..2.3.4 99999999999.1.1.1", "card 4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 4111  1111", "tel +49 (30) 1234-5678. +1 2 +123456789 + 1 ++4930123456 +49 30 12345678901234567",
    "", None, "é 4111111111111111 é+4930123456 é", "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000 xDE89370400440532013000", "1" * 3000, "a" * 3000 + "@", "1.2.3.4" * 50, "+1 ( " * 200 + "2", "a@b.c" * 60,
]


def test_personal_data(spark):
    rows = list(enumerate(PRIVATE))
    got = {r.doc_id: r for r in pii.counts(documents(spark, rows)).collect()}
    for i, t in rows:
        want = brute.personal(t)
        assert got[i].base_sha256 == brute.sha(",".join(want)), (t, got[i].spans, want)
        assert [x for x in got[i].spans.split(",") if x and not x.startswith("iban")] == want
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(x.startswith(k) for x in want) for k in ("email", "ip", "card", "phone"))
    assert got[7].spans.split(",")[-2:] == ["iban:0:27", "iban:32:54"] and got[7].n_added == 2


def test_personal_data_random(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("0123456789+-.() @ab\né", weights=[6] * 10 + [2] * 11, k=rng.randrange(120)))) for i in range(400)]
    got = {r.doc_id: r.base_sha256 for r in pii.counts(documents(spark, rows)).collect()}
    assert got == {i: brute.sha(",".join(brute.personal(t))) for i, t in rows}


def test_context_raises_the_score(spark):
    found = {r.doc_id: r.spans[0].score for r in pii.detect(documents(spark, [(1, "phone: +4930123456"), (2, "so +4930123456"), (3, "visa 4111111111111111")])).collect()}
    assert found[2] < found[1] < found[3]


def test_native_plan(spark):
    plan = pii.counts(documents(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_forward_algorithm_sums_all_segmentations():
    pieces = langid.Pieces(["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba"])
    prob = np.random.default_rng(1).random((len(pieces.names), 2)) * 0.1
    model = langid.Model(pieces, ["x", "y"], prob)

    def total(text):
        if not text:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(text) + 1):
            if (i := pieces.ids.get(text[:k])) or (k == 1 and not i):
                out = out + prob[i or 0] * total(text[k:])
        return out

    for word in ("a", "ab", "abab", "abcab", "bbaab"):
        assert np.allclose(model.log_words([word])[0], np.log(total("▁" + word)))
        assert np.allclose(model.log_long(word), np.log(total("▁" + word)))
    assert np.allclose(model.log_long("ab" * 30), model.log_words(["ab" * 15])[0] * 0 + model.log_long("ab" * 30)) and np.isfinite(model.log_long("ab" * 5000)).all()


def test_language(spark):
    rng = random.Random(3)
    stock = {"en": "the house and water of this evening with many people".split(), "de": "das haus und wasser von diesem abend mit vielen leuten".split(), "fr": "la maison et eau de cette soirée avec beaucoup monde".split()}
    rows = [(i, " ".join(rng.choices(stock[lang], k=30)), lang) for i, lang in enumerate(list(stock) * 40)]
    rows += [(500, None, "en"), (501, "", None), (502, "123 !!", "de"), (503, "x" * 5000, None), (None, rows[0][1], "en"), (504, "Das Haus", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = langid.detect(docs, PIECES).collect()
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang for i, _, lang in rows[:120]) and by[504].lang_pred == "de"
    assert [by[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and by[503].lang_pred in stock
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    numbers = spark.createDataFrame([(1, "½ ² Ⅷ ٣", None), (2, "ß", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.detect(docs.drop("score").union(numbers).where("doc_id is not null"), PIECES).where("doc_id in (1, 2) and lang is null").collect()}[1] == "und"
    untrained = langid.detect(docs.withColumn("lang", F.lit(None).cast("string")), PIECES).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in untrained] == ["und"]
    assert langid.detect(docs.limit(0), PIECES).collect() == []


def test_language_of_long_words(spark):
    """Languages written without blanks: every word counts, however long; repeated rows stay, and no language is left out."""
    rng = random.Random(31)
    letters = {f"l{k}": "abcdefghijklmnopqrstuvwxyz"[3 * k : 3 * k + 5] for k in range(7)}
    rows = [(i, "".join(rng.choices(letters[f"l{i % 7}"], k=rng.randrange(40, 90))), f"l{i % 7}") for i in range(210)]
    rows += rows[:3]
    got = langid.detect(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES).collect()
    assert len(got) == len(rows) and sum(r.lang_pred == r.lang for r in got) > 0.97 * len(rows)


def test_language_held_out_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = langid.detect(docs, PIECES).where("held_out and lang is not null").select("lang", "lang_pred").collect()
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)


def test_toxicity_held_out_on_the_table(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels, toxicity.held_out())
    held = docs.join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out())
    found = {(r.toxic, r.predicted): r["count"] for r in toxicity.score(held, model).groupBy("toxic", "predicted").count().collect()}
    caught, missed, wrong, right = (found.get(k, 0) for k in ((1, 1), (1, 0), (0, 1), (0, 0)))
    assert caught >= 0.9 * (caught + missed) and wrong <= 0.01 * (wrong + right), found


def test_toxicity_of_repeats_and_long_texts(spark):
    rows = [(i, f"word{i} " + ("grobblex" if i % 3 == 0 else "kind") + " word") for i in range(90)] + [(7, "kind words"), (7, "kind words"), (500, "kind " * 200_000), (None, None), (None, None)]
    table = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int").withColumn("score", F.lit(1)).withColumn("text", F.lit("z"))
    got = toxicity.detect(documents(spark, rows), table).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in rows), key=str) and all(0 <= r.score <= 1 for r in got)


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 1
        w = [f"word{rng.randrange(300)}" for _ in range(60)]
        if toxic:
            w[rng.randrange(60)] = "grobblex"
            w[rng.randrange(60)] = f"zurgh{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (None, "grobblex")]
    labels += [(1000, None), (None, 1), (2000, 1), (3, 0)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.detect(documents(spark, rows), table).collect()
    held = {r.doc_id: r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400}
    assert len(held) > 40 and sum(r.predicted == (i % 5 == 1) for i, r in held.items()) > 0.97 * len(held)
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = toxicity.detect(documents(spark, rows), table.limit(0)).collect()
    assert len({r.score for r in none}) == 1 and toxicity.detect(documents(spark, rows).limit(0), table).collect() == []


def test_isotonic_never_falls():
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    fit = toxicity.Isotonic(x, (rng.random(300) < 1 / (1 + np.exp(-3 * x))).astype(float))
    at = np.linspace(-4, 4, 200)
    assert (np.diff(fit(at)) >= 0).all() and fit(at).min() >= 0 and fit(at).max() <= 1
