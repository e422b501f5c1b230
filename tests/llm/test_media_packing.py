"""Media, packing, WARC and quality against round trips and brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from weftgraph.llm import media, packing, quality, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, path, texts, schema="doc_id long, text string"):
    spark.createDataFrame(list(enumerate(texts)), schema).write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (64, 64), (3, 9, 3)])
def test_image_round_trips(shape):
    image = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    if image.ndim == 2:
        assert (media.decode(media.encode_pgm(image)) == image).all()
        text = b"P2 # grey\n%d %d\n# top\n255\n" % (shape[1], shape[0]) + b" ".join(b"%d" % x for x in image.reshape(-1))
        assert (media.decode(text) == image).all()
        bits = image & 1
        packed = b"P4\n%d %d\n" % (shape[1], shape[0]) + np.packbits(1 - bits, axis=1).tobytes()
        assert (media.decode(packed) == bits).all()
        plain = b"P1\n%d %d\n" % (shape[1], shape[0]) + b" ".join(b"%d" % (1 - x) for x in bits.reshape(-1))
        assert (media.decode(plain) == bits).all()
        wide = image.astype(np.uint16) * 257
        assert (media.decode(b"P5 %d %d 65535\n" % (shape[1], shape[0]) + wide.astype(">u2").tobytes()) == wide).all()
    else:
        assert (media.decode(b"P6 %d %d 255\n" % (shape[1], shape[0]) + image.tobytes()) == image).all()
    assert (media.decode(media.encode_bmp(image)) == image).all()


def test_area_resize_matches_exact_areas():
    image = np.random.default_rng(2).integers(0, 256, (13, 10)).astype(np.int64)
    fine = np.kron(image, np.ones((8, 9), np.int64))  # every sample as 8 x 9 equal parts: cells of 8 x 9 hold whole parts
    expected = fine.reshape(8, 13, 9, 10).sum(axis=(1, 3))
    assert (media.area_sums(image, 8, 9) == expected).all()


def test_bad_media(spark):
    beyond = bytearray(media.encode_bmp(np.full((2, 2), 9, np.uint8)))
    beyond[46:50] = (4).to_bytes(4, "little")
    cut = media.encode_bmp(np.zeros((4, 4, 3), np.uint8))
    bad = [b"P5 2 2 255\n\0", b"zz", None, b"", b"P5 99999999999 99999999999 255\n", b"P5 999999999 999999999 255\n\0", b"P2 1 1 255\n99999999999999999999999", b"P2 1 1 15\n16", b"P2 1 1 255\n-1", b"P1 1 1\n7", b"P5 -1 2 255\n"]
    bad += [bytes(beyond), cut[:-1], cut[:40], b"BM", b"P6", b"P4 9 9\n", b"P5 2 2 70000\n" + b"0" * 20, b"BM" + b"\xff" * 60]
    r = random.Random(3)
    noise = [bytes(r.choices(range(256), k=80)) for _ in range(50)] + [b"BM" + bytes(r.choices([0, 1, 2, 8, 40, 255], k=90)) for _ in range(200)] + [b"P%d " % r.randint(1, 6) + bytes(r.choices(b"0123 \n#", k=40)) for _ in range(200)]
    good = media.encode_pgm(np.zeros((2, 2), np.uint8))
    rows = spark.createDataFrame([*enumerate(bad + noise), (-1, good), (-2, good)], "id int, media binary")
    got = {r.id: (r.error, r.tile, r.dhash) for r in media.media_tiles(rows).collect()}
    assert got[-1][0] is None and got[-1] == got[-2] and len(got) == len(bad) + len(noise) + 2
    assert all(got[i][0] and got[i][1] is None for i in range(len(bad)))
    assert all((error is None) == (tile is not None) for error, tile, _ in got.values())
    assert media.media_tiles(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        media.media_tiles(rows.withColumnRenamed("id", "tile"))


def test_samples_are_scaled_by_maxval():
    image = np.random.default_rng(6).integers(0, 16, (5, 6)).astype(np.uint8)
    body = b" ".join(b"%d" % x for x in image.reshape(-1))
    assert media.features(b"P2 6 5 15\n" + body) == media.features(media.encode_pgm(image * 17))
    bits = image & 1
    assert media.features(b"P1 6 5\n" + b"".join(b"%d" % (1 - x) for x in bits.reshape(-1))) == media.features(media.encode_pgm(bits * 255))


def test_empty_tables(spark, tmp_path):
    path = documents(spark, tmp_path, [])
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert media.op5_media(spark, path).count() == 0
    assert packing.op6_packing(spark, path).count() == 0
    assert warc.op8_warc(spark, path).count() == 0


def test_media_query(spark, tmp_path):
    texts = [None, "", "x" * 64, "x" * 65, "é\0" * 500, "x" * 64]
    rows = {r.doc_id: r for r in media.op5_media(spark, documents(spark, tmp_path, texts)).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (64 if not data else 0))
        row = rows[i]
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, 64))
        assert (row.media_bytes, row.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert rows[2].feature == rows[5].feature and rows[2].tile == rows[5].tile
    tile = np.load(__import__("io").BytesIO(bytes(rows[4].tile)))
    assert tile.shape == (16, 16) and tile.dtype == np.uint8 and 0 < tile.max() <= 255


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    reference, own = Tokenizer.from_file(path), packing.encoder(path)
    r = random.Random(5)
    texts = ["", " ", "\n\n x", "a  b\t\n c ", "it's we'll I'M", "<|endoftext|> x<|endoftext|>", "日本語テキスト 한국어", "naïve ½ ² ٣ Ⅷ", "\x1c\x85\xa0　x", "​ź"]
    texts += ["".join(r.choice("ab 1.\n'\té日𝒳  \x1c²") for _ in range(80)) for _ in range(300)]
    for text in texts:
        assert own.encode_to_numpy(text, allowed_special="all").tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_query(spark, tmp_path):
    r = random.Random(7)
    texts = [None, "", "word " * 5000] + [" ".join(r.choices(["alpha", "beta", "gamma!", "né"], k=r.randint(1, 1500))) for _ in range(120)]
    rows = packing.op6_packing(spark, documents(spark, tmp_path, texts)).collect()
    words = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for row in rows:
        by_doc.setdefault(row.doc_id, []).append(row)
        by_sequence.setdefault(row.sequence_id, []).append(row)
    for i, text in enumerate(texts):
        ids = np.array([*words.encode_to_numpy(text or "", allowed_special="all"), 2], "<u4")
        pieces = sorted(by_doc[i], key=lambda x: x.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        at = 0
        for k, p in enumerate(pieces):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            assert p.length == 1024 or k == 0
            at += p.length
        assert at == len(ids)
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda x: x.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    # What best fit decreasing guarantees, against the least number of sequences that could hold all tokens.
    assert len(by_sequence) <= 11 / 9 * np.ceil(sum(x.length for x in rows) / 1024) + 6 / 9


def test_best_fit_is_best_fit():
    lengths = np.sort(np.random.default_rng(4).integers(1, 1025, 3000))[::-1]
    bins, offsets = packing.best_fit(lengths)
    rooms = []
    for n, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        fitting = [x for x in rooms if x >= n]
        if fitting:
            assert rooms[b] == min(fitting) and o == 1024 - rooms[b]
        else:
            assert b == len(rooms) and o == 0
            rooms.append(1024)
        rooms[b] -= n


def test_warc(spark, tmp_path):
    big, small = "<p>é</p>" * 30, "tiny"
    pages = [(5, "u", big), (3, None, big), (4, "w", small), (1, "w", small), (9, "z", None), (8, "z\r\nx", big + "1"), (3, None, big)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    headers, payloads = warc.write_archive(rows)
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in headers.collect())
    assert got == sorted([(5, "revisit", 3), (3, "response", None), (3, "response", None), (4, "response", None), (1, "response", None), (9, "response", None), (8, "response", None)], key=lambda x: x[0])
    assert {r.digest for r in payloads.collect()} == {hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in pages}
    full = warc.reconstruct(headers, payloads).collect()
    assert len(full) == len(pages)
    for r in full:
        head, block = r.record.split(b"\r\n\r\n", 1)
        assert bytes(head) + b"\r\n\r\n" == r.header.encode()
        length = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert length == len(block) - 4 and (r.record_type == "revisit" or block[:-4] == r.payload)
    broken = payloads.selectExpr("digest", "records", "cast('x' as binary) as payload")
    with pytest.raises(Exception, match="another digest"):
        warc.verified(broken).collect()


@pytest.mark.parametrize("hot", [1, 1000])
def test_archive_of_one_page(spark, tmp_path, hot, monkeypatch):
    """Half of the pages are empty and a quarter equal: every record comes back whole, whichever digests are looked up."""
    monkeypatch.setattr("weftgraph.llm.shared.HOT_KEYS", hot)
    same = "<html>" + "x" * 200
    pages = [(i, f"u{i}", None if i % 2 else same if i % 4 else f"{same}{i}") for i in range(400)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    headers, payloads = warc.write_archive(rows)
    found = {r.page_id: r for r in warc.reconstruct(headers, payloads).collect()}
    assert len(found) == 400
    for i, _, body in pages:
        r = found[i]
        assert (r.record_type, r.refers_to) == (("revisit", 2) if body == same and i != 2 else ("response", None))
        assert bytes(r.record) == r.header.encode() + (b"" if r.record_type == "revisit" else (body or "").encode()) + b"\r\n\r\n"
        fields = dict(x.split(": ", 1) for x in r.header.strip().split("\r\n")[1:])
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= fields.keys()
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.op8_warc(spark, str(tmp_path)).collect()}
    assert got == {i: (len((b or "").encode()), hashlib.sha256((b or "").encode()).hexdigest()) for i, _, b in pages}
    with pytest.raises(ValueError):
        warc.write_archive(rows.withColumnRenamed("page_id", "digest"), "digest")


def brute_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in often for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_counts(spark, tmp_path):
    r = random.Random(9)
    texts = [None, "", " \n ", "a a a a", "x\nx\n \n x\nx", "é b \x1c c"] + [" ".join(r.choices(["a", "b", "#c", "dé", "\n", "\n\n"], k=r.randint(1, 120))) for _ in range(80)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = quality.op9_quality(spark, documents(spark, tmp_path, texts)).collect()
    for row in rows:
        n, chars, symbols, dup, repeat = brute_counts(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert row.base_failed == (n < 50 or 100 * repeat > 50 * n) and row.kept == (not row.base_failed)


def test_forest_is_flat_and_monotone():
    rng = np.random.default_rng(3)
    rows = rng.random((3000, 3))
    labels = (rows[:, 0] + 0.5 * np.sin(9 * rows[:, 1]) + 0.2 * rng.standard_normal(3000) < 0.6).astype(float)
    forest = quality.fit(rows[:2000], labels[:2000], (-1, 0, 0))
    assert ((forest.score(rows[2000:]) > 0) == (labels[2000:] > 0)).mean() > 0.85
    grid = np.repeat(rows[:50], 40, axis=0)
    grid[:, 0] = np.tile(np.linspace(-0.2, 1.2, 40), 50)
    assert (np.diff(forest.score(grid).reshape(50, 40), axis=1) <= 1e-12).all()
    one = forest.score(rows[:7])
    for i in range(7):
        total = forest.bias
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if rows[i, forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        assert abs(total - one[i]) < 1e-9


def test_quality_model_on_labelled_rows(spark, tmp_path):
    r = random.Random(1)
    vocabulary = ["w%03d" % i for i in range(400)]
    good = [" ".join(r.choices(vocabulary, k=200)) for _ in range(150)]
    bad = [" ".join(x + "###" if r.random() < 0.5 else x for x in r.choices(vocabulary, k=200)) for _ in range(150)]
    path = documents(spark, tmp_path, good + bad)
    spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {x.doc_id: x.kept for x in quality.op9_quality(spark, path).collect()}
    assert all(kept[i] for i in range(150)) and not any(kept[i] for i in range(150, 300))
