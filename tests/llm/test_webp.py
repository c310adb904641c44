from __future__ import annotations

import hashlib
import zlib
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import media, webp
from tidewatch.llm.webp import Profile, decode, encode


def images():
    rng = np.random.default_rng(0)
    ramp = (np.add.outer(np.arange(40), np.arange(70)) * 3 % 256).astype(np.uint8)
    yield "noise", rng.integers(0, 256, (13, 37, 4), dtype=np.uint8)
    yield "ramp", np.stack([ramp, ramp // 2, 255 - ramp, np.full_like(ramp, 255)], -1)
    for n in (1, 2, 3, 4, 5, 16, 17, 200):
        yield f"{n} colours", rng.integers(0, 256, (n, 4), dtype=np.uint8)[rng.integers(0, n, (17, 45))]
    yield "one pixel", np.array([[[1, 2, 3, 4]]], np.uint8)
    yield "one column", rng.integers(0, 256, (30, 1, 4), dtype=np.uint8)
    yield "tiles", np.tile(rng.integers(0, 256, (4, 16, 4), dtype=np.uint8), (6, 3, 1))
    grey = np.repeat(rng.integers(97, 123, (20, 64, 1), dtype=np.uint8), 4, axis=2)
    grey[..., 3] = 255
    yield "grey", grey


PROFILES = [
    Profile(),
    Profile(match=False),
    Profile(subtract_green=True, cache_bits=5),
    Profile(cache_bits=1),
    Profile(cache_bits=11, group_tile=2),
    Profile(predictor_tile=3),
    *[Profile(predictor_tile=2, modes=(m,)) for m in range(14)],
    Profile(predictor_tile=2, modes=tuple(range(14))),
    Profile(cross=(2, 32, 224, 17)),
    Profile(predictor_tile=4, modes=(11, 12, 13, 1), cross=(3, 5, 250, 99), subtract_green=True, cache_bits=6, group_tile=3),
    Profile(palette=True),
    Profile(palette=True, predictor_tile=2, modes=(5, 6, 7, 10, 11)),
    Profile(palette=True, cache_bits=4, group_tile=2),
]


@pytest.mark.parametrize(("name", "image"), list(images()))
def test_every_profile_gives_the_pixels_back(name, image):
    for profile in PROFILES:
        if profile.palette and len(np.unique(image.reshape(-1, 4), axis=0)) > 256:
            with pytest.raises(webp.WebpError):
                encode(image, profile)
            continue
        data = encode(image, profile)
        assert np.array_equal(decode(data), image), profile
        assert np.array_equal(decode(data, grey=True), image[..., 1]), profile


def bits(*fields):
    """A chunk of (value, size) fields in a file."""
    total, at = 0, 0
    for value, size in fields:
        total |= value << at
        at += size
    chunk = total.to_bytes((at + 7) // 8 + 8, "little")
    body = b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + chunk
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def test_a_file_written_by_hand():
    """Two by one pixels: green 1 or 200 by one bit, the other channels constant; no transform, no cache."""
    head = [(0x2F, 8), (1, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)]
    green = [(1, 1), (1, 1), (0, 1), (1, 1), (200, 8)]
    others = [(1, 1), (0, 1), (1, 1), (7, 8)] * 2 + [(1, 1), (0, 1), (1, 1), (255, 8)] + [(1, 1), (0, 1), (0, 1), (0, 1)]
    assert decode(bits(*head, *green, *others, (1, 1), (0, 1))).tolist() == [[[7, 200, 7, 255], [7, 1, 7, 255]]]


def test_a_colour_that_was_never_cached_is_transparent_black():
    """Two by one pixels with a cache of two colours: green 1, or the second, empty, place of the cache."""
    head = [(0x2F, 8), (1, 14), (0, 14), (0, 1), (0, 3), (0, 1), (1, 1), (1, 4), (0, 1)]
    cached = (0xFF070107 * webp.CACHE_MULTIPLIER & 0xFFFFFFFF) >> 31
    empty = 280 + (1 - cached)
    # code lengths: symbols 1 and ``empty`` have length 1, all others 0, written with runs of zeros
    order, own = webp.CODE_LENGTH_ORDER, {18: 1, 0: 2, 1: 2}
    code = {18: (0, 1), 0: (0b01, 2), 1: (0b11, 2)}
    run = lambda n: [code[18], (n - 11, 7)]
    rest = 282 - empty - 1
    last = max(i for i, s in enumerate(order) if s in own)
    green = [(0, 1), (last + 1 - 4, 4), *[(own.get(s, 0), 3) for s in order[: last + 1]], (0, 1), code[0], code[1], *run(138), *run(100), *run(empty - 2 - 238), code[1], *[code[0]] * rest]
    others = [(1, 1), (0, 1), (1, 1), (7, 8)] * 2 + [(1, 1), (0, 1), (1, 1), (255, 8)] + [(1, 1), (0, 1), (0, 1), (0, 1)]
    assert decode(bits(*head, *green, *others, (0, 1), (1, 1))).tolist() == [[[7, 1, 7, 255], [0, 0, 0, 0]]]


def test_two_dimensional_distances_are_in_the_order_of_the_format():
    near = webp.near_offsets()
    assert len(near) == 120
    assert near[:12] == ((0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2))
    assert near[-3:] == ((-7, 7), (8, 6), (8, 7))


def test_lengths_and_distances_have_the_prefixes_of_the_format():
    for value in (*range(1, 600), 4096, 65536, 1_000_000):
        prefix, extra, rest = webp._prefixed(value)
        base = prefix + 1 if prefix < 4 else ((2 + (prefix & 1)) << ((prefix - 2) >> 1)) + 1
        assert base + rest == value and 0 <= rest < 1 << extra or extra == 0 and base == value


def test_code_lengths_are_complete_and_bounded():
    frequency = np.array([int(1.7**i) for i in range(40)])
    for limit in (7, 11, 15):
        lengths = webp._lengths(frequency, limit)
        assert lengths.max() <= limit and (2.0 ** -lengths).sum() == 1


def test_damaged_files_are_told_from_whole_ones():
    data = encode(next(images())[1])
    for cut in range(0, len(data) - 2, 7):
        with pytest.raises((webp.WebpError, IndexError, ValueError)):
            decode(data[:cut])
    with pytest.raises(webp.WebpError):
        decode(b"RIFF" + bytes(40))


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.text("ab\n ", max_size=4000).map(str.encode)), st.sampled_from(sorted(set(media.PROFILES), key=str)))
def test_payloads_round_trip(data, profile):
    whole = media.payload(data)
    assert len(whole) % 64 == 0 and len(whole) > 0 and whole.startswith(data)
    assert decode(media.stored(whole), grey=True).tobytes()[: len(whole)] == whole
    grey = np.frombuffer(whole, np.uint8).reshape(-1, 64)
    pixels = np.dstack([grey] * 3 + [np.full_like(grey, 255)])
    assert np.array_equal(decode(encode(pixels, profile), grey=True), grey)


def test_large_payload_has_wider_rows():
    data = (b"0123456789abcdef" * (media.ROW * webp.MAX_SIDE // 16)) + b"x" * 64
    width = decode(media.stored(data), grey=True).shape[1]
    assert width > media.ROW


def test_payload_beyond_the_largest_image_takes_several(monkeypatch):
    monkeypatch.setattr(webp, "MAX_SIDE", 64)
    monkeypatch.setattr(media, "ROW", 32)
    data = media.payload(np.random.default_rng(1).integers(0, 9, 10_000, dtype=np.uint8).tobytes())
    files = media.files_in(media.stored(data))
    assert len(files) == 3
    assert b"".join(decode(f, grey=True).tobytes() for f in files)[: len(data)] == data
    assert media.files_in(b"junk") == [b"junk"]


def test_operator_on_odd_rows(spark, odd, odd_rows, empty):
    stored = media.store_texts(odd, keep=["doc_id", "score"])
    found = media.decode_media(stored, grey=True).collect()
    key = lambda r: (r is None, r)
    assert sorted((r["doc_id"] for r in found), key=key) == sorted((r[0] for r in odd_rows), key=key)
    by_text = {r[0]: (r[1] or "").encode() for r in odd_rows if r[0] is not None}
    for r in found:
        if r["doc_id"] is not None:
            whole = media.payload(by_text[r["doc_id"]])
            assert r["n_bytes"] == len(by_text[r["doc_id"]]) and r["error"] is None
            assert bytes(r["pixels"])[: len(whole)] == whole and r["width"] * r["height"] == len(r["pixels"])
    assert media.decode_media(media.store_texts(empty), keep=[]).count() == 0
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"junk")), (3, bytearray(media.stored(media.payload(b"x"))[:-9]))], "id long, media binary")
    said = {r["id"]: (r["pixels"], r["error"]) for r in media.decode_media(bad).collect()}
    assert said[1] == (None, None) and said[2][0] is None and said[2][1] and said[3][1]


def test_query(spark, data):
    texts = dict(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    found = media.op1_webp_media(spark, data).collect()
    assert len(found) == len(texts)
    for r in found:
        raw = (texts[r["doc_id"]] or "").encode()
        whole = media.payload(raw)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(whole))
        assert r["payload_sha256"] == hashlib.sha256(whole).hexdigest() and r["tail_crc32"] == zlib.crc32(whole[-64:])
        file = media.stored(whole)
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())


def test_all_profiles_of_production_occur():
    assert {media.PROFILES[zlib.crc32(bytes([a, b])) % len(media.PROFILES)] for a, b in product(range(16), range(16))} == set(media.PROFILES)


def test_large_tile_images_end_exactly():
    """Tile images of over 512 tiles are read several literals at a time, and more data follow them."""
    rng = np.random.default_rng(0)
    for extra in range(4):
        image = rng.integers(0, 256, (4 * (19 + extra), 4 * 27, 4), dtype=np.uint8)
        image[..., 3] = 255
        modes = tuple(int(x) for x in rng.integers(0, 14, 900))
        for profile in (webp.Profile(predictor_tile=2, modes=modes), webp.Profile(predictor_tile=2, modes=modes, cross=(2, 3, 5, 7), subtract_green=True)):
            assert (webp.decode(webp.encode(image, profile)) == image).all()


def test_grey_pixels_need_one_byte_each():
    grey = next(x for name, x in images() if name == "grey")
    for profile in (*PROFILES, *media.PROFILES):
        assert encode(np.ascontiguousarray(grey[..., 1]), profile) == encode(grey, profile), profile


@pytest.mark.parametrize("cache_bits", [1, 3, 8, 11])
@pytest.mark.parametrize("match", [False, True])
def test_cached_greens_are_read_in_pairs_as_one_by_one(monkeypatch, cache_bits, match):
    """Few and many colours, back-references over what the cache gave, several windows of the data."""
    rng = np.random.default_rng(cache_bits)
    words = [rng.integers(97, 123, n, dtype=np.uint8) for n in rng.integers(3, 60, 200)]
    for alphabet, n in ((2, 600), (26, 40_000), (256, 90_000)):
        flat = np.concatenate([words[i] for i in rng.integers(0, 200, n // 20)])[:n] if alphabet == 26 else rng.integers(0, alphabet, n, dtype=np.uint8)
        grey = np.resize(flat, (-(-n // 300), 300))
        for alpha in (0, 255):
            pixels = np.stack([grey * 0, grey, grey * 0, np.full_like(grey, alpha)], -1)
            data = encode(pixels, Profile(cache_bits=cache_bits, match=match))
            assert np.array_equal(decode(data), pixels), (alphabet, alpha)
            pairs, calls = webp._read_pairs, []
            with monkeypatch.context() as patch:
                patch.setattr(webp, "_read_pairs", lambda *a: calls.append(a[4]) or pairs(*a))
                assert np.array_equal(decode(data, grey=True), grey)
                patch.setattr(webp, "_read_pairs", webp._read_greens)
                assert np.array_equal(decode(data, grey=True), grey)
            assert cache_bits in calls
