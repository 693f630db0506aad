import struct
from io import BytesIO

import pytest
from hypothesis import given
from hypothesis import strategies as st

from cairn.errors import CodecError
from cairn.functions import codec

# Contents and their identifiers.
GOLDEN = {
    "63636363": "bafkreifw7plhl6mofk6sfvhnfh64qmkq73oeqwl6sloru6rehaoujituke",
    "62626262": "bafkreiebzrnroamgos2adnbpgw5apo3z4iishhbdx77gldnbk57d4zdio4",
    "61616161": "bafkreidbxzk2ryxwwtqxem4l3xyyjvw35yu4tcct4cqeqxwo47zhxgxqwq",
    b"Hello Kitty!".hex(): "bafkreihc4mcq2bl6auyzhtnbyt7umesg6m5cjsvrn23jqnd23e2plmgt3i",
}
V0 = "QmNX6Tffavsya4xgBi2VJQnSuqy9GsxongxZZ9uZBqp16d"


@pytest.mark.parametrize("content,text", GOLDEN.items())
def test_cid_golden(content, text):
    cid = codec.make_cid(bytes.fromhex(content))
    assert codec.cid_text(cid) == text and codec.cid_bytes(text) == cid


def test_cid_v0_text():
    raw = codec.cid_bytes(V0)
    assert len(raw) == 34 and codec.cid_text(raw) == V0


def test_empty_header_and_pragma():
    assert codec.v1_header([], 2).hex() == "11a265726f6f7473806776657273696f6e02"
    f = BytesIO()
    codec.ArchiveWriter(f).close()
    raw = f.getvalue()
    assert raw[:11].hex() == "0aa16776657273696f6e02" and codec.V2_START == 51
    assert codec.Archive(BytesIO(raw)).index() == {}


def test_v2_header_golden():
    raw = codec.V2_HEADER.pack(bytes(16), 51, 448, 499)
    assert codec.V2_HEADER.unpack(raw)[1:] == (51, 448, 499) and len(raw) == 40


def test_block_length():
    raw = codec.block(codec.make_cid(b"Hello Kitty!"), b"Hello Kitty!")
    assert raw[0] == 48 and len(raw) == 49


@given(st.integers(0, 2**64 - 1))
def test_varint_round_trip(n):
    assert codec.read_varint(BytesIO(codec.varint(n) + b"\xff")) == n


leaf = st.none() | st.booleans() | st.integers(-(2**63), 2**63) | st.text(max_size=9) | st.binary(max_size=9)


@given(st.recursive(leaf, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=5), x, max_size=3), max_leaves=9))
def test_cbor_round_trip(value):
    assert codec.uncbor(codec.cbor(value)) == value
    assert codec.cbor(codec.uncbor(codec.cbor(value))) == codec.cbor(value)


def test_cbor_key_order_and_links():
    link = codec.Link(codec.make_cid(b"x"))
    back = codec.uncbor(codec.cbor({"bb": link, "a": 1}))
    assert list(back) == ["a", "bb"] and isinstance(back["bb"], codec.Link)
    for bad in (b"", b"\xa1", b"\x9f\xff", b"\xd8\x2b\x41\x00", b"\x01\x01"):
        with pytest.raises(CodecError):
            codec.uncbor(bad)


def _v2(contents, roots=()):
    f = BytesIO()
    w = codec.ArchiveWriter(f, list(roots))
    for x in contents:
        w.put(x)
    w.put(b"old", cid=codec.cid_bytes(V0))  # another width: a bucket of its own
    w.close()
    return f.getvalue()


def test_archive_round_trip_and_skips_present_blocks():
    root = codec.make_cid(b"one")
    a = codec.Archive(BytesIO(_v2([b"one", b"", b"one", b"two" * 9000], [root])))
    found = list(a.scan())
    assert [x[3] for x in found] == [b"one", b"", b"two" * 9000, b"old"] and a.roots == [root] and a.version == 2
    assert a.index() == {c: o for c, o, _, _ in found}
    assert all(a.get(o) == (c, x) for c, o, _, x in found)


def test_archive_without_index_stops_at_its_data():
    raw = bytearray(_v2([b"one"]))
    raw[11 + 32 : 51] = bytes(8)
    assert len(codec.Archive(BytesIO(bytes(raw))).index()) == 2


def test_padded_archive():
    raw = _v2([b"one"])
    _, start, size, _ = codec.V2_HEADER.unpack(raw[11:51])
    padded = raw[:11] + codec.V2_HEADER.pack(bytes(16), start + 5, size, 0) + bytes(5) + raw[51 : 51 + size] + bytes(8)
    assert [x[3] for x in codec.Archive(BytesIO(padded)).scan()] == [b"one", b"old"]


def test_v1_keeps_duplicates_and_new_roots_move_blocks():
    c = codec.make_cid(b"a")
    raw = codec.v1_archive([(c, b"a"), (c, b"a")], [])
    assert len(list(codec.Archive(BytesIO(raw)).scan())) == 2
    moved = codec.Archive(BytesIO(codec.with_roots(raw, [c, c])))
    assert [x[3] for x in moved.scan()] == [b"a", b"a"] and moved.roots == [c, c]
    assert codec.with_roots(codec.with_roots(raw, [c, c]), []) == raw


@pytest.mark.parametrize("cut", [5, 30, 60, 100])
def test_broken_archives_raise(cut):
    with pytest.raises(CodecError):
        list(codec.Archive(BytesIO(_v2([b"one" * 50])[:cut])).scan())


def test_broken_index_raises():
    for raw in (codec.varint(0x0401) + bytes(20), codec.varint(0x0400), codec.varint(0x0400) + b"\x2c\0\0\0" + b"\x05" + bytes(7) + b"x"):
        with pytest.raises(CodecError):
            codec.read_index(BytesIO(raw))


def test_blake3_vectors():
    assert codec.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert codec.blake3(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    long = bytes(i % 251 for i in range(2049))
    assert codec.blake3(long).hex() == "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030"


def plain_blake3(data: bytes) -> bytes:
    """BLAKE3 digest (32 bytes), from its specification."""
    iv = [0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19]
    order = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
    lanes = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]
    mask, start, end, parent, root = 0xFFFFFFFF, 1, 2, 4, 8

    def compress(cv: list[int], words: list[int], counter: int, size: int, flags: int) -> list[int]:
        s = cv + iv[:4] + [counter & mask, counter >> 32 & mask, size, flags]
        for r in range(7):
            for i, (a, b, c, d) in enumerate(lanes):
                for x, (p, q) in zip(words[2 * i : 2 * i + 2], ((16, 12), (8, 7)), strict=True):
                    s[a] = (s[a] + s[b] + x) & mask
                    v = s[d] ^ s[a]
                    s[d] = (v >> p | v << (32 - p)) & mask
                    s[c] = (s[c] + s[d]) & mask
                    v = s[b] ^ s[c]
                    s[b] = (v >> q | v << (32 - q)) & mask
            words = [words[k] for k in order] if r < 6 else words
        return [s[i] ^ s[i + 8] for i in range(8)]

    def words_of(raw: bytes) -> list[int]:
        return list(struct.unpack("<16I", raw.ljust(64, b"\0")))

    def chunk(raw: bytes, counter: int, last: int) -> list[int]:
        cv, parts = iv[:], [raw[i : i + 64] for i in range(0, len(raw), 64)] or [b""]
        for i, p in enumerate(parts):
            flags = start * (i == 0) | (end | last) * (i == len(parts) - 1)
            cv = compress(cv, words_of(p), counter, len(p), flags)
        return cv

    def tree(first: int, raw: bytes, last: int) -> list[int]:
        n = -(-len(raw) // 1024)
        if n <= 1:
            return chunk(raw, first, last)
        left = 1 << ((n - 1).bit_length() - 1)
        pair = tree(first, raw[: left * 1024], 0) + tree(first + left, raw[left * 1024 :], 0)
        return compress(iv[:], pair, 0, 64, parent | last)

    return struct.pack("<8I", *tree(0, data, root))


def test_blake3_parts_and_stream(monkeypatch):
    from cairn.functions import blake3 as b3

    raw = bytes(i * i % 251 for i in range(40_000))
    monkeypatch.setattr(b3, "PART", 4096)
    for n in (0, 1, 64, 65, 1023, 1024, 1025, 3072, 4096, 4097, 8192, 8193, 12_288, 13_000, 20_481, 40_000):
        h = b3.Blake3()
        for i in range(0, n, 777):
            h.update(raw[i : min(n, i + 777)])
        assert h.digest() == b3.blake3(raw[:n]) == plain_blake3(raw[:n])


def test_archives_are_digested_by_their_bytes(spark, tmp_path):
    """r_blake3 is the digest of the archive that codec writes, so other blocks of equal sizes give another one."""
    from cairn.plans.queries import QUERIES

    found = []
    for k in range(2):
        rows = [(i, f"{k}{i:03}" * (1 + i * 400), f"src{i % 2}") for i in range(60)]
        path = str(tmp_path / str(k))
        spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, source string, lang string").write.parquet(f"{path}/documents.parquet")
        got = {r["delta"]: r["digest"].lower() for r in QUERIES["r_blake3"](spark, path).collect()}
        for d in range(2):
            f = BytesIO()
            w = codec.ArchiveWriter(f)
            for i, text, _ in rows:
                if i % 2 == d:
                    w.put(text.encode())
            w.close()
            assert got[d] == codec.blake3(f.getvalue()).hex()
        found.append(got)
    assert not set(found[0].values()) & set(found[1].values())


def test_push_records_digests(spark, tmp_path):
    from cairn.plans.mount import Mount

    m = Mount(spark, str(tmp_path / "drive"), str(tmp_path / "remote"))
    for n in range(2):
        m.write(f"{n}.txt", b"content" * (n + 1))
        m.push()
    archives = {int(p.stem): p.read_bytes() for p in (tmp_path / "remote" / "blocks").glob("*.car")}
    rows = m.remote.uploads().collect()
    assert len(rows) == len(archives) >= 2
    assert {r["delta"]: (r["length"], r["digest"]) for r in rows} == {k: (len(x), codec.blake3(x).hex()) for k, x in archives.items()}
