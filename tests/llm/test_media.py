import hashlib
import tarfile
import zlib
from urllib.parse import urlparse

import pytest

from veilframe.llm import media

TEXTS = [None, "", "a", " ", "é" * 96, "x" * 192, "y" * 193, "long text " * 60_000, "a", "日本"]


def test_payloads_come_back(frame):
    df = frame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, digest string")
    index = media.read_back(media.with_headers(media.store(df)))
    rows = media.with_references(df).join(index, "digest").collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        raw = (TEXTS[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == r["digest"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert (r["width"], r["height"], r["bits"], r["colour"]) == (192, len(payload) // 192, 8, 0)
    assert len({r["media_sha256"] for r in rows if TEXTS[r["doc_id"]] in (None, "", " ")}) == 1


def test_shards_are_tar_files_and_index_points_into_them(frame):
    index = media.store(frame([(i, f"text {i}") for i in range(50)])).collect()
    for r in index:
        with tarfile.open(urlparse(r["shard"]).path) as tar:
            member = tar.getmember(f"{r['digest']}.png")
            assert (member.offset_data, member.size) == (r["offset"], r["length"])
            assert hashlib.sha256(media.samples_of(tar.extractfile(member).read()).tobytes()).hexdigest() == r["digest"]


def test_damage_is_an_error():
    image = bytearray(media.image_of(media.payload_of("some text")))
    image[media.HEADER_BYTES + 12] ^= 1
    with pytest.raises(ValueError):
        media.samples_of(bytes(image))


def test_empty_table(frame):
    assert media.read_back(media.with_headers(media.store(frame([(1, "a")]).limit(0)))).count() == 0
