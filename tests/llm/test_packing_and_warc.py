"""Exact round trips: packed ids against the tokenizers library, archives against their pages."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textloom.llm.packing import Encoder, binary_pieces, pack
from textloom.llm.warc import LoserTree, archive_round_trip, members_of, parse_records, payload_of, read_index, url_key, write_archives


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["", None, "Hello world", "été à la mer\n\n  x", "日本語 テスト 😀", "a<|endoftext|>b", "a" * 5000, " " * 3000, "\x85\xa0 x ² ½", "word " * 3000]


def test_ids_are_those_of_the_library(reference):
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    every = [f"a {chr(c)}b1{chr(c)}{chr(c)} {chr(c)}" for c in [*range(1, 0x250), *range(0x2000, 0x2070)]]
    for text in [*filter(None, TEXTS), *every]:
        assert encoder.encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 2047, 2048, 2049, 10_000])
def test_binary_pieces(n):
    found = binary_pieces(n, 2048)
    assert [s for s, _ in found] == np.cumsum([0, *(k for _, k in found[:-1])]).tolist() and sum(k for _, k in found) == n
    assert all(k <= 2048 and k & (k - 1) == 0 for _, k in found)


def test_pack(spark, reference):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 5), (None, "x", 5)], "doc_id long, text string, length int")
    rows = pack(docs, with_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and min(r.sequence_id for r in rows) == 0 and max(r.sequence_id for r in rows) == len(rows) - 1
    lengths = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True) and all(n & (n - 1) == 0 and n <= 2048 for n in lengths) and {r.offset for r in rows} == {0}
    for i, text in enumerate(TEXTS):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)[:: 2 if i == 3 else 1]
        ids = reference.encode(text or "", add_special_tokens=False).ids + [1]
        assert [x for r in own for x in r.ids] == ids and {r.doc_tokens for r in own} == {len(ids)}
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in own)
    assert pack(docs.limit(0)).collect() == []
    many = pack(docs.withColumnRenamed("length", "sequence_id"), shards=3000).collect()  # more shards than a super-shard has
    assert sorted(r.sequence_id for r in many) == list(range(len(rows)))


def test_runs_that_the_fast_encoder_gives_up(reference):
    text = "\n" * 2_000_000
    assert len(Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(text)) == len(reference.encode(text, add_special_tokens=False).ids)


def test_sequence_tokens_must_be_a_power_of_two(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError):
        pack(docs, sequence_tokens=1000)


PAGES = [(5, "http://www.B.org/x?q=1", "<p>é</p>"), (3, "https://b.org:443/x?q=1", "<p>é</p>"), (9, None, "<p>é</p>"), (7, "http://a.b.org/", None), (8, "http://a.b.org/", ""), (2, "bad\r\nurl", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3), (4, "http://a.b.org/", "y" * 300_000), (5, "http://www.B.org/x?q=1", "<p>é</p>"), (None, "http://c", "<p>é</p>")]


def page_frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, archive string")


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_archives(spark, tmp_path):
    pages = page_frame(spark, PAGES)
    write_archives(pages.coalesce(1), str(tmp_path / "w"), archive_bytes=700)
    files = sorted((tmp_path / "w").rglob("*.txt"))
    records = [r for f in files for m, _, _ in members_of(f.read_bytes()) for r in parse_records(m)]
    assert len(records) == len(PAGES) and len(files) > 2
    assert all(gzip.decompress(f.read_bytes()) == b"".join(m for m, _, _ in members_of(f.read_bytes())) for f in files)
    by_id = {fields["warc-record-id"]: block for fields, block, _, _ in records}
    html = {p: (h or "") for p, _, h in PAGES}
    for fields, block, _, _ in records:
        page = None if fields["warc-page-id"] == "-" else int(fields["warc-page-id"])
        source = by_id[fields["warc-refers-to"]] if fields["warc-type"] == "revisit" else block
        assert payload_of(source).decode() == html[page] and fields["warc-payload-digest"] == "sha1:" + digest(html[page])
    index = read_index(spark, str(tmp_path / "w"), captures_per_task=2).collect()
    assert [(r.urlkey, r.timestamp) for r in index] == sorted((r.urlkey, r.timestamp) for r in index)
    for r in index:  # a capture is read alone, by its offset and length
        data = (tmp_path / "w" / r.archive).read_bytes()[r.offset : r.offset + r.length]
        ((fields, _, _, _),) = parse_records(gzip.decompress(data))
        assert fields["warc-page-id"] == ("-" if r.page_id is None else str(r.page_id))
    first = {3: None, 5: 3, 9: 3, 7: None, 8: 7, 2: None, 4: None, None: 3}
    assert all(r.refers_to == first[r.page_id] and r.record_type == ("response" if first[r.page_id] is None else "revisit") for r in index)
    assert all(r.payload_bytes == len(html[r.page_id].encode()) and r.payload_digest == digest(html[r.page_id]) for r in index)


def test_small_payloads_are_not_revisited(spark):
    rows = archive_round_trip(page_frame(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), min_dedup_bytes=3).collect()
    assert {r.page_id: r.refers_to for r in rows} == {1: None, 2: None, 3: None, 4: 3}


def test_no_pages(spark):
    assert archive_round_trip(page_frame(spark, [])).collect() == []


def test_loser_tree():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(30) for _ in range(rng.randrange(12))) for _ in range(k)]
        out = [(runs[r][i], r, i) for r, i in LoserTree(runs)]
        assert [x for x, _, _ in out] == sorted(x for run in runs for x in run)
        assert [(r, i) for _, r, i in out] == [(r, i) for _, r, i in sorted(out)]  # ties go to the smaller run


def test_url_key():
    assert url_key("https://WWW2.Example.com:8443/A?b=C") == "com,example:8443)/a?b=c"
    assert url_key("not a url") == "not a url" and url_key("http://[bad") == "http://[bad"
