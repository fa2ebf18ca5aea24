import hashlib
import zlib
from collections import Counter

import pytest

from helpers import DATA
from folioframe.llm import media, pieces, token_counts
from folioframe.llm.common import documents


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_token_histogram_against_a_plain_count(spark, odd):
    encode = token_counts._encoding(token_counts.tokenizer_path("byte_bpe_50k.tiktoken")).encode_ordinary
    for df in (odd, documents(spark, DATA)):
        lengths = [len(encode(t)) for _, t in texts_of(df)]
        sums = token_counts.suffix_sums(token_counts.histogram(df)).cache()
        got = {r.length: r for r in sums.collect()}
        assert {k: r.n_docs for k, r in got.items()} == Counter(lengths)
        for k, r in got.items():
            assert (r.docs_ge, r.tokens_ge) == (sum(x >= k for x in lengths), sum(x for x in lengths if x >= k))
            assert r.truncated_tokens == sum(min(x, k) for x in lengths) and r.docs_le == sum(x <= k for x in lengths)
        for r in token_counts.at_limits(sums, [1, 100, 2048, 10**7]).collect():
            assert (r.truncated_tokens, r.lost_tokens) == (sum(min(x, r.limit) for x in lengths), sum(max(0, x - r.limit) for x in lengths))
        for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect():
            assert r.length == min(k for k in got if sum(x <= k for x in lengths) >= r.q * len(lengths))
    assert sorted(r.length for r in token_counts.token_lengths(odd).collect()) == sorted(len(encode(t)) for _, t in texts_of(odd))


def test_long_runs_are_counted_whole(spark):
    """No blank in 300,000 characters, and nothing but blanks."""
    encode = token_counts._encoding(token_counts.tokenizer_path("byte_bpe_50k.tiktoken")).encode_ordinary
    texts = ["x" * 300_000, " " * 300_000, "ab1é" * 50_000, None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert sorted(r.length for r in token_counts.token_lengths(df).collect()) == sorted(len(encode(t or "")) for t in texts)
    assert sum(r.n_docs for r in token_counts.histogram(df).collect()) == len(texts)


def test_token_histogram_of_nothing(empty):
    sums = token_counts.suffix_sums(token_counts.histogram(empty))
    assert sums.count() == 0
    assert [(r.docs_ge, r.truncated_tokens) for r in token_counts.at_limits(sums, [5]).collect()] == [(0, 0)]


def test_pieces_equal_the_library(spark, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.tokenizer_path("piece_bpe_32k.model"))
    for df in (odd, documents(spark, DATA)):
        want = []
        for d, t in texts_of(df):
            ids = library.encode(t)
            want.append((d, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids).encode())))
        assert Counter(map(tuple, pieces.encode_decode(df).collect())) == Counter(want)
    kept = pieces.encode_decode(odd, keep=True).filter("doc_id = 1").first()
    assert list(kept.ids) == library.encode("Hello world again, hello") and kept.decoded == "Hello world again, hello"


def test_agenda_one_by_one_and_all_at_once():
    m = pieces.model(pieces.tokenizer_path("piece_bpe_32k.model"))
    cuts = [pieces.SPACE + w for w in ("internationalization", "a", "the", "supercalifragilistic", "é" * 9, "naïveté", "漢字漢字", "\x07bell")] + ["xyz" * 40, "q"]
    assert m.merge_all(cuts) == [m.merge(c) for c in cuts]


def test_differences_from_the_library_raise():
    m = pieces.model(pieces.tokenizer_path("piece_bpe_32k.model"))
    with pytest.raises(AssertionError):
        m.check(["the"], [[5]], ["the"])


def test_caches_stay_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 50)
    m = pieces.PieceModel(pieces.tokenizer_path("piece_bpe_32k.model"))
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(20)]
    for t in texts * 2:
        m.encode_texts([t])
        assert len(m.units) < 100 and len(m.units.old) < 100
    assert m.encode_texts(texts) == [(",".join(map(str, m.library.encode(t))), t) for t in texts]


def test_media_round_trip(spark, odd):
    for df in (odd, documents(spark, DATA)):
        want = Counter()
        for d, t in texts_of(df):
            raw = t.encode()
            payload = raw + bytes(-len(raw) % 64) if raw else bytes(64)
            want[(d, len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))] += 1
        got = media.media_digest(df).collect()
        assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
        by_payload = {}
        for r in got:
            assert by_payload.setdefault((r.n_bytes, r.payload_sha256), (r.feature, r.media_sha256, r.media_bytes)) == (r.feature, r.media_sha256, r.media_bytes)


def test_packets_cover_the_payload(odd):
    stored = media.media_column(odd)
    content = {r.doc_id: r.media for r in stored.filter("doc_id IN (4, 15)").collect()}
    for d, blob in content.items():
        rows = media.packet_table(stored.filter(f"doc_id = {d}")).orderBy("packet").collect()
        payload = b"".join(blob[r.start : r.start + r.size] for r in rows)
        assert payload == media.demux(blob) and payload.rstrip(b"\0") == {r.doc_id: r.text for r in odd.collect() if r.doc_id}[d].encode()
        times = [r.timestamp_ns for r in rows]
        assert times == sorted(times) and rows[0].cued and {r.track for r in rows} == {1}
    frames, cues = media.packets(content[4])
    assert len(cues) == len({f[0] for f in frames}) > 1
    assert all(content[4][at : at + 4] == b"\x1f\x43\xb6\x75" for _, _, at in cues)


def test_all_lacings_unknown_sizes_and_groups():
    def block(ident, lacing, head, frames, flags=0):
        return media._element(ident, b"\x81\x00\x05" + bytes([flags | lacing << 1]) + head + b"".join(frames))

    sizes = [300, 10, 700, 5]
    frames = [bytes([i]) * n for i, n in enumerate(sizes)]
    xiph = bytes([3, 255, 45, 10, 255, 255, 190])
    blocks = [block(media.SIMPLE_BLOCK, media.XIPH, xiph, frames, 0x80), block(media.SIMPLE_BLOCK, media.FIXED, b"\x01", [b"ab", b"cd"])]
    blocks.append(media._element(media.BLOCK_GROUP, block(media.BLOCK, media.NO_LACING, b"", [b"zz"]) + media._element(media.REFERENCE, b"\x01")))
    blocks.append(media._block(frames, 9))
    unknown = media._uint(media.CLUSTER) + b"\xff" + media._element(media.TIMESTAMP, b"\x64") + b"".join(blocks)
    data = media._HEAD + media._uint(media.SEGMENT) + b"\x01" + b"\xff" * 7 + media._INFO + unknown + media._element(media.CLUSTER, media._element(media.TIMESTAMP, b"\xc8") + blocks[1])
    got, _ = media.packets(data)
    assert [(f[0], f[5]) for f in got] == [(0, n) for n in sizes] + [(0, 2), (0, 2), (0, 2)] + [(0, n) for n in sizes] + [(1, 2), (1, 2)]
    assert got[0][2] == 105 * media.SCALE_NS and got[0][6] and not got[6][6]
    assert media.demux(data) == b"".join(frames) + b"abcdzz" + b"".join(frames) + b"abcd"


@pytest.mark.parametrize("cut", [0, 3, 40, 150, 200])
def test_broken_media_ends_quietly(cut):
    whole = media.mux(bytes(range(256)) * 4)
    frames, _ = media.packets(whole[:cut])
    assert len(frames) <= len(media.packets(whole)[0])


def test_rowwise_on_empty_tables(empty):
    for df in (pieces.encode_decode(empty), media.media_digest(empty), media.media_column(empty), media.packet_table(media.media_column(empty))):
        assert df.count() == 0
