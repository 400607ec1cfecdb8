"""Operators on token ids against the tokenizers library itself."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barloom.llm import chunk_codec, encoding, packing, token_count, token_file
from barloom.llm.encoding import PieceEncoder
from barloom.llm.queries import BYTE_TOKENIZER, WORD_TOKENIZER, tokenizer_path
from tests.llm.cases import ODD_TEXTS, documents, empty_documents, plain

BYTES, WORDS = tokenizer_path(BYTE_TOKENIZER), tokenizer_path(WORD_TOKENIZER)


def library_ids(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_piece_encoder_equals_the_library(path):
    encoder = PieceEncoder(path, max_pieces=50, max_words=50)
    texts = [t or "" for t in ODD_TEXTS]
    want = [packed(library_ids(path, t)) for t in texts]
    for _ in range(2):
        assert encoder.encode(texts) == want
        assert [encoder.encode([t])[0] for t in texts] == want


PIECES = st.sampled_from(["a", "the", "don't", "'s", " ", "  ", "\n", "###", "12", "é", "ß", "<|", "日", "Ab", ".", "'"])


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join))
def test_pieces_counts_and_chunks_equal_the_library(text):
    for path in (BYTES, WORDS):
        ids = packed(library_ids(path, text))
        encoder = _encoder(path)
        assert encoder.encode([text])[0] == ids
        assert chunk_codec.ChunkEncoder(encoder).encode([text.encode()])[0] == ids
    assert token_count.pair_merger(BYTES).count(text) == len(library_ids(BYTES, text))


_ENCODERS = {}


def _encoder(path):
    return _ENCODERS.setdefault(path, PieceEncoder(path))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=6))
def test_texts_side_by_side_equal_the_library(texts):
    encoder = _encoder(BYTES)
    want = [packed(encoder.library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert encoder.encode(texts) == want
    forgetful = encoding.BytePieces(encoder.library, max_pieces=3)
    plain_texts = [(raw, ids) for t, ids in zip(texts, want, strict=True) if (raw := encoder._plain(t)) is not None]
    for _ in range(2):
        assert forgetful.encode([raw for raw, _ in plain_texts]) == [ids for _, ids in plain_texts]
    assert len(forgetful.slots) <= 3 and len(forgetful.stops) == len(forgetful.slots) + 1
    assert len(forgetful.ids) == forgetful.stops[-1]


class Asked:
    """The library, noting the texts that go through all its steps."""

    def __init__(self, library):
        self.library, self.texts = library, []

    @classmethod
    def from_file(cls, path):
        return cls(Tokenizer.from_file(path))

    def __getattr__(self, name):
        return getattr(self.library, name)

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.library.encode_batch_fast(texts, **options)


def test_runs_of_letters_go_to_the_model_alone(monkeypatch):
    monkeypatch.setattr("tokenizers.Tokenizer", Asked)
    encoder = PieceEncoder(BYTES)
    text = "The thonre inwh ästÀÃig.\nThat thonre. 12 don't"
    for new in ([" 12", "'t", ".", "\n"], []):
        assert encoder.encode([text, text]) == [packed(library_ids(BYTES, text))] * 2
        assert sorted(encoder.library.texts) == sorted(new)
        encoder.library.texts.clear()


def test_token_counts(spark):
    docs = documents(spark)
    got = Counter(tuple(r) for r in token_count.token_counts(docs, BYTES).collect())
    want = Counter()
    for doc_id, text in plain(docs):
        n = len(library_ids(BYTES, text))
        want[doc_id, len(text.encode()), n, n > 512] += 1
    assert got == want
    assert token_count.token_counts(empty_documents(spark), BYTES).count() == 0


def test_merges_take_the_lowest_rank_first():
    merger = token_count.pair_merger(BYTES)
    rng = np.random.default_rng(3)
    for _ in range(200):
        word = "".join(rng.choice(list("etaoinsrhl'.!"), rng.integers(1, 40)))
        assert merger.count(word) == len(library_ids(BYTES, word))


def test_chunks_meet_exactly_and_are_encoded_once():
    encoder = chunk_codec.ChunkEncoder(PieceEncoder(WORDS))
    passage = " ".join(f"word{i} other{i * 7}" for i in range(2000))
    texts = [passage, "some lead text " + passage, passage + " and more"]
    got = encoder.encode([t.encode() for t in texts])
    assert got == [packed(library_ids(WORDS, t)) for t in texts]
    total = sum(len(chunk_codec.chunks(t.encode())) for t in texts)
    assert encoder.encoded < total / 2  # the passage's chunks are shared
    assert all(len(chunk_codec.chunks(t.encode())) > 5 for t in texts)


def test_chunk_codec(spark):
    docs = documents(spark)
    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for doc_id, text in plain(docs):
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in chunk_codec.encode_and_decode(docs, WORDS).collect()) == want
    ids = {r.doc_id: r.ids for r in chunk_codec.encode_documents(docs.where("doc_id < 8"), WORDS).collect()}
    assert ids[4] == library_ids(WORDS, "a") and ids[0] == []
    assert chunk_codec.encode_and_decode(empty_documents(spark), WORDS).count() == 0


# ---- token files


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700),
    st.integers(1, 200),
    st.sampled_from([50.0, 90.0, 100.0]),
)
def test_blocks_round_trip(values, block, percentile):
    ids = np.array(values, np.uint32)
    payload, starts = token_file.pack_blocks(ids, block, percentile)
    got = [token_file.unpack_block(payload[s:], min(block, len(ids) - k * block)) for k, s in enumerate(starts.astype(int))]
    assert (np.concatenate(got) if got else np.zeros(0)).tolist() == values


def test_shard_reads_whole_and_in_part():
    rng = np.random.default_rng(0)
    ids = np.where(rng.random(5000) < 0.02, rng.integers(0, 2**31, 5000), rng.integers(100, 900, 5000)).astype(np.uint32)
    raw = token_file.write_shard([None, 7, 9], [0, 1234, 3766], ids)
    shard = token_file.Shard(raw)
    assert shard.doc_ids == [None, 7, 9] and shard.counts.tolist() == [0, 1234, 3766]
    assert (shard.read_all() == ids).all()
    for start, length in [(0, 0), (0, 1), (127, 2), (1234, 3766), (4999, 1)]:
        assert (shard.read(start, length) == ids[start : start + length]).all()
    assert len(raw) < 4 * len(ids) / 2  # outliers do not widen their blocks
    with pytest.raises(ValueError):
        token_file.Shard(b"\0" * 64)


def test_token_file(spark):
    docs = documents(spark)
    rows = token_file.token_file_index(docs, BYTES, end_id=2).collect()
    texts = sorted(plain(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start, want = 0, Counter()
    for doc_id, text in texts:
        ids = [*library_ids(BYTES, text), 2]
        want[doc_id, start, len(ids), zlib.crc32(packed(ids))] += 1
        start += len(ids)
    assert Counter(tuple(r) for r in rows) == want
    assert token_file.token_file_index(empty_documents(spark), BYTES, end_id=2).count() == 0


def test_shards_close_at_their_size(spark, monkeypatch):
    monkeypatch.setattr(token_file, "SHARD_IDS", 500)
    docs = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(token_file.token_file_index(docs, BYTES, end_id=2).collect())
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()


# ---- packing


def check_packing(pieces, docs_ids):
    """Every id in one piece, sequences gapless and within size; returns padding and tokens."""
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault(p.doc_id, []).append(p)
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        total = sum(p.length for p in own)
        assert total <= 2048 and len({p.context for p in own}) == len({p.step_group for p in own}) == 1
        padding += own[0].context - total
    assert set(by_doc) == set(docs_ids)
    for doc_id, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        raw = packed(docs_ids[doc_id])
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        assert sum(p.length for p in own) == len(raw) // 4 == own[0].doc_tokens
        for p in own:
            assert p.ids_crc32 == zlib.crc32(raw[4 * p.start : 4 * (p.start + p.length)])
    return padding, sum(p.length for p in pieces)


def test_packing(spark):
    docs = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {d: [*library_ids(WORDS, t), 1] for d, t in plain(docs)}
    pieces = packing.pack_documents(docs.coalesce(2), WORDS, pool_tokens=20_000).collect()
    padding, tokens = check_packing(pieces, ids)
    # one short sequence a task at most
    assert padding <= 2 * 2048
    assert {p.context for p in pieces} >= {2048, 1024, 512}
    repeated = packing.pack_documents(documents(spark), WORDS).collect()
    assert sum(p.length for p in repeated) == sum(len(library_ids(WORDS, t)) + 1 for _, t in plain(documents(spark)))
    assert packing.pack_documents(empty_documents(spark), WORDS).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=60))
def test_tiers_fill_their_windows(lengths):
    packer = packing.TierPacker()
    made = [s for i, n in enumerate(lengths) for s in packer.add(i, n)]
    made += packer.pack()
    sizes = [sum(p[2] for p in s) for s in made]
    assert set(sizes) <= {256, 512, 1024, 2048}
    made += packer.rest()
    sizes = [sum(p[2] for p in s) for s in made]
    assert sum(size not in (256, 512, 1024, 2048) for size in sizes) <= 1
    covered = Counter()
    for doc, start, length in (p for s in made for p in s):
        covered.update((doc, k) for k in range(start, start + length))
    assert set(covered.values()) <= {1} and len(covered) == sum(lengths)


def test_step_groups_are_even():
    lengths = [2048] * 40 + [1024] * 30 + [512] * 50 + [256] * 20
    groups = packing.step_groups(lengths, 16 * 2048)
    cost = Counter()
    for size, group in zip(lengths, groups, strict=True):
        cost[group] += size**2
    assert len(cost) > 1 and max(cost.values()) - min(cost.values()) <= 2048**2


def test_sizes_must_be_powers_of_two():
    with pytest.raises(ValueError):
        packing.TierPacker(2000)
