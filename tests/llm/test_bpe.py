import hashlib
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from brindle.llm.bpe import decode_documents, encode_documents, load_tokenizer, op7_bpe_round_trip, pieces_of  # noqa: E402
from brindle.llm.packing import op1_best_fit_packing, pack_documents, plan_bins, sequences  # noqa: E402
from brindle.session import table  # noqa: E402
from tests.conftest import SF  # noqa: E402

ODD = [
    None, "", " ", "   ", "\n\n", "a", "a b", "a  b", " a\n b", "a\n\nb", "a \n\n  b\t", "don't we'll\x1c!! x\x1f y", "été\xa0  ñ   z　q", "x" * 30_000,
    "1234 5,678.9 <|endoftext|> end<|endoftext|>x", "日本語 テスト 漢字", "\x00 a\x00b", "é ΣΑΣ ΟΔΟΣ. İstanbul", "😀😀 👍🏽", "tab\tand\r\nline ",
]


@pytest.mark.parametrize("name,split", [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "spaces")])
def test_ids_equal_the_library(spark, name, split):
    path = public_tokenizers.path(name)
    rows = [(i if i else None, t, 1) for i, t in enumerate([*ODD, *ODD[4:8]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    found = encode_documents(docs, path, split, store=True).collect()
    tokenizer = load_tokenizer(path)
    want = sorted((i or -1, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
    assert sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in found) == want


def test_round_trip_of_the_table(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = load_tokenizer(path)
    found = {r.doc_id: r for r in op7_bpe_round_trip(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(found) == len(docs)
    for d in docs:
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (found[d.doc_id].n_tokens, found[d.doc_id].ids_sha256, found[d.doc_id].decoded_sha256) == want


def test_decode_of_odd_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = [np.array(x, "<u4").tobytes() for x in ([], [50256, 64], [165, 99, 50_000_000])]
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(ids)] + [(9, None)], "doc_id long, ids binary")
    found = {r.doc_id: r.text for r in decode_documents(rows, pieces_of(spark, path)).collect()}
    tokenizer = load_tokenizer(path)
    assert found == {0: "", 1: "<|endoftext|>a", 2: tokenizer.decode([165, 99], skip_special_tokens=False), 9: ""}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_the_table(spark):
    rows = op1_best_fit_packing(spark, SF).collect()
    tokenizer = load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    used = check_places(rows, 2048)
    assert used <= -(-sum(r.length for r in rows) // 2048) * 1.03 + 1
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for d in table(spark, SF, "documents").collect():
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [(k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
        assert sorted(found.pop(d.doc_id)) == cuts
    assert not found


def test_packing_small_capacity_and_sequences(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i % 7, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, length string")
    packed = pack_documents(docs, path, capacity=16)
    check_places(packed.collect(), 16)
    total = sum(len(r.ids) for r in sequences(packed).collect())
    assert total == 4 * packed.agg({"length": "sum"}).first()[0]


def test_plan_places_every_item_once():
    rng = np.random.default_rng(1)
    for capacity in (10, 64, 2048):
        lengths = rng.integers(1, capacity + 1, 3000)
        values, counts = np.unique(lengths, return_counts=True)
        plan = plan_bins(dict(zip(values.tolist(), counts.tolist(), strict=True)), capacity)
        bins, seen, large = {}, {}, {}
        for n, since, upto, first, each, at in plan:
            for k in range(since, upto):
                seen.setdefault(n, []).append(k)
                j = k - since
                bins.setdefault(first + j // each, []).append((at + j % each * n, n))
                large[first + j // each] = large.get(first + j // each, 0) + (3 * n > capacity)
        assert {n: sorted(k) for n, k in seen.items()} == {int(n): list(range(c)) for n, c in zip(values, counts, strict=True)}
        for own in bins.values():
            ends = [0]
            for offset, n in sorted(own):
                assert offset == ends[-1]
                ends.append(offset + n)
            assert ends[-1] <= capacity
        assert max(large.values()) <= 2
        assert len(bins) <= lengths.sum() / capacity * 1.05 + 1
