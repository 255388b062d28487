import bisect
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from brindle.llm import alignment
from brindle.session import table
from tests.conftest import SF


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def byte_chars():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


def brute(rows, libraries):
    """By definition, with the libraries' own ids of whole texts."""
    a, b = libraries
    back = byte_chars()
    spell = {i: bytes(back[c] for c in p) for p, i in a.get_vocab(with_added_tokens=False).items()}

    def piece(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if len(name) == 6 and name.startswith("<0x") and name.endswith(">") else name.replace("▁", " ").encode()

    docs, count = [], Counter()
    for doc, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        by_a, by_b = [spell.get(i, b"?") for i in ids_a], [piece(i) for i in ids_b]
        if not text or not b"".join(by_a) == b"".join(by_b) == (" " + text).encode():
            docs.append((doc, [], [], []))
            continue
        end_a, end_b = np.cumsum([len(x) for x in by_a]).tolist(), np.cumsum([len(x) for x in by_b]).tolist()
        cuts = sorted(set(end_a) & set(end_b))
        groups = [([], []) for _ in cuts]
        for side, (ids, ends) in enumerate(((ids_a, end_a), (ids_b, end_b))):
            for i, e in zip(ids, ends, strict=True):
                groups[bisect.bisect_left(cuts, e)][side].append(i)
        docs.append((doc, ids_a, ids_b, groups))
        count.update({(x, y) for left, right in groups for x in left for y in right})
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for doc, ids_a, ids_b, groups in docs:
        links = [(x, y) for left, right in groups for x in left for y in right]
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc, len(ids_a), len(ids_b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), sha))
    return sorted(out, key=str)


def found(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, a int, chunk string").repartition(parts)
    paths = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
    return sorted((tuple(r) for r in alignment.align_documents(docs, *paths).collect()), key=str)


ODD = [
    "", " ", "  ", "a", " a", "a ", "  two  spaces  ", "line\nline\n\n  next", "tab\tand \t mixed \n x", "café à la", "你好 世界", "\U0001f600 x",
    "a▁b", "▁", "<|endoftext|> and <s> </s> <unk> <0x41>", "no break 　wide", "\x00 nul \x1f", "don't we'll I'M", "é combining", "x" * 3000,
    "1234567 12 3", "\r\n windows\r\n", "﻿mark", "ﬁ ligature ½", "a" + " " * 70 + "b", "trail \n", "  sep",
]


def test_odd_texts_equal_brute_force(spark, libraries):
    rows = [*enumerate(ODD), (100, None), (None, "a null id"), (3, "a"), (3, "a"), (7, "the end of the end")]
    assert found(spark, rows) == brute(rows, libraries)


def test_query_equals_brute_force(spark, libraries):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert sorted((tuple(r) for r in alignment.op11_token_alignment(spark, SF).collect()), key=str) == brute(rows, libraries)


def test_long_texts_in_parts_and_small_chunks(spark, libraries):
    known = alignment._units(P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model"))
    text = " ".join(f"wort{i % 97} und\nzeile {i}" for i in range(400))
    whole, parts = alignment._Document(), alignment._Document()
    units = known.numbers(text)
    known.learn()
    alignment._align(known, [(whole, units)])
    for own in np.array_split(units, 9):
        alignment._align(known, [(parts, own)])
    assert whole.sha.digest() == parts.sha.digest() and whole.n_links == parts.n_links
    assert all((x == y).all() for x, y in zip(whole.pairs(), parts.pairs(), strict=True))


def test_overlaps_of_both_directions():
    a, b = np.array([0, 3, 4, 9]), np.array([0, 2, 4, 6, 9])
    ends_a, ends_b = [3, 4, 9, 12], [2, 4, 6, 9, 12]
    want = [(i, j) for i in range(4) for j in range(5) if a[i] < ends_b[j] and b[j] < ends_a[i]]
    assert [tuple(x) for x in alignment.overlap_pairs(a, b).tolist()] == want
    in_a, in_b = alignment.groups(a, b)
    assert in_a.tolist() == [0, 0, 1, 2] and in_b.tolist() == [0, 0, 1, 1, 2]
    assert set(want) <= set(zip(*(x.tolist() for x in alignment.group_links(in_a, in_b)), strict=True))


def test_empty_table(spark):
    assert found(spark, []) == []
