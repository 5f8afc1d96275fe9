"""Encoding, decoding and alignment against the libraries, on awkward and real texts."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vouchlake.llm import piece_bpe, scratch, token_alignment
from vouchlake.llm.bpe import byte_symbols

P = pytest.importorskip("public_tokenizers")
PIECES, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
ALPHABET = ["a", "e", "▁", " ", "  ", "é", "中", "文", "😀", "\n", "\r", "\t", "\0", "<s>", "<0x41>", "<|endoftext|>", "the", "ing", "1", ".", "'s", "\xa0", "　", "\x1c", "ß", "‍"]
FIXED = [None, "", " ", "   ", "x   y", "};\r\n  x", "a" * 3000, "ab " * 4000, "=" * 500, " " * 400 + "z", "same text", "same text"]


def texts():
    rng = random.Random(7)
    return FIXED + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(600)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 50 else 1, t, "clash", "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, codes string")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.mark.parametrize("table", ["docs", "real"])
def test_pieces_are_those_of_the_library(spark, request, table):
    rows, sp = request.getfixturevalue(table), library()
    encoded = piece_bpe.encode(spark, rows, PIECES)
    got = piece_bpe.decode(spark, encoded, PIECES).collect()
    want = []
    for r in rows.collect():
        ids = sp.encode(r["text"] or "")
        want.append((r["doc_id"], ids, sp.decode(ids)))
    assert sorted(map(tuple, got)) == sorted(want)
    assert piece_bpe.decode(spark, encoded.limit(0), PIECES).count() == 0


def test_any_ids_are_decoded_as_the_library_does():
    rng, sp, mine = random.Random(3), library(), piece_bpe.PieceDecoder(PIECES)
    for _ in range(4000):
        ids = [rng.randrange(sp.vocab_size()) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randint(0, 10))]
        assert mine.decode(ids) == sp.decode(ids)


def test_backtracking_gives_what_merging_one_by_one_gives():
    rng, encoder = random.Random(5), piece_bpe.PieceEncoder(PIECES)
    for _ in range(500):
        text = "".join(rng.choice("▁▁abethingéx中") for _ in range(rng.randint(1, 30)))
        assert encoder.pieces(text) == encoder.merged(text)


def test_short_segments_are_merged_side_by_side():
    rng, encoder, sp = random.Random(6), piece_bpe.PieceEncoder(PIECES), library()
    segments = ["".join(rng.choice("  abethingéxб1.'") for _ in range(rng.randint(1, piece_bpe.SHORT))) for _ in range(500)]
    for s, ids in zip(segments, encoder.merges.merge(segments), strict=True):
        assert ids == b"".join(encoder.codes[p] for p in encoder.merged(s.replace(" ", "▁")))
    assert encoder.merges.merge(["\n", "the", "a\n"])[0::2] == [None, None]
    encoder.pieces = None  # no walk from the left
    for t in ("oueauenelle, Anhast%%%  thenreentionhe", "Шатble 555-4155"):
        assert np.frombuffer(encoder.encode([t])[0], np.int32).tolist() == sp.encode(t)


def test_texts_are_cut_between_characters_that_no_piece_joins():
    find = piece_bpe.PieceEncoder(PIECES).find
    assert find(" Anhast.\nThe  end") == [" Anhast", ".", "\n", "The", "  end"]


def test_lists_are_decoded_together_as_one_by_one():
    rng, sp, mine = random.Random(4), library(), piece_bpe.PieceDecoder(PIECES)
    for ids in (3, 300, sp.vocab_size()):  # with ids of no text, with bytes, any
        lists = [[rng.randrange(3, max(ids, 4)) for _ in range(rng.randint(0, 10))] for _ in range(500)]
        whole = pa.array([*lists, None], pa.list_(pa.int32()))
        assert mine.decode_all(whole) == [*map(sp.decode, lists), ""]
        assert mine.decode_all(whole[7:20]) == list(map(sp.decode, lists[7:20]))


def test_the_cache_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHE_BYTES", 2000)
    encoder, sp = piece_bpe.PieceEncoder(PIECES, 50), library()
    for t in texts()[2:]:
        assert np.frombuffer(encoder.encode([t])[0], np.int32).tolist() == sp.encode(t)
        assert len(encoder.pairs) <= 51


def aligned_one_by_one(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) from the libraries' whole texts."""
    from tokenizers import Tokenizer

    a_lib, sp = Tokenizer.from_file(BYTES), library()
    a_lib.encode_special_tokens = True
    byte = {s: b for b, s in enumerate(byte_symbols())}

    def a_bytes(i):
        return bytes(byte[c] for c in a_lib.id_to_token(i))

    def b_bytes(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    def spans(ids, value):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(value(i))))
            at = out[-1][2]
        return out

    counts, per = Counter(), []
    for r in rows:
        t = r["text"] or ""
        a = a_lib.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t)
        if b"".join(map(a_bytes, a)) != (" " + t).encode() or b"".join(map(b_bytes, b)) != (" " + t).encode():
            a = b = []
        a, b = spans(a, a_bytes), spans(b, b_bytes)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) * len(b) < 200_000 else None
        if links is None:
            links, j = [], 0
            for x in a:
                while b[j][2] <= x[1]:
                    j += 1
                k = j
                while k < len(b) and b[k][1] < x[2]:
                    links.append((x[0], b[k][0]))
                    k += 1
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [",".join(str(x[0]) for x in a if c0 < x[2] <= c1) + "|" + ",".join(str(y[0]) for y in b if c0 < y[2] <= c1) for c0, c1 in zip([0, *cuts], cuts)]
        counts.update(links)
        per.append((r["doc_id"], len(a), len(b), len(cuts), links, ";".join(groups)))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return sorted((d, na, nb, ng, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), g) for d, na, nb, ng, links, g in per)


@pytest.mark.parametrize(("block", "hot"), [(2000, 3), (20 << 20, 20_000)])
def test_alignment_of_awkward_texts(spark, docs, monkeypatch, block, hot):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(token_alignment, "HOT", hot)
    monkeypatch.setattr(token_alignment, "small_batches", lambda spark, rows: scratch.small_batches(spark, 40))
    got = token_alignment.align_tokens(spark, docs, BYTES, PIECES).collect()
    assert sorted(map(tuple, got)) == aligned_one_by_one(docs.collect())


def test_alignment_of_an_empty_table_and_of_empty_texts(spark, docs):
    assert token_alignment.align_tokens(spark, docs.limit(0), BYTES, PIECES).count() == 0
    blank = docs.where("coalesce(text, '') = ''")
    assert {tuple(r)[1:] for r in token_alignment.align_tokens(spark, blank, BYTES, PIECES).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_alignment_keeps_no_shuffle_files_of_its_steps(spark, docs):
    """They go with the step that made them, whether or not the driver's garbage is collected; the setting stays as it was."""

    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split()
        return {b.split("_")[1] for b in blocks if b.startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(scratch._CLEAN)
    token_alignment.align_tokens(spark, docs, BYTES, PIECES)
    until = time.time() + 10
    while len(shuffles() - before) > 1 and time.time() < until:  # Spark deletes them a moment later
        time.sleep(0.1)
    assert len(shuffles() - before) <= 1 and spark.conf.get(scratch._CLEAN) == setting  # one: a single number, the sum of the pairs
