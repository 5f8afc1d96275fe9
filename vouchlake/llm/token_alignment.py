"""Alignment of two tokenizers by distinct segments.

A (byte-level BPE of the `tokenizers` library) reads a space and the text, B
(SentencePiece BPE) the text, before which it puts a space itself. The text is cut
before each run of white space where both vocabularies show that nothing merges across: A
splits there by its pattern, and neither has a token in which the run's first character
stands behind another that is no white space.

Documents are read in blocks of consecutive rows; a block knows each of its segments by
a number, so that it sends a segment once, however often it has it. Over all blocks each
distinct segment is tokenised and aligned once. Its links, weighted by how often it
occurs, give the counts of id pairs. Pairs in more than one of HOT links are at most
HOT in number and are broadcast; all others, none of them frequent, are joined. Then the
alignments are joined back to the blocks' segments, packed by block, and each document
is composed from its segments' numbers.

Groups are the stretches between byte offsets at which tokens of both end; links are all
pairs of an A and a B token whose byte ranges overlap. Null and empty texts, and texts
that hold U+2581 (which B reads as a space, so that its bytes are not the text's), have
no tokens: zeros and an empty string. Rows that share an id are documents of their own;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchlake.llm.bpe import byte_symbols
from vouchlake.llm.piece_bpe import SPACE, PieceEncoder, PieceVocabulary
from vouchlake.llm.scratch import Scratch, small_batches
from vouchlake.llm.token_count import SPACE as WHITE

BLOCK_BYTES, HOT, B_BITS = 20 << 20, 20_000, 20
_PARTS = "block long, doc_id long, codes array<int>, code int, segment string, n long"
_ALIGNED = "segment string, n long, n_a int, n_b int, n_groups int, groups string, links array<long>"
_PACKED = pa.schema([("code", pa.int32()), ("n_a", pa.int32()), ("n_b", pa.int32()), ("n_groups", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string())])


def unsafe_spaces(a_path: str, b_path: str) -> str | None:
    """The white space that a token of either vocabulary holds right behind another
    character, so that a run that starts with it is no place to cut; None: all."""
    with open(a_path, encoding="utf-8") as f:
        whole = json.load(f)
    pre = whole["pre_tokenizer"]
    if whole["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
        raise ValueError("A must be a byte-level vocabulary that leaves the text as it is")
    byte = {s: b for b, s in enumerate(byte_symbols())}
    a = (bytes(map(byte.__getitem__, t)).decode(errors="replace") for t in whole["model"]["vocab"] if byte.keys() >= set(t))
    b = (p.replace(SPACE, " ") for p in PieceVocabulary(b_path).score)
    behind = re.compile(f"[^{WHITE}]([{WHITE}])").findall
    return "".join(sorted({w for token in chain(a, b) for w in behind(token)})) if pre["use_regex"] else None


def segmenter(unsafe: str | None) -> Callable[[str | None], list[str]]:
    """Cuts a space and a text before runs of white space that start with no unsafe one."""
    on = f"(?:[{re.escape(unsafe)}][{WHITE}]*[^{WHITE}]*)*" if unsafe else ""
    find = re.compile(f"[{WHITE}]*[^{WHITE}]+{on}|[{WHITE}]+").findall if unsafe is not None else lambda text: [text]
    return lambda text: find(" " + text) if text and SPACE not in text else []


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.a, self.b = Tokenizer.from_file(a_path), PieceEncoder(b_path, 100_000)
        self.a.encode_special_tokens = True
        byte = set(byte_symbols())
        vocab = self.a.get_vocab()
        self.a_size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.a_size[i] = len(token) if byte >= set(token) else len(token.encode())
        self.b_size = np.array([len(b) for b in self.b.vocabulary.bytes], np.int64)
        self.names = list(map(str, range(max(len(self.a_size), len(self.b_size)))))

    def align(self, segments: list[str]) -> dict[str, list | np.ndarray]:
        """n_a, n_b, n_groups, groups and links (as a * 2^B_BITS + b) of each segment."""
        each_a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        codes = self.b.codes.__getitem__
        each_b = [b"".join(map(codes, self.b.pieces(s.replace(" ", SPACE)))) for s in segments]
        n_a, n_b = np.array(list(map(len, each_a))), np.array([len(b) // 4 for b in each_b])
        a, b = np.array(list(chain.from_iterable(each_a)), np.int64), np.frombuffer(b"".join(each_b), np.int32).astype(np.int64)
        ends = np.cumsum([len(s.encode()) for s in segments])
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        if not np.array_equal(a_ends[np.cumsum(n_a) - 1], ends) or not np.array_equal(b_ends[np.cumsum(n_b) - 1], ends):
            raise ValueError("tokens do not give back the bytes of their segment")
        cuts, links = np.intersect1d(a_ends, b_ends), np.union1d(a_ends, b_ends)
        pairs = a[np.searchsorted(a_ends, links)] << B_BITS | b[np.searchsorted(b_ends, links)]
        group_a, group_b = np.searchsorted(a_ends, cuts) + 1, np.searchsorted(b_ends, cuts) + 1
        words_a, words_b = [self.names[i] for i in a.tolist()], [self.names[i] for i in b.tolist()]
        shown, at_a, at_b = [], 0, 0
        for to_a, to_b in zip(group_a.tolist(), group_b.tolist(), strict=True):
            shown.append(f"{','.join(words_a[at_a:to_a])}|{','.join(words_b[at_b:to_b])}")
            at_a, at_b = to_a, to_b
        last = np.searchsorted(cuts, ends) + 1
        first = np.concatenate([[0], last[:-1]])
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": last - first, "groups": [";".join(shown[x:y]) for x, y in zip(first.tolist(), last.tolist(), strict=True)],
            "links": pairs, "link_ends": np.searchsorted(links, ends) + 1,
        }


@lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this Python worker, kept from task to task."""
    return Aligner(a_path, b_path)


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, kind))


def _numbers() -> defaultdict[str, int]:
    """Gives each new key the next number."""
    out: defaultdict[str, int] = defaultdict()
    out.default_factory = out.__len__
    return out


def _parts(docs: DataFrame, unsafe: str | None) -> DataFrame:
    """Rows of two kinds: documents as numbers of their block's segments, and those segments."""
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.list_(pa.int32())), ("code", pa.int32()), ("segment", pa.string()), ("n", pa.int64())])

    def rows(k: int, block: int, **columns: pa.Array) -> pa.RecordBatch:
        full = {"block": pa.array(np.full(k, block)), **columns}
        return pa.RecordBatch.from_arrays([full[f.name].cast(f.type) if f.name in full else pa.nulls(k, f.type) for f in schema], schema=schema)

    limit = BLOCK_BYTES  # as it is on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, block = segmenter(unsafe), TaskContext.get().partitionId() << 32
        code, count, held = _numbers(), np.zeros(0, np.int64), 0

        def close() -> Iterator[pa.RecordBatch]:
            names = list(code)
            for k in range(0, len(names), 20_000):
                some = names[k : k + 20_000]
                numbers = np.arange(k, k + len(some))
                yield rows(len(some), block, code=pa.array(numbers), segment=pa.array(some, pa.string()), n=pa.array(count[numbers]))

        for batch in batches:
            split = [cut(t) for t in batch.column(1).to_pylist()]
            numbers = np.array(list(map(code.__getitem__, chain.from_iterable(split))), np.int32)
            count = np.bincount(numbers, minlength=len(code)) + np.pad(count, (0, len(code) - len(count)))
            yield rows(batch.num_rows, block, doc_id=batch.column(0), codes=_lists(numbers, np.cumsum(list(map(len, split))), pa.int32()))
            held += batch.column(1).nbytes
            if held > limit:
                yield from close()
                code, count, held, block = _numbers(), np.zeros(0, np.int64), 0, block + 1
        yield from close()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, _PARTS)


def _aligned(distinct: DataFrame, a_path: str, b_path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = _aligner(a_path, b_path).align(batch.column(0).to_pylist())
                ints = [pa.array(got[c], pa.int32()) for c in ("n_a", "n_b", "n_groups")]
                links = _lists(got["links"], got["link_ends"], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, *ints, pa.array(got["groups"], pa.string()), links], names=["segment", "n", "n_a", "n_b", "n_groups", "groups", "links"])

    return distinct.mapInArrow(run, _ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """link, count (occurrences in the corpus), best (whether no pair of its B id has more), segments."""
    b = F.col("link").bitwiseAND(F.lit((1 << B_BITS) - 1))
    counts = aligned.select("n", F.explode("links").alias("link")).groupBy("link").agg(F.sum("n").alias("count"), F.count("*").alias("segments"))
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))  # a row for each id of B's vocabulary at most
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("link", "count", (F.col("count") == F.col("most")).alias("best"), "segments")


def _link_sums(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """n_best and count_sum of each distinct segment."""
    total = pairs.agg(F.sum("segments")).first()[0] or 0
    hot = F.broadcast(pairs.where(F.col("segments") * HOT > total))
    cold = pairs.where(F.col("segments") * HOT <= total)
    links = aligned.select("segment", F.explode("links").alias("link"))
    both = links.join(hot, "link").unionByName(links.join(hot.select("link"), "link", "left_anti").join(cold, "link"))
    return both.groupBy("segment").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))


def _packed(rows: DataFrame) -> DataFrame:
    """Rows sorted by block, as one compressed table for each block and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blob() -> pa.RecordBatch:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, _PACKED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(pa.concat_tables(held).select(_PACKED.names).cast(_PACKED))
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["block", "packed"])

        _aligner.cache_clear()  # this worker aligns no more
        held: list[pa.Table] = []
        now = None
        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if held and block[x] != now:
                    yield blob()
                    held = []
                now = int(block[x])
                held.append(pa.Table.from_batches([batch.slice(x, y - x)]))
        if held:
            yield blob()

    return rows.mapInArrow(run, "block long, packed binary")


_OUT = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups", pa.string())])


def _compose(docs: pa.Table, packed: pa.Table) -> pa.Table:
    _aligner.cache_clear()
    tables = [pa.ipc.open_stream(b).read_all() for b in packed.column("packed").to_pylist()]
    segments = (pa.concat_tables(tables) if tables else _PACKED.empty_table()).sort_by("code")
    n_a, n_b, n_groups, n_best, count_sum = (segments.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b", "n_groups", "n_best", "count_sum"))
    sums = np.stack([n_a, n_b, n_groups, n_a + n_b - n_groups, n_best, count_sum], axis=1)
    shown = segments.column("groups").to_pylist()
    out, rows, size = [], [], 0
    ids = docs.column("doc_id").to_pylist()
    for k, codes in enumerate(docs.column("codes")):
        mine = codes.values.to_numpy()
        text = ";".join(map(shown.__getitem__, mine.tolist()))
        rows.append((ids[k], *sums[mine].sum(axis=0).tolist(), text))
        size += len(text)
        if size > 4 << 20 or k == len(ids) - 1:
            out.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT))
            rows, size = [], 0
    return pa.Table.from_batches(out, _OUT)


def align_tokens(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups, the alignment
    itself: `a1,a2|b1;a3|b2,b3`."""
    scratch = Scratch(spark, "alignment")
    small_batches(spark, 256)  # whole texts
    parts = scratch.cut(_parts(docs, unsafe_spaces(a_path, b_path)), "parts", "zstd")
    small_batches(spark, 5_000)  # segments
    members = parts.where("code is not null").select("block", "code", "segment", "n")
    distinct = members.groupBy("segment").agg(F.sum("n").alias("n"))
    aligned = scratch.cut(_aligned(distinct, a_path, b_path), "aligned", "zstd", clean=True)
    pairs = scratch.cut(pair_counts(aligned), "pairs", clean=True)
    sums = scratch.cut(_link_sums(aligned, pairs), "sums", "zstd", clean=True)
    joined = members.drop("n").join(aligned.drop("n", "links"), "segment").join(sums, "segment")
    rows = joined.select("block", *_PACKED.names).sortWithinPartitions("block")
    packed = scratch.cut(_packed(rows), "packed", clean=True)
    scratch.drop("aligned", "pairs", "sums")
    whole = parts.where("code is null").select("block", "doc_id", "codes")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return whole.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(_compose, schema)
