"""Links between the tokens of two tokenizers, by products of sparse incidence matrices.

Each text is encoded by both tokenizers.  A matrix in compressed rows (:class:`Csr`) says which bytes a token
covers.  The product of A's matrix with the transpose of B's (row by row, after Gustavson) has an entry for each pair
of token occurrences that share bytes: an overlap link, whose value is the number of shared bytes.  Where tokens
of both end, the text falls into groups; products of the token-group matrices are the shared-group links, of which
only the number is computed (the symbolic phase of the product), since a group's pairs grow with its square.

Tokens of neither tokenizer reach over the place between a character that is surely no white space and a space, so a
text is cut into *segments* there.  A piece of texts encodes and links each distinct segment once; its documents are lists
of segments.  Any other text is one segment.

Counts over the corpus: how many documents hold a pair of ids linked.  Tasks count pairs before the shuffle, so what moves
is bounded by the pairs of ids that occur.  Each link's count is then looked up in the counted pairs, which are broadcast in
blocks of at most ``BLOCK`` pairs; each block is one pass over the stored pieces, and sums add up over blocks.  The encoding
is done once.

Defined cases: texts that are null, empty, or not given back by the bytes of their tokens have no tokens, zeros and
an empty digest; every row gets a row, and counts as a document, also repeated rows and those of null or equal ids; ties for the
highest count all are highest; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterlens.llm import text as tx
from clusterlens.llm.repeats import pack, unpack
from clusterlens.llm.staging import column, stage

BLOCK = 1 << 20  # pairs of ids in a broadcast, 17 bytes each
HELD = 1 << 20  # pairs of ids that a task holds before it hands them on, about
TOGETHER = 1 << 11  # segments encoded as one text: tokenizers slow down on long ones
PORTION = 1 << 21  # bytes of text in a piece; a longer text is a piece of its own
# A segment ends where one of these characters, none of which is white space, comes before a space; spaces at the end
# of a text stay with what is before them.
SEGMENT = re.compile(r" [^ ]*(?:(?<=[^!-~\u00a1-\u052f]) [^ ]*| +\Z)*")
CLOSED = re.compile("[!-~\u00a1-\u052f]$")
RESULT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_shared_group_links bigint,"
    " n_best bigint, count_sum bigint, groups_sha256 string"
)


class Csr:
    """A sparse matrix in compressed rows: row i has the columns ``at[ends[i] : ends[i + 1]]``, each once, with ``values``."""

    def __init__(self, ends: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
        self.ends, self.at, self.values, self.width = ends, at, values, width

    @staticmethod
    def of_intervals(sizes: np.ndarray) -> Csr:
        """Row i has ones in the ``sizes[i]`` columns after those of row i - 1."""
        total = int(sizes.sum())
        return Csr(np.concatenate([[0], np.cumsum(sizes)]), np.arange(total), np.ones(total, np.int64), total)

    @staticmethod
    def of_column(at: np.ndarray, width: int) -> Csr:
        """Row i has a one in column ``at[i]``."""
        return Csr(np.arange(len(at) + 1), at, np.ones(len(at), np.int64), width)

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))
        order = np.argsort(self.at, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(self.at, minlength=self.width))])
        return Csr(ends, rows[order], self.values[order], len(self.ends) - 1)

    def row_sizes(self, other: Csr) -> np.ndarray:
        """Terms of each row of the product with ``other``; its entries if no two of a row meet in one column."""
        terms = np.concatenate([[0], np.cumsum(np.diff(other.ends)[self.at])])
        return terms[self.ends[1:]] - terms[self.ends[:-1]]

    def times(self, other: Csr) -> Csr:
        """The product: each row is the sum of the rows of ``other`` that its columns name, times their values."""
        picked = np.diff(other.ends)[self.at]
        source = tx.spread(other.ends[self.at], picked)
        row = np.repeat(np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends)), picked)
        key = row * max(other.width, 1) + other.at[source]
        value = np.repeat(self.values, picked) * other.values[source]
        if len(key) and (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(value, first) if len(first) else value
        row, at = key[first] // max(other.width, 1), key[first] % max(other.width, 1)
        return Csr(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(self.ends) - 1))]), at, total, other.width)


# --------------------------------------------------------------------------- tokenizers


def byte_alphabet() -> dict[str, int]:
    """Which byte a character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others, in order, for the characters from 256 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {**{chr(b): b for b in printable}, **{chr(256 + k): b for k, b in enumerate(others)}}


class Vocabulary:
    """The bytes of each token, and an encoder of many texts; ``ascii`` encodes ASCII text alike, but faster."""

    def __init__(
        self, tokens: list[bytes], encode: Callable[[list[str]], list[list[int]]], ascii: Callable[[str], list[int]] | None = None
    ) -> None:
        self.encode, self._ascii = encode, ascii
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def one(self, text: str) -> np.ndarray:
        return np.array(self._ascii(text) if self._ascii and text.isascii() else self.encode([text])[0], np.int64)

    def text(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[tx.spread(self.starts[ids], self.sizes[ids])]


# Fixed value: how a byte-level tokenizer cuts text before merging.
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _by_rank(definition: dict, tokens: list[bytes]) -> Callable[[str], list[int]] | None:
    """An encoder by ranks, if merges are numbered in their order and the text is cut as usual.

    Both cut ASCII text alike; beyond that their versions of Unicode may differ.
    """
    import tiktoken

    model, cut = definition["model"], definition.get("pre_tokenizer") or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    numbered = all(model["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
    if not numbered or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or definition.get("normalizer"):
        return None
    ranks = {token: k for k, token in enumerate(tokens[: 256 + len(merges)])}
    encoding = tiktoken.Encoding("byte-level", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})
    return lambda text: encoding.encode_ordinary(" " + text)


def byte_level(definition: str) -> Vocabulary:
    """A byte-level tokenizer; it reads the text after a space, and special tokens' strings as plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.encode_special_tokens = True
    special = {t["id"]: t["content"].encode() for t in json.loads(definition).get("added_tokens", ())}
    alphabet = byte_alphabet()
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    tokens = [special[i] if i in special else bytes(alphabet[c] for c in name) for i, name in enumerate(names)]

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    return Vocabulary(tokens, encode, _by_rank(json.loads(definition), tokens))


def pieces(model: bytes) -> Vocabulary:
    """A sentence-piece tokenizer with byte pieces, which puts a space before the text itself."""
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_proto=model)

    def piece(i: int) -> bytes:
        name = processor.id_to_piece(i)
        return bytes([int(name[3:-1], 16)]) if processor.is_byte(i) else name.replace("▁", " ").encode()

    return Vocabulary([piece(i) for i in range(processor.get_piece_size())], lambda texts: processor.encode(texts, num_threads=1))


@lru_cache(maxsize=1)
def _vocabularies(definition: str, model: bytes) -> tuple[Vocabulary, Vocabulary]:
    return byte_level(definition), pieces(model)


# --------------------------------------------------------------------------- one portion of texts


class Links:
    """Tokens of several texts and the links between them.

    ``a`` and ``b`` are the ids of all tokens, ``before_a`` and ``before_b`` the tokens before each text.
    """

    def __init__(self, a: np.ndarray, before_a: np.ndarray, size_a: np.ndarray, b: np.ndarray, before_b: np.ndarray, size_b: np.ndarray) -> None:
        self.a, self.b, self.before_a, self.before_b = a, b, before_a, before_b
        # Both cover the same bytes, text by text, so no link leaves its text.
        overlap = Csr.of_intervals(size_a).times(Csr.of_intervals(size_b).transposed())
        self.left, self.right, self.shared = np.repeat(np.arange(len(a)), np.diff(overlap.ends)), overlap.at, overlap.values
        self.before_links = overlap.ends[before_a]
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True) if len(a) else np.zeros(0, np.int64)
        self.group_a, self.group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        self.before_groups = np.concatenate([[0], np.cumsum(np.bincount(self.group_a, minlength=len(cuts)))])
        self.n_groups = np.searchsorted(self.before_groups, before_a)
        together = Csr.of_column(self.group_a, len(cuts)).row_sizes(Csr.of_column(self.group_b, len(cuts)).transposed())
        self.shared_group_links = np.concatenate([[0], np.cumsum(together)])[before_a]

    def pairs(self) -> np.ndarray:
        return self.a[self.left] << 32 | self.b[self.right]

    def groups(self, table: list[str], of_a: int) -> list[str]:
        """Of each text, ``a1,a2|b1;a3|b2,b3``: the ids of each group in order.

        ``table`` has the ids of A followed by a comma or a bar, ``of_a`` entries, then those of B by a comma or a semicolon.
        """
        last_a = np.append(self.group_a[1:] != self.group_a[:-1], True)[: len(self.a)]
        last_b = np.append(self.group_b[1:] != self.group_b[:-1], True)[: len(self.b)]
        count = len(self.before_groups) - 1
        upto_a = np.concatenate([[0], np.cumsum(np.bincount(self.group_a, minlength=count))])
        upto_b = np.concatenate([[0], np.cumsum(np.bincount(self.group_b, minlength=count))])
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + upto_b[self.group_a]] = self.a * 2 + last_a
        code[np.arange(len(self.b)) + upto_a[self.group_b + 1]] = of_a + self.b * 2 + last_b
        cut = (self.before_a + self.before_b).tolist()
        listed = [table[c] for c in code.tolist()]
        return ["".join(listed[low:high])[:-1] for low, high in zip(cut[:-1], cut[1:])]


def _sums(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[before[1:]] - upto[before[:-1]]


def segment_tokens(segments: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all segments in order, how many each has, and whether their bytes are the segment's.

    Segments that end where tokens end are joined and encoded as one text, the others one by one.  If a joined text
    is not given back by its tokens, its halves are encoded, down to single segments.
    """
    raw = [s.encode() for s in segments]
    lengths = np.array([len(x) for x in raw], np.int64)
    ended = np.array([CLOSED.search(s[-1]) is not None for s in segments], bool)
    counts, good = np.zeros(len(segments), np.int64), np.ones(len(segments), bool)
    parts, order = [], []

    def single(k: int) -> None:
        ids = vocabulary.one(segments[k][1:])
        good[k] = vocabulary.text(ids).tobytes() == raw[k]
        counts[k] = len(ids)
        parts.append(ids)
        order.append(k)

    def together(waiting: list[list[int]]) -> None:
        # A loop: a function that names itself would hold all arrays of this call until a garbage collection.
        while waiting:
            own = waiting.pop()
            if len(own) < 2:
                for k in own:
                    single(k)
                continue
            joined = b"".join([raw[k] for k in own])
            ids = vocabulary.one(joined[1:].decode())
            upto, ends = np.cumsum(vocabulary.sizes[ids]), np.cumsum(lengths[own])
            at = np.minimum(np.searchsorted(upto, ends), len(upto) - 1)
            if (upto[at] != ends).any() or vocabulary.text(ids).tobytes() != joined:
                waiting += [own[len(own) // 2 :], own[: len(own) // 2]]
                continue
            counts[own] = np.diff(at + 1, prepend=0)
            parts.append(ids)
            order.extend(own)

    plain = np.array([s.isascii() for s in segments], bool)
    for closed in (np.flatnonzero(ended & plain).tolist(), np.flatnonzero(ended & ~plain).tolist()):
        for low in range(0, len(closed), TOGETHER):
            together([closed[low : low + TOGETHER]])
    for k in np.flatnonzero(~ended).tolist():
        single(k)
    ids = np.concatenate([*parts, np.zeros(0, np.int64)])
    place = np.argsort(np.array(order, np.int64))
    starts = np.cumsum(counts[order]) - counts[order] if order else np.zeros(0, np.int64)
    return ids[tx.spread(starts[place], counts)], counts, good


def _ends(sizes: list[int] | np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype(np.int64)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _encoder(held):
    """Texts to pieces: the ids of the documents, and packed the distinct segments' tokens and each document's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = _vocabularies(*held.value)
        for batch in batches:
            for first, last, data, offsets in tx.pieces(batch.column(1), PORTION):
                texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                number: dict[str, int] = {}
                segment, sizes = array("i"), []
                for t in texts:
                    own = SEGMENT.findall(" " + t) if t else []
                    segment.extend([number.setdefault(s, len(number)) for s in own])
                    sizes.append(len(own))
                segment, before = np.frombuffer(segment, np.int32) if segment else np.zeros(0, np.int32), _ends(sizes)
                (a, count_a, good_a), (b, count_b, good_b) = (segment_tokens(list(number), v) for v in vocabularies)
                bad = ~(good_a & good_b)[segment]
                if bad.any():
                    keep = np.ones(len(segment), bool)
                    for d in np.unique(np.searchsorted(before, np.flatnonzero(bad), side="right") - 1).tolist():
                        own = segment[before[d] : before[d + 1]]
                        sides = ((a, count_a), (b, count_b))
                        given = [v.text(_slices(x, _ends(n), own)[0]) for v, (x, n) in zip(vocabularies, sides)]
                        if any(x.tobytes() != (" " + texts[d]).encode() for x in given):
                            keep[before[d] : before[d + 1]], sizes[d] = False, 0
                    segment, before = segment[keep], _ends(sizes)
                body = pack(a.astype(np.int32), _ends(count_a), b.astype(np.int32), _ends(count_b), segment, before)
                ids = pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), pa.concat_arrays([batch.column(0).slice(first, last - first)]))
                stored = len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)
                zeros = pa.array([[0] * (last - first)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([stored], pa.binary()), zeros, zeros], names=["ids", "body", "n_best", "count_sum"])

    return run


class Piece:
    """The stored texts of a piece: links between the tokens of its distinct segments, and the segments of each text."""

    def __init__(self, stored: bytes, one: Vocabulary, two: Vocabulary) -> None:
        body = pa.decompress(stored[8:], int.from_bytes(stored[:8], "little"), codec="zstd", asbytes=True)
        a, before_a, b, before_b, segment, self.before = unpack(body, np.int32, np.int64, np.int32, np.int64, np.int32, np.int64)
        a, b, self.segment = a.astype(np.int64), b.astype(np.int64), segment.astype(np.int64)
        used = np.flatnonzero(np.bincount(self.segment, minlength=1))
        if len(used) < len(before_a) - 1:  # those of texts without tokens go
            new = np.zeros(len(before_a), np.int64)
            new[used] = np.arange(len(used))
            a, before_a, b, before_b = *_slices(a, before_a, used), *_slices(b, before_b, used)
            self.segment = new[self.segment]
        self.links = Links(a, before_a, one.sizes[a], b, before_b, two.sizes[b])

    def total(self, before: np.ndarray) -> np.ndarray:
        """Sums over the segments of each text, from what lies before each segment."""
        return _sums(np.diff(before)[self.segment], self.before).astype(np.int64)


def _slices(values: np.ndarray, before: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(before)[own]
    return values[tx.spread(before[own], sizes)], _ends(sizes)


def _counter(held):
    """Pairs of linked ids, each once per document, counted within the task."""

    def batch_of(pairs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(counts)], names=["a", "b", "n"])

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pairs, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        return pairs[first], np.add.reduceat(counts, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _vocabularies(*held.value)
        parts, size = [], 0
        for batch in batches:
            for stored in batch.column(1):
                piece = Piece(stored.as_py(), one, two)
                links = piece.links
                if not len(links.left):
                    continue
                pairs, number = np.unique(links.pairs(), return_inverse=True)
                doc = np.repeat(np.arange(len(piece.before) - 1), np.diff(piece.before))
                many = len(links.before_links) - 1
                own = _distinct(doc * many + piece.segment)
                doc, segment = own // many, own % many
                sizes = np.diff(links.before_links)[segment]
                own = _distinct(np.repeat(doc, sizes) * len(pairs) + number[tx.spread(links.before_links[segment], sizes)])
                counts = np.bincount(own % len(pairs), minlength=len(pairs))
                found = pairs
                parts.append((found, counts.astype(np.int64)))
                size += len(found)
                if size > HELD:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    if size > HELD // 2:
                        yield batch_of(*parts[0])
                        parts, size = [], 0
        if parts:
            yield batch_of(*merged(parts))

    return run


def _looker(held, block):
    """Adds a block's counts to ``n_best`` and ``count_sum``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _vocabularies(*held.value)
        pairs, counts, best = (np.frombuffer(x, t) for x, t in zip(block.value, (np.int64, np.int64, np.bool_)))
        for batch in batches:
            for k in range(batch.num_rows):
                piece = Piece(batch.column(1)[k].as_py(), one, two)
                n_best, total = (batch.column(c)[k].values.to_numpy().copy() for c in (2, 3))
                if len(piece.links.left) and len(pairs):
                    wanted = piece.links.pairs()
                    at = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
                    here = pairs[at] == wanted
                    n_best += piece.total(_ends(_sums(here & best[at], piece.links.before_links)))
                    total += piece.total(_ends(_sums(np.where(here, counts[at], 0), piece.links.before_links)))
                added = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (n_best, total)]
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), *added], names=batch.schema.names)

    return run


def _finisher(held, find):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _vocabularies(*held.value)
        table = [f"{i}{end}" for v, ends in ((one, ",|"), (two, ",;")) for i in range(len(v.sizes)) for end in ends]
        for batch in find(batches):
            for k in range(batch.num_rows):
                piece = Piece(batch.column(1)[k].as_py(), one, two)
                links = piece.links
                numbers = [piece.total(x) for x in (links.before_a, links.before_b, links.n_groups, links.before_links, links.shared_group_links)]
                groups, listed, cut = links.groups(table, 2 * len(one.sizes)), piece.segment.tolist(), piece.before.tolist()
                digests = [
                    hashlib.sha256(";".join([groups[i] for i in listed[low:high]]).encode()).hexdigest() if high > low else ""
                    for low, high in zip(cut[:-1], cut[1:])
                ]
                sums = [batch.column(c)[k].values for c in (2, 3)]
                columns = [batch.column(0)[k].values, *[pa.array(x) for x in numbers], *sums, pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in RESULT.split(", ")])

    return run


# --------------------------------------------------------------------------- all documents


_PIECE = "ids array<bigint>, body binary, n_best array<bigint>, count_sum array<bigint>"


def encoded(documents: DataFrame, held, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents: their ids, their segments and tokens, and zeros to add counts to."""
    rows = documents.select(column(doc_id).cast("bigint").alias("doc_id"), column(text).cast("string").alias("text"))
    return rows.mapInArrow(tx.frugal(_encoder(held)), _PIECE)


def pair_counts(tokens: DataFrame, held) -> DataFrame:
    """``a, b, n, best``: documents that hold the pair linked, and whether none of the same ``a`` has more."""
    counted = tokens.mapInArrow(tx.frugal(_counter(held)), "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # At most as many rows per key as the other vocabulary has entries.
    return counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def _blocks(counts: DataFrame, size: int) -> Iterator[tuple[bytes, bytes, bytes]]:
    """The counted pairs in sorted blocks of at most about ``size`` rows."""
    blocks = -(-counts.count() // size)
    for k in range(blocks):
        part = counts if blocks == 1 else counts.where(F.pmod(F.xxhash64("a", "b"), F.lit(blocks)) == k)
        table = part.select(F.expr("shiftleft(a, 32) | b").alias("pair"), "n", "best").toArrow()
        pair, n, best = (table.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))
        order = np.argsort(pair)
        yield pair[order].tobytes(), n[order].tobytes(), best[order].astype(np.bool_).tobytes()


def align(documents: DataFrame, definition: str, model: bytes, *, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per document: id, numbers of tokens, groups and links, ``n_best``, ``count_sum`` and ``groups_sha256``.

    ``definition`` is the content of a byte-level tokenizer file (A), ``model`` that of a sentence-piece model (B).
    ``n_best`` counts links whose pair is the most frequent one of its A id, ``count_sum`` adds up the pairs' counts.
    """
    context = documents.sparkSession.sparkContext
    held = context.broadcast((definition, model))
    tokens = stage(encoded(documents, held, doc_id=doc_id, text=text), "tokens")
    counts = stage(pair_counts(tokens, held), "pairs")
    state, last = tokens, None
    for part in _blocks(counts, block):
        if last is not None:
            state = stage(state.mapInArrow(tx.frugal(last), state.schema), "links")
        last = _looker(held, context.broadcast(part))
    return state.mapInArrow(tx.frugal(_finisher(held, last or (lambda batches: batches))), RESULT)


def links_of(documents: DataFrame, definition: str, model: bytes, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id and ``links``, an array of (place of the A token, place of the B token, A id, B id, shared bytes)."""
    held = documents.sparkSession.sparkContext.broadcast((definition, model))
    link = pa.struct([(n, pa.int64()) for n in ("a_place", "b_place", "a", "b", "shared_bytes")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _vocabularies(*held.value)
        for batch in batches:
            for k in range(batch.num_rows):
                piece = Piece(batch.column(1)[k].as_py(), one, two)
                links, before = piece.links, piece.before
                # Places count from the start of the text: first those before a segment, then those in it.
                ahead = [np.concatenate([[0], np.cumsum(np.diff(x)[piece.segment])]) for x in (links.before_a, links.before_b)]
                sizes = np.diff(links.before_links)[piece.segment]
                at = tx.spread(links.before_links[piece.segment], sizes)
                segment, doc = (np.repeat(x, sizes) for x in (piece.segment, np.repeat(np.arange(len(before) - 1), np.diff(before))))
                places = [
                    np.repeat(x[:-1], sizes) - x[before[:-1]][doc] + own[at] - start[segment]
                    for x, own, start in zip(ahead, (links.left, links.right), (links.before_a, links.before_b))
                ]
                fields = (*places, links.a[links.left[at]], links.b[links.right[at]], links.shared[at])
                flat = pa.StructArray.from_arrays([pa.array(f.astype(np.int64)) for f in fields], fields=list(link))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)])[before].astype(np.int64))
                listed = pa.LargeListArray.from_arrays(offsets, flat).cast(pa.list_(link))
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, listed], names=["doc_id", "links"])

    schema = "doc_id bigint, links array<struct<a_place bigint, b_place bigint, a bigint, b bigint, shared_bytes bigint>>"
    return encoded(documents, held, doc_id=doc_id, text=text).mapInArrow(tx.frugal(run), schema)
