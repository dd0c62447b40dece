"""Cross-tokenizer alignment by lockstep merging.

Two tokenizers cut the same bytes differently.  Given the byte ends of the tokens of A and B,
a merge of the two sequences meets every pair of tokens whose ranges overlap exactly once (a
link), and every offset where both end (a cut).  All texts of a batch are merged at once: one
NumPy state vector holds the A pointer, the B pointer and the next output place of each text;
a step emits a link for every text, compares the ends, advances the side that ends first (both
at a cut) and compacts texts that are finished out of the vector.  Every text emits one link a
step, so its links stand at its own base plus the step, and nothing has to be sorted.

A text with many tokens would leave a vector of one element for most steps.  So long texts
enter as several lanes, parted at offsets where both tokenizers end a token; a lane is merged
like a text of its own.

Corpus counts: each text's distinct (A id, B id) pairs with their number of links are written
once; the document frequency of a pair is one aggregate over them, and the counts are joined
back to the written pairs, so the tokenizers run once.  Texts are never shuffled.

Defined results: a null or empty text, and one whose token bytes don't spell space + text (a
character that normalisation changes), has no tokens; repeated rows count as documents of
their own; very long texts are tokenized and merged whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabula.llm.common import stored
from tabula.operators.ranking import small_side

#: Folder of the vocabulary files, the same on every executor.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: How byte-level BPE cuts words (a fixed value of that kind of file).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows that a task has as Python strings at once, characters that it merges at once, texts that it tokenizes at once, A tokens of a lane.
BATCH_ROWS, BATCH_CHARS, BATCH_TEXTS, LANE = 512, 1 << 19, 64, 1024
_SHIFT = 32  # a pair is one long: A id above, B id below


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for
    themselves, the others for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def entry_bytes(entry: str, alphabet: dict[str, int]) -> bytes:
    """Bytes of a byte-level entry; characters outside the alphabet (special tokens) as UTF-8."""
    return b"".join(bytes([alphabet[c]]) if c in alphabet else c.encode() for c in entry)


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:-1], 16)]) if is_byte else piece.replace("▁", " ").encode()


class ByteTokens:
    """A: byte-level BPE over space + text, read from the vocabulary file.

    Where the file's merges make the ids 256, 257, ... in order and its words are cut by the usual
    pattern, ids are merge ranks, and the merging is done by the engine for ranks, which is some
    times faster; any other file is handed to the library that it is made for."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.bytes = [b""] * (max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1)
        for entry, i in [*vocab.items(), *((t["content"], t["id"]) for t in spec.get("added_tokens", []))]:
            self.bytes[i] = entry_bytes(entry, alphabet)
        ranks = self._ranks(spec, vocab)
        if ranks is None:
            from tokenizers import Tokenizer
            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            self.ids = lambda texts: [e.ids for e in model.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        else:
            import tiktoken
            model = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            self.ids = lambda texts: [model.encode_ordinary(f" {t}") for t in texts]

    def _ranks(self, spec: dict, vocab: dict[str, int]) -> dict[bytes, int] | None:
        cut, kind = spec.get("pre_tokenizer") or {}, spec["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in kind["merges"]]
        plain = (cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer")
                 and kind["type"] == "BPE" and not kind.get("dropout") and not kind.get("continuing_subword_prefix")
                 and not kind.get("end_of_word_suffix") and not kind.get("ignore_merges"))
        if not plain or any(vocab.get(x + y) != 256 + i for i, (x, y) in enumerate(pairs)) \
                or {i for e, i in vocab.items() if len(e) == 1 and e in byte_alphabet()} != set(range(256)):
            return None
        return {self.bytes[i]: i for i in range(256 + len(pairs))}


class PieceTokens:
    """B: pieces with byte fallback; the model puts the space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(self.model.get_piece_size())
        self.bytes = [piece_bytes(self.model.id_to_piece(i), self.model.is_byte(i)) for i in n]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=1)
def tokenizers(folder: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(f"{folder}/{BYTE_BPE}"), PieceTokens(f"{folder}/{PIECE_BPE}")


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_from: np.ndarray, b_from: np.ndarray, a_to: np.ndarray, b_to: np.ndarray):
    """Merge lane k's tokens a_from[k]:a_to[k] and b_from[k]:b_to[k], whose ends reach the same offset.

    Returns (a, b, cut), a row per link, lane after lane in order; ``cut`` marks links that end a group."""
    base = np.concatenate([[0], np.cumsum((a_to - a_from) + (b_to - b_from))])
    out_a, out_b = np.full(base[-1], -1, np.int32), np.empty(base[-1], np.int32)
    cut = np.zeros(base[-1], bool)
    live = a_from < a_to
    pa_, pb, at, stop = a_from[live], b_from[live], base[:-1][live], a_to[live]
    while len(pa_):
        ea, eb = a_end[pa_], b_end[pb]
        out_a[at], out_b[at] = pa_, pb
        step_a, step_b = ea <= eb, eb <= ea
        cut[at] = step_a & step_b
        pa_, pb, at = pa_ + step_a, pb + step_b, at + 1
        live = pa_ < stop
        if not live.all():
            pa_, pb, at, stop = pa_[live], pb[live], at[live], stop[live]
    used = out_a >= 0
    return out_a[used], out_b[used], cut[used]


def _lanes(a_end: np.ndarray, b_end: np.ndarray, a_off: np.ndarray, b_off: np.ndarray, size: int = LANE):
    """Starts of the lanes: those of the texts, and about every ``size`` A tokens the next offset where both end."""
    starts_a, starts_b = [a_off[:-1]], [b_off[:-1]]
    for k in np.flatnonzero(np.diff(a_off) > 2 * size):
        a, b = a_end[a_off[k]:a_off[k + 1]], b_end[b_off[k]:b_off[k + 1]]
        want = np.arange(size, len(a) - size, size)
        # the first of the next tokens whose end B has too; a stretch without one stays in its lane
        near = want[:, None] + np.arange(64)
        near = np.minimum(near, len(a) - 1)
        place = np.searchsorted(b, a[near])
        both = b[np.minimum(place, len(b) - 1)] == a[near]
        hit, row = both.argmax(1), np.arange(len(want))
        ok = both[row, hit] & (near[row, hit] < len(a) - 1)
        cut_a, cut_b = near[row, hit][ok] + 1, place[row, hit][ok] + 1
        cut_a, first = np.unique(cut_a, return_index=True)
        starts_a.append(a_off[k] + cut_a)
        starts_b.append(b_off[k] + cut_b[first])
    sa, sb = np.sort(np.concatenate(starts_a)), np.sort(np.concatenate(starts_b))
    return sa, sb, np.append(sa[1:], a_off[-1]), np.append(sb[1:], b_off[-1])


class Aligner:
    """Tokenizes and aligns a list of texts at a time; A and B are objects with ``ids`` and ``bytes``."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.a_size, self.b_size = (np.array([len(x) for x in t.bytes], np.int64) for t in (a, b))
        # Text of an id and what follows it: "," inside a group's side, "|" after its A ids, ";" after its B ids.
        self.text = pa.array([f"{i}{mark}" for t, marks in ((a, ",|"), (b, ",;")) for i in range(len(t.bytes)) for mark in marks], pa.large_binary())
        self.text_size = np.diff(np.frombuffer(self.text.buffers()[1], np.int64, len(self.text) + 1))
        self.bits = [max(1, (len(t.bytes) - 1).bit_length()) for t in (a, b)]

    def tokens(self, texts: list[str | None]):
        """(A ids, A offsets, B ids, B offsets) of the texts, nothing for those without tokens."""
        some = [i for i, t in enumerate(texts) if t]
        ids: list[list] = [[], []]
        counts = np.zeros((2, len(texts)), np.int64)
        for s in range(0, len(some), BATCH_TEXTS):
            part = some[s:s + BATCH_TEXTS]
            have = [texts[i] for i in part]
            for i, t, x, y in zip(part, have, self.a.ids(have), self.b.ids(have)):
                raw = b" " + t.encode()
                if b"".join(map(self.a.bytes.__getitem__, x)) == raw == b"".join(map(self.b.bytes.__getitem__, y)):
                    ids[0].append(np.array(x, np.int32))
                    ids[1].append(np.array(y, np.int32))
                    counts[:, i] = len(x), len(y)
        off = np.zeros((2, len(texts) + 1), np.int64)
        np.cumsum(counts, axis=1, out=off[:, 1:])
        none = np.empty(0, np.int32)
        return np.concatenate([none, *ids[0]]), off[0], np.concatenate([none, *ids[1]]), off[1]

    def align(self, texts: list[str | None]) -> dict:
        """Per text: n_a, n_b, n_groups, n_links, groups (ASCII bytes), pairs and their number of links (arrays).
        ``links`` has (A place, B place) of every link and ``link_off`` its offsets by text."""
        a, a_off, b, b_off = self.tokens(texts)
        # ends count on over the batch, so lanes of different texts never meet; empty tokens can't occur in equal bytes but at an end
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        la, lb, cut = lockstep(a_end, b_end, *_lanes(a_end, b_end, a_off, b_off))
        order = np.searchsorted(la, a_off)  # links are in order of A places
        n_groups = np.diff(np.concatenate([[0], np.cumsum(cut)])[order])

        # the texts of the groups: tokens in order of (group, side)
        a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_last[la[cut]], b_last[lb[cut]] = True, True
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        b_until = np.concatenate([[0], np.flatnonzero(b_last) + 1])
        a_until = np.concatenate([[0], np.flatnonzero(a_last) + 1])
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + b_until[a_group]] = 2 * a.astype(np.int64) + a_last
        codes[np.arange(len(b)) + a_until[b_group + 1] if len(b) else []] = 2 * (b.astype(np.int64) + len(self.a.bytes)) + b_last
        whole = self.text.take(pa.array(codes)).buffers()  # the texts of all ids one behind the other
        ends = np.concatenate([[0], np.cumsum(self.text_size[codes])])[a_off + b_off]
        joined = memoryview(whole[2]) if len(codes) else b""
        groups = [joined[s:e - 1] if e > s else b"" for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]

        # distinct pairs of each text: sorted as one number of text, A id and B id
        doc = np.repeat(np.arange(len(texts)), np.diff(order))
        at, bt = self.bits
        key = (doc << (at + bt)) | (a[la].astype(np.int64) << bt) | b[lb]
        key.sort()
        new = np.flatnonzero(np.diff(key, prepend=-1))
        key, times = key[new], np.diff(np.append(new, len(key)))
        d, pair = key >> (at + bt), ((key >> bt & ((1 << at) - 1)) << _SHIFT) | (key & ((1 << bt) - 1))
        return {"n_a": np.diff(a_off), "n_b": np.diff(b_off), "n_groups": n_groups, "n_links": np.diff(order), "groups": groups,
                "pairs": pair, "times": times, "pair_off": np.searchsorted(d, np.arange(len(texts) + 1)),
                "links": (la, lb), "link_off": order, "a": a, "b": b, "a_off": a_off, "b_off": b_off}


@lru_cache(maxsize=1)
def aligner_of(folder: str) -> Aligner:
    """One for all tasks of a worker."""
    return Aligner(*tokenizers(folder))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """(ids, texts) of a few hundred rows at a time, cut where their texts reach BATCH_CHARS; memory that a slice
    needed goes back before the next."""
    for batch in batches:
        for s in range(0, batch.num_rows, BATCH_ROWS):
            rows = batch.slice(s, BATCH_ROWS)
            texts = rows.column(1).to_pylist()
            for part in _parts(texts, BATCH_CHARS):
                yield rows.column(0)[part.start:part.stop], texts[part]
            pa.default_memory_pool().release_unused()


def _parts(texts: list[str | None], most: int) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def aligned(docs: DataFrame, folder: str = TOKENIZERS, text: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, row (a number of its own once written), n_a, n_b, n_groups, n_links,
    groups_sha256, pairs (array of longs, A id above 32 bits and B id below) and times (links of each pair)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(folder)
        for ids, texts in _slices(batches):
            x = aligner.align(texts)
            sha = [hashlib.sha256(g).hexdigest() if len(g) else "" for g in x["groups"]]
            off = pa.array(x["pair_off"].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(x[n].astype(np.int64)) for n in ("n_a", "n_b", "n_groups", "n_links")), pa.array(sha, pa.string()),
                 pa.ListArray.from_arrays(off, pa.array(x["pairs"])), pa.ListArray.from_arrays(off, pa.array(x["times"].astype(np.int32)))],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    out = docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, "
                                                      "groups_sha256 string, pairs array<long>, times array<int>")
    return out.withColumn("row", F.monotonically_increasing_id())


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (no pair of its A id has a greater n)."""
    pairs = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "alignment_pairs")
    a = F.shiftright("pair", _SHIFT)
    top = pairs.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    return pairs.withColumn("a", a).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def links(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, a_place, b_place, a_id, b_id: the link table itself, in row form."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(folder)
        for ids, texts in _slices(batches):
            x = aligner.align(texts)
            la, lb = x["links"]
            doc = np.repeat(np.arange(len(texts)), x["n_links"])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(doc)), pa.array((la - x["a_off"][doc]).astype(np.int64)),
                 pa.array((lb - x["b_off"][doc]).astype(np.int64)), pa.array(x["a"][la].astype(np.int64)), pa.array(x["b"][lb].astype(np.int64))],
                ["doc_id", "a_place", "b_place", "a_id", "b_id"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, a_place long, b_place long, a_id long, b_id long")


def report(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every document row."""
    rows = stored(aligned(docs, folder), "alignments")
    counts = stored(pair_counts(rows), "alignment_counts")
    # measured rows of two numbers and a flag; beyond the bound the planner shuffles both sides by pair
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = each.join(small_side(counts), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
