"""Alignment of two tokenizers' ids over the same bytes.

Ends that both sides share cut the tokens into groups, and both sides' ends in
one order cut the text into stretches, each of one token of either side: a
link. No token crosses the place before a blank that follows a word, so texts
are cut there, and groups and links of each different segment are found once
per worker; a document adds up those of its segments. How many documents hold
a pair of ids linked is counted over the exploded pairs. tokenise_both() and
align() do the same for whole tables of tokens, by Spark's array functions.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, ship_package, text_or_empty
from .tokens import PLAIN, byte_alphabet, public_path, tokenizer

#: None of the pieces has a blank after another letter, so no piece crosses the place before a run of blanks: what lies
#: between two of these is encoded by itself, with its blanks.
SEGMENT = re.compile(r" +[^ ]*|[^ ]+")
#: Segments remembered by a worker, none of them longer than LONGEST.
CACHED, LONGEST = 300_000, 40
#: Pairs of ids, at most so many, that are sent to every task; beyond it only frequent ones are, fewer than FREQUENT.
BROADCAST_PAIRS, FREQUENT = 1_000_000, 100_000


class BothTokenizers:
    """Ids under a byte-level vocabulary and a sentencepiece model, as little-endian unsigned 32-bit bytes, equal to the libraries' own."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece

        self.a = tokenizer(byte_level, cache_size=CACHED, plain_added=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        found = [byte.fullmatch(n) for n in names]
        piece_bytes = [bytes([int(m[1], 16)]) if m else n.replace("▁", " ").encode() for m, n in zip(found, names, strict=True)]
        self.bytes = (byte_level_bytes(byte_level), piece_bytes)
        self.lengths = [np.array([len(t) for t in table], dtype=np.int32) for table in self.bytes]
        apart = self.b.encode("a b") == [*self.b.encode("a"), *self.b.encode("b")]
        self.separable = apart and not any(re.search("[^▁]▁", n) for n in names)
        file = json.loads(Path(byte_level).read_text(encoding="utf-8"))
        usual = file["normalizer"] is None and (file["pre_tokenizer"] or {}).get("type") == "ByteLevel" and file["pre_tokenizer"].get("use_regex", True)
        #: Whether the same holds of both sides before a blank after what is no white space.
        self.both_separable = self.separable and usual and all(t["special"] for t in file["added_tokens"])
        #: With a token for each byte no byte of a plain text can get lost on the byte-level side.
        self.whole = {t for t in self.bytes[0] if len(t) == 1} == {bytes([b]) for b in range(256)} and not self.a.words
        #: Whether the byte-level side's ids of plain texts can be had in one call for many.
        self.joint = usual and self.whole and self.a.mark is not None and not self.a.added
        self.blank = np.array([self.b.piece_to_id("▁")], dtype="<u4").tobytes()
        self.cache: dict[str, bytes | None] = {" ": self.blank}

    def sound(self, side: int, text: str, raw: bytes) -> bool:
        return b"".join(map(self.bytes[side].__getitem__, np.frombuffer(raw, dtype="<u4").tolist())) == text.encode()

    def exact(self, text: str, a: bytes, b: bytes | None) -> bool:
        """Whether side A's ids give the text's bytes; ``b`` is nothing where side B's do not."""
        return b is not None and (self.whole and PLAIN.fullmatch(text) is not None or self.sound(0, text, a))

    def pieces(self, spaced: list[str]) -> list[bytes]:
        """Side B's ids of texts that begin with a blank, each for itself."""
        found = self.b.encode([t[1:] for t in spaced], num_threads=1)
        return [np.array(ids, dtype="<u4").tobytes() if t != " " else self.blank for t, ids in zip(spaced, found, strict=True)]

    def encode_b(self, spaced: str) -> bytes | None:
        """Side B's ids of a text that begins with a blank; nothing if its pieces do not give its bytes."""
        parts = SEGMENT.findall(spaced) if self.separable else [spaced]
        cache = self.cache
        try:
            return b"".join([cache[s] for s in parts])
        except KeyError:
            missing = list(set(parts).difference(cache))
            new = {s: x if self.sound(1, s, x) else None for s, x in zip(missing, self.pieces(missing), strict=True)}
            found = [cache[s] if s in cache else new[s] for s in parts]
            if len(cache) > CACHED:
                self.cache = cache = {" ": self.blank}
            cache.update((s, x) for s, x in new.items() if len(s) <= LONGEST)
            return None if None in found else b"".join(found)
        except TypeError:  # a segment that does not come back
            return None

    def ids_a(self, spaced: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Side A's ids of segments, one after the other, and how many each has; plain ones are encoded as one text."""
        plain = [s for s in spaced if not s[-1].isspace() and PLAIN.fullmatch(s)] if self.joint else []
        if plain:
            raw, letters, sizes = self.a.encode_parts("".join(plain))
            parts, ends = np.cumsum(letters), np.cumsum([len(s) for s in plain])
            at = np.searchsorted(parts, ends)
            if np.array_equal(parts[at], ends):
                n = np.diff(np.concatenate(([0], np.cumsum(sizes)[at])))
                ids = np.frombuffer(raw, dtype="<u4").astype(np.int64)
                if len(plain) == len(spaced):
                    return ids, n
                own = np.array([not s[-1].isspace() and PLAIN.fullmatch(s) is not None for s in spaced])
                other = [x for x, mine in zip(spaced, own.tolist(), strict=True) if not mine]
                rest = self.a.encode(other)
                count = np.empty(len(spaced), dtype=np.int64)
                count[own], count[~own] = n, [len(x) // 4 for x in rest]
                out = np.empty(int(count.sum()), dtype=np.int64)
                mine = np.repeat(own, count)
                out[mine], out[~mine] = ids, np.frombuffer(b"".join(rest), dtype="<u4")
                return out, count
        found = self.a.encode(spaced)
        return np.frombuffer(b"".join(found), dtype="<u4").astype(np.int64), np.array([len(x) // 4 for x in found], dtype=np.int64)

    def ids_b(self, spaced: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Side B's ids of segments, one after the other, and how many each has."""
        found = self.b.encode([t[1:] for t in spaced], num_threads=1)
        for k, text in enumerate(spaced):
            if text == " ":
                found[k] = np.frombuffer(self.blank, dtype="<u4").tolist()
        n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(n.sum())), n

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids of a blank and each text on both sides; none where there is no text or it cannot be told from its tokens."""
        spaced = [f" {t}" if t else "" for t in texts]
        out = []
        for text, a in zip(spaced, self.a.encode(spaced), strict=True):
            b = self.encode_b(text) if text else None
            out.append((a, b) if self.exact(text, a, b) else (b"", b""))
        return out


def byte_level_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    byte = {letter: b for b, letter in enumerate(byte_alphabet())}
    tokens = [library.id_to_token(k) for k in range(library.get_vocab_size(True))]
    return [bytes(byte[c] for c in t) if t is not None and all(c in byte for c in t) else b"" for t in tokens]


_LOADED: dict[tuple[str, str], BothTokenizers] = {}


def both_tokenizers(byte_level: str, pieces: str) -> BothTokenizers:
    """Loaded once per worker."""
    key = (byte_level, pieces)
    if key not in _LOADED:
        _LOADED[key] = BothTokenizers(byte_level, pieces)
    return _LOADED[key]


def tokenise_both(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """``_row, doc_id, a_ids, a_ends, b_ids, b_ends`` of every row of ``docs(doc_id, text)``.

    ``_row`` numbers the rows. Side A encodes a blank and the text, side B the
    text, to which it adds the blank; special tokens' names are plain text.
    Ends count bytes. Texts that are null, empty, or whose tokens' bytes are
    not the blank and the text have no tokens. A text is encoded whole.
    """
    ship_package(docs.sparkSession)
    byte_level, pieces = byte_level or public_path("byte_bpe_50k.json"), pieces or public_path("piece_bpe_32k.model")
    schema = "_row long, doc_id long, a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>"
    names = [f.split()[0] for f in schema.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = both_tokenizers(byte_level, pieces)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for begin in range(0, batch.num_rows, 128):
                part = batch.slice(begin, 128)
                raw = tokenizers.encode(part.column(1).to_pylist())
                columns = []
                for side, lengths in enumerate(tokenizers.lengths):
                    ids = np.frombuffer(b"".join([x[side] for x in raw]), dtype="<u4").astype(np.int32)
                    offsets = np.concatenate(([0], np.cumsum([len(x[side]) // 4 for x in raw])))
                    ends = np.concatenate(([0], np.cumsum(lengths[ids], dtype=np.int64)))
                    own = (ends[1:] - np.repeat(ends[offsets[:-1]], np.diff(offsets))).astype(np.int32)
                    columns += [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x)) for x in (ids, own)]
                rows = pa.array(np.arange(row, row + part.num_rows))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([rows, part.column(0), *columns], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(encode, schema)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)


class Growing:
    """Whole numbers that are added to without a copy of all each time."""

    def __init__(self) -> None:
        self.held, self.size = np.zeros(1024, dtype=np.int64), 0

    def add(self, more: np.ndarray) -> None:
        size = self.size + len(more)
        if size > len(self.held):
            self.held = np.concatenate((self.held[: self.size], np.zeros(2 * size - self.size, dtype=np.int64)))
        self.held[self.size : size] = more
        self.size = size


class AlignedSegments:
    """Texts aligned by their segments, each different one of which is encoded and aligned once, while it is remembered."""

    def __init__(self, tokenizers: BothTokenizers, wide: int):
        self.tokenizers, self.wide = tokenizers, wide
        self.bytes = [pa.array(x, pa.binary()) for x in tokenizers.bytes]
        a, b = (range(len(x)) for x in tokenizers.lengths)
        #: Ids as they stand within and at the end of a group, B's also at the end of all.
        self.names = pa.array([*(f"{k}{c}" for c in ",|" for k in a), *(f"{k}{c}" for c in (",", ";", "") for k in b)], pa.string())
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}  # of a segment without its first blank
        self.groups: list[str] = []
        self.letters = 0
        #: Of each segment: A's tokens (-1 where they do not give its bytes), B's tokens, groups, links, place of its first pair.
        self.n_a, self.n_b, self.n_groups, self.n_links, self.first = (Growing() for _ in range(5))
        self.pairs = Growing()

    def learn(self, segments: list[str]) -> None:
        t, spaced = self.tokenizers, [f" {s}" for s in segments]
        texts = pa.array(spaced, pa.string()).cast(pa.binary())
        sides = [t.ids_a(spaced), t.ids_b(spaced)]
        sound = np.ones(len(spaced), dtype=bool)
        for (x, n), table in zip(sides, self.bytes, strict=True):
            sound &= pc.equal(pc.binary_join(_lists(n, table.take(pa.array(x))), b""), texts).to_numpy(zero_copy_only=False)
        ids = [x[np.repeat(sound, n)] for x, n in sides]
        last = [np.concatenate(([0], np.cumsum(np.where(sound, n, 0)))) for _, n in sides]
        ends = [np.cumsum(lengths[x], dtype=np.int64) for lengths, x in zip(t.lengths, ids, strict=True)]
        stretches = np.union1d(*ends)
        i, j = (np.searchsorted(e, stretches) for e in ends)
        cut = (ends[0][i] == stretches) & (ends[1][j] == stretches)
        bounds = np.searchsorted(stretches, np.concatenate(([0], ends[0]))[last[0]], side="right")  # stretches before the end of each segment
        closed = np.concatenate(([0], np.cumsum(cut)))[bounds]
        self.groups += self._texts(ids, last, i[cut], j[cut])
        self.first.add(self.pairs.size + bounds[:-1])
        for held, sums in ((self.n_a, last[0]), (self.n_b, last[1]), (self.n_groups, closed), (self.n_links, bounds)):
            held.add(np.where(sound, np.diff(sums), -1) if held is self.n_a else np.diff(sums))
        self.pairs.add(ids[0][i] * self.wide + ids[1][j])
        self.number.update(zip(segments, range(len(self.number), len(self.number) + len(segments)), strict=True))
        self.letters += sum(map(len, segments))

    def _texts(self, ids: list[np.ndarray], last: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> list[str]:
        """The text of each segment's groups, of which ``i`` and ``j`` are the last tokens: every id takes what follows it along."""
        closing = [np.zeros(len(x), dtype=np.int64) for x in ids]
        closing[0][i] = closing[1][j] = 1
        a, b = (np.cumsum(x) - x for x in closing)  # the group of each token
        closing[1][last[1][1:][np.diff(last[1]) > 0] - 1] = 2
        n_a, n_b = (len(x) for x in self.tokenizers.lengths)
        code = np.empty(len(a) + len(b), dtype=np.int64)
        code[np.arange(len(a)) + np.concatenate(([0], j + 1))[a]] = ids[0] + n_a * closing[0]
        code[np.arange(len(b)) + (i + 1)[b]] = 2 * n_a + ids[1] + n_b * closing[1]
        return pc.binary_join(_lists(np.diff(last[0] + last[1]), self.names.take(pa.array(code))), "").to_pylist()

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Offsets of each text's segments, and the segments without their first blanks."""
        if not self.tokenizers.both_separable:
            return np.arange(len(texts) + 1), texts
        words = pc.split_pattern(texts, " ")
        offsets, flat = words.offsets.to_numpy().astype(np.int64), words.flatten()
        # a blank after white space begins no segment: an open word goes on behind it
        coded = flat.dictionary_encode()
        letters = pc.utf8_slice_codeunits(coded.dictionary, -1).dictionary_encode()
        open_ = np.array([not x or x.isspace() for x in letters.dictionary.to_pylist()], dtype=bool)[letters.indices.to_numpy()][coded.indices.to_numpy()]
        open_[offsets[1:] - 1] = False
        if not open_.any():
            return offsets, flat
        held, joined, sizes = flat.to_pylist(), [], []
        some = np.add.reduceat(open_, offsets[:-1]) > 0
        for begin, end, mend in zip(offsets.tolist(), offsets[1:].tolist(), some.tolist(), strict=False):
            parts = held[begin:end]
            if mend:
                parts, waiting = [], ""
                for word, on in zip(held[begin:end], open_[begin:end].tolist(), strict=True):
                    if on:
                        waiting += f"{word} "
                    else:
                        parts.append(waiting + word)
                        waiting = ""
            joined += parts
            sizes.append(len(parts))
        return np.concatenate(([0], np.cumsum(sizes))), pa.array(joined, pa.string())

    def align(self, texts: pa.Array) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, groups_sha256 and pairs of each text: zeros and nothing where it has no tokens."""
        offsets, flat = self.cut(texts)
        coded = flat.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        missing = [s for s in distinct if s not in self.number]
        if missing:
            self.learn(missing)
        known = np.array([self.number[s] for s in distinct], dtype=np.int64)
        starts = offsets[:-1]
        exact = (np.minimum.reduceat(self.n_a.held[known][codes], starts) >= 0) & (pc.binary_length(texts).to_numpy() > 0)
        sums = [np.where(exact, np.add.reduceat(x.held[known][codes], starts), 0) for x in (self.n_a, self.n_b, self.n_groups, self.n_links)]
        groups = pa.array([self.groups[k] for k in known.tolist()], pa.string()).take(coded.indices)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), groups), ";").cast(pa.binary())
        digests = [hashlib.sha256(g).hexdigest() if x else "" for g, x in zip(joined.to_pylist(), exact.tolist(), strict=True)]
        links = np.where(np.repeat(exact, np.diff(offsets)), self.n_links.held[known][codes], 0)
        before = np.cumsum(links) - links
        pairs = self.pairs.held[np.repeat(self.first.held[known][codes] - before, links) + np.arange(int(links.sum()))]
        ends = np.concatenate(([0], np.cumsum(sums[3]))).astype(np.int32)
        if len(self.number) > CACHED or self.letters > CACHED * LONGEST:
            self.forget()
        return [*map(pa.array, sums), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(pairs))]


_SEGMENTS: dict[tuple[str, str], AlignedSegments] = {}


def align_texts(docs: DataFrame, byte_level: str, pieces: str, wide: int) -> DataFrame:
    """``_row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs`` of every row of ``docs(doc_id, text)``.

    What align() finds of tokenise_both()'s tokens, found by segments.
    """
    ship_package(docs.sparkSession)
    schema = "_row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>"
    names = [f.split()[0] for f in schema.split(", ")]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (byte_level, pieces)
        if key not in _SEGMENTS:
            _SEGMENTS[key] = AlignedSegments(both_tokenizers(*key), wide)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for begin in range(0, batch.num_rows, 128):
                part = batch.slice(begin, 128)
                rows = pa.array(np.arange(row, row + part.num_rows))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([rows, part.column(0), *_SEGMENTS[key].align(part.column(1))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(found, schema)


def _with(values: dict[str, Column], use: Callable[[Column], Column]) -> Column:
    """``use`` of a struct of ``values``, each computed once and not again for each element of a lambda that names it."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), use)[0]


def align(tokens: DataFrame, wide: int) -> DataFrame:
    """Groups and links of ``tokens``, as tokenise_both() gives them, by array functions only.

    Adds n_a, n_b, n_groups, n_links, ``groups`` (the text of all groups) and
    ``pairs``, an entry ``a * wide + b`` for each overlapping pair of token
    occurrences; ``wide`` is the number of B's ids. A row without tokens has
    zeros, no pairs and an empty text.
    """
    low, side = F.lit((1 << 31) - 1).cast("long"), F.lit(1 << 31).cast("long")
    # all ends in one order: the end above, B's mark (so A's comes first of equal ends) and the token's place below
    a_marks = F.transform("a_ends", lambda e, i: F.shiftleft(e.cast("long"), 32).bitwiseOR(i.cast("long")))
    b_marks = F.transform("b_ends", lambda e, j: F.shiftleft(e.cast("long"), 32).bitwiseOR(side).bitwiseOR(j.cast("long")))
    sides = {c: F.col(c) for c in ("a_ids", "a_ends", "b_ids", "b_ends")}

    def link(a: Column, b: Column) -> Column:
        return a.cast("long") * F.lit(wide).cast("long") + b

    def scanned(s: Column) -> Column:
        """Every end closes a stretch of bytes of one token of each side, which is a link; of two equal ends the second closes a group."""

        def of_end(m: Column, p: Column) -> Column:
            own = m.bitwiseAND(low).cast("int")
            other = p - own  # so many ends of the other side come before
            closing = (other > 0) & (F.get(s["a_ends"], other - 1) == F.get(s["b_ends"], own))
            cut = -F.shiftleft(other.cast("long"), 32).bitwiseOR(own.cast("long")) - 1  # one more than A's place, B's place
            return (
                F.when(m.bitwiseAND(side) == 0, link(F.get(s["a_ids"], own), F.get(s["b_ids"], other)))
                .when(closing, cut)
                .otherwise(link(F.get(s["a_ids"], other), F.get(s["b_ids"], own)))
            )

        return F.transform(s["marks"], of_end)

    def grouped(s: Column) -> Column:
        def of_group(c: Column, k: Column) -> Column:
            i, j = F.shiftright(c, 32).cast("int"), c.bitwiseAND(low).cast("int")
            before = F.get(s["ends"], k)
            i0, j0 = F.shiftright(before, 32).cast("int"), before.bitwiseAND(low).cast("int")
            one = F.concat(F.get(s["a"], i - 1), F.lit("|"), F.get(s["b"], j - 1))
            return F.when((i - i0 == 1) & (j - j0 == 1), one).otherwise(F.concat(run(s["a"], i0, i), F.lit("|"), run(s["b"], j0, j)))

        def run(ids: Column, start: Column, end: Column) -> Column:
            # not slice(), which goes through the whole array
            return F.array_join(F.transform(F.sequence(start, end - 1), lambda x: F.get(ids, x)), ",")

        return F.array_join(F.transform(s["cuts"], of_group), ";")

    def found_of(t: Column) -> Column:
        cuts = F.filter(t["scanned"], lambda x: x < 0)
        return F.struct(F.filter(t["scanned"], lambda x: x >= 0).alias("pairs"), _with({"a": t["a"], "b": t["b"], "cuts": cuts}, counted).alias("groups"))

    def counted(s: Column) -> Column:
        # how many tokens of A (above) and of B (below) end with each group
        ends = F.transform(s["cuts"], lambda c: -(c + 1) + 1)
        return _with({"a": s["a"], "b": s["b"], "cuts": ends}, shifted)

    def shifted(s: Column) -> Column:
        return _with({"a": s["a"], "b": s["b"], "cuts": s["cuts"], "ends": F.concat(F.array(F.lit(0).cast("long")), s["cuts"])}, grouped)

    def in_order(s: Column) -> Column:
        return _with({"a": s["a"], "b": s["b"], "scanned": scanned(s)}, found_of)

    strings = {"a": F.col("a_ids").cast("array<string>"), "b": F.col("b_ids").cast("array<string>")}
    found = _with(sides | strings | {"marks": F.sort_array(F.concat(a_marks, b_marks))}, in_order)
    n_a, n_b = F.size("a_ids").cast("long"), F.size("b_ids").cast("long")
    n_groups = F.size(F.array_intersect("a_ends", "b_ends")).cast("long")
    held = tokens.select("_row", "doc_id", n_a.alias("n_a"), n_b.alias("n_b"), n_groups.alias("n_groups"), found.alias("_found"))
    n_links = F.col("n_a") + F.col("n_b") - F.col("n_groups")  # as many as there are stretches
    pairs, groups = F.col("_found.pairs").alias("pairs"), F.col("_found.groups").alias("groups")
    return held.select("_row", "doc_id", "n_a", "n_b", "n_groups", n_links.alias("n_links"), groups, pairs)


def count_pairs(aligned: DataFrame, wide: int) -> DataFrame:
    """``pair, n, best``: the rows that hold a pair of ids linked, and whether none of the same A id is held by more."""
    single = aligned.select(F.explode(F.array_distinct("pairs")).alias("pair"))
    counts = single.groupBy("pair").agg(F.count("*").alias("n"))
    own = Window.partitionBy(F.floor(F.col("pair") / wide))  # an A id has at most ``wide`` pairs
    return counts.withColumn("best", F.col("n") == F.max("n").over(own))


def sum_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``_row, n_best, count_sum`` over the links of each row that has any.

    Pairs go to every task while they are few; where they are not, those that
    make up over 1 / FREQUENT of what was counted do, and the links of the
    others, none of them frequent, meet their counts by an exchange.
    """
    links = aligned.select("_row", F.explode("pairs").alias("pair"))
    if counts.count() <= BROADCAST_PAIRS:
        found = links.join(F.broadcast(counts), "pair")
    else:
        total = counts.agg(F.sum("n")).first()[0]
        often = F.col("n") * FREQUENT > total
        frequent = links.join(F.broadcast(counts.filter(often)), "pair", "left")
        rest = frequent.filter(F.col("n").isNull()).select("_row", "pair").groupBy("_row", "pair").agg(F.count("*").alias("k"))
        rest = rest.join(counts.filter(~often), "pair")
        sums = [F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum")]
        weighed = [F.sum(F.col("best").cast("long") * F.col("k")).alias("n_best"), F.sum(F.col("n") * F.col("k")).alias("count_sum")]
        both = frequent.filter(F.col("n").isNotNull()).groupBy("_row").agg(*sums).unionByName(rest.groupBy("_row").agg(*weighed))
        return both.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.groupBy("_row").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))


def align_documents(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts the links whose pair is held by as many rows as the most
    held pair of its A id, ``count_sum`` adds those numbers over the links.
    ``groups_sha256`` is the digest of all groups' text, empty without tokens.
    Null ids are kept, repeated rows each count, texts that are null or empty
    or cannot be told from their tokens have zeros, a very long text is aligned
    whole by one task, an empty table gives an empty result; columns other than
    doc_id and text are not read.
    """
    from sentencepiece import SentencePieceProcessor

    byte_level, pieces = byte_level or public_path("byte_bpe_50k.json"), pieces or public_path("piece_bpe_32k.model")
    wide = SentencePieceProcessor(model_file=pieces).get_piece_size()
    sizes = ("n_a", "n_b", "n_groups", "n_links")
    aligned = materialize(align_texts(docs, byte_level, pieces, wide), "aligned")
    counts = materialize(count_pairs(aligned, wide), "pairs")
    sums = materialize(sum_counts(aligned, counts), "sums")
    discard(counts)
    zero = F.lit(0).cast("long")
    best = [F.coalesce(c, zero).alias(c) for c in ("n_best", "count_sum")]
    return aligned.select("_row", "doc_id", *sizes, "groups_sha256").join(sums, "_row", "left").select("doc_id", *sizes, *best, "groups_sha256")
