"""Byte-pair encoding and decoding of whole texts in batched numpy merge rounds.

A text is cut into words and runs of other marks, units that encode independently of each other: the texts of a
pass are one array of characters, cut where their class changes, and Arrow finds the different units and their
places in a bounded table of those that the worker has met. The new units of a pass are encoded together: the
symbols of all their words lie in one flat array, the rank of every adjacent pair is found by binary search over
the sorted pair keys, every word merges its lowest-ranked pair wherever it occurs, ranks beside a merge are found
anew, and words without a pair that can merge leave the array. The ids of a pass are then gathered from the table
in one step.

The ids equal those of the tokenizers library for the two kinds of vocabulary file it is given: byte-level
merges with the pattern built in, and merges over lower-cased words with a word-end suffix. A text to be lower-cased
that has characters on which Python's Unicode tables and the library's differ is encoded by the library itself. A vocabulary file is read
once by the driver and broadcast (at most MAX_VOCABULARY bytes).
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import appended, passes, sliced, with_fields

#: Fixed value: the public pattern that byte-level files without one of their own split by.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY = 64_000_000
#: Units and bytes of units that a worker's table holds before it starts anew.
TABLE_UNITS = 250_000
TABLE_BYTES = 5_000_000
#: Before a special token's string in the table: a lone surrogate, which no text holds.
SPECIAL = "\ud800"
_NONE = np.iinfo(np.int32).max
#: Classes of characters: what no unit holds, letters and digits, other marks, the line feed and the space where units hold them.
GAP, LETTER, MARK, FEED, SPACE = range(5)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, more = {b: chr(b) for b in own}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(more)
            more += 1
    return [letters[b] for b in range(256)]


#: Marks that str.split() counts as white space and \\s of the library doesn't.
CONTROL_SPACE = "\x1c\x1d\x1e\x1f"
#: White space but the space and the line feed.
RARE_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (0x0A, 0x20)]
RARE_IN_ASCII = [c for c in RARE_SPACE if c.isascii()]


def odd_space(text: str) -> bool:
    """Whether white space stands at the end, beside other white space, or is neither a space nor a line feed."""
    return (
        text[-1:] in (" ", "\n")
        or any(two in text for two in ("  ", " \n", "\n ", "\n\n"))
        or any(c in text for c in (RARE_IN_ASCII if text.isascii() else RARE_SPACE))
    )


@cache
def newer_letters() -> str:
    """Letters and numbers of the regex module that this Python's own Unicode tables don't have, as a set's ranges; the library's tables are no newer."""
    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    found = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    starts = [c for c, before in zip(found, [-2, *found], strict=False) if c != before + 1]
    ends = [c for c, after in zip(found, [*found[1:], -2], strict=True) if c + 1 != after]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


@cache
def strange() -> frozenset[str]:
    """Characters that Python's Unicode tables don't have, though later ones may, or that the library puts in another order or case; none of Latin-1."""
    from tokenizers.normalizers import NFC, Lowercase

    nfc, low = NFC().normalize_str, Lowercase().normalize_str

    def differs(c: str) -> bool:
        if unicodedata.category(c) == "Cn":
            return True
        if unicodedata.combining(c) and nfc(f"a{c}\u0334") != unicodedata.normalize("NFC", f"a{c}\u0334"):
            return True
        return c.lower() != c and low(c) != c.lower()

    return frozenset(c for c in map(chr, range(0x100, 0x40000)) if not "\ud800" <= c <= "\udfff" and differs(c))


def has_strange(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not strange().isdisjoint(text)
    return False


@cache
def classes() -> np.ndarray:
    """GAP, LETTER or MARK of every code point, as str has it; from U+40000 on there are marks alone."""
    out = np.full(0x110000, MARK, dtype=np.uint8)
    out[:0x40000] = np.fromiter((LETTER if c.isalnum() else GAP if c.isspace() else MARK for c in map(chr, range(0x40000))), dtype=np.uint8)
    return out


def letters_as_assigned(pattern: str) -> str:
    newer = newer_letters()
    for kind in (r"\p{L}", r"\p{N}") if newer else ():
        pattern = pattern.replace(kind, f"[{kind}--[{newer}]]")
    return pattern


class Encoder:
    """One vocabulary file; encode() and decode() take whole batches."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.library = raw, None
        spec = json.loads(raw)
        model = spec["model"]
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("only plain byte-pair files are supported")
        letters = byte_letters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.added.values()])
        self.first = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.last = np.array([vocab[c + self.end] for c in letters], dtype=np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        second = np.concatenate([self.first, self.last])  # by byte, and by byte at a word's end
        self.byte_ranks = self._ranks_of(np.repeat(self.first, len(second)), np.tile(second, len(self.first)))
        normal = (spec.get("normalizer") or {}).get("normalizers", [])
        self.folds = any(x["type"] == "Lowercase" for x in normal)
        pre = spec["pre_tokenizer"]
        own = next((x["pattern"]["Regex"] for x in pre.get("pretokenizers", []) if x["type"] == "Split"), None)
        self.words = regex.compile(letters_as_assigned(own or BYTE_LEVEL_PATTERN), regex.V1)
        self.drops_space = own is not None
        if self.drops_space != self.folds:
            raise ValueError("neither of the two supported kinds of file")
        self.classes = classes()
        if not self.drops_space:
            self.classes = self.classes.copy()
            self.classes[[ord("\n"), ord(" ")]] = FEED, SPACE
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        back = {c: b for b, c in enumerate(letters)}
        text = [b""] * self.size
        for token, i in vocab.items():
            body, gap = (token[: -len(self.end)], b" ") if self.end and token.endswith(self.end) else (token, b"")
            text[i] = bytes(back[c] for c in body) + gap
        for token, i in self.added.items():
            text[i] = token.encode()
        self.token_at = np.concatenate([[0], np.cumsum([len(t) for t in text])]).astype(np.int64)
        self.token_bytes = np.frombuffer(b"".join(text), dtype=np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.units, self.held = pa.array([], pa.large_binary()), 0
        self.flat, self.at = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    # -- cutting -----------------------------------------------------------------------------------------
    def _folded(self, text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower() if self.folds else text

    def _odd(self, text: str) -> bool:
        """Whether the file's own pattern must cut the text, as classes of characters don't do it."""
        if any(a in text for a in self.added):
            return True
        return any(c in text for c in CONTROL_SPACE) if self.folds else odd_space(text)

    def _odd_units(self, text: str) -> list[str]:
        """Units of a text that is not folded yet; special tokens are looked for before."""
        pieces = self.special.split(text) if self.special else [text]
        out: list[str] = []
        for k, piece in enumerate(pieces):
            if k % 2:
                out.append(SPECIAL + piece)
            elif piece:
                out += self.words.findall(self._folded(piece))
        return out

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Units of all texts in UTF-8, one after the other, and how many each text has.

        A unit is a run of letters and digits or of other marks; where spaces count, with the space before it, and a
        line feed is one. A stretch without white space that has an apostrophe is one unit, whose words the file's own
        pattern finds. Between the texts stands a mark that no unit holds.
        """
        joined = "\r".join(texts)
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        if len(data) == len(joined):
            chars = data
        else:
            try:
                chars = np.frombuffer(joined.encode("latin-1"), dtype=np.uint8)
            except UnicodeEncodeError:
                chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        own = self.classes[chars]
        held = own != GAP
        start = held.copy()
        start[1:] &= (own[1:] != own[:-1]) & (own[:-1] != SPACE)
        begin = np.flatnonzero(start)
        apostrophes = np.flatnonzero(chars == ord("'"))
        if len(apostrophes):
            first = (begin == 0) | np.isin(own[begin], (SPACE, FEED)) | np.isin(own[begin - 1], (GAP, FEED))
            stretch = np.cumsum(first) - 1
            whole = np.zeros(len(begin), dtype=bool)
            whole[stretch[np.searchsorted(begin, apostrophes, side="right") - 1]] = True
            begin = begin[first | ~whole[stretch]]
        if chars is data:
            before = np.cumsum(held)
        else:
            width = np.uint8(1) + (chars >= 0x80)
            if chars.itemsize > 1:
                width += (chars >= 0x800).astype(np.uint8) + (chars >= 0x10000)
            before = np.cumsum(width * held, dtype=np.int64)
            held = np.repeat(held, width)
        data = data[held]
        offsets = np.append(np.concatenate([[0], before])[begin], len(data)).astype(np.int64)
        units = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        bounds = np.cumsum([len(t) + 1 for t in texts])
        return units, np.diff(np.searchsorted(begin, bounds), prepend=0)

    def _all_units(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Units of all texts in UTF-8, one after the other, and how many each text has."""
        odd = np.array([self._odd(t) for t in texts], dtype=bool)
        units, plain = self._cut([self._folded(t) for t, o in zip(texts, odd, strict=True) if not o])
        if not odd.any():
            return units, plain
        lists = [self._odd_units(t) for t, o in zip(texts, odd, strict=True) if o]
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[~odd], counts[odd] = plain, [len(x) for x in lists]
        more = pa.array([u.encode("utf-8", "surrogatepass") for u in chain.from_iterable(lists)], pa.large_binary())
        owner = np.concatenate([np.repeat(np.flatnonzero(x), counts[x]) for x in (~odd, odd)])
        return pa.concat_arrays([units, more]).take(pa.array(np.argsort(owner, kind="stable"))), counts

    def _rows(self, units: pa.Array) -> np.ndarray:
        """The units' rows in the table, which learns those that it doesn't have."""
        each = units.dictionary_encode()
        found = pc.index_in(each.dictionary, value_set=self.units)
        new = each.dictionary.filter(found.is_null())
        rows = found.fill_null(-1).to_numpy().astype(np.int64)
        rows[rows < 0] = len(self.units) + np.arange(len(new))
        if len(new):
            self._learn(new)
        return rows[each.indices.to_numpy()]

    def _pieces(self, unit: bytes) -> list[bytes]:
        """Words of the unit; a special token is not taken apart."""
        if unit.lstrip(b" ").isalpha():
            return [unit]
        text = unit.decode("utf-8", "surrogatepass")
        if text[0] == SPECIAL or text.lstrip(" ").isalpha():
            return [unit]
        return [w.encode("utf-8", "surrogatepass") for w in self.words.findall(text)]

    # -- merging -----------------------------------------------------------------------------------------
    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; those that never merge have _NONE."""
        if not len(self.keys):
            return np.full(len(left), _NONE, dtype=np.int32)
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE).astype(np.int32)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has. No word is empty."""
        if not words:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(sizes) - 1
        sym, second = self.first[data], data.astype(np.int32)
        if self.end:
            sym[ends] = self.last[data[ends]]
            second[ends] += 256
        ranks = np.full(len(sym), _NONE, dtype=np.int32)  # of the symbol and the next one of its word
        ranks[:-1] = self.byte_ranks[data[:-1] * np.int32(512) + second[1:]]
        ranks[ends] = _NONE
        word, starts = np.arange(len(words)), ends + 1 - sizes
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            lowest = np.minimum.reduceat(ranks, starts)
            rest = lowest != _NONE
            if not rest.all():
                going = np.repeat(rest, sizes)
                done.append((sym[~going], word[~rest], sizes[~rest]))
                sym, ranks, word, sizes, lowest = sym[going], ranks[going], word[rest], sizes[rest], lowest[rest]
                if not len(word):
                    break
            hit = np.flatnonzero(ranks == np.repeat(lowest, sizes))
            # in a run of hits that overlap (aaa), every second one merges, from the left
            new_run = np.concatenate([[True], np.diff(hit) != 1])
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
            sym[hit] = self.made[ranks[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            sizes = np.add.reduceat(keep, np.cumsum(sizes) - sizes, dtype=np.int64)
            sym, ranks = sym[keep], ranks[keep]
            starts = np.cumsum(sizes) - sizes
            last = np.zeros(len(sym), dtype=bool)
            last[starts + sizes - 1] = True
            made = hit - np.arange(len(hit))  # where the merged symbols are now
            ranks[made] = _NONE
            beside = np.concatenate([made, made[made > 0] - 1])
            beside = beside[~last[beside]]
            ranks[beside] = self._ranks_of(sym[beside], sym[beside + 1])
        all_sym, all_word, all_sizes = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(all_word)
        return _gather(all_sym, (np.cumsum(all_sizes) - all_sizes)[order], all_sizes[order]), all_sizes[order]

    def _learn(self, new: pa.Array) -> None:
        words: list[bytes] = []
        counts = []
        for unit in new.to_numpy(zero_copy_only=False):
            own = self._pieces(unit)
            counts.append(len(own))
            words += own
        mark = SPECIAL.encode("utf-8", "surrogatepass")
        special = [k for k, w in enumerate(words) if w.startswith(mark)]
        ids, lens = self.merge([w for w in words if not w.startswith(mark)] if special else words)
        for k in special:
            at = int(lens[:k].sum())
            ids, lens = np.insert(ids, at, self.added[words[k][len(mark) :].decode()]), np.insert(lens, k, 1)
        owner = np.repeat(np.arange(len(new)), counts)
        sizes = np.bincount(owner, weights=lens, minlength=len(new)).astype(np.int64)
        self.units, self.held = pa.concat_arrays([self.units, new]), self.held + sum(map(len, words))
        self.flat = np.concatenate([self.flat, ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])

    # -- batches -----------------------------------------------------------------------------------------
    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (int32) and the offsets of the texts (int64, one more than texts). Holds all texts' ids at once."""
        rare = [i for i, t in enumerate(texts) if has_strange(t)] if self.folds else []
        if rare:
            return self._with_rare(texts, rare)
        if len(self.units) > TABLE_UNITS or self.held > TABLE_BYTES:
            self._clear()
        units, counts = self._all_units(texts)
        rows = self._rows(units)
        lens = self.at[rows + 1] - self.at[rows]
        flat = _gather(self.flat, self.at[rows], lens)
        total = np.concatenate([[0], np.cumsum(lens)])
        return flat, total[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)

    def _with_rare(self, texts: list[str], rare: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.raw.decode())
            self.library.no_truncation()
            self.library.no_padding()
        own = {i: np.array(self.library.encode(texts[i], add_special_tokens=False).ids, dtype=np.int32) for i in rare}
        flat, at = self.encode(["" if i in own else t for i, t in enumerate(texts)])
        parts = [own[i] if i in own else flat[at[i] : at[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)

    def decode(self, flat: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id lists. Bytes that are no UTF-8 become U+FFFD; ids outside of the vocabulary have no text."""
        flat = np.where((flat >= 0) & (flat < self.size), flat, 0), (flat >= 0) & (flat < self.size)
        lens = (self.token_at[flat[0] + 1] - self.token_at[flat[0]]) * flat[1]
        data = _gather(self.token_bytes, self.token_at[flat[0]], lens).tobytes()
        ends = np.concatenate([[0], np.cumsum(lens)])[offsets]
        out = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [t.removesuffix(" ") for t in out] if self.end else out


def _gather(values: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """values[at[i] : at[i] + lens[i]] of all i, one after the other."""
    total = int(lens.sum())
    if not total:
        return values[:0]
    shift = at - (np.cumsum(lens) - lens)
    return values[np.repeat(shift, lens) + np.arange(total)]


_encoders: dict[int, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """The process's encoder for a vocabulary file's content."""
    key = hash(raw)
    if key not in _encoders:
        _encoders[key] = Encoder(raw)
    return _encoders[key]


def vocabulary(df: DataFrame, path: str):
    """The file's content as a broadcast variable; its size is checked."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY + 1)
    if len(raw) > MAX_VOCABULARY:
        raise ValueError(f"{path} is no vocabulary file: over {MAX_VOCABULARY} bytes")
    return df.sparkSession.sparkContext.broadcast(raw)


def id_lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with `ids` array<int>: the whole text encoded by the vocabulary file at path, without special tokens added.

    Their strings in a text become their ids, as in the library. Null and empty texts have no ids. An existing
    column `ids` is replaced; other columns are kept. Narrow: no exchange, one pass of at most
    common.PASS_CHARS characters (or one text) in memory.
    """
    raw = vocabulary(df, path)
    schema = with_fields(df, **{ids: T.ArrayType(T.IntegerType(), False)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = encoder(raw.value), None
        for batch, texts in sliced(batches, text):
            flat, offsets = own.encode(texts)
            column = id_lists(flat, offsets)
            out = out or _out_schema(batch.schema, ids, column.type)
            yield appended(batch, out, **{ids: column})

    return df.mapInArrow(run, schema)


def _out_schema(schema: pa.Schema, name: str, kind: pa.DataType) -> pa.Schema:
    return pa.schema([f for f in schema if f.name.lower() != name.lower()] + [pa.field(name, kind)])


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with `text`: the ids decoded, special tokens included. Null id lists give an empty text; null ids have none."""
    raw = vocabulary(df, path)
    schema = with_fields(df, **{text: T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = encoder(raw.value), None
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            lens = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            out = out or _out_schema(batch.schema, text, pa.string())
            start = 0
            for a, b in _id_passes(lens):
                own_ids = column.slice(a, b - a).flatten()
                offsets = np.concatenate([[0], np.cumsum(lens[a:b])]).astype(np.int64)
                texts = own.decode(own_ids.fill_null(-1).to_numpy(zero_copy_only=False), offsets)
                start += len(own_ids)
                yield appended(batch.slice(a, b - a), out, **{text: pa.array(texts, pa.string())})

    return df.mapInArrow(run, schema)


def _id_passes(lens: np.ndarray) -> Iterator[tuple[int, int]]:
    return passes([range(int(n)) for n in lens])  # type: ignore[arg-type]
