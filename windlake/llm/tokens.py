"""Token ids of whole texts by a public tokenizer, with the work of each distinct unit done about once for each worker.

A text is cut at spaces and line feeds where the tokenizer's own splitting always cuts too, so ids of the units, put
together, are the ids of the text. Units repeat a lot; their ids are kept in a table of fixed size, by two 64-bit hashes
of a unit, and numpy looks up and puts together all units of a step at once.
"""

from __future__ import annotations

import os
import re
from itertools import chain
from operator import attrgetter

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402

from windlake.llm.common import kept_in_stage  # noqa: E402

#: White space other than space and line feed; a text with any of these is cut by CUT instead.
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
CUT = re.compile("(?<=[!-~¡-ᙿ]) (?=[!-~¡-ᙿ])")
LATIN_END = "ɐ"
FIRST = "\r"  # marks a unit with no space before it; a unit cut at spaces never starts so
CUT_MARK = "\0"  # stands between units; a text that has one is encoded by the library as a whole
STEP_CHARACTERS = 1_000_000
ID = attrgetter("id")
SPACE_LETTER = "\u0120"  # byte-level BPE's letter for a space


class UnitHashes:
    """Two 64-bit polynomial hashes of many slices of one byte array, from running sums."""

    BLOCK = 1 << 20

    def __init__(self):
        rng = np.random.default_rng(11)
        self.tables = rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
        self.bases = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        def powers(base: int) -> np.ndarray:
            out = np.full(n, base, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        self.powers = [(powers(b), powers(pow(b, -1, 1 << 64))) for b in self.bases]

    def __call__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            base = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, base + self.BLOCK, "right")))
            part = raw[base : int(ends[to - 1])]
            if len(part) > len(self.powers[0][0]):
                self._grow(max(len(part), self.BLOCK))
            lo, hi = starts[at:to] - base, ends[at:to] - base
            for table, (up, down), out in zip(self.tables, self.powers, (first, second)):
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(table[part] * up[: len(part)], out=sums[1:])
                h = (sums[hi] - sums[lo]) * down[np.minimum(lo, max(0, len(part) - 1))]
                out[at:to] = h ^ (h >> np.uint64(29))
            if len(self.powers[0][0]) > self.BLOCK:
                self._grow(1 << 16)  # one huge unit shouldn't keep its powers
            at = to
        return first, second


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable character for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class UnitEncoder:
    """Ids by ``tokenizers`` of one file: kind "byte" (byte-level BPE) or "word" (lower case, white space dropped).

    The table has ``1 << bits`` places in pairs; a new unit takes the first place of its pair, whose unit moves to the
    second. Units of more than INLINE ids aren't kept.
    """

    INLINE = 8

    def __init__(self, path: str, kind: str, bits: int = 20):
        from tokenizers import Tokenizer

        self.tok, self.kind = Tokenizer.from_file(path), kind
        self.tok.no_padding()
        self.tok.no_truncation()
        self.tokenize, self.letters = self.tok.model.tokenize, byte_letters()
        self.dtype = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        pairs = 1 << (bits - 1)
        self.shift = np.uint64(64 - (bits - 1))
        self.first, self.second = np.zeros((2, pairs), np.uint64), np.zeros((2, pairs), np.uint64)
        self.ids, self.size = np.zeros((2, pairs, self.INLINE), self.dtype), np.zeros((2, pairs), np.uint8)
        self.hashes = UnitHashes()
        self.marks = {m: self._ids([m])[0] for m in ("\n", ".", ",")}

    def joined(self, text: str) -> str:
        """The text's units with CUT_MARK between them; it must not hold one itself."""
        if self.kind == "word":
            return text.replace("\n", CUT_MARK).replace(" ", CUT_MARK)
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in OTHER_SPACE):
            return FIRST + CUT.sub(CUT_MARK, text)
        return FIRST + text.replace("\n", " \n").replace(" ", CUT_MARK)

    def unit_text(self, unit: str) -> str:
        if self.kind == "word":
            return unit
        return unit[1:] if unit.startswith(FIRST) else unit if unit.startswith("\n") else " " + unit

    def _letters_only(self, word: str, spaced: bool) -> list[int] | None:
        """Ids of a word that is one pre-token for sure: Latin letters only."""
        if not word.isalpha():
            return None
        if self.kind == "word":
            low = word.lower()
            if len(low) != len(word):
                return None
            word, spaced = low, False
        if word.isascii():
            word = SPACE_LETTER + word if spaced else word
        elif max(word) >= LATIN_END:
            return None
        else:
            word = "".join(map(self.letters.__getitem__, (" " + word if spaced else word).encode()))
        return list(map(ID, self.tokenize(word)))

    def _simple(self, unit: str) -> list[int] | None:
        """Ids of a unit that is a word, maybe after a line feed and before a full stop or comma; None for any other."""
        if not unit:
            return None
        before, after, spaced = None, None, self.kind == "byte"
        if spaced and unit[0] in "\n\r":
            before, spaced = self.marks["\n"] if unit[0] == "\n" else None, False
            unit = unit[1:]
        if unit[-1:] in (".", ","):
            after, unit = self.marks[unit[-1]], unit[:-1]
        word = self._letters_only(unit, spaced)
        if word is None:
            return None
        return (before or []) + word + (after or [])

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def of_units(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit, without the table."""
        out = list(map(self._simple, units))
        slow = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(slow, self._ids([self.unit_text(units[i]) for i in slow]) if slow else ()):
            out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        out: list[np.ndarray] = [None] * len(texts)
        step, held = [], 0
        for i, text in enumerate(texts):
            if CUT_MARK in text:
                out[i] = np.array(self._ids([text])[0], "<u4")
                continue
            step.append(i)
            held += len(text)
            if held > STEP_CHARACTERS:
                self._encode_step(texts, step, out)
                step, held = [], 0
        if step:
            self._encode_step(texts, step, out)
        return out

    def _encode_step(self, texts: list[str], step: list[int], out: list[np.ndarray]) -> None:
        cut = [self.joined(texts[i]) for i in step]
        data = CUT_MARK.join(cut).encode()
        raw = np.frombuffer(data, np.uint8)
        marks = np.flatnonzero(raw == 0)
        starts, ends = np.concatenate([[0], marks + 1]), np.append(marks, len(raw))
        first, second = self.hashes(raw, starts, ends)
        place = (first * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        way = np.full(len(place), -1, np.int8)
        for w in (1, 0):
            way[(self.first[w, place] == first) & (self.second[w, place] == second) & (self.size[w, place] > 0)] = w
        known = np.flatnonzero(way >= 0)
        sizes = np.zeros(len(place), np.int64)
        kept_way, kept_place = way[known], place[known]
        kept_ids, sizes[known] = self.ids[kept_way, kept_place], self.size[kept_way, kept_place]
        lost = np.flatnonzero(way < 0)
        _, some, lost_to = np.unique(first[lost], return_index=True, return_inverse=True)
        some = lost[some]
        if (second[some][lost_to] != second[lost]).any():  # two units with one first hash: each on its own
            some, lost_to = lost, np.arange(len(lost))
        new_ids = self.of_units([data[a:b].decode() for a, b in zip(starts[some].tolist(), ends[some].tolist())])
        new_sizes = np.fromiter(map(len, new_ids), np.int64, len(new_ids))
        new_flat = np.fromiter(chain.from_iterable(new_ids), self.dtype, int(new_sizes.sum()))
        new_starts = np.cumsum(new_sizes) - new_sizes
        sizes[lost] = new_sizes[lost_to]
        to = np.cumsum(sizes) - sizes
        ids = np.empty(int(sizes.sum()), "<u4")
        lanes = np.arange(self.INLINE)
        on = lanes < sizes[known][:, None]
        ids[(to[known][:, None] + lanes)[on]] = kept_ids[on]
        size = sizes[lost]
        before = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(before, size)
        ids[np.repeat(to[lost], size) + within] = new_flat[np.repeat(new_starts[lost_to], size) + within]
        self._keep(first[some], second[some], place[some], new_sizes, new_starts, new_flat)
        units = np.fromiter((t.count(CUT_MARK) + 1 for t in cut), np.int64, len(cut))
        bounds = np.append(to, len(ids))[np.concatenate([[0], np.cumsum(units)])]
        for k, i in enumerate(step):
            out[i] = ids[bounds[k] : bounds[k + 1]]

    def _keep(self, first: np.ndarray, second: np.ndarray, place: np.ndarray, sizes: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> None:
        fit = np.flatnonzero((sizes > 0) & (sizes <= self.INLINE))
        at, one = np.unique(place[fit], return_index=True)  # one for each pair
        fit = fit[one]
        for a in (self.first, self.second, self.ids, self.size):
            a[1, at] = a[0, at]
        self.first[0, at], self.second[0, at], self.size[0, at] = first[fit], second[fit], sizes[fit]
        lanes = np.arange(self.INLINE)
        inside = np.minimum(starts[fit][:, None] + lanes, max(0, len(flat) - 1))
        self.ids[0, at] = flat[inside] if len(fit) else 0


def encoder(path: str, kind: str) -> UnitEncoder:
    """The worker's encoder of this file; later tasks of the stage find its cache filled."""
    return kept_in_stage(("encoder", path, kind), lambda: UnitEncoder(path, kind))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
