"""Fast, exact use of the `tokenizers` library inside tasks.

Both public vocabularies split a text with a fixed pattern before merging.  Texts are cut with numpy where every such
pattern begins a new part whatever stands around: before a space that stands next to a printable character, between a
letter and a sign, and around a single line's end.  A text's ids are then the ids of its parts in a row.  The distinct parts of
a slice are encoded by the library in a few long strings, with a special token between them, and their ids are gathered.
Where the vocabulary marks the ends of words, parts of a space and a word need no such token: they follow each other in
the string, and each must have given one end.
What has been encoded is remembered within a bound: by an ``Encoder`` made in a task until the task's end, by one from
``kept_encoder`` in a Python worker also for its next tasks.
Special-token strings in a text are treated as the library treats them by default.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from .wordhash import text_bytes

SLICE_BYTES = 2 << 20
ENCODED_BYTES = 4 << 20  # of texts at a time
REMEMBERED = 6 << 20  # bytes of parts and ids in each of two generations; their objects take about six times as much
LONGEST_REMEMBERED = 48
TOGETHER = 1000  # parts in one string


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices holding at most ``most`` bytes of ``column`` each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


SAME = np.arange(256, dtype=np.uint8)
LOWERED = SAME.copy()
LOWERED[65:91] = np.arange(97, 123)
LOWERED[10] = 32  # a vocabulary that lower-cases drops white space: a line's end is like any other
PRINTED = np.zeros(256, bool)
PRINTED[33:127] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
SIGN = PRINTED & ~LETTER
SIGN[48:58] = False
LATIN = 0xC3  # leads the two bytes of U+00C0 to U+00FF, all letters but the two signs below
LATIN_SIGNS = (0x97, 0xB7)
BEGINS = PRINTED.copy()
BEGINS[0xC3:0xCA] = True  # leads of letters up to U+027F: no white space among them, one sign apart from letters


def cut_points(data: np.ndarray, ends: np.ndarray, signs: bool = True) -> np.ndarray:
    """Offsets of the parts, the texts' own ``ends`` among them; ``signs``: also between a letter and a sign."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        left, right = data[:-1], data[1:]
        here = (right == 10) & PRINTED[left]
        here[1:] |= here[:-1] & BEGINS[right[1:]]  # after a single line's end; several in a row are merged in part
        space = right == 32
        here |= space & PRINTED[left]
        here[:-1] |= space[:-1] & BEGINS[right[1:]]
        if signs:
            ended = LETTER[left]
            ended[1:] |= (left[:-1] == LATIN) & (left[1:] != LATIN_SIGNS[0]) & (left[1:] != LATIN_SIGNS[1])
            here |= ended & SIGN[right]
        cut[1:-1] = here
    cut[ends] = True
    return np.flatnonzero(cut)


def _gather(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``pool[first : first + size]`` in a row, and their n + 1 offsets."""
    ends = np.concatenate([[0], np.cumsum(size)])
    return pool[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])], ends


class Encoder:
    """Texts to ids; made within a task, so that its memory of parts ends with the task, unless it is kept."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark fills the cores already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        rule = self.library.normalizer
        self.lowers = rule is not None and rule.normalize_str("A") == "a"
        self.between_id, last = max(self.library.get_added_tokens_decoder().items())
        self.between = last.content
        self.closing = None  # by id: whether it ends a word
        mark = getattr(self.library.model, "end_of_word_suffix", None)
        if mark:
            vocabulary = self.library.get_vocab()
            self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closing[[i for token, i in vocabulary.items() if token.endswith(mark)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _new(self, parts: list[str]) -> list[bytes]:
        """Little-endian ids of each part, from the library."""
        if self.closing is None:
            return self._apart(parts)
        words = [p for p in parts if p[0] == " " and p[1:].isalpha()]
        found = dict(zip(words, self._words(words), strict=True))
        others = [p for p in parts if p not in found]
        found.update(zip(others, self._apart(others), strict=True))
        return [found[p] for p in parts]

    def _apart(self, parts: list[str]) -> list[bytes]:
        """Ids of parts with the special token between them."""
        out: list[bytes] = []
        whole = [self.between.join(parts[lo : lo + TOGETHER]) for lo in range(0, len(parts), TOGETHER)]
        for e in self.library.encode_batch_fast(whole, add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            data, at = ids.tobytes(), 0
            for stop in [*np.flatnonzero(ids == self.between_id).tolist(), len(ids)]:
                out.append(data[4 * at : 4 * stop])
                at = stop + 1
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of parts that are a space and letters; where a string's words and ends differ in number, one by one."""
        out: list[bytes] = []
        groups = [words[lo : lo + TOGETHER] for lo in range(0, len(words), TOGETHER)]
        for group, e in zip(groups, self.library.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = (np.flatnonzero(self.closing[ids]) + 1).tolist()
            if len(stops) != len(group):  # a letter that becomes several characters, some no letters
                out += self._apart(group)
                continue
            data, at = ids.tobytes(), 0
            for stop in stops:
                out.append(data[4 * at : 4 * stop])
                at = stop
        return out

    def _ids_of(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts; short ones are remembered, those of the last two generations at most."""
        young, old = self.young, self.old
        found = [young.get(p) for p in parts]
        missing = [i for i, f in enumerate(found) if f is None]
        fresh = []
        for i in missing:
            found[i] = known = old.get(parts[i])
            if known is None:
                fresh.append(i)
        special = [i for i in fresh if "<|" in parts[i]]  # might be the token that stands between the others
        plain = [i for i in fresh if "<|" not in parts[i]] if special else fresh
        for i, ids in zip(plain, self._new([parts[i] for i in plain]), strict=True):
            found[i] = ids
        for i in special:
            found[i] = np.array(self.library.encode(parts[i], add_special_tokens=False).ids, "<u4").tobytes()
        for i in missing:
            p, ids = parts[i], found[i]
            if len(p) <= LONGEST_REMEMBERED:
                young[p] = ids
                self.held += len(p) + len(ids)
                if self.held > REMEMBERED:
                    self.young, self.old, self.held = {}, young, 0
                    young = self.young
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, n + 1 offsets); a null text has none."""
        data, ends = text_bytes(texts)
        plain = not pc.any(pc.match_substring(texts, "<|")).as_py()  # else a special token's case and signs would matter
        data = np.ascontiguousarray((LOWERED if plain and self.lowers else SAME)[data])
        at = cut_points(data, ends, plain)
        parts = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        known = self._ids_of(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        which = parts.indices.to_numpy(zero_copy_only=False)
        ids, runs = _gather(np.frombuffer(b"".join(known), "<u4"), (np.cumsum(size) - size)[which], size[which])
        return ids, runs[np.searchsorted(at, ends)]


def kept_encoder(path: str) -> Encoder:
    """The one encoder of this Python process for a vocabulary, read once and with what it remembers from task to task.

    Each task gets this module's globals anew, so the encoders are kept in a module that only the process has.
    """
    kept = sys.modules.setdefault("spanloom_kept_encoders", ModuleType("spanloom_kept_encoders")).__dict__
    key = f"{path}:{os.stat(path).st_mtime_ns}"
    if key not in kept:
        kept[key] = Encoder(path)
    return kept[key]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
