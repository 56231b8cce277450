"""Word-wise use of a public tokenizer, with a bounded memory of words.

Many tokenizers never merge across white space, so a text is encoded as its
words are. Words repeat; each is encoded once per process until the memory is
full and starts anew. Whether a tokenizer is of such a family is read from its
file or tried on probes; texts of others are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

from fieldloom.llm.common import kept  # noqa: E402

#: Words and cut units a process remembers, and the longest word in bytes.
REMEMBERED, REMEMBERED_UNITS = 1_000_000, 200_000
LONG_WORD = 64

#: Owner of tokenizers and word memories in a worker process (``common.kept``).
OWNER = "tokens"


def _opened(path: str) -> Tokenizer:
    opened = Tokenizer.from_file(path)
    opened.no_padding()
    opened.no_truncation()
    return opened


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, opened once per process, without padding or truncation."""
    return kept(OWNER, path, lambda: _opened(path))


def word_encoder(path: str, dtype: str) -> WordEncoder:
    """The encoder of a file and a type of ids, made once per process."""
    return kept(OWNER, (path, dtype), lambda: WordEncoder(path, dtype))


def encode_batch(path: str, texts: list[bytes]) -> list[list[int]]:
    found = tokenizer(path).encode_batch_fast(
        [t.decode("utf-8", "replace") for t in texts], add_special_tokens=False
    )
    return [e.ids for e in found]


#: Parts encoded in one call: a call costs more than a word.
JOINED = 500


def encode_parts(path: str, parts: list[bytes], between: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the parts, and the number of ids of each part.

    Parts must be such that the tokenizer encodes them alike when joined by
    ``between``; ids are told apart by where they start.
    """
    ids, counts = [], []
    opened = tokenizer(path)
    for at in range(0, len(parts), JOINED):
        texts = [p.decode("utf-8", "replace") for p in parts[at : at + JOINED]]
        found = opened.encode(between.join(texts), add_special_tokens=False)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + len(between))
        starts = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
        of = np.searchsorted(ends, starts, side="right")
        ids.append(np.array(found.ids, np.int64))
        counts.append(np.bincount(of, minlength=len(texts)))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(ids or none), np.concatenate(counts or none)


#: ASCII marks that end a word in a token of their own.
_MARKS = b".,;:!?&*#$%|)]}>\"+-=_/~@^"


_SIMPLE = re.compile("[a-zß-öø-ÿ]+")
_PROBES = "a the word größe élève niño ÿ øre straßenbahnhaltestelle".split()
#: Texts on which a tokenizer shows whether it lower-cases, drops white space and parts marks from words.
_PROBE_TEXTS = [
    "Two  WORDS\tand\nmore ", "Über ÄRGER, it's fine.", *(f"word{chr(m)} other{chr(m)}{chr(m)}" for m in _MARKS),
]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level BPE: printable Latin-1 stands for
    itself, and the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordEncoder:
    """Encodes whole texts with a tokenizer that lower-cases and drops white space.

    Its tokens lie within words, and marks after a letter are apart from it, so
    a word's ids are those of its stem and of the marks behind. ``dtype`` is
    the type of the ids. Texts that hold ``special``, the start of a special
    token, are encoded whole, as are all texts if the tokenizer is of another
    family.
    """

    def __init__(self, path: str, dtype: str, special: bytes = b"<|"):
        self.path, self.dtype, self.special = path, dtype, special
        self.known: dict[bytes, bytes] = {}
        self.letters = _byte_letters()
        self.pieces = tokenizer(path).model.tokenize
        # Words of plain letters are one piece to the model, if the tokenizer is of this family.
        self.simple = all(
            [t.id for t in self.pieces(self._shown(w))] == tokenizer(path).encode(w, add_special_tokens=False).ids
            for w in _PROBES
        )
        self.wordwise = True
        probes = [t.encode() for t in _PROBE_TEXTS]
        whole = [np.array(x, dtype).tobytes() for x in encode_batch(path, probes)]
        self.wordwise = self.encode(probes) == whole

    def _shown(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        learnt: dict[bytes, bytes] = {}
        if self.simple:
            pieces, dtype, rest = self.pieces, self.dtype, []
            for w in words:
                shown = w.decode("utf-8", "replace")
                if _SIMPLE.fullmatch(shown):
                    learnt[w] = np.array([t.id for t in pieces(self._shown(shown))], dtype).tobytes()
                else:
                    rest.append(w)
            words = rest
        ids, counts = encode_parts(self.path, words, " ")
        data, width = ids.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
        ends = (np.cumsum(counts) * width).tolist()
        learnt.update((w, data[a:b]) for w, a, b in zip(words, [0, *ends], ends))
        return learnt

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as bytes of ``dtype``."""
        apart = [self.wordwise and self.special not in t for t in texts]
        words = [t.lower().split() if a else None for a, t in zip(apart, texts)]
        fresh: set[bytes] = set()
        for w in words:
            if w:
                fresh.update(w)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
        known = self.known
        split, learn = {}, set()
        for w in fresh:
            if w not in known:
                stem = w.rstrip(_MARKS)
                if stem and len(stem) < len(w) and 97 <= stem[-1] <= 122:
                    split[w] = stem
                    learn |= {x for x in (stem, w[len(stem) :]) if x not in known}
                else:
                    learn.add(w)
        now = self._learn(list(learn))
        for w, stem in split.items():
            marks = w[len(stem) :]
            now[w] = (now[stem] if stem in now else known[stem]) + (
                now[marks] if marks in now else known[marks]
            )
        long = {w: x for w, x in now.items() if len(w) > LONG_WORD}
        known.update((w, x) for w, x in now.items() if len(w) <= LONG_WORD)
        get = (lambda w: long[w] if w in long else known[w]) if long else known.__getitem__
        whole = encode_batch(self.path, [t for a, t in zip(apart, texts) if not a])
        packed = iter([np.array(x, self.dtype).tobytes() for x in whole])
        return [next(packed) if w is None else b"".join(map(get, w)) for w in words]


_WS = rb"\t-\r "
_UNIT = re.compile(rb"[" + _WS + rb"]*[^" + _WS + rb"]+|[" + _WS + rb"]+")
#: Bytes of white space other than ASCII's, and of characters on which engines differ.
_OTHER_SPACE = re.compile(
    rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf"
)
_OTHER_END = re.compile(rb"(?:" + _OTHER_SPACE.pattern + rb")\Z")


def units(text: bytes) -> list[bytes]:
    """A text cut before white space that follows another character: words with the space before them."""
    found = _UNIT.findall(text)
    if not _OTHER_SPACE.search(text):
        return found
    joined, held = [], []
    for unit in found:  # after white space of another kind the same run goes on
        held.append(unit)
        if not _OTHER_END.search(unit):
            joined.append(b"".join(held))
            held = []
    return joined + [b"".join(held)] * bool(held)


#: Units of one word and the marks behind it, which every version of the pattern cuts alike.
_PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\\[-`{-~]*)")


class PreTokens:
    """Cuts texts into the pre-tokens of a byte-level tokenizer, by its own pattern.

    A pre-token never goes on from another character into white space, so the
    pattern is applied to units, each once per process until the memory is
    full. Units that hold ``special`` are not cut. A tokenizer of another
    family has one pre-token, the whole text.
    """

    def __init__(self, path: str, special: bytes = b"<|"):
        self.path, self.special = path, special
        settings = json.loads(tokenizer(path).to_str())
        before = settings["pre_tokenizer"] or {}
        self.bytewise = (
            settings["normalizer"] is None
            and (before.get("type"), before.get("use_regex"), before.get("add_prefix_space")) == ("ByteLevel", True, False)
        )
        self.cut = tokenizer(path).pre_tokenizer
        self.letters = _byte_letters()
        self.pieces = tokenizer(path).model.tokenize
        self.known: dict[bytes, tuple[bytes, ...]] = {}

    def _learn(self, fresh: list[bytes]) -> None:
        rest = []
        for unit in fresh:
            if self.special in unit:
                self.known[unit] = (unit,)
            elif found := _PLAIN.fullmatch(unit.decode("utf-8", "replace")):
                self.known[unit] = tuple(x.encode() for x in found.groups() if x)
            else:
                rest.append(unit)
        for at in range(0, len(rest), JOINED):
            some = rest[at : at + JOINED]
            texts = [u.decode("utf-8", "replace") for u in some]
            # A unit ends in front of white space; a line break and a letter, a unit too, keep it so.
            between = "\nx"
            ends = np.cumsum([len(t) + len(between) for t in texts])
            found = self.cut.pre_tokenize_str(between.join(texts))
            starts = np.array([x[1] for x in found], np.int64)[:, 0] if found else np.zeros(0, np.int64)
            of = np.searchsorted(ends, starts, side="right")
            first = np.searchsorted(of, np.arange(len(some) + 1))
            for k, (unit, text) in enumerate(zip(some, texts)):
                low = int(ends[k]) - len(text) - len(between)
                own = [x[1] for x in found[first[k] : first[k + 1]] if x[1][0] < low + len(text)]
                self.known[unit] = tuple(text[a - low : b - low].encode() for a, b in own)

    def __call__(self, text: bytes) -> dict[bytes, int]:
        """How often each pre-token occurs in a text."""
        if not self.bytewise:
            return {text: 1} if text else {}
        if len(self.known) > REMEMBERED_UNITS:
            self.known.clear()
        counts: dict[bytes, int] = {}
        own = Counter(units(text))
        self._learn([u for u in own if u not in self.known])
        for unit, n in own.items():
            for part in self.known[unit]:
                counts[part] = counts.get(part, 0) + n
        return counts

    def piece_counts(self, parts: list[bytes]) -> list[int]:
        """Tokens of each pre-token."""
        if not self.bytewise:
            return [len(x) for x in encode_batch(self.path, parts)]
        letters, pieces = self.letters, self.pieces
        return [
            len(encode_batch(self.path, [p])[0]) if self.special in p else len(pieces(p.decode("latin-1").translate(letters)))
            for p in parts
        ]


_PRE_TOKENS: dict[str, PreTokens] = {}


def pre_tokens(path: str) -> PreTokens:
    if path not in _PRE_TOKENS:
        _PRE_TOKENS[path] = PreTokens(path)
    return _PRE_TOKENS[path]
