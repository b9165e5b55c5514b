"""Token ids from a tokenizer file, with each distinct word encoded once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import SparkSession

from barspark.llm.common import Memo, release_memory
from barspark.llm.sketch import forget_words

#: Characters that Arrow splits at and tokenizers do not, or that join oddly.
_ODD = r"[\x{1C}-\x{1F}\x{180E}\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
#: Words of these alone are normal (NFC) already and lower-case letter by letter.
_PLAIN = re.compile("[!-~¡-ɏ]+")
#: A tokenizer file above this size is refused, since it is broadcast.
MOST_TOKENIZER_BYTES = 64 << 20
#: Text of one round; its distinct words are looked up once.
ROUND_BYTES = 16 << 20
#: Distinct words that are Python strings at a time.
LOOKUP_WORDS = 1 << 15
#: Words of a round whose ids are put together at a time (one text at least).
GATHER_WORDS = 1 << 17
MOST_PIECES = 500_000


def broadcast_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The file's text for all executors; its size is checked."""
    if (size := os.path.getsize(path)) > MOST_TOKENIZER_BYTES:
        raise ValueError(f"tokenizer file of {size} bytes; at most {MOST_TOKENIZER_BYTES} are broadcast")
    return spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def id_width(text: str, *more: int) -> int:
    """Bytes, 2 or 4, that hold every id of a tokenizer file and these more."""
    spec = json.loads(text)
    vocab = spec["model"]["vocab"]
    largest = max([*more, *(vocab.values() if isinstance(vocab, dict) else [len(vocab)]), *(t["id"] for t in spec.get("added_tokens", []))])
    return 2 if largest < 1 << 16 else 4


def load_tokenizer(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text)


def byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies.

    Rule: printable Latin-1 characters stand for themselves, and the other
    bytes, ascending, for the letters from U+0100.
    """
    out, more = {}, 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit arrays.

    Where the tokenizer drops white space and encodes each word by itself (it
    is probed for that), texts are split by Arrow, and each round's distinct
    words are put together from a bounded memo of distinct pre-tokens. Texts with odd characters or the
    strings of added tokens go to the library whole, as do all texts of other
    tokenizers.
    """

    def __init__(self, text: str, most_pieces: int = MOST_PIECES):
        self.tokenizer = load_tokenizer(text)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Memo(most_pieces)
        one, two = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("Ab1", "c.d"))
        self.by_word = all(
            self.tokenizer.encode(f"{gap}Ab1{gap}c.d{gap}", add_special_tokens=False).ids == one + two
            for gap in (" ", "\n", " \t\r\n ", " ", " ")
        )
        self.find = self._pre_tokens(json.loads(text)) if self.by_word else None
        if self.find:
            from tokenizers import Tokenizer

            self.bare = Tokenizer(self.tokenizer.model)
            # the line feed parts words here and is in none of them
            self.letters = str.maketrans(byte_letters() | {0x0A: "\n"})

    @staticmethod
    def _pre_tokens(spec: dict):
        """The finder of pre-tokens in a lower-cased plain word, if the file has these steps."""
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split, level = ((spec.get("pre_tokenizer") or {}).get("pretokenizers", []) + [{}, {}])[:2]
        fits = (
            steps == ["NFC", "Replace", "Lowercase"]
            and split.get("type") == "Split"
            and (split.get("behavior"), split.get("invert")) == ("Removed", True)
            and "Regex" in split.get("pattern", {})
            and level.get("type") == "ByteLevel"
            and not level.get("add_prefix_space")
            and not level.get("use_regex", True)
        )
        return regex.compile(split["pattern"]["Regex"]).findall if fits else None

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    @staticmethod
    def _each(tokenizer, words: list[str]) -> Iterator[bytes]:
        """The ids of each word by itself."""
        for i in range(0, len(words), 500):
            part = words[i : i + 500]
            found = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            raw = np.array(found.ids, dtype="<u4").tobytes()
            ends = (np.searchsorted(np.array(found.word_ids, dtype=np.int64), np.arange(len(part) + 1)) * 4).tolist()
            yield from (raw[a:b] for a, b in zip(ends, ends[1:], strict=False))

    def _know(self, names: list[str], tokenizer, spell) -> None:
        """Have the ids of all these names in the memo."""
        pieces = self.pieces
        unknown = [t for t in names if t not in pieces]
        if len(pieces) + len(unknown) > pieces.most:
            pieces.clear()
            unknown = names
        if unknown:
            pieces.update(zip(unknown, self._each(tokenizer, spell(unknown)), strict=True))

    def _spell(self, names: list[str]) -> list[str]:
        return "\n".join(names).encode().decode("latin-1").translate(self.letters).split("\n")

    def _lookup(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, in order."""
        if not words:
            return []
        if not self.find:
            self._know([w for w in words if w], self.tokenizer, list)
            return [self.pieces[w] if w else b"" for w in words]
        odd: dict[str, bytes] = {}
        if not _PLAIN.fullmatch("".join(words)):
            strange = [w for w in words if w and not _PLAIN.fullmatch(w)]
            odd = dict(zip(strange, self._each(self.tokenizer, strange), strict=True))
        lower = "\n".join(words).lower().split("\n") if not odd else [w.lower() if w not in odd else "" for w in words]
        pieces = self.pieces
        out = list(map(pieces.get, lower))  # a word that is one known pre-token
        rest = [i for i, x in enumerate(out) if x is None]
        split = [self._split(lower[i]) for i in rest]
        names = {t for ts in split for t in ts}
        self._know(list(names), self.bare, self._spell)
        for i, ts in zip(rest, split, strict=True):
            out[i] = pieces[ts[0]] if len(ts) == 1 else b"".join([pieces[t] for t in ts])
        return [odd.get(w, x) for w, x in zip(words, out, strict=True)] if odd else out

    def _split(self, word: str):
        """Pre-tokens of a lower-cased plain word; letters alone are one."""
        if word.isalpha():
            return (word,)
        if word[-1:] in (",", ".") and word[:-1].isalpha():
            return word[:-1], word[-1]
        return self.find(word)

    def _round(self, texts: pa.Array) -> Iterator[np.ndarray]:
        lists = pc.utf8_split_whitespace(texts)
        bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        flat = lists.flatten().dictionary_encode()
        del lists
        at, words = flat.indices.to_numpy(), flat.dictionary
        found, lengths = [], [np.empty(0, np.int32)]
        for i in range(0, len(words), LOOKUP_WORDS):
            parts = self._lookup(words.slice(i, LOOKUP_WORDS).to_pylist())
            lengths.append(np.fromiter(map(len, parts), np.int32, len(parts)))
            found.append(b"".join(parts))
        sizes = np.concatenate(lengths) // 4
        ids = np.frombuffer(b"".join(found), "<u4")
        firsts = np.cumsum(sizes, dtype=np.int64) - sizes
        # the words' ids are put together for few texts at a time
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + GATHER_WORDS, "right")) - 1)
            own = at[bounds[a] : bounds[b]]
            n = sizes[own]
            ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            whole = ids[np.repeat(firsts[own] - ends[:-1], n) + np.arange(ends[-1])]
            cuts = ends[bounds[a : b + 1] - bounds[a]].tolist()
            for x, y in zip(cuts, cuts[1:], strict=False):
                yield whole[x:y]
            a = b

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, nulls as empty, in order."""
        if not self.by_word:
            yield from (self.whole(t or "") for t in texts.to_pylist())
            return
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + ROUND_BYTES, "right")) - 1)
            part = pc.fill_null(texts.slice(a, b - a).cast(pa.large_string()), "")
            strange = pc.match_substring_regex(part, _ODD)
            for s in self.added:
                strange = pc.or_(strange, pc.match_substring(part, s))
            odd = {i: self.whole(part[i].as_py()) for i in np.flatnonzero(strange.to_numpy(zero_copy_only=False)).tolist()}
            if odd:
                part = pc.if_else(strange, "", part)
            for i, ids in enumerate(self._round(part)):
                yield odd.get(i, ids)
            a = b


_encoders: dict[tuple[int, int], Encoder] = {}


def encoder(shared: Broadcast, most_pieces: int = MOST_PIECES) -> Encoder:
    """This worker's encoder; it lives as long as the worker does."""
    key = hash(shared.value), most_pieces
    if key not in _encoders:
        _encoders.clear()
        forget_words()  # a worker that sketched before needs its memory for the encoder now
        release_memory()
        _encoders[key] = Encoder(shared.value, most_pieces)
    return _encoders[key]


def forget_encoders() -> None:
    """Free this worker's encoders; a later task loads them again."""
    _encoders.clear()
    release_memory()
