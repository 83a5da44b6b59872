"""Whole-text encoding by the merge loop of the tiktoken library.

A tokenizers file of plain byte-pair merges is a rank file written differently:
its ids follow its merges, so they serve as ranks of byte strings. What differs
is how a text is cut into pre-tokens, and that is kept exactly:

* *Byte-level files.* The pattern's look-ahead only matters where two white
  characters follow each other; a text without takes the same pattern without it,
  which the regex library matches several times faster.
* *Files with word ends.* The pre-tokens of a text, lower-cased, are joined by
  spaces; white space is dropped by the file's pre-tokeniser, so the space is free to
  stand for the word end, and a pre-token with its space is one piece. Runs of
  white-space-separated words with characters whose normal form, lower case or
  class is not plain go through the tokenizers library itself; white space always
  cuts, so the ids of the runs, concatenated, are those of the text.

A special token written out in a text gets its id, as in a plain call of the
library; the texts around it are encoded by themselves.
"""

from __future__ import annotations

import base64
import functools
import itertools
import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

#: The characters of Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_TWO_WHITE = re.compile(f"[{WHITE}]{{2}}")
_WORDS = re.compile(f"[^{WHITE}]+")
#: Letters and numbers of plain texts in lower case.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af\u2c65\u2c66"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Characters in normal form that lose nothing but case in lower case and have had
#: their class since early versions of Unicode; and texts of them and white space.
#: U+0130 is left out: its lower case is two characters.
_PLAIN = "\x21-\x7e\xa1-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e"
_PLAIN_WORD = re.compile(f"[{_PLAIN}]+")
_PLAIN_TEXT = re.compile(f"[{_PLAIN}{WHITE}]*")
#: The two files' patterns. The first as the library's ByteLevel
#: pre-tokeniser has it, less the look-ahead of its last part but one; the second
#: with the classes above, which hold for plain texts.
_BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE_PATTERN_SINGLE_WHITE = _BYTE_PATTERN.replace(r"|\s+(?!\S)", "")
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN_WORD_PATTERN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{WHITE}{_LETTERS}{_NUMBERS}]+")


class TextEncoder:
    """``ids(texts)``: per text its token ids as little-endian unsigned 32-bit
    bytes. ``encode`` gives the ids of a text without special tokens; ``special``
    are their literals and ids."""

    def __init__(self, encode: Callable[[str], bytes], special: dict[str, int]):
        self._encode = encode
        self._special = {s: _id_bytes([i]) for s, i in special.items()}
        longest = sorted(special, key=len, reverse=True)
        self._apart = re.compile(f"({'|'.join(map(re.escape, longest))})").split

    def text_ids(self, text: str) -> bytes:
        if not any(s in text for s in self._special):
            return self._encode(text)
        parts = self._apart(text)
        return b"".join(self._special[p] if i % 2 else self._encode(p) for i, p in enumerate(parts))

    def ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        return (self.text_ids(text or "") for text in texts)


def _id_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


@functools.cache
def _tokenizer(path: str):
    """The library's tokenizer, loaded by a worker that needs it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _special(path: str) -> dict[str, int]:
    """The literals that the library takes out of a text before anything else."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t[k] for t in tokens for k in ("normalized", "lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that depend on the text around them")
    return {t["content"]: t["id"] for t in tokens}


def _byte_symbols() -> dict[str, int]:
    """The characters that byte-level files write for bytes: printable Latin-1
    ones stand for themselves, the code points from 256 on for the others."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(c): b for c, b in [*((b, b) for b in plain), *((256 + i, b) for i, b in enumerate(others))]}


def _ranks(path: str, pattern: str, word_end: str | None, end_byte: bytes = b"") -> dict[bytes, int]:
    """Byte strings by id, checked: the file's pattern and plain merges, ids that
    follow the merges after the single symbols. ``end_byte`` stands for the word end."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec["pre_tokenizer"]
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        raise ValueError("not a file of plain merges")
    if word_end is None:
        given = spec["normalizer"] is None and cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
    else:
        given = cut["pretokenizers"][0]["pattern"]["Regex"] == pattern and cut["pretokenizers"][0]["invert"]
    if not given or model.get("end_of_word_suffix") != word_end:
        raise ValueError("the file cuts texts in another way")
    special = {t["content"] for t in spec["added_tokens"]}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    joined = [a + b for a, b in merges]
    if [vocab[t] for t in joined] != list(range(len(vocab) - len(joined), len(vocab))):
        raise ValueError("the ids do not follow the merges")
    symbols = _byte_symbols()

    def raw(token: str) -> bytes:
        if word_end and token.endswith(word_end):
            return bytes(symbols[c] for c in token.removesuffix(word_end)) + end_byte
        return bytes(symbols[c] for c in token)

    ranks = {raw(t): i for t, i in vocab.items()}
    if len(ranks) != len(vocab):
        raise ValueError("two tokens of the same bytes")
    return ranks


@functools.cache
def byte_level_encoder(path: str) -> TextEncoder:
    """For a byte-level BPE file of the tokenizers library without prefix space."""
    import tiktoken

    ranks = _ranks(path, _BYTE_PATTERN, None)
    single, full = (
        tiktoken.Encoding("bytes", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for p in (_BYTE_PATTERN_SINGLE_WHITE, _BYTE_PATTERN))
    return TextEncoder(lambda text: _id_bytes((full if _TWO_WHITE.search(text) else single)(text)), _special(path))


@functools.cache
def word_end_encoder(path: str) -> TextEncoder:
    """For a BPE file with word ends whose pre-tokenisation drops white space."""
    import tiktoken

    ranks = _ranks(path, _WORD_PATTERN, "</w>", b" ")
    pieces = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def plain(text: str) -> bytes:
        words = _PLAIN_WORD_PATTERN.findall(text.lower())
        return _id_bytes(pieces(" ".join(words) + " ")) if words else b""

    def encode(text: str) -> bytes:
        if _PLAIN_TEXT.fullmatch(text):
            return plain(text)
        out = []
        for is_plain, run in itertools.groupby(_WORDS.findall(text), lambda w: bool(_PLAIN_WORD.fullmatch(w))):
            run = " ".join(run)
            out.append(plain(run) if is_plain else _id_bytes(_tokenizer(path).encode(run, add_special_tokens=False).ids))
        return b"".join(out)

    return TextEncoder(encode, _special(path))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.cache
def rank_encoder(path: str, pattern: str) -> Callable[[str], bytes]:
    """For a rank file of the tiktoken library: text -> ids as bytes. Its own
    pre-tokeniser and merges are fast enough for whole texts."""
    import tiktoken

    e = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return lambda text: e.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@functools.cache
def rank_tokens(path: str) -> list[bytes]:
    """Bytes of every token, by id."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out
