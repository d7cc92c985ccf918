"""Ids and counts of byte-level BPE vocabularies, word by word with memos."""

from __future__ import annotations

import json
import os
import re
from functools import cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

#: Where a text can't be cut before a space: the space is followed by white space or the end.
_LOOSE = re.compile(r" (?=\s|\Z)")
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBPE:
    """Encodes as the library does for a .json vocabulary, without added tokens.

    Texts are cut before each single space, where the library's own pattern cuts too; each distinct
    run is encoded once and remembered up to a bound. Texts with loose spaces or with a special
    string in them go to the library whole.
    """

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.plain = (
            spec.get("normalizer") is None and spec.get("truncation") is None and spec.get("padding") is None
            and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.model, self.most, self.letters = self.library.model, most, byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(1 + max(self.library.get_vocab().values()))]
        self.ids_of: dict[str, bytes] = {}
        self.count_of: dict[str, int] = {}
        self._alone: frozenset | None = None

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def cuttable(self, text: str) -> bool:
        return self.plain and not any(s in text for s in self.special) and not _LOOSE.search(text)

    def merged(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        if word.isascii() and word[1:].isalpha():
            written = "\u0120" + word[1:] if word[0] == " " else word
        else:
            written = word.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(written)]

    def assume(self, alone: frozenset) -> ByteBPE:
        """Takes what alone() has proved elsewhere for the same vocabulary."""
        self._alone = alone
        return self

    def alone(self) -> frozenset:
        """The pre-tokens that encode alone as one token, proved by encoding every vocabulary string.

        The pre-tokenizer must leave the string whole, and the merges must end in its own id.
        """
        if self._alone is None:
            back = {c: b for b, c in self.letters.items()}
            proved = []
            for token, i in self.library.get_vocab(with_added_tokens=False).items():
                try:
                    text = bytes(back[c] for c in token).decode("utf-8")
                except (KeyError, UnicodeDecodeError):
                    continue
                if len(self.library.pre_tokenizer.pre_tokenize_str(text)) == 1 and self.merged(text) == [i]:
                    proved.append(text)
            self._alone = frozenset(proved)
        return self._alone

    def pretokens(self, run: str) -> list[str]:
        """The pattern's pieces of one run, which has a space at most in front."""
        word = run[1:] if run[:1] == " " else run
        if word.isalpha():
            return [run]
        bare = word.rstrip(_MARKS)
        if bare.isalpha():  # marks that follow a word are one piece
            cut = len(run) - len(word) + len(bare)
            return [run[:cut], run[cut:]]
        return [run[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(run)]

    def _ids(self, run: str) -> bytes:
        got = self.ids_of.get(run)
        if got is None:
            pieces, packed, known = self.pretokens(run) if run else [], self.packed, self.ids_of
            parts = []
            for p in pieces:
                one = known.get(p)
                if one is None:
                    one = b"".join([packed[i] for i in self.merged(p)])
                    if len(known) < self.most:
                        known[p] = one
                parts.append(one)
            got = b"".join(parts)
            if len(pieces) > 1 and len(known) < self.most:
                known[run] = got
        return got

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if not self.cuttable(text):
            return self._pack(self.whole(text))
        runs = text.split(" ")
        first, runs = runs[0], [" " + r for r in runs[1:]]
        get, own = self.ids_of.get, self._ids
        return b"".join([own(first), *[get(r) or own(r) for r in runs]])

    def _count(self, run: str) -> int:
        got = self.count_of.get(run)
        if got is None:
            pieces, alone, known, got = self.pretokens(run) if run else [], self.alone(), self.count_of, 0
            for p in pieces:
                one = 1 if p in alone else known.get(p)
                if one is None:
                    one = len(self.merged(p))
                    if len(known) < self.most:
                        known[p] = one
                got += one
            if len(known) < self.most:
                known[run] = got
        return got

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuttable(text):
            return len(self.whole(text))
        runs = text.split(" ")
        get, own = self.count_of.get, self._count
        return own(runs[0]) + sum([get(r) or own(r) for r in [" " + r for r in runs[1:]]])


@cache
def byte_bpe(path: str) -> ByteBPE:
    """One for each worker process, so that its memos serve all its tasks."""
    return ByteBPE(path)


@cache
def sentence_pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)
