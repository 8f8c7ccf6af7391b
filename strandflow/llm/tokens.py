"""Token ids of whole texts, with the encodings of repeated words kept.

A byte-level vocabulary whose words start at a single space or newline encodes
a word the same way wherever it stands, so each task encodes a word once and
looks it up afterwards. Texts with any other white space (doubled, at an end,
tabs), and those that spell one of the vocabulary's special tokens, go to the
tokenizer whole; long ones in pieces cut where a single space stands between two
other characters, a place no token crosses.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain, count

import numpy as np

#: Words kept before the rare ones are given up (some 300 bytes each).
KEPT_WORDS = 400_000
#: Characters handed to the tokenizer at once.
PIECE = 100_000
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Latin letters, then ASCII punctuation: two pieces that are encoded apart.
LETTERS = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]*)")


def byte_chars() -> np.ndarray:
    """The characters that stand for bytes in byte-level vocabularies, as code points."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    out = np.arange(256, dtype="<u4")
    out[hidden] = 256 + np.arange(len(hidden))
    return out


BYTE_CHARS = byte_chars()


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare file name is one of the public vocabulary files."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(name: str) -> "Encoder":
    return Encoder(tokenizer_path(name))


class Numbers(dict):
    """Numbers its keys in the order of first use."""

    def __init__(self, keys: Iterable[str] = ()) -> None:
        super().__init__(zip(keys, count()))
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n

    def taken(self) -> list[str]:
        new, self.new = self.new, []
        return new


class Ragged:
    """Id lists of different lengths in one array; a size of -1 marks a list that is not known."""

    def __init__(self) -> None:
        self.pool = np.zeros(0, dtype=np.uint32)
        self.first = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)

    def extend(self, ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        self.first = np.concatenate([self.first, first + len(self.pool)])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, ids])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[at]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.pool[np.repeat(self.first[at] - (end - size), size) + np.arange(total)], size

    def take_known(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same where some sizes are -1: those have no ids."""
        size = self.size[at]
        return self.take(at[size > 0])[0], size


class Known:
    """Keys, their id lists, and how often each was asked for."""

    def __init__(self) -> None:
        self.number, self.ids, self.uses = Numbers(), Ragged(), np.zeros(0, dtype=np.int64)

    def used(self, at: np.ndarray) -> None:
        times = np.bincount(at, minlength=len(self.number))
        times[: len(self.uses)] += self.uses
        self.uses = times

    def thin(self, most: int, always: int = 0) -> None:
        """Give up what was used once, and the less used beyond ``most``; the first ``always`` stay."""
        uses = np.concatenate([self.uses, np.zeros(len(self.number) - len(self.uses), dtype=np.int64)])
        uses[:always] = 1 << 40
        stay = np.flatnonzero(uses > 1)
        if len(stay) > most:
            stay = np.sort(stay[np.argsort(-uses[stay], kind="stable")[:most]])
        keys = np.array(list(self.number), dtype=object)[stay]
        ids, size = self.ids.take_known(stay)
        self.number, self.ids, self.uses = Numbers(keys.tolist()), Ragged(), uses[stay] // 2
        self.ids.extend(ids, np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), size)


class Encoder:
    """Ids of texts, as the tokenizer at ``path`` gives them without special tokens."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        #: Spellings that the tokenizer takes out of a text before anything else.
        self.special = [t["content"] for t in added]
        newline = self.tok.encode("\n", add_special_tokens=False).ids
        self.by_word = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not spec.get("normalizer")
            and spec["model"]["type"] == "BPE"
            and len(newline) == 1
            # They lie within a word, and take no white space beside them.
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or not t["content"] or t["content"].split() != [t["content"]] for t in added)
        )
        self.newline = newline[0] if newline else -1
        # The merges alone, for runs of letters: nothing in them is left to split.
        self.merges = Tokenizer(self.tok.model)
        self.merges.pre_tokenizer = pre_tokenizers.Split(chr(int(BYTE_CHARS[10])), "isolated")
        self.kept = kept

        # Piece 0 is empty, piece 1 the newline.
        self.words, self.pieces = Known(), Known()
        self.pieces.number = Numbers(["", "\n"])
        self.pieces.ids.extend(np.array([max(0, self.newline)], dtype=np.uint32), np.zeros(2, dtype=np.int64), np.array([0, 1]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        if not self.by_word:
            return join([self.whole(t) for t in texts])
        for known, always in ((self.words, 0), (self.pieces, 2)):
            if len(known.number) > self.kept:
                known.thin(self.kept // 2, always)
        # A word at the start of a line keeps its newline; so does the first of a text, for now.
        split = [("\n" + t).replace("\n", " \n").split(" ")[1:] for t in texts]
        counts = np.array([len(w) for w in split], dtype=np.int64)
        at = np.fromiter(map(self.words.number.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(counts.sum()))
        self.learn(self.words.number.taken())
        self.words.used(at)
        start = np.cumsum(counts) - counts
        known = np.minimum.reduceat(self.words.ids.size[at], start) >= 0 if len(texts) else np.zeros(0, dtype=bool)
        ids, size = self.words.ids.take(at if known.all() else at[np.repeat(known, counts)])
        n = np.add.reduceat(size, np.cumsum(counts[known]) - counts[known]) if known.any() else np.zeros(0, dtype=np.int64)
        ids = np.delete(ids, np.cumsum(n) - n)  # the newline put before the first word
        if known.all():
            return ids, n - 1
        good = iter(np.split(ids, np.cumsum(n - 1)[:-1]))
        return join([next(good) if k else self.whole(t) for k, t in zip(known, texts)])

    def learn(self, new: list[str]) -> None:
        """The ids of new words: those of a run of letters and of a tail, or of one odd piece."""
        if not new:
            return
        parts = np.zeros((len(new), 3), dtype=np.int64)
        bad = np.zeros(len(new), dtype=bool)
        number, letters = self.pieces.number.__getitem__, []
        for i, w in enumerate(new):
            if w[:1] == "\n":
                parts[i, 0], body, space = 1, w[1:], ""
            else:
                body, space = w, " "
            if any(x in w for x in self.special):
                bad[i] = True
            elif m := LETTERS.fullmatch(body):
                parts[i, 1] = number(space + m[1])
                letters.append(parts[i, 1])
                if m[2]:
                    parts[i, 2] = number(m[2])
            elif body.split() == [body]:
                parts[i, 1] = number(space + body)
            else:  # white space next to white space, or other than a space or newline
                bad[i] = True
        self.learn_pieces(self.pieces.number.taken(), np.array(letters, dtype=np.int64))
        self.pieces.used(parts.ravel())
        ids, size = self.pieces.ids.take(parts.ravel())
        size = size.reshape(-1, 3).sum(axis=1)
        self.words.ids.extend(ids, np.cumsum(size) - size, np.where(bad, -1, size))

    def learn_pieces(self, new: list[str], runs: np.ndarray) -> None:
        """Encode many pieces in one line, a newline between any two, and cut the ids there.

        ``runs`` numbers the pieces that are runs of letters; some are old.
        """
        runs = runs - len(self.pieces.ids.size)
        letters = np.zeros(len(new), dtype=bool)
        letters[runs[runs >= 0]] = True
        for tok, chosen in ((self.merges, np.flatnonzero(letters)), (self.tok, np.flatnonzero(~letters))):
            lines = []
            texts = [new[i] for i in chosen.tolist()]
            for a in range(0, len(texts), 256):
                line = "\n".join(texts[a : a + 256])
                if tok is self.merges:
                    line = BYTE_CHARS[np.frombuffer(line.encode(), dtype=np.uint8)].tobytes().decode("utf-32-le")
                lines.append(line)
            got = [np.array(e.ids, dtype=np.uint32) for e in tok.encode_batch_fast(lines, add_special_tokens=False)]
            if tok is self.merges:
                letter_ids = self.cut(got, len(chosen))
            else:
                other_ids = self.cut(got, len(chosen))
        order = np.argsort(np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)]), kind="stable")
        both = Ragged()
        both.extend(*letter_ids)
        both.extend(*other_ids)
        ids, size = both.take(order)
        self.pieces.ids.extend(ids, np.cumsum(size) - size, size)

    def cut(self, got: list[np.ndarray], count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edge = np.array([self.newline], dtype=np.uint32)
        ids = np.concatenate([edge, *(x for g in got for x in (g, edge))])
        cuts = np.flatnonzero(ids == self.newline)
        if len(cuts) != count + 1:
            raise RuntimeError("the vocabulary joins newlines to words")
        return ids, cuts[:-1] + 1, np.diff(cuts) - 1

    def whole(self, text: str) -> np.ndarray:
        if len(text) <= PIECE or not self.by_word:
            parts = [text]
        else:
            parts, start = [], 0
            while len(text) - start > PIECE:
                cut = SAFE_CUT.search(text, start + PIECE)
                if not cut:
                    break
                parts.append(text[start : cut.start()])
                start = cut.start()
            parts.append(text[start:])
        return np.concatenate(
            [np.array(self.tok.encode_batch_fast([p], add_special_tokens=False)[0].ids, dtype=np.uint32) for p in parts]
        )


def join(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
    return flat.astype(np.uint32, copy=False), counts


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end`` after each text; the second result holds the start of each text and the total."""
    return np.insert(ids, np.cumsum(counts), end).astype("<u4"), np.concatenate([[0], np.cumsum(counts + 1)])
