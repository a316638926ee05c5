"""Encoding texts word by word through the tokenizers library, each distinct word once.

Where no token reaches across a single space or a single newline, a text's ids are those
of its words one after another. A worker sends only words that it has not met to the
library, many of them in one string with newlines between, and joins the stored ids.
Texts with other white space, or with two white spaces side by side, go to the library whole.

The store is bounded: it has two generations of ``limit`` words at most; a full one
replaces the older, from which words still in use are taken over.
"""

from __future__ import annotations

from collections.abc import Callable

#: Unicode's White_Space property without the space and the newline.
OTHER_ASCII_SPACE = "\t\x0b\x0c\r"
OTHER_SPACE = "\x85\xa0                　"


def simple_spacing(text: str) -> bool:
    """Whether the only white space is single spaces and single newlines between other characters."""
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in OTHER_ASCII_SPACE) and (text.isascii() or not any(c in text for c in OTHER_SPACE))


class Store:
    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int):
        self.encode, self.limit = encode, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        new = []
        for w in set(words):
            found = self.old.get(w)
            if found is None:
                new.append(w)
            else:
                self.young[w] = found
        if new:
            self.young.update(zip(new, self.encode(new), strict=True))

    def turn(self) -> None:
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}


class WordEncoder:
    """``first``, ``later``: ids of words at the start of a line and of words after a space. ``whole``: ids of any text."""

    def __init__(self, first: Callable[[list[str]], list[bytes]], later: Callable[[list[str]], list[bytes]], whole: Callable[[list[str]], list[bytes]], newline: bytes, simple: Callable[[str], bool] = simple_spacing, opening: Callable[[list[str]], list[bytes]] | None = None, limit: int = 250_000):
        self.first, self.later, self.whole, self.newline, self.simple = Store(first, limit), Store(later, limit), whole, newline, simple
        self.opening = Store(opening, limit) if opening else self.first

    def encode(self, texts: list[str], step: int = 256) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), step):
            out += self._encode(texts[at : at + step])
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        stores = self.opening, self.first, self.later
        for store in {id(s): s for s in stores}.values():
            store.turn()
        new: list[list[str]] = [[], [], []]
        newline, odd, parsed = self.newline, [], []
        for t in texts:
            if not t or not self.simple(t):
                odd += [t] if t else []
                parsed.append((None, t))
                continue
            parts, gaps = [], []
            for k, line in enumerate(t.split("\n")):
                words = line.split(" ")
                at, kind = len(parts) + (k > 0), min(k, 1)
                if k:
                    parts.append(newline)
                parts.append(stores[kind].young.get(words[0]))
                parts += map(self.later.young.get, words[1:])
                if None in parts[at:]:
                    missing = [i for i, x in enumerate(parts[at:]) if x is None]
                    for i in missing:
                        gaps.append((at + i, words[i], which := 2 if i else kind))
                        new[which].append(words[i])
            parsed.append((parts, gaps))
        for store, found in zip(stores, new, strict=True):
            store.learn(found)
        whole, out = iter(self.whole(odd) if odd else []), []
        for parts, gaps in parsed:
            if parts is None:
                out.append(next(whole) if gaps else b"")
                continue
            for i, word, which in gaps:
                parts[i] = stores[which].young[word]
            out.append(b"".join(parts))
        return out


def split_at(ids: list[int], mark: int, kind: str) -> list[bytes]:
    """The ids between the marks, as bytes."""
    import numpy as np

    a = np.array(ids, kind)
    data, size, ends = a.tobytes(), a.itemsize, (a == mark).nonzero()[0].tolist()
    return [data[(i + 1) * size : j * size] for i, j in zip([-1, *ends], [*ends, len(ids)], strict=True)]
