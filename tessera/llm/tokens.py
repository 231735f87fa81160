"""Exact, cached encoding with a tokenizer whose pretokens never cross white space.

The vocabulary drops white space, so a text's ids are the ids of its chunks between
ASCII white space put end to end; each worker encodes a chunk it has not seen lately once.
"""

from __future__ import annotations

import itertools
import os
from functools import lru_cache

import numpy as np

from .common import LEAVING

#: Chunks in each of the two generations that a worker remembers while it has a partition (some 25 MB each), and the longest one it does.
CACHE, CACHE_BYTES = 150_000, 40
#: Chunks that it remembers between partitions (some 6 MB).
KEPT = 40_000
#: Stands between chunks that are encoded together; a chunk that holds it is encoded alone.
MARK = "‖"
MARK_BYTES = MARK.encode()
TOGETHER = 200


class ChunkEncoder:
    """``encode(texts)``: for each UTF-8 text its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # a text that holds a special token, in any case, is encoded whole by the library
        self.special = [t.content.encode().lower() for t in self.tok.get_added_tokens_decoder().values()]
        self.mark = np.array(self.ids(MARK), "<u4")
        self.stops = {s: np.array(self.ids(s), "<u4").tobytes() for s in ".,"}
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def fresh(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, none of which holds the mark, encoded many at a time."""
        parts = [f" {MARK} ".join(chunks[k : k + TOGETHER]) for k in range(0, len(chunks), TOGETHER)]
        found = [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]
        ids = np.concatenate([x for one in found for x in (one, self.mark)][:-1])
        n, hit = len(self.mark), np.ones(max(0, len(ids) - len(self.mark) + 1), bool)
        for k in range(n):
            hit &= ids[k : len(ids) - n + 1 + k] == self.mark[k]
        at = np.flatnonzero(hit)
        raw, start, stop = ids.tobytes(), [0, *(4 * (at + n)).tolist()], [*(4 * at).tolist(), 4 * len(ids)]
        if len(start) != len(chunks):
            raise ValueError("chunks and their ids don't match")
        return [raw[a:b] for a, b in zip(start, stop, strict=True)]

    def learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        """Puts unseen chunks into the cache; those too long to keep are returned."""
        ends: list[tuple[bytes, bytes, str]] = []
        todo: set[bytes] = set()
        for c in new:
            if (known := self.before.get(c)) is not None:
                self.now[c] = known
                continue
            last = c[-1:]
            # a full stop or comma after letters is a pretoken of its own
            if last in (b".", b",") and c[:-1].decode().isalpha():
                ends.append((c, c[:-1], last.decode()))
                if c[:-1] not in self.now:
                    if (known := self.before.get(c[:-1])) is not None:
                        self.now[c[:-1]] = known
                    else:
                        todo.add(c[:-1])
            else:
                todo.add(c)
        long: dict[bytes, bytes] = {}
        plain = [c for c in todo if MARK_BYTES not in c]
        for c, ids in zip(plain, self.fresh([c.decode() for c in plain]) if plain else (), strict=True):
            (self.now if len(c) <= CACHE_BYTES else long)[c] = ids
        for c in todo.difference(plain):
            long[c] = np.array(self.ids(c.decode()), "<u4").tobytes()
        for c, core, stop in ends:
            (self.now if len(c) <= CACHE_BYTES else long)[c] = (long.get(core) or self.now[core]) + self.stops[stop]
        return long

    def forget(self) -> None:
        """Keeps the chunks that came first, which the frequent ones are among, for the worker's next partition."""
        self.now, self.before = dict(itertools.islice(self.now.items(), KEPT)), {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        odd = [any(s in low for s in self.special) for low in map(bytes.lower, texts)]
        if any(odd):
            plain = iter(self.encode([t for t, o in zip(texts, odd, strict=True) if not o]))
            return [np.array(self.ids(t.decode()), "<u4").tobytes() if o else next(plain) for t, o in zip(texts, odd, strict=True)]
        if len(self.now) > CACHE:
            self.before, self.now = self.now, {}
        # without combining marks (U+0300 to U+036F) lower-casing A-Z first changes no id, and chunks recur more
        chunks = [(t if b"\xcc" in t or b"\xcd" in t else t.lower()).split() for t in texts]
        long = self.learn(set().union(*chunks).difference(self.now))
        self.now.update(long)
        out = [b"".join(map(self.now.__getitem__, one)) for one in chunks]
        for c in long:
            del self.now[c]
        return out


@lru_cache(1)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for a worker, which forgets its chunks after each partition. A bare file name is looked up among the installed public tokenizers."""
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    out = ChunkEncoder(path)
    LEAVING.append(out.forget)
    return out
