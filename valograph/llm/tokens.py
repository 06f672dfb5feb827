"""Token ids by the tokenizers library, with each distinct chunk of text encoded once per Python worker."""

from __future__ import annotations

import re

import numpy as np

#: Chunks a worker remembers between tasks; when full it starts anew. Bounds memory, has no effect on results.
REMEMBERED = 900_000


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes whole texts as little-endian unsigned 32-bit ids.

    The tokenizers split a text at white space before they merge, so the chunks between are encoded on their own and
    their ids put together again; this equals encoding the whole text. ``spaced`` tells that a word keeps the one space
    before it (byte-level vocabularies); otherwise white space is dropped and letters are lower-cased by the tokenizer.
    With ``special``, strings of special tokens in a text get those tokens' ids, as by the library's default; they are
    split off first, since the library encodes what stands between them on its own. Otherwise they are ordinary text.
    """

    def __init__(self, path: str, spaced: bool, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.spaced = spaced
        own = {t.content: (i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special} if special else {}
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for _, t in own.values()):
            raise ValueError("special tokens that depend on the text around them cannot be split off")
        self.ids = {(name,): np.array([i], "<u4").tobytes() for name, (i, _) in own.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(own, key=len, reverse=True))) + ")") if own else None
        self.known: dict = dict(self.ids)

    def chunks(self, text: str) -> list:
        if self.marks is None or not self.marks.search(text):
            return self.plain_chunks(text)
        out = []
        for k, part in enumerate(self.marks.split(text)):
            if k % 2:
                out.append((part,))
            elif part:
                out += self.plain_chunks(part)
        return out

    def plain_chunks(self, text: str) -> list:
        if not self.spaced:
            data = text.encode("utf-8", "replace")
            if b"\xcc" in data or b"\xcd" in data:  # combining marks: some compose with a small letter only, and composing comes first
                return [c.lower() if c.isascii() else c for c in data.split()]
            return data.lower().split()  # bytes.lower() changes A-Z only
        parts = text.split(" ")
        out, open_ = [parts[0]], not parts[0] or parts[0][-1].isspace()
        for part in parts[1:]:
            if open_:  # inside a longer run of white space, which must stay whole
                out[-1] += " " + part
            else:
                out.append(" " + part)
            open_ = not part or part[-1].isspace()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.chunks(t) if t else [] for t in texts]
        known = self.known
        new = list({c for chunks in split for c in chunks if c not in known})
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                known.update(self.ids)
                new = list({c for chunks in split for c in chunks if c not in known})
            for i in range(0, len(new), 50_000):
                some = new[i : i + 50_000]
                plain = some if self.spaced else [c.decode("utf-8", "replace") for c in some]
                for c, e in zip(some, self.tokenizer.encode_batch_fast(plain, add_special_tokens=False), strict=True):
                    known[c] = np.array(e.ids, "<u4").tobytes()
        look = known.__getitem__
        return [b"".join(map(look, chunks)) for chunks in split]


_ENCODERS: dict[tuple[str, bool, bool], Encoder] = {}


def encoder(path: str, spaced: bool, special: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file, kept from task to task."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core per task
    if (path, spaced, special) not in _ENCODERS:
        _ENCODERS[path, spaced, special] = Encoder(path, spaced, special)
    return _ENCODERS[path, spaced, special]
