"""Token ids by the tokenizers library, a white-space chunk at a time.

Both vocabularies split text at spaces before they merge, so a chunk between two spaces has the same
ids wherever it stands. Each worker keeps the ids of chunks and pieces it has met, as little-endian
unsigned 32-bit bytes, and joins them; anything unusual goes to the library's own encode, so do texts
that spell a special token, which get its id as from the library. Where a
byte-level vocabulary's ids are its merge ranks, tiktoken merges the chunks not yet met, from the
same file: the ids are the same (tests compare them with the library's), in a third of the time.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

KEEP = 300_000
#: The two vocabularies' piece patterns.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNSPACED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below this code point no character changes under NFC and the libraries' letter classes agree.
PLAIN = "ɐ"
#: Fixed value: a byte that no UTF-8 has.
END = b"\xff"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """ids(text): the ids as bytes, 4 for each; none are added before or after."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = sorted({x.content for x in self.whole.get_added_tokens_decoder().values()}, key=len, reverse=True)
        self.marked = regex.compile("|".join(map(regex.escape, added)), regex.I).search if added else lambda text: None
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        before, changes = kind.get("pre_tokenizer") or {}, kind.get("normalizer")
        self.spaced = changes is None and before.get("type") == "ByteLevel" and before.get("use_regex") is True and not before.get("add_prefix_space")
        steps = before.get("pretokenizers") or [{}]
        self.unspaced = [x.get("type") for x in (changes or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and steps[0].get("pattern", {}).get("Regex") == UNSPACED
        self.letters, self.merge = _byte_letters(), self.whole.model.tokenize
        self.find = regex.compile(SPACED if self.spaced else UNSPACED).findall
        self.ranked = self._ranked(kind["model"]) if self.spaced else None
        self.ended = self._ended(kind["model"]) if self.unspaced else None
        self.chunks, self.firsts, self.pieces = {}, {}, {}

    def _ranked(self, model: dict):
        import tiktoken

        back = {letter: byte for byte, letter in self.letters.items()}
        ranks = {bytes(map(back.get, token)): i for token, i in model["vocab"].items() if not set(token) - set(back)}
        merges = (x if isinstance(x, list) else x.split(" ") for x in model["merges"])
        order = [model["vocab"]["".join(pair)] for pair in merges]
        marked = model.get("end_of_word_suffix") or model.get("continuing_subword_prefix")
        if marked or order != list(range(256, 256 + len(order))) or {len(b) for b, i in ranks.items() if i < 256} != {1}:
            return None
        ranks = {token: i for token, i in ranks.items() if i < 256 + len(order)}
        return tiktoken.Encoding("file", pat_str=SPACED, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _ended(self, model: dict):
        """tiktoken's merging of one piece where bytes at a word's end have ids of their own, the last before the merges: a byte that UTF-8 never has marks the end, and joins the last byte first."""
        import tiktoken

        suffix, vocab = model.get("end_of_word_suffix"), model["vocab"]
        back = {letter: byte for byte, letter in self.letters.items()}
        order = [vocab["".join(x if isinstance(x, list) else x.split(" "))] for x in model["merges"]]
        ends = sorted(vocab.get(letter + (suffix or ""), -1) for letter in back)
        if not suffix or model.get("continuing_subword_prefix") or order != list(range(512, 512 + len(order))) or sorted(map(vocab.get, back)) != list(range(256)) or ends != list(range(256, 512)):
            return None
        ranks = {bytes(map(back.get, token.removesuffix(suffix))) + END * token.endswith(suffix): i for token, i in vocab.items() if i < 512 + len(order)}
        return tiktoken.Encoding("ended", pat_str=UNSPACED, mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def plain(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids)

    def piece(self, text: str) -> bytes:
        if (ids := self.pieces.get(text)) is None:
            if self.ended:
                ids = array("I", self.ended(text.encode() + END)).tobytes()
            else:
                spelled = text.encode().decode("latin1").translate(self.letters)
                ids = b"".join(t.id.to_bytes(4, "little") for t in self.merge(spelled))
            if len(self.pieces) < KEEP:
                self.pieces[text] = ids
        return ids

    def chunk(self, text: str, kept: dict[str, bytes], lead: str) -> bytes:
        if max(text, default=" ") >= PLAIN:
            ids = self.plain(lead + text if self.spaced else text)
        elif self.ranked:
            ids = array("I", self.ranked(lead + text)).tobytes()
        elif self.spaced:
            ids = b"".join(map(self.piece, self.find(lead + text)))
        else:
            low = text.lower()
            ids = self.piece(low) if low.isalpha() else b"".join(map(self.piece, self.find(low)))
        if len(kept) < KEEP and len(text) < 64:
            kept[text] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not (self.spaced or self.unspaced) or self.marked(text):  # a text may spell an added token, which the library finds first
            return self.plain(text)
        first, *rest = text.split(" ")
        known = list(map(self.chunks.get, rest))
        out = [self.firsts.get(first) or self.chunk(first, self.firsts, "")] if first else []
        if self.spaced and (self._runs(first) or None in known and any(map(self._runs, rest)) or rest and not rest[-1] or not first and rest):
            return self.plain(text)
        if None in known:
            known = [self.chunk(c, self.chunks, " ") if k is None else k for c, k in zip(rest, known, strict=True)]
        return b"".join(out + known)

    @staticmethod
    def _runs(chunk: str) -> bool:
        """Whether the chunk makes a run of white space with the space beside it; then it's never kept."""
        return not chunk or chunk[0].isspace() or chunk[-1].isspace()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
