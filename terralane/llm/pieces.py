"""Word-level helper of the BPE operators: token ids of white-space separated pieces, each encoded once per worker."""

from __future__ import annotations

import itertools
import json
import os
import re
import unicodedata

import numpy as np

from .shingles import span_hashes, word_spans

#: Pieces kept in a worker's cache. Beyond it the older half stays: frequent pieces are met first.
CACHE_PIECES = 1_200_000
#: A longer piece is encoded each time.
CACHE_BYTES = 64


def _latin(kind: str) -> str:
    """The characters below U+0250 of a Unicode category, escaped for a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c)).startswith(kind))


#: The tokenizer file's own pattern (fixed value), with the letters and numbers below U+0250 written out.
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_latin('L')}]+|[{_latin('N')}]|[^{_latin('L')}{_latin('N')}]+")
#: Pieces that normalisation only lower-cases, letter by letter: no white space, no combining marks, no dotted capital I.
PLAIN = re.compile("[^\x85\xa0\u0130\u0250-\U0010ffff]*")
WORD_END = "</w>"
#: What the file must say for pieces to stand alone (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": WORD_END, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


class PieceEncoder:
    """Ids (little-endian unsigned 32-bit) of pieces between ASCII white space.

    White space ends every token of this tokenizer and takes no part in normalisation, so the ids of a text are those
    of its pieces in order. Pieces of Latin letters are lower-cased and cut here; others go through the library's
    normaliser and pre-tokenizer. The library's BPE then encodes all new words at once.
    """

    def __init__(self, path: str, most: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        with open(path) as f:
            spec = json.load(f)
        if not self.supported(spec):
            raise ValueError(f"{path}: only a byte-level BPE whose tokens end at white space, with an end of word and without a decoder, is encoded by pieces")
        self.special = [x["content"] for x in spec["added_tokens"]]
        size = self.full.get_vocab_size()
        names = [self.full.id_to_token(i) for i in range(size)]
        self.tokens = [x.encode() for x in names]
        self.ends = np.array([x.endswith(WORD_END) for x in names])
        # the names that the byte-level vocabulary gives to bytes: printable ones their own, the others those from U+0100 on
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.byte_names = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
        self.most = most
        self.cache: dict[bytes, bytes] = {}

    @staticmethod
    def supported(spec: dict) -> bool:
        same = spec.get("normalizer") == NORMALIZER and spec.get("pre_tokenizer") == PRE_TOKENIZER and spec.get("decoder") is None and spec.get("post_processor") is None
        model = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")} == MODEL
        # an added token with white space in it would stand in no piece
        added = all({k: x.get(k) for k in ADDED} == ADDED and x["content"] and not re.search(r"\s", x["content"]) for x in spec["added_tokens"])
        return same and model and added

    def words(self, piece: str) -> list[str] | None:
        """The pre-tokens of a piece, or None where only the whole library gives them."""
        if any(s in piece for s in self.special):
            return None
        if PLAIN.fullmatch(piece):
            found = WORDS.findall(piece.lower())
            return found if piece.isascii() else [w.encode().decode("latin-1").translate(self.byte_names) for w in found]
        return [w for w, _ in self.full.pre_tokenizer.pre_tokenize_str(self.full.normalizer.normalize_str(piece))]

    def learn(self, pieces: set[bytes]) -> None:
        """Put the ids of all the pieces into the cache."""
        new = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(new) > self.most:
            self.cache = dict(itertools.islice(self.cache.items(), self.most // 2))
            new = [p for p in pieces if p not in self.cache]
        cut = [self.words(p.decode()) for p in new]
        flat = [w for ws in cut if ws for w in ws]
        lines = [" ".join(flat[i : i + 256]) for i in range(0, len(flat), 256)]
        ids = np.array([i for e in self.bare.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        sound = len(ends) == len(flat)  # one end for each word, else word by word through the library
        raw, at = ids.tobytes(), 0
        bounds = [0, *(ends * 4).tolist()]
        for p, ws in zip(new, cut, strict=True):
            if ws is None or not sound:
                self.cache[p] = np.array(self.full.encode(p.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            else:
                self.cache[p] = raw[bounds[at] : bounds[at + len(ws)]]
            at += len(ws or ())

    def forget_long(self, pieces: set[bytes]) -> None:
        for p in pieces:
            if len(p) > CACHE_BYTES:
                self.cache.pop(p, None)

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """The ids of whole texts: each distinct piece of them is looked up once, and its ids are put to all its places."""
        joined, start, end, first = word_spans(texts)
        _, at, place = np.unique(span_hashes(joined, start, end), return_index=True, return_inverse=True)
        pieces = [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
        self.learn(set(pieces))
        found = list(map(self.cache.__getitem__, pieces))
        self.forget_long(set(pieces))
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        n = sizes[place]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[place] - ends[:-1], n)]
        cut = ends[first].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cut, cut[1:])]

    def decode(self, ids: bytes) -> bytes:
        """As decode(ids, skip_special_tokens=False): this tokenizer has no decoder, so tokens are joined by a space."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, most: int = CACHE_PIECES) -> PieceEncoder:
    """The worker's encoder for a tokenizer file, with a cache of `most` pieces."""
    if (path, most) not in _encoders:
        _encoders[path, most] = PieceEncoder(path, most)
    return _encoders[path, most]


def slices(sizes: list[int], most: int = 1 << 21):
    """(start, end) of runs of texts that hold about `most` bytes together; a longer text is a run of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)
