"""Fast use of a ``tokenizers`` byte-level BPE file: a text is cut where the pre-tokeniser
always cuts, and each distinct piece is encoded once per Python worker, by the library.

A byte-level pre-tokeniser ends a run of letters at any other character, and starts
a new piece at a letter (with the single space before it) unless an apostrophe
stands there; nothing before a cut changes what follows. So the ids of a text are
the ids of its pieces in order. This needs to know which characters are letters and
which are white space: texts with others than visible ASCII, Latin letters and the six
ASCII white-space characters are cut only at a space between two of the former.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np

#: Pieces that stay cached in a worker, and those learnt later, which are dropped together
#: (memory bounds, not limits on input).
STAY, PASSING = 450_000, 100_000

_L = "A-Za-zÀ-ÖØ-öø-ɏ"
_OTHER = re.compile(rf"[^\t-\r -~{_L}]")
# The last of several white-space characters before a letter is a token of its own.
_PIECES = re.compile(rf" ?[{_L}]+|[^{_L}]+?(?:(?<=')[{_L}]+|(?=[\t-\r ]?[{_L}])|\Z)")
_CUT = re.compile(rf"(?<=[!-~{_L}])(?= [!-~{_L}])")
#: The string of the vocabulary's special token; texts that hold it are cut at spaces only.
_SPECIAL = "<|"
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The character that stands for each byte in a byte-level vocabulary: itself if visible, else one from 256 on.
_BYTES = {b: b if b in _SEEN else 256 + b - sum(x < b for x in _SEEN) for b in range(256)}


class _Pieces(dict):
    """Piece -> its ids as bytes; a missing piece is encoded when it is asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        # a run of letters is one pre-token already, so the splitting pattern needs no second look
        self.run = Tokenizer.from_file(path)
        self.run.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.run.model._resize_cache(0)
        # the model alone says the same if nothing else looks at letters
        plain = self.run.normalizer is None and not any(t.content.strip().isalpha() for t in self.run.get_added_tokens_decoder().values())
        self.tokenize = self.run.model.tokenize if plain else None
        self.passing: list[str] = []

    def __missing__(self, piece: str) -> bytes:
        if (piece[1:] if piece[0] == " " else piece).isalpha():  # letters, with or without a space before them
            if self.tokenize:
                known = piece.replace(" ", "Ġ") if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
                ids = [t.id for t in self.tokenize(known)]
            else:
                ids = self.run.encode_batch_fast([piece], add_special_tokens=False)[0].ids
        else:
            ids = self.whole.encode(piece, add_special_tokens=False).ids
        out = self[piece] = array("I", ids).tobytes()
        if len(self) > STAY:
            self.passing.append(piece)
            if len(self.passing) > PASSING:
                for p in self.passing:
                    del self[p]
                self.passing = []
        return out


class PieceEncoder:
    """``encode(texts)`` gives a uint32 array per text, equal to the library's own ids."""

    def __init__(self, path: str):
        self.pieces = _Pieces(path)
        self.tokenizer = self.pieces.whole

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        get, out = self.pieces.__getitem__, []
        for t in texts:
            cut = _CUT.split(t) if _SPECIAL in t or _OTHER.search(t) else _PIECES.findall(t)
            out.append(np.frombuffer(b"".join(map(get, cut)), dtype="<u4"))
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return PieceEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
